"""Operator 8: tool calls of conversations, linked, ordered, validated, in canonical JSON.  DataFrame functions only.

* Linking: calls and results are joined by (conversation, identifier).  Several calls of one identifier: the first by turn
  (then arguments) stands, the others are ``duplicate``; several results: the first by turn (then content).
* Order: a call may name the call whose result it builds on (``after``; if it needs several, the latest).  ``depth`` is the length
  of that chain, found by pointer doubling in about log2(longest chain) rounds; (depth, turn, identifier) is a topological
  order.  An unknown predecessor counts as none; calls on or behind a cycle have depth -1 and status ``cycle``.
* Arguments: JSON text is parsed and held against the tool's schema: parameter -> (type, required, least), type one of string, integer, number,
  boolean, object, array; ``least`` is the least length of a string or the least number, or None.  ``problems`` lists missing, mistyped, too small and
  unknown parameters in order of their names; text that is no JSON object gives ``not an object``, an unknown tool ``unknown tool``.
* ``json``: identifier, tool, arguments and result with sorted keys and no blanks; arguments that don't parse stay text.

Nulls: a call without identifier, or a null conversation, links with nothing and is its own row; a null result content counts as an empty text.  Results
without a call are left out (``orphans`` returns them).  Extra columns are ignored.

Scale.  Joins on (conversation, identifier), unique on the side that is looked up, so a hot conversation spreads over tasks; no window
or list per conversation.  The schemas are a parameter and become part of the expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.store import materialise

TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}
MAX_ROUNDS = 62

#: parameter -> (type, required, least) of the tools that the query derives from a plain conversation.
CHAT_TOOLS = {
    "reply": {"text": ("string", True, 1), "turn": ("integer", True, 0)},
    "configure": {"text": ("string", True, 1), "turn": ("integer", True, 0)},
}


def _problems(name: Column, arguments: Column, schemas: dict) -> Column:
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    keys = F.json_object_keys(arguments)
    known = F.lit(False)
    found = F.array().cast("array<string>")
    for tool, parameters in sorted(schemas.items()):
        checks = []
        for p, (kind, required, least) in sorted(parameters.items()):
            path = "$['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']"
            part = F.try_variant_get(value, path, "variant")
            type_ = F.regexp_extract(F.schema_of_variant(part), "^[A-Z]+", 0)
            absent = part.isNull() | (type_ == "VOID")
            right = type_.rlike(f"^({TYPES[kind]})$")
            check = F.when(absent, F.lit(f"missing {p}") if required else F.lit(None)).when(~right, F.lit(f"{p} is no {kind}"))
            if least is not None:
                size = F.length(F.try_variant_get(value, path, "string")) if kind == "string" else F.try_variant_get(value, path, "double")
                check = check.when(size < least, F.lit(f"{p} below {least}"))
            checks.append(check)
        strange = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(p) for p in parameters]).cast("array<string>"))), lambda k: F.concat(F.lit("unknown "), k))
        found = F.when(name == tool, F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), F.coalesce(strange, F.array().cast("array<string>")))).otherwise(found)
        known = known | (name == tool)
    return F.when(~F.coalesce(known, F.lit(False)), F.array(F.lit("unknown tool"))).when(~is_object, F.array(F.lit("not an object"))).otherwise(found)


def _quoted(text: Column) -> Column:
    """A JSON string of a text."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), "(?s)^\\{\"t\":(.*)\\}$", 1)


def depths(calls: DataFrame) -> DataFrame:
    """(conv, id, depth) of calls (conv, id, after): steps to the start of the chain, -1 on or behind a cycle."""
    known = calls.select("conv", "id")
    start = calls.alias("c").join(known.select(F.col("conv").alias("pc"), F.col("id").alias("pi")), (F.col("conv") == F.col("pc")) & (F.col("after") == F.col("pi")), "left")
    now = materialise(start.select("conv", "id", F.col("pi").alias("to"), F.when(F.col("pi").isNull(), 0).otherwise(1).cast("long").alias("depth")), "depths")
    rounds = 0
    while now.filter("to is not null").limit(1).count():
        ahead = now.select(F.col("conv").alias("pc"), F.col("id").alias("pi"), F.col("to").alias("next"), F.col("depth").alias("more"))
        now = materialise(now.join(ahead, (F.col("conv") == F.col("pc")) & (F.col("to") == F.col("pi")), "left").select(
            "conv", "id", F.col("next").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths")
        rounds += 1
        if rounds == 1:
            longest = calls.count()
        if 2 ** rounds > longest or rounds >= MAX_ROUNDS:  # only cycles are left
            break
    return now.select("conv", "id", F.when(F.col("to").isNull(), F.col("depth")).otherwise(-1).alias("depth"))


def _first(df: DataFrame, *order: str) -> DataFrame:
    """The first row of each (conv, id)."""
    rest = [c for c in df.columns if c not in ("conv", "id")]
    return df.groupBy("conv", "id").agg(F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])).alias("r")).select("conv", "id", "r.*")


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """``calls``: conv, turn, id, tool, arguments, after; ``results``: conv, turn, id, content.  One row per call: conv, turn, id, tool,
    depth, status (ok, invalid, unanswered, duplicate, cycle), problems, json.  Invalid goes before unanswered."""
    calls = calls.select("conv", "turn", "id", "tool", "arguments", "after")
    usable = F.col("id").isNotNull() & F.col("conv").isNotNull()
    # equal calls share turn, tool, arguments: one of them stands, found by a count, the rest are duplicates
    same = calls.filter(usable).groupBy("conv", "turn", "id", "tool", "arguments", "after").agg(F.count(F.lit(1)).alias("copies"))
    first = _first(same, "turn", "arguments", "tool", "after", "copies")
    others = same.join(first.select(*[F.col(c).alias("f_" + c) for c in ("conv", "id", "turn", "arguments", "tool", "after")]),
                       (F.col("conv") == F.col("f_conv")) & (F.col("id") == F.col("f_id")), "left")
    stands = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("f_" + c)) for c in ("turn", "arguments", "tool", "after")])
    spread = others.withColumn("stands", stands).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "conv", "turn", "id", "tool", "arguments", (F.col("stands") & (F.col("copy") == 1)).alias("stands"))
    apart = calls.filter(~usable).select("conv", "turn", "id", "tool", "arguments", F.lit(True).alias("stands"))
    answers = _first(results.filter(usable).select("conv", "turn", "id", F.coalesce("content", F.lit("")).alias("content")), "turn", "content").select(
        F.col("conv").alias("r_conv"), F.col("id").alias("r_id"), "content")
    levels = depths(first.select("conv", "id", "after")).select(F.col("conv").alias("d_conv"), F.col("id").alias("d_id"), "depth")
    joined = (spread.unionByName(apart).join(answers, (F.col("conv") == F.col("r_conv")) & (F.col("id") == F.col("r_id")), "left")
              .join(levels, (F.col("conv") == F.col("d_conv")) & (F.col("id") == F.col("d_id")), "left"))
    value = F.try_parse_json("arguments")
    plain = F.when(value.isNull(), F.coalesce(_quoted(F.col("arguments")), F.lit("null"))).otherwise(F.to_json(value))

    def text(c):
        return F.when(F.col(c).isNull(), F.lit("null")).otherwise(_quoted(F.col(c)))

    out = joined.withColumn("problems", _problems(F.col("tool"), F.col("arguments"), schemas))
    status = (F.when(~F.col("stands"), "duplicate").when(F.col("depth") < 0, "cycle").when(F.size("problems") > 0, "invalid").when(F.col("content").isNull(), "unanswered").otherwise("ok"))
    return out.select("conv", "turn", "id", "tool", F.coalesce("depth", F.lit(0)).alias("depth"), status.alias("status"), F.concat_ws("; ", "problems").alias("problems"),
                      F.concat(F.lit('{"arguments":'), plain, F.lit(',"id":'), text("id"), F.lit(',"result":'), text("content"), F.lit(',"tool":'), text("tool"), F.lit("}")).alias("json"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose (conversation, identifier) no call has."""
    return results.join(calls.select("conv", "id").distinct(), ["conv", "id"], "left_anti")


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a plain conversation (conv_id, turn, role, text): a user turn calls ``reply``, a system turn ``configure``, with
    its text and turn as arguments; the assistant turn right after it is the result.  A call builds on the call two turns back, the one right
    before it if that is a system turn."""
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))

    def name(turn):
        return F.concat(F.lit("call-"), turn.cast("string"))

    asked = rows.filter(F.col("role").isin("user", "system"))
    before = asked.filter("role = 'system'").select(F.col("conv").alias("s_conv"), (F.col("turn") + 1).alias("s_turn")).distinct()
    calls = asked.join(before, (F.col("conv") == F.col("s_conv")) & (F.col("turn") == F.col("s_turn")), "left").select(
        "conv", "turn", name(F.col("turn")).alias("id"), F.when(F.col("role") == "user", "reply").otherwise("configure").alias("tool"),
        F.to_json(F.struct("turn", "text")).alias("arguments"), name(F.col("turn") - F.when(F.col("s_turn").isNotNull(), 1).otherwise(2)).alias("after"))
    results = rows.filter("role = 'assistant'").select("conv", "turn", name(F.col("turn") - 1).alias("id"), F.col("text").alias("content"))
    return calls, results


def op8_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link(calls, results, CHAT_TOOLS).withColumnRenamed("conv", "conv_id")


OP8_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT a.conv_id, a.turn, a.role, a.text, CASE WHEN s.turn IS NOT NULL THEN a.turn - 1 ELSE a.turn - 2 END AS after
      FROM t a LEFT JOIN t s ON s.conv_id = a.conv_id AND s.turn = a.turn - 1 AND s.role = 'system' WHERE a.role IN ('user', 'system')),
d AS (SELECT conv_id, turn, 0 AS depth FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.after)
      UNION ALL SELECT c.conv_id, c.turn, d.depth + 1 FROM c JOIN d ON c.conv_id = d.conv_id AND c.after = d.turn)
SELECT c.conv_id, c.turn, 'call-' || c.turn AS id, CASE WHEN c.role = 'user' THEN 'reply' ELSE 'configure' END AS tool, d.depth,
  CASE WHEN c.text = '' THEN 'invalid' WHEN r.text IS NULL THEN 'unanswered' ELSE 'ok' END AS status, CASE WHEN c.text = '' THEN 'text below 1' ELSE '' END AS problems,
  '{"arguments":{"text":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn || '},"id":"call-' || c.turn || '","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null')
  || ',"tool":"' || CASE WHEN c.role = 'user' THEN 'reply' ELSE 'configure' END || '"}' AS json
FROM c JOIN d USING (conv_id, turn) LEFT JOIN t r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant'
"""
