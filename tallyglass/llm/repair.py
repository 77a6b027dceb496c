"""Operator 12: cheapest repair of conversation structure by an auction shortest-path algorithm.

Rows of a conversation go by turn (nulls first; rows of one turn by a hash of role and text).  The first of these faults counts: blank (no
character but white space), duplicate (role and text seen earlier), truncated (the last character is no full stop, ! or ?).  A repair
keeps (0), re-roles to user or assistant (2) or deletes (3, required for blank and duplicate rows) every row and inserts empty user
or assistant rows anywhere (2 each); an undeleted truncated row adds 1.  The role initials that are left must match (s?(ua)+)?.

The edits are arcs of a lattice: a node is the number of rows read and the state of the pattern (nothing, s, u, a).  Node prices start at
zero or the least price of the row behind, so price(i) <= cost(i, j) + price(j) for every arc, and equal along the path.  A path grows from its origin: at its end the
cheapest arc + price is sought; if the price is below it, the price rises to it and the path contracts by a node, else it extends by
that arc.  Origins are taken from the last row backward, and a path that meets a node settled by an earlier one ends
there, as its way on is known; so prices of all nodes end as exact distances.  The arcs whose cost is the difference of their prices
are tight; following from the start the tight arc of the least letter (D, I, K, R) gives the cheapest edits that are first in ASCII order.

Nulls: a null role or text is one space, so such a text is blank; a null key is a conversation of its own; null turns come first and don't
count in ``gaps``.  Repeated rows are duplicates.  A conversation without rows has zeros, no edits and the hash of the empty text.
Extra columns are ignored.

Scale.  Row numbers come from ranges of turns inside a conversation, first occurrences from a combined minimum.  A conversation is cut into
blocks of ``BLOCK`` rows: for each, the distances between its four entry and four exit states are auctioned apart, then
distances to the end run backward over the blocks; only conversations of several blocks need that.  The last step streams the rows of
a conversation in order, with one block in memory: a hash of the whole repaired text can only be taken in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.exprs import q
from ..functions.sequences import row_index
from ..functions.store import materialise

BLOCK = 1024
FAR = 1 << 40
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}
#: States of the pattern: nothing yet, after s, after u, after a; the state after each initial that may come, and after one put in.
NOTHING, S, U, A = range(4)
NEXT = {NOTHING: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
PUT = {NOTHING: U, S: U, U: A, A: U}
ACCEPTS = (NOTHING, A)
ROLE = {U: "user", A: "assistant"}


def arcs(initial: str, fault: int) -> list[list[tuple[str, int, int, int]]]:
    """Per state the arcs (letter, cost, rows read, state) of a row, in the order of their letters."""
    out = []
    for state in range(4):
        own = [("D", DELETE, 1, state), ("I", INSERT, 0, PUT[state])]
        if fault not in (BLANK, DUPLICATE):
            more = UNFINISHED if fault == TRUNCATED else 0
            if initial in NEXT[state]:
                own.append(("K", KEEP + more, 1, NEXT[state][initial]))
            own.append(("R", REROLE + more, 1, PUT[state]))
        out.append(own)
    return out


_arcs: dict[tuple[str, int], list] = {}


class Lattice:
    """Rows of one block; ``ahead``: distances from the four states behind it to the end, None for the last block."""

    def __init__(self, initials: list[str], faults: list[int], ahead: list[int] | None):
        self.size = len(initials)
        self.rows = []
        for key in zip(initials, faults):
            if key not in _arcs:
                if len(_arcs) > 10_000:
                    _arcs.clear()
                _arcs[key] = arcs(*key)
            self.rows.append(_arcs[key])
        self.price = [0] * (4 * self.size + 5)  # the last node is the end
        self.end = 4 * self.size + 4
        if ahead is None:  # an accepting state may stop, any may insert
            self.rows.append([[("", 0, 1, NOTHING)] * (s in ACCEPTS) + [("I", INSERT, 0, PUT[s])] for s in range(4)])
        else:
            self.price[4 * self.size:self.end] = ahead
        nodes = 4 * len(self.rows)
        self.settled = bytearray(nodes) + b"\1" * (len(self.price) - nodes)
        for row in range(nodes - 4, -1, -4):
            if row + 8 <= len(self.price):  # as every way goes on to the row behind, prices may start at the least there
                self.price[row:row + 4] = [min(self.price[row + 4:row + 8])] * 4
            for origin in range(row + 3, row - 1, -1):
                if not self.settled[origin]:
                    self.auction(origin)

    def auction(self, origin: int) -> None:
        price, settled, rows = self.price, self.settled, self.rows
        path = [origin]
        while True:
            at, state = divmod(path[-1], 4)
            best, to = min((cost + price[4 * (at + read) + after], 4 * (at + read) + after) for _, cost, read, after in rows[at][state])
            if price[path[-1]] < best:
                price[path[-1]] = best
                if len(path) > 1:
                    path.pop()
            elif settled[to]:
                for node in path:
                    settled[node] = 1
                return
            else:
                path.append(to)

    def trace(self, state: int) -> tuple[list[str], int]:
        """Letters of the edits from ``state``, one text per row and one for those after the last row, and the state behind."""
        out, now, at = [], "", 0
        while True:
            if at == self.size and len(self.rows) == self.size:
                return out + [now], state
            here = self.price[4 * at + state]
            letter, read, state = next((letter, read, after) for letter, cost, read, after in self.rows[at][state] if cost + self.price[4 * (at + read) + after] == here)
            if not letter:
                return out + [now], state
            now += letter
            if read:
                out.append(now)
                now = ""
                at += 1


def _reach(initials: list[str], faults: list[int], last: bool) -> list[int]:
    """Distances from the four states before a block to the four behind it, row by row; of the last block to the end.

    To u and a the inserts that lead there from other states may come right behind the block.  Only deletions lead to nothing, and one kept s to s."""
    if last:
        return Lattice(initials, faults, None).price[:4]
    whole = DELETE * len(initials)
    kept = [KEEP + UNFINISHED * (f == TRUNCATED) for i, f in zip(initials, faults) if i == "s" and f not in (BLANK, DUPLICATE)]
    to = [[whole, FAR, FAR, FAR], [whole - DELETE + min(kept) if kept else FAR, whole, FAR, FAR],
          Lattice(initials, faults, [INSERT, INSERT, 0, INSERT]).price[:4], Lattice(initials, faults, [2 * INSERT, 2 * INSERT, INSERT, 0]).price[:4]]
    return [to[b][a] for a in range(4) for b in range(4)]


def damage(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, turn, role and text with faults put in by the crc32 of ``key:turn``: of 20 remainders 0 drops the row, 1 empties its text,
    2 removes its [.!?], 3 repeats it, 4 makes its role user.  Nulls are one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(q(key).cast("string"), space), F.lit(":"), F.coalesce(q(turn).cast("string"), space))
    base = turns.select(q(key).alias(key), q(turn).alias(turn), F.coalesce(q(role), space).alias(role), F.coalesce(q(text), space).alias(text), (F.crc32(name.cast("binary")) % 20).alias("_part"))
    part = F.col("_part")
    lines = F.when(part == 1, F.lit("")).when(part == 2, F.regexp_replace(q(text), "[.!?]", "")).otherwise(q(text))
    copies = F.when(part == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.filter(part != 0).select(q(key), q(turn), F.when(part == 4, F.lit("user")).otherwise(q(role)).alias(role), lines.alias(text), F.explode(copies).alias("_copy")).drop("_copy")


def _numbered(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """g (the key as text), turn, role, text, pos of every row, its initial and what the row alone shows of its faults."""
    space, blanks = F.lit(" "), r"\x20\x09-\x0D"
    rows = turns.select(_group(key).alias("g"), q(turn).cast("long").alias("turn"), F.coalesce(q(role), space).alias("role"), F.coalesce(q(text), space).alias("text"))
    rows = rows.withColumn("_o", F.coalesce(F.col("turn").cast("double"), F.lit(float("-inf")))).withColumn("_h", F.xxhash64("role", "text"))
    rows = row_index(rows, ["_o", "_h", "turn", "role", "text"], ["g"], "pos").drop("_o", "_h")
    return rows.select("g", "pos", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(f"[^{blanks}]")).alias("blank"),
                       (~F.col("text").rlike(f"[.!?][{blanks}]*\\z")).alias("cut"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("same"))


def _group(key: str):
    return F.coalesce(F.concat(F.lit("v"), q(key).cast("string")), F.lit("n"))


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(g, block, initials, faults, turns): the rows of every block in order, without their texts."""
    first = rows.groupBy("g", "same").agg(F.min("pos").alias("first"))
    light = rows.select("g", "pos", "turn", "initial", "blank", "cut", "same").join(first, ["g", "same"])
    fault = F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(OK)
    each = F.sort_array(F.collect_list(F.struct("pos", "initial", fault.alias("fault"), "turn")))
    return light.groupBy("g", F.floor(F.col("pos") / block).alias("block")).agg(each.alias("rows")).select(
        "g", "block", F.col("rows.initial").alias("initials"), F.col("rows.fault").alias("faults"), F.col("rows.turn").alias("turns"))


def _distances(batches):
    for batch in batches:
        ways = [_reach(i, f, end) for i, f, end in zip(*(batch.column(c).to_pylist() for c in ("initials", "faults", "last")))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ways, pa.list_(pa.int64()))], ["g", "block", "ways"])


def _backward(batches):
    """Over the blocks of a conversation from its last: the distances from behind each block to the end."""
    of, ahead = None, None
    for batch in batches:
        out = []
        for g, ways in zip(batch.column("g").to_pylist(), batch.column("ways").to_pylist()):
            if g != of:
                of, ahead = g, None
            out.append(ahead)
            ahead = ways if len(ways) == 4 else [min(FAR, min(ways[4 * a + b] + ahead[b] for b in range(4))) for a in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("block"), pa.array(out, pa.list_(pa.int64()))], ["g", "block", "ahead"])


def _ahead(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``ahead``, null for the last block of a conversation."""
    none = F.lit(None).cast("array<long>")
    many = blocks.groupBy("g").agg(F.max("block").alias("end")).filter("end > 0")
    if not many.limit(1).count():
        return blocks.withColumn("ahead", none)
    long = blocks.join(many, "g").withColumn("last", F.col("block") == F.col("end"))
    ways = long.repartition("g", "block").select("g", "block", "initials", "faults", "last").mapInArrow(_distances, "g string, block long, ways array<long>")
    back = ways.repartition("g").sortWithinPartitions("g", F.desc("block")).mapInArrow(_backward, "g string, block long, ahead array<long>")
    return blocks.join(back, ["g", "block"], "left")


class _Conversation:
    """What a stream over one conversation keeps: counts, the state between blocks, the running hash; no texts."""

    def __init__(self):
        self.counts, self.illegal, self.turns = [0] * 4, 0, [None, None, 0]
        self.previous, self.state, self.cost, self.audit, self.pieces = None, NOTHING, None, [], []
        self.written, self.put, self.hash, self.tail = 0, NOTHING, hashlib.sha256(), ""

    def block(self, initials, faults, turns, ahead):
        for initial, fault, turn in zip(initials, faults, turns):
            self.counts[fault] += 1
            if self.previous is not None and self.previous + initial not in LEGAL:
                self.illegal += 1
            self.previous = initial
            if turn is not None:
                low, high, n = self.turns
                self.turns = [turn if low is None else low, turn, n + (turn != high)]
        lattice = Lattice(initials, faults, ahead)
        if self.cost is None:
            self.cost = lattice.price[self.state]
        pieces, self.state = lattice.trace(self.state)
        self.pieces, self.tail = pieces[:-1][::-1], pieces[-1]
        self.audit.extend(pieces)

    def inserted(self, letters):
        """Lines of the inserts among ``letters``."""
        out = []
        for _ in range(letters.count("I")):
            self.put = PUT[self.put]
            out.append(("I", ROLE[self.put], ""))
        return out

    def row(self, initial, role, text):
        """Lines that the repair writes up to this row."""
        letters = self.pieces.pop()
        out = self.inserted(letters)
        if letters[-1] == "K":
            self.put = NEXT[self.put][initial]
            out.append(("K", role, text))
        elif letters[-1] == "R":
            self.put = PUT[self.put]
            out.append(("R", ROLE[self.put], text))
        if not self.pieces:
            out += self.inserted(self.tail)
        return out

    def write(self, lines):
        for _, role, text in lines:
            self.hash.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
            self.written += 1

    def result(self):
        low, high, n = self.turns
        return [0 if low is None else high - low + 1 - n, *self.counts[1:], self.illegal, self.cost or 0, "".join(self.audit), self.hash.hexdigest()]


def _stream(rows_out: bool, schema):
    """Conversations in order, the record of a block before its rows; gives one row per conversation, or the repaired rows."""
    names = schema.names

    def run(batches):
        of, now, out = None, None, []
        columns = ["g", "initials", "faults", "turns", "ahead", "pos", "initial", "role", "text", "kind"]
        for batch in batches:
            for g, initials, faults, turns, ahead, _, initial, role, text, kind in zip(*(batch.column(c).to_pylist() for c in columns)):
                if g != of:
                    if of is not None and not rows_out:
                        out.append([of, *now.result()])
                    of, now, n = g, _Conversation(), 0
                if kind == 1:
                    now.block(initials, faults, turns, ahead)
                lines = now.row(initial, role, text) if kind == 2 else []
                if rows_out:
                    out.extend([g, n + k, *line] for k, line in enumerate(lines))
                    n += len(lines)
                else:
                    now.write(lines)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], names)
                out = []
        if of is not None and not rows_out:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([of, *now.result()], schema)], names)

    return run


SUMMARY = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
LINES = [("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]


def _streamed(turns: DataFrame, conversations: DataFrame, key: str, turn: str, role: str, text: str, block: int, fields, rows_out: bool) -> DataFrame:
    rows = materialise(_numbered(turns, key, turn, role, text), "turns")
    blocks = _ahead(materialise(_blocks(rows, block), "blocks"))
    keys = conversations.select(_group(key).alias("g")).distinct()
    every = (keys.withColumn("block", F.lit(-1).cast("long")).withColumn("kind", F.lit(0))
             .unionByName(blocks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
             .unionByName(rows.select("g", F.floor(F.col("pos") / block).alias("block"), "pos", "initial", "role", "text", F.lit(2).alias("kind")), allowMissingColumns=True))
    schema = pa.schema([("g", pa.string()), *fields])
    spark_schema = T.StructType([T.StructField(n, T.LongType() if t == pa.int64() else T.StringType()) for n, t in zip(schema.names, schema.types)])
    out = every.repartition("g").sortWithinPartitions("g", "block", "kind", "pos").mapInArrow(_stream(rows_out, schema), spark_schema)
    named = F.when(F.col("g") != "n", F.substr("g", F.lit(2)).cast(conversations.schema[key].dataType))
    return out.select(named.alias(key), *[n for n, _ in fields])


def repair(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``conversations`` (of ``turns`` unless given): faults found, cost and letters of the cheapest edits, hash of the result."""
    return _streamed(turns, turns if conversations is None else conversations, key, turn, role, text, block, SUMMARY, False)


def repaired(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The repaired conversations: key, ``position`` from 0, ``edit`` (K, R or I), ``role`` and ``text``."""
    return _streamed(turns, turns, key, turn, role, text, block, LINES, True)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damage(turns), conversations=turns)


def _step(states: list[tuple[str, int, str]]) -> str:
    """Of (cost and letters behind, cost, letter) the first by cost, then letters."""
    return "least(" + ", ".join(f"printf('%09d', {x}[1:9]::INT + {cost}) || '{letter}' || {x}[10:]" for x, cost, letter in states) + ")"


def _sql() -> str:
    """Edits as cost and letters from every state to the end, from the last row backward; inserts are put before a row at most twice."""
    def before(name):  # inserts in front of what follows
        return f"""SELECT conv_id, pos, n, least({name}0, {_step([(name + 'U', 2, 'I')])}, {_step([(name + 'A', 4, 'II')])}) AS c0, least({name}S, {_step([(name + 'U', 2, 'I')])}, {_step([(name + 'A', 4, 'II')])}) AS cS,
      least({name}U, {_step([(name + 'A', 2, 'I')])}) AS cU, least({name}A, {_step([(name + 'U', 2, 'I')])}) AS cA"""

    far = "'900000000'"

    def row(state, kept, put):
        keep = " ".join(f"WHEN r.initial = '{i}' THEN " + _step([(f"b.c{to}", 0, "K")]).replace("+ 0)", "+ (r.fault = 3)::INT)") for i, to in kept.items())
        reroled = _step([(f"b.c{put}", 2, "R")]).replace("+ 2)", "+ 2 + (r.fault = 3)::INT)")
        return f"least({_step([(f'b.c{state}', 3, 'D')])}, CASE WHEN r.fault IN (1, 2) THEN {far} ELSE {reroled} END, CASE WHEN r.fault IN (1, 2) THEN {far} {keep} ELSE {far} END) AS r{state}"

    rows = ", ".join([row("0", {"s": "S", "u": "U"}, "U"), row("S", {"u": "U"}, "U"), row("U", {"a": "A"}, "A"), row("A", {"u": "U"}, "U")])
    return rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 20 AS part FROM t),
d AS (SELECT conv_id, turn, CASE WHEN part = 4 THEN 'user' ELSE role END AS role, CASE part WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN part = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE part <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
r AS (SELECT *, role[1] AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS previous FROM p),
b AS (SELECT conv_id, pos, n, '000000000' AS c0, '000000004II' AS cS, '000000002I' AS cU, '000000000' AS cA FROM (SELECT conv_id, n + 1 AS pos, n FROM r GROUP BY conv_id, n)
      UNION ALL
      {before('x.r')} FROM (SELECT b.conv_id, r.pos, b.n, {rows} FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos - 1) x),
e AS (SELECT conv_id, c0[1:9]::BIGINT AS cost, c0[10:] AS audit FROM b WHERE pos = 1),
l AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, len(audit) + 1)) AS i FROM e WHERE len(audit) > 0),
m AS (SELECT *, sum((letter <> 'I')::INT) OVER w AS pos, sum((letter <> 'D')::INT) OVER w AS line FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
o AS (SELECT m.*, r.role, r.text, max((line = 1 AND letter = 'K' AND r.initial = 's')::INT) OVER (PARTITION BY m.conv_id) AS s
      FROM m LEFT JOIN r ON m.letter <> 'I' AND r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.pos = m.pos),
f AS (SELECT conv_id, sha256(coalesce(string_agg(CASE letter WHEN 'K' THEN role || ':' || text ELSE CASE WHEN (line - s) % 2 = 1 THEN 'user:' ELSE 'assistant:' END
      || CASE letter WHEN 'R' THEN text ELSE '' END END, chr(10) ORDER BY i) FILTER (WHERE letter <> 'D'), '')) AS repaired_sha256 FROM o GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
      count_if(previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT k.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank, coalesce(g.duplicate, 0)::BIGINT AS duplicate, coalesce(g.truncated, 0)::BIGINT AS truncated,
       coalesce(g.illegal, 0)::BIGINT AS illegal, coalesce(e.cost, 0) AS cost, coalesce(e.audit, '') AS audit, coalesce(f.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM k.conv_id
"""


OP12_SQL = _sql()
