"""Operator 13: mixing sources to target weights by Efraimidis-Spirakis sampling.  DataFrame functions only.

* Size: the number of words, runs without ASCII white space; a null text has none.
* Targets: sources in code-point order, null last, get ``weights`` in turn and share the budget (all words, unless given) by them.  A
  target stops at ``ceiling`` times its source's size and the excess goes to the others by weight, until none is above: every target is
  min(ceiling * size, level * weight) for one common level, found by a few exact sums over the sources.
* Taken: a target of e whole source sizes and a rest takes every document e times, then fills the rest without replacement: a document
  gets the exponential key -ln(u) / quality, u a hash of its id and text, and documents go by ascending keys (a better one earlier on
  average) until their words sum up to the rest.  The document at the limit gives its first words only, so a source meets its target to
  the word.  Rows of equal key, id and text at the limit share what is left evenly, rounded down.

A null id hashes as an empty text; rows that repeat an id and text are rows of their own; an empty text has size 0 and is taken 0 times;
a source without words has target 0; an empty table gives an empty result.  Quality must be positive; null, NaN or less counts as ``LEAST``.
Extra columns are ignored by ``mix`` and kept by ``mixed``.

Scale.  Texts are read once and never shuffled; sums combine before the shuffle, so a hot source costs no task more than a row per bin.
The limit of a source is found by narrowing an interval of keys that holds it, all sources together, until few rows are left to order.
Per-source rows are broadcast while their checked size is small, else joined with hot sources held in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.exprs import q
from ..functions.keyed import attach
from ..functions.store import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CEILING = (5, 2, 1), 3
LEAST = 0.1
BINS, ORDERED_ROWS = 1024, 4_096
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_quality(text: Column, size: Column) -> Column:
    """From ``LEAST`` to 1: how near the characters per word are to those of running prose."""
    return F.when(size > 0, F.greatest(F.lit(LEAST), 1 - F.abs(F.length(text) / size - 6) / 12)).otherwise(LEAST)


def _rows(docs: DataFrame, key: str, text: str, source: str, quality, seed: int) -> DataFrame:
    """_row (all columns of ``docs``), _key, _text, _source, _size, _k (the exponential key) and _tie (a hash of id and text)."""
    given = F.lit(None).cast("double") if quality is None else quality.cast("double")
    base = docs.select(F.struct(*[q(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row"), q(key).alias("_key"), q(text).alias("_text"), q(source).alias("_source"), given.alias("_q"))
    sized = base.withColumn("_size", words(F.col("_text")))
    given = plain_quality(F.col("_text"), F.col("_size")) if quality is None else F.col("_q")
    weight = F.when((given > 0) & ~F.isnan(given), given).otherwise(LEAST)
    tie = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("_text", F.lit("")))))
    u = (F.conv(F.substring("_tie", 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return sized.withColumn("_tie", tie).withColumn("_k", -F.ln(u) / weight).drop("_q")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point, null last: ranges of the order are written, numbered each, and shifted."""
    ranged = materialise(sources.repartitionByRange(F.col("_source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    inside = Window.partitionBy("part").orderBy(F.col("_source").asc_nulls_last())
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    return ranged.join(F.broadcast(offsets), F.col("part") == F.col("p")).withColumn("rank", F.row_number().over(inside) - 1 + F.col("off")).drop("part", "p", "off")


def targets(sources: DataFrame, weights=WEIGHTS, ceiling: int = CEILING, budget: int | None = None) -> DataFrame:
    """``sources`` (_source, size) with ``weight`` and ``target`` in words."""
    ranked = _ranked(sources)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = materialise(ranked.withColumn("weight", weight).drop("rank"), "weights")
    total, whole = ranked.agg(F.sum("size"), F.sum("weight")).first()
    total = (total or 0) if budget is None else min(budget, ceiling * (total or 0))
    level, held = (total / whole if whole else 0.0), -1
    while True:  # the level only rises, and a source that is held stays held
        above = F.col("weight") * F.lit(level) > F.col("size") * ceiling
        n, kept, free = ranked.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("size") * ceiling)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if n == held or not free:
            break
        held, level = n, (total - kept) / free
    return ranked.withColumn("target", F.least((F.col("size") * ceiling).cast("double"), F.col("weight") * F.lit(level)))


def _beside(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source's row of ``state`` (_source, ...)."""
    n, size = state.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length(F.col("_source").cast("string")), F.lit(0)) + 128)).first()
    if (size or 0) > BROADCAST_BYTES:
        return attach(rows, state, ["_source"], n_keys=n)
    side = state.withColumnRenamed("_source", "_of")
    return rows.join(F.broadcast(side), rows["_source"].eqNullSafe(side["_of"])).drop("_of")


def _limits(rows: DataFrame, state: DataFrame, ordered: int) -> DataFrame:
    """(_source, limit_k, limit_tie, left, equal): the row at which the rest of a source ends, how many words are left for it and its equals, and
    how many those are.  ``state``: _source, rest, n, lo, hi of the sources with a rest; every round narrows [lo, hi]."""
    state = materialise(state.withColumn("under", F.lit(0).cast("long")), "limits")
    wide = (F.col("n") > ordered) & (F.col("lo") < F.col("hi"))
    by = Window.partitionBy("_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    while state.filter(wide).limit(1).count():
        inside = _beside(rows, state.filter(wide)).filter(F.col("_k").between(F.col("lo"), F.col("hi")))
        place = F.least(F.floor((F.col("_k") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins = inside.groupBy("_source", "rest", "under", place.alias("bin")).agg(F.sum("_size").alias("w"), F.count(F.lit(1)).alias("n"), F.min("_k").alias("lo"), F.max("_k").alias("hi"))
        upto = bins.withColumn("upto", F.col("under") + F.sum("w").over(by)).filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("w") < F.col("rest")))
        state = materialise(upto.select("_source", "rest", "n", "lo", "hi", (F.col("upto") - F.col("w")).alias("under")).unionByName(state.filter(~wide)), "limits")
    last = _beside(rows, state).filter(F.col("_k").between(F.col("lo"), F.col("hi")))
    equal = last.groupBy("_source", "rest", "under", "_k", "_tie").agg(F.sum("_size").alias("w"), F.count(F.lit(1)).alias("equal"))
    by = Window.partitionBy("_source").orderBy("_k", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    upto = equal.withColumn("upto", F.col("under") + F.sum("w").over(by)).filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("w") < F.col("rest")))
    return upto.select("_source", F.col("_k").alias("limit_k"), F.col("_tie").alias("limit_tie"), (F.col("rest") - F.col("upto") + F.col("w")).alias("left"), "equal")


def _plan(rows: DataFrame, weights, ceiling: int, budget: int | None, ordered: int) -> DataFrame:
    """One row per source: source_size, target, epochs, limit_k, limit_tie, part; of the row at the limit ``part`` words are taken."""
    sources = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("_k").alias("lo"), F.max("_k").alias("hi"))
    aimed = targets(sources, weights, ceiling, budget)
    whole = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("size") * ceiling)
    epochs = F.when(F.col("size") > 0, F.floor(whole / F.greatest("size", F.lit(1)))).otherwise(0).cast("long")
    aimed = materialise(aimed.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("size") > 0, whole - F.col("epochs") * F.col("size")).otherwise(F.lit(0)).cast("long")), "targets")
    limits = _limits(rows, aimed.filter("rest > 0").select("_source", "rest", "n", "lo", "hi"), ordered).withColumnRenamed("_source", "_of")
    out = aimed.join(limits, aimed["_source"].eqNullSafe(limits["_of"]), "left")
    return materialise(out.select("_source", F.col("size").alias("source_size"), "target", "epochs", "limit_k", "limit_tie", F.floor(F.col("left") / F.col("equal")).cast("long").alias("part")), "plan")


def _taken() -> Column:
    k, tie, limit_k, limit_tie = (F.col(c) for c in ("_k", "_tie", "limit_k", "limit_tie"))
    more = F.when(limit_k.isNull() | (k > limit_k), 0).when(k < limit_k, F.col("_size")).when(tie < limit_tie, F.col("_size")).when(tie == limit_tie, F.col("part")).otherwise(0)
    return (F.col("epochs") * F.col("_size") + more).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, weights=WEIGHTS, ceiling: int = CEILING,
        budget: int | None = None, seed: int = 0, ordered: int = ORDERED_ROWS) -> DataFrame:
    """One row per row of ``docs``: key, ``source``, ``size``, ``source_size``, ``target`` of its source, ``taken`` words with repeats counted.

    ``quality``: a positive number per row; by default ``plain_quality``.  ``budget``: words of the mix, at most ``ceiling`` times all."""
    rows = _rows(docs, key, text, source, quality, seed).select("_key", "_source", "_size", "_k", "_tie")
    rows = materialise(rows, "sizes")
    out = _beside(rows, _plan(rows, weights, ceiling, budget, ordered))
    return out.select(F.col("_key").alias(key), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", _taken().alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, weights=WEIGHTS, ceiling: int = CEILING,
          budget: int | None = None, seed: int = 0, ordered: int = ORDERED_ROWS) -> DataFrame:
    """The mix itself: the columns of ``docs`` once per copy taken, with ``copy`` from 0; a copy that is cut holds its first words, joined by blanks."""
    rows = _rows(docs, key, text, source, quality, seed)
    plan = _plan(materialise(rows.select("_source", "_size", "_k", "_tie"), "sizes"), weights, ceiling, budget, ordered)
    out = _beside(rows, plan).withColumn("_taken", _taken()).filter("_taken > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_taken") / F.col("_size")) - 1)))
    left = F.least("_size", F.col("_taken") - F.col("_copy") * F.col("_size"))
    cut = F.when(left < F.col("_size"), F.concat_ws(" ", F.slice(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")))).otherwise(F.col("_text"))
    return out.select(*[(cut if c == text else F.col(f"_row.c{i}")).alias(c) for i, c in enumerate(docs.columns) if c != "copy"], F.col("_copy").alias("copy"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
h AS (SELECT *, md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(text)) AS tie,
      CASE WHEN size > 0 THEN greatest(0.1::DOUBLE, 1 - abs(length(text)::DOUBLE / size - 6) / 12) ELSE 0.1::DOUBLE END AS quality FROM d),
k AS (SELECT *, -ln((('0x' || substr(tie, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / quality AS k FROM h),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
o AS (SELECT *, coalesce(sum(3 * source_size) OVER p, 0) AS held, coalesce(sum(weight) OVER p, 0) AS taken_weight, sum(source_size) OVER () AS total, sum(weight) OVER () AS whole
      FROM w WINDOW p AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (total - held)::DOUBLE / (whole - taken_weight)::DOUBLE AS level FROM o WHERE weight * ((total - held)::DOUBLE / (whole - taken_weight)::DOUBLE) <= 3 * source_size
      ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * level) AS target FROM w, l),
e AS (SELECT *, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS goal, CASE WHEN source_size > 0 THEN least(floor(target + 0.5)::BIGINT, 3 * source_size) // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, e.source_size, e.target, e.epochs, e.goal - e.epochs * e.source_size AS rest,
      coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY k, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
"""
