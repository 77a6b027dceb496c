"""Functional dependencies between columns of one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import collect_stats, kind, q, ratio, records, resolve
from ..functions.keyed import attach

# fixed values: settings
MIN_CONFIDENCE = 0.95
MAX_DETERMINANT_LEVELS = 1000
STRICT = 0.99
SAMPLES = 3


def _usable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind(f.dataType) != "nested"]


def determinants(df: DataFrame, cols: list[str], max_levels: int) -> list[str]:
    """Columns with at most ``max_levels`` distinct values (sketch, exact count near the limit)."""
    rough = collect_stats(df, {c: F.approx_count_distinct(q(c), 0.02) for c in cols})
    near = [c for c in cols if 0.8 * max_levels <= rough[c] <= 1.25 * max_levels]
    exact = collect_stats(df, {c: F.count_distinct(q(c)) for c in near}) if near else {}
    return [c for c in cols if exact.get(c, rough[c]) <= max_levels]


def confidences(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(determinant, dependent, n_levels, confidence): share of determinant values with exactly one
    dependent value.  "Exactly one" is min = max, so each determinant needs a single aggregation
    that combines before its shuffle, whatever the number of dependents and however hot a value."""
    out = []
    for x in dict.fromkeys(a for a, _ in pairs):
        ys = [b for a, b in pairs if a == x]
        per = df.filter(q(x).isNotNull()).groupBy(q(x)).agg(*[
            F.struct(F.min(q(y)).alias("lo"), F.max(q(y)).alias("hi")).alias(f"_{i}") for i, y in enumerate(ys)])
        rows = F.array(*[F.struct(
            F.lit(x).alias("determinant"), F.lit(y).alias("dependent"), F.count(F.col(f"_{i}.lo")).alias("n_levels"),
            ratio(F.count_if(F.col(f"_{i}.lo") == F.col(f"_{i}.hi")), F.count(F.col(f"_{i}.lo"))).alias("confidence"))
            for i, y in enumerate(ys)])
        out.append(per.agg(rows.alias("r")).select(F.inline("r")))
    return reduce(DataFrame.unionByName, out)


def find(df: DataFrame, cols: list[str] | None = None, min_confidence: float = MIN_CONFIDENCE,
         max_levels: int = MAX_DETERMINANT_LEVELS) -> DataFrame:
    """(determinant, dependent, confidence) of all ordered pairs that reach the confidence."""
    cols = _usable(df) if cols is None else resolve(df, cols)
    pairs = [(x, y) for x in determinants(df, cols, max_levels) for y in cols if x != y]
    if not pairs:
        return records(df.sparkSession, [], "determinant string, dependent string, confidence double")
    return confidences(df, pairs).filter(F.col("confidence") >= min_confidence).select(
        "determinant", "dependent", F.round("confidence", 4).alias("confidence"))


def find_typed(df: DataFrame, cols: list[str] | None = None, min_confidence: float = MIN_CONFIDENCE,
               max_levels: int = MAX_DETERMINANT_LEVELS) -> DataFrame:
    """``find`` with the type (1:1, M:1, M:1 (partial)), both cardinalities and the mean number of
    dependent values; distinct counts are made for the surviving pairs only."""
    cols = _usable(df) if cols is None else resolve(df, cols)
    pairs = [(x, y) for x in determinants(df, cols, max_levels) for y in cols if x != y]
    if not pairs:
        kept = []
    else:
        kept = confidences(df, pairs).filter(F.col("confidence") >= min_confidence).collect()  # column pairs
    rows = []
    for r in kept:
        x, y = r["determinant"], r["dependent"]
        both = df.filter(q(x).isNotNull() & q(y).isNotNull())
        rows.append(both.select(q(x).alias("x"), q(y).alias("y")).distinct().agg(
            F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("x").alias("nx"), F.count_distinct("y").alias("ny")).select(
            F.lit(x).alias("determinant"), F.lit(y).alias("dependent"), F.lit(round(r["confidence"], 4)).alias("confidence"),
            F.when(F.lit(r["confidence"] < 1.0), "M:1 (partial)").when(F.col("nx") == F.col("ny"), "1:1").otherwise("M:1").alias("type"),
            F.col("nx").alias("determinant_levels"), F.col("ny").alias("dependent_levels"),
            F.round(ratio(F.col("n_pairs"), F.col("nx")), 2).alias("mean_dependents")))
    if not rows:
        return records(df.sparkSession, [], "determinant string, dependent string, confidence double, type string, "
                                            "determinant_levels bigint, dependent_levels bigint, mean_dependents double")
    return reduce(DataFrame.unionByName, rows)


def samples(df: DataFrame, x: str, y: str, n: int = SAMPLES) -> DataFrame:
    """First ``n`` determinant values with up to three of their dependent values."""
    pairs = df.filter(q(x).isNotNull() & q(y).isNotNull()).select(q(x).alias("x"), q(y).alias("y")).distinct()
    first = pairs.select("x").distinct().orderBy("x").limit(n)
    w = Window.partitionBy("x").orderBy("y")
    few = pairs.join(F.broadcast(first), "x", "left_semi").withColumn("_r", F.row_number().over(w)).filter("_r <= 3")
    return few.groupBy("x").agg(F.concat_ws(",", F.sort_array(F.collect_list(F.col("y").cast("string")))).alias("y")).select(
        F.lit(x).alias("determinant"), F.lit(y).alias("dependent"), F.col("x").cast("string").alias("value"), F.col("y").alias("maps_to"))


def graph(fds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, totals) of the dependency graph."""
    ends = fds.select(F.explode(F.array(
        F.struct(F.col("determinant").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dependent").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    nodes = ends.groupBy("id").agg(F.sum("o").alias("as_determinant"), F.sum("i").alias("as_dependent"))
    edges = fds.select(F.col("determinant").alias("source"), F.col("dependent").alias("target"), "confidence")
    totals = fds.agg(F.count(F.lit(1)).alias("total_dependencies"), F.count_if(F.col("confidence") == 1.0).alias("strict_dependencies")
                     ).withColumn("_k", F.lit(1)).join(nodes.agg(F.count(F.lit(1)).alias("columns_involved")).withColumn("_k", F.lit(1)), "_k").drop("_k")
    return nodes, edges, totals


def validate(fds: DataFrame, other: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Are the dependencies preserved in another table?"""
    known = [(r["determinant"], r["dependent"], r["confidence"]) for r in fds.collect()]  # column pairs
    here = [(a, b) for a, b, _ in known if a in other.columns and b in other.columns]
    seen = {}
    if here:
        seen = {(r["determinant"], r["dependent"]): r["confidence"] for r in confidences(other, here).collect()}
    rows = []
    for a, b, c in known:
        if (a, b) not in here:
            rows.append((a, b, "MISSING_COLUMNS", c, 0.0, None))
        else:
            now = seen.get((a, b)) or 0.0
            rows.append((a, b, "PRESERVED" if now >= min_confidence else "VIOLATED", c, now, round(c - now, 4)))
    return records(other.sparkSession, rows, "determinant string, dependent string, status string, confidence double, "
                                             "other_confidence double, confidence_drop double")


def preservation_rate(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "PRESERVED").alias("n_preserved"),
                       ratio(F.count_if(F.col("status") == "PRESERVED") * 100.0, F.count(F.lit(1))).alias("pct_preserved"))


def constraints(fds: DataFrame, strict: float = STRICT) -> DataFrame:
    return fds.filter(F.col("confidence") >= strict)


def mapping(df: DataFrame, x: str, y: str) -> DataFrame:
    """Most frequent dependent value of every determinant value (ties: smallest)."""
    counts = df.filter(q(x).isNotNull() & q(y).isNotNull()).groupBy(q(x), q(y)).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(q(x)).agg(F.min_by(q(y), F.struct(-F.col("_n"), q(y))).alias(y))


def enforce(df: DataFrame, source: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Overwrite each dependent column of ``df`` by the mapping learnt from ``source``; values of the
    determinant that ``source`` does not hold keep their dependent value."""
    for x, y in pairs:
        known = mapping(source, x, y).withColumnRenamed(y, "_mapped")
        order = df.columns
        df = attach(df, known, [x], how="left").withColumn(y, F.coalesce("_mapped", q(y))).drop("_mapped").select(*[q(c) for c in order])
    return df
