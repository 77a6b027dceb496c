"""Cumulative sums, ranks and grouped order statistics over a global order.

A window ordered without a partition sends every row to one task.  Here values
are first reduced to (value, counts), then cut into ranges at literal boundaries
(so recomputed tasks cut identically), summed inside each range, and shifted by
the totals of the ranges before it.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

VALUES_PER_RANGE = 1_000_000
MAX_RANGES = 8_192


def range_cuts(df: DataFrame, value: str, rows: int | None = None) -> list[float]:
    """Boundaries that cut ``value`` (double) into ranges of about equal row count.

    A value heavy enough to repeat as a boundary gets a range of its own."""
    n = df.count() if rows is None else rows
    ranges = min(MAX_RANGES, math.ceil(n / VALUES_PER_RANGE))
    if ranges <= 1:
        return []
    probs = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(F.col(value), F.array(*[F.lit(p) for p in probs]), F.lit(10 * ranges))).first()[0]
    return isolate(cuts or [])


def isolate(cuts: list[float]) -> list[float]:
    out = set(cuts)
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            out.add(math.nextafter(a, math.inf))
    return sorted(out)


def with_range(df: DataFrame, value: str, cuts: list[float], out: str = "range_id") -> DataFrame:
    """Adds the range number of a non-null double column."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    edges = [-math.inf, *cuts, math.inf]
    cutter = Bucketizer(splits=edges, inputCol=value, outputCol=out, handleInvalid="keep")
    return cutter.transform(df).withColumn(out, F.col(out).cast("int"))


def running_totals(freq: DataFrame, value: str, sums: list[str], group: list[str] | None = None,
                   rows: int | None = None, cuts: list[float] | None = None) -> DataFrame:
    """``freq`` has one row per (group, value).  Adds ``cum_<c>`` inclusive running sums."""
    group = group or []
    if cuts is None:
        cuts = range_cuts(freq.select(F.col(value).cast("double").alias(value)), value, rows)
    cut = freq.withColumn("_key", F.col(value).cast("double"))
    cut = with_range(cut, "_key", cuts).drop("_key")
    inside = Window.partitionBy(*group, "range_id").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = cut.select("*", *[F.sum(c).over(inside).alias(f"cum_{c}") for c in sums])
    if not cuts:
        return cum.drop("range_id")
    # One row per range and group; ranges are capped, so this side stays small.
    totals = cut.groupBy(*group, "range_id").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*group).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1) if group else (
        Window.partitionBy(F.lit(0)).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*group, "range_id", *[
        F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    joined = cum.join(offsets, [*group, "range_id"])
    for c in sums:
        joined = joined.withColumn(f"cum_{c}", F.col(f"cum_{c}") + F.col(f"_o_{c}"))
    return joined.drop("range_id", *[f"_o_{c}" for c in sums])


def average_ranks(df: DataFrame, value: str, rows: int | None = None) -> DataFrame:
    """(value, n, rank) with tied values sharing their mean rank; nulls left out."""
    freq = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    cum = running_totals(freq, value, ["n"], rows=df.count() if rows is None else rows)
    return cum.select(value, "n", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("rank"))


def grouped_quantiles(df: DataFrame, by: str, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear quantiles per group: (by, n, <name>...).  A hot group is spread
    over the value ranges instead of being held by one task."""
    freq = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    cum = running_totals(freq, value, ["n"], group=[by], rows=df.count())
    sizes = freq.groupBy(F.col(by).alias("_by")).agg(F.sum("n").alias("_size"))
    sized = cum.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    start = F.col("cum_n") - F.col("n")
    out = [F.max("_size").alias("n")]
    for name, p in probs.items():
        h = (F.col("_size") - 1) * F.lit(float(p))
        at = [F.max(F.when((start <= r) & (r < F.col("cum_n")), F.col(value))) for r in (F.floor(h), F.ceil(h))]
        frac = F.max(h - F.floor(h))
        out.append((at[0] + (at[1] - at[0]) * frac).alias(name))
    return sized.groupBy(by).agg(*out)
