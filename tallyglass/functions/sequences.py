"""Row order at scale: global row numbers, neighbours along the order, carried values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .exprs import q
from .ordered import MAX_RANGES, VALUES_PER_RANGE, isolate, with_range

BLOCK = 100_000


def as_number(df: DataFrame, name: str) -> Column:
    """Order-preserving double for numbers, dates and times."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)").cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(q(name)).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(q(name)).cast("double")
    return q(name).cast("double")


def _cuts(df: DataFrame, col: str, ranges: int) -> list[float]:
    probs = [F.lit(i / ranges) for i in range(1, ranges)]
    return df.agg(F.percentile_approx(F.col(col), F.array(*probs), F.lit(10 * ranges))).first()[0] or []


def ranged(df: DataFrame, order: list[str], rows: int | None = None, per_range: int = VALUES_PER_RANGE) -> tuple[DataFrame, bool]:
    """Adds ``_range``: literal ranges over order[0].  A range that holds one value only (a hot time
    stamp, say) is cut further along order[1], so no range grows with a single value."""
    n = df.count() if rows is None else rows
    ranges = min(MAX_RANGES, math.ceil(n / per_range))
    if ranges <= 1:
        return df.withColumn("_range", F.lit(0).cast("long")), False
    keyed = df.withColumn("_o0", as_number(df, order[0]))
    cuts = isolate(_cuts(keyed, "_o0", ranges))
    out = with_range(keyed, "_o0", cuts, "_r0")
    single = [i + 1 for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b == math.nextafter(a, math.inf)]
    if single and len(order) > 1:
        out = out.withColumn("_o1", as_number(df, order[1]))
        tie_cuts = sorted(set(_cuts(out, "_o1", ranges)))
        out = with_range(out, "_o1", tie_cuts, "_r1")
        sub = F.when(F.col("_r0").isin(single), F.col("_r1")).otherwise(F.lit(0))
        out = out.withColumn("_range", F.col("_r0").cast("long") * (len(tie_cuts) + 1) + sub).drop("_o1", "_r1")
    else:
        out = out.withColumn("_range", F.col("_r0").cast("long"))
    return out.drop("_o0", "_r0"), True


def row_index(df: DataFrame, order: list[str], group: list[str] | None = None, out: str = "idx",
              per_range: int = VALUES_PER_RANGE) -> DataFrame:
    """0-based position of every row along ``order`` (per group), without a single-task sort.
    ``order`` should identify the row; its first column must be number-like."""
    group = group or []
    cut, many = ranged(df, order, per_range=per_range)
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    numbered = cut.withColumn(out, (F.row_number().over(inside) - 1).cast("long"))
    if not many:
        return numbered.drop("_range")
    totals = cut.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return numbered.join(offsets, [*group, "_range"]).withColumn(out, F.col(out) + F.col("_off")).drop("_off", "_range")


def blocks(df: DataFrame, before: int, after: int, index: str = "idx", block: int = BLOCK) -> DataFrame:
    """Rows copied into every block whose own rows need them as neighbours: adds ``_block`` and
    ``_own``.  A window per block then sees the same neighbours as one global window would."""
    block = max(block, before + after + 1)
    i = F.col(index)
    spots = F.sequence(F.floor((i - after) / block), F.floor((i + before) / block))
    return (df.withColumn("_block", F.explode(spots)).filter("_block >= 0")
            .withColumn("_own", F.floor(i / block) == F.col("_block")))


def fill(df: DataFrame, col: str, order: list[str], direction: str = "forward", group: list[str] | None = None,
         per_range: int = VALUES_PER_RANGE) -> DataFrame:
    """Forward or backward fill.  Each range fills itself; the last (first) known value of the
    ranges before (after) it is carried in from one row per range."""
    if direction not in ("forward", "backward"):
        raise ValueError(f"unknown direction: {direction}")
    group, ahead = group or [], direction == "forward"
    cut, many = ranged(df, order, per_range=per_range)
    # backward runs along the reversed order: a frame that only grows is one pass, one that shrinks is read again for every row
    full = Window.partitionBy(*group, "_range").orderBy(*order if ahead else [F.desc(c) for c in order])
    filled = cut.withColumn("_f", F.last(q(col), ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, 0)))
    if many:
        known = cut.filter(q(col).isNotNull())
        pick = F.max_by if ahead else F.min_by
        edge = known.groupBy(*group, "_range").agg(pick(q(col), F.struct(*order)).alias("_e"))
        ranges = cut.select(*group, "_range").distinct().join(edge, [*group, "_range"], "left")
        w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range" if ahead else F.desc("_range"))
        carry = F.last("_e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        filled = filled.join(ranges.select(*group, "_range", carry.alias("_c")), [*group, "_range"], "left")
        filled = filled.withColumn("_f", F.coalesce("_f", "_c"))
    return filled.withColumn(col, F.col("_f")).select(*[q(c) for c in df.columns])
