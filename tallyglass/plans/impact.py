"""What transforms changed: before/after statistics, deltas, scores, recipe comparisons, sampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.exprs import collect_stats, columns_of, num, q, ratio, records, resolve, skew_pop, tidy
from ..operators.outliers import iqr_fences
from ..functions.quantiles import quantiles, smallest
from ..sources.tables import SAMPLE_SEED

# fixed values: settings
DELTA_METRICS = ("mean", "median", "std", "skewness", "kurtosis", "outlier_pct")
MIN_VALUES = 3
STRATA = (2, 20)
SKEW_STEP, OUTLIER_STEP = 0.1, 1.0
RISKY_SKEW, RISKY_OUTLIERS = 2.0, 10.0


def column_stats(df: DataFrame, cols=None) -> DataFrame:
    """Mean, median, sample std, min, max, population skewness and kurtosis, IQR outliers; all columns
    in one quantile pass and one aggregate.  Columns with fewer than three values carry an error."""
    cols = resolve(df, cols, "numeric")
    med = {c: v[0] for c, v in quantiles(df, {c: (num(df, c), [0.5]) for c in cols}).items()}
    fences = iqr_fences(df, cols)
    rows = []
    for c in cols:
        x = num(df, c)
        lo, hi = fences[c][2:]
        far = F.count_if((x < F.lit(lo)) | (x > F.lit(hi))) if lo is not None else F.lit(0).cast("long")
        ok = F.count(x) >= MIN_VALUES
        show = lambda e: F.when(ok, e)
        rows.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("n"), show(F.avg(x)).alias("mean"), show(F.lit(med[c]).cast("double")).alias("median"),
            show(F.stddev(x)).alias("std"), show(F.min(x)).alias("min"), show(F.max(x)).alias("max"), show(skew_pop(x)).alias("skewness"),
            show(F.kurtosis(x)).alias("kurtosis"), F.when(ok, far).otherwise(F.lit(0)).alias("outlier_count"),
            F.when(ok, ratio(far * 100.0, F.count(x))).otherwise(F.lit(0.0)).alias("outlier_pct"),
            F.when(~ok, "insufficient_data").alias("error")))
    return tidy(df, rows)


def deltas(before: DataFrame, after: DataFrame, pairs: DataFrame) -> DataFrame:
    """(action, column, output, metric, before, after, change, pct_change); ``pairs`` maps columns to outputs.
    The change in percent of a zero is 0."""
    def long(df, name):
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in DELTA_METRICS])
        return df.select("column", F.inline(cells))
    b = long(before, "before")
    a = long(after, "after").withColumnRenamed("column", "output")
    t = pairs.join(F.broadcast(b), "column").join(F.broadcast(a), ["output", "metric"])
    t = t.filter(F.col("before").isNotNull() & F.col("after").isNotNull())
    return t.withColumn("change", F.col("after") - F.col("before")).withColumn(
        "pct_change", F.when(F.col("before") == 0, F.lit(0.0)).otherwise(ratio((F.col("after") - F.col("before")) * 100.0, F.col("before")))
    ).select(*[c for c in pairs.columns], "metric", "before", "after", "change", "pct_change")


def improvement(changes: DataFrame) -> DataFrame:
    """(action, column, output, score, label): skewness reduction (at most 50 points) plus half the outlier
    reduction (at most 50 points)."""
    cut = F.greatest(ratio((F.abs("before") - F.abs("after")) * 100.0, F.abs("before")), F.lit(0.0))
    points = F.when(F.col("metric") == "skewness", F.least(F.coalesce(cut, F.lit(0.0)), F.lit(50.0))).when(
        F.col("metric") == "outlier_pct", F.least(F.coalesce(cut, F.lit(0.0)) / 2, F.lit(50.0))).otherwise(0.0)
    s = changes.groupBy("action", "column", "output").agg(F.round(F.sum(points), 2).alias("score"))
    return s.withColumn("label", F.when(F.col("score") >= 75, "excellent").when(F.col("score") >= 50, "good").when(F.col("score") >= 25, "moderate")
                        .when(F.col("score") > 0, "minor").otherwise("none"))


def compare_recipe(df: DataFrame, steps) -> tuple[DataFrame, DataFrame]:
    """(deltas, log) of every applied step whose input and output are both numeric.  The statistics of all
    inputs come from one pass over the table and those of all outputs from one pass over the result."""
    from .recipe import apply_recipe

    out, log = apply_recipe(df, steps, on_error="skip")
    done = [r for r in log.collect() if r["status"] == "applied"]  # one row per step
    before_cols, after_cols = columns_of(df, "numeric"), columns_of(out, "numeric")
    pairs = [(r["action"], r["column"], r["output"]) for r in done if r["column"] in before_cols and r["output"] in after_cols
             and r["action"] not in ("rename", "drop", "suppress")]
    schema = "action string, column string, output string"
    table = records(df.sparkSession, pairs, schema)
    if not pairs:
        return records(df.sparkSession, [], schema + ", metric string, before double, after double, change double, pct_change double"), log
    before = column_stats(df, sorted({p[1] for p in pairs}))
    after = column_stats(out, sorted({p[2] for p in pairs}))
    return deltas(before, after, table), log


def impact_kpis(changes: DataFrame, total_columns: int) -> DataFrame:
    """Share of columns transformed, mean skewness and outlier change, improved / worsened / still risky."""
    wide = changes.groupBy("action", "column", "output").agg(
        *[F.max(F.when(F.col("metric") == m, F.col(v))).alias(f"{v}_{m}") for m in ("skewness", "outlier_pct") for v in ("change", "after")])
    up = F.coalesce(F.col("change_skewness") < -SKEW_STEP, F.lit(False)) | F.coalesce(F.col("change_outlier_pct") < -OUTLIER_STEP, F.lit(False))
    down = F.coalesce(F.col("change_skewness") > SKEW_STEP, F.lit(False)) | F.coalesce(F.col("change_outlier_pct") > OUTLIER_STEP, F.lit(False))
    risky = F.coalesce(F.abs("after_skewness") > RISKY_SKEW, F.lit(False)) | F.coalesce(F.col("after_outlier_pct") > RISKY_OUTLIERS, F.lit(False))
    return wide.agg(F.count_distinct("column").alias("n_transformed"),
                    (F.count_distinct("column") * 100.0 / F.lit(float(max(total_columns, 1)))).alias("pct_transformed"),
                    F.coalesce(F.avg("change_skewness"), F.lit(0.0)).alias("avg_skewness_change"),
                    F.coalesce(F.avg("change_outlier_pct"), F.lit(0.0)).alias("avg_outlier_change"), F.count_if(up).alias("improved"),
                    F.count_if(down & ~up).alias("worsened"), F.concat_ws(",", F.sort_array(F.collect_list(F.when(risky, F.col("output"))))).alias("risky_columns"))


def strata_column(df: DataFrame) -> str | None:
    """First text or whole-number column with 2..20 distinct values."""
    cands = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.IntegralType))]
    rough = collect_stats(df, {c: F.approx_count_distinct(q(c), 0.02) for c in cands})
    near = [c for c in cands if rough[c] <= STRATA[1] + 5]
    exact = collect_stats(df, {c: F.count_distinct(q(c)) for c in near})
    return next((c for c in near if STRATA[0] <= exact[c] <= STRATA[1]), None)


def sample_rows(df: DataFrame, method: str, n: int, key: list[str], seed: int = SAMPLE_SEED, order: list[str] | None = None) -> DataFrame:
    """``first`` n rows in ``order`` (default: key), ``random`` by a keyed hash, or ``stratified`` with exactly
    n rows split in proportion (largest remainders).  All three are reproducible."""
    total = df.count()
    if n <= 0 or n >= total:
        return df
    if method == "first":
        return df.orderBy(*[q(c) for c in (order or key)]).limit(n)
    if method not in ("random", "stratified"):
        raise ValueError(f"unknown method: {method}")
    by = strata_column(df) if method == "stratified" else None
    keyed = F.xxhash64(*[q(c) for c in key], F.lit(seed))
    if by is None:
        return smallest(df, keyed, n, [q(c) for c in key])
    sizes = {r[0]: r[1] for r in df.groupBy(q(by)).agg(F.count(F.lit(1))).collect()}  # at most 21 strata
    quota = {k: n * v // total for k, v in sizes.items()}
    rest = sorted(sizes, key=lambda k: (-(n * sizes[k] % total), str(k)))
    for k in rest[: n - sum(quota.values())]:
        quota[k] += 1
    # Only rows whose hash is small enough to be drawn are ranked, so a heavy stratum is never gathered.
    spread = keyed.cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)
    few = df
    for slack in (2.0, 8.0, 64.0, math.inf):
        share = {k: min(1.0, (slack * quota[k] + 100) / sizes[k]) for k in sizes}
        few = df.filter(spread <= _per_stratum(by, share))
        got = {r[0]: r[1] for r in few.groupBy(q(by)).agg(F.count(F.lit(1))).collect()}
        if all(got.get(k, 0) >= quota[k] for k in quota):
            break
    w = Window.partitionBy(q(by)).orderBy(keyed, *[q(c) for c in key])
    few = few.withColumn("_r", F.row_number().over(w))
    return few.filter(F.col("_r") <= _per_stratum(by, quota)).drop("_r")


def _per_stratum(by: str, values: dict):
    out = F.when(F.lit(False), F.lit(0))
    for k, v in values.items():
        out = out.when(q(by).eqNullSafe(F.lit(k)), F.lit(v))
    return out
