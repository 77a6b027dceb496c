"""Quasi-identifiers and k-anonymity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import collect_stats, q, ratio, resolve
from ..functions.keyed import attach, frequency
from ..functions.ordered import running_totals
from .profile import profile_columns

# fixed values: settings
QI_LEVELS = (2, 100)
SKETCH_ERROR = 0.02
RISK_STEPS = (1, 2, 3, 5, 10, 20, 50, 100)
TARGET_K = 5


def quasi_identifiers(df: DataFrame, lo: int = QI_LEVELS[0], hi: int = QI_LEVELS[1]) -> DataFrame:
    """Columns with lo..hi distinct values, riskiest first.  A sketch of every column in one scan rules most columns out; only those
    that may be within the limits are counted exactly."""
    cols = resolve(df, None, "numeric", "categorical", "datetime")
    seen = collect_stats(df, {c: F.approx_count_distinct(q(c), SKETCH_ERROR) for c in cols})
    near = [c for c in cols if lo * (1 - 5 * SKETCH_ERROR) - 1 <= seen[c] <= hi * (1 + 5 * SKETCH_ERROR) + 1]
    p = profile_columns(df, near).filter(F.col("n_unique").between(lo, hi))
    share = ratio(F.col("n_unique"), F.col("n_rows"))
    risk = F.when(share < 0.01, "Low").when(share < 0.1, "Medium").otherwise("High")
    rank = F.when(F.col("risk_level") == "High", 3).when(F.col("risk_level") == "Medium", 2).otherwise(1)
    return (p.select("column", "dtype", F.col("n_unique").alias("unique_values"), F.round(share, 4).alias("uniqueness_ratio"),
                     risk.alias("risk_level"), "samples")
            .orderBy(F.desc(rank), F.desc("uniqueness_ratio"), "column"))


def group_sizes(df: DataFrame, qis: list[str]) -> DataFrame:
    """One row per combination (null is a value) with its size ``k``."""
    return frequency(df, resolve(df, qis), "k")


def k_anonymity(df: DataFrame, qis: list[str]) -> DataFrame:
    """Every row with the size of its group; large groups are not gathered into one task."""
    return attach(df, group_sizes(df, qis), qis)


def vulnerable(df: DataFrame, qis: list[str], k: int = 5) -> DataFrame:
    return k_anonymity(df, qis).filter(F.col("k") < k)


def k_distribution(df: DataFrame, qis: list[str], rows: int | None = None) -> DataFrame:
    """Records per k; the smallest ``rows`` values of k when given."""
    total = df.count()
    out = group_sizes(df, qis).groupBy("k").agg(F.sum("k").alias("n_records")).withColumn(
        "pct", F.round(F.col("n_records") * 100.0 / F.lit(float(max(total, 1))), 2)).orderBy("k")
    return out.limit(rows) if rows else out


def k_risk_curve(df: DataFrame, qis: list[str]) -> DataFrame:
    """Records with a group smaller than each threshold."""
    sums = group_sizes(df, qis).agg(F.sum("k").alias("_n"), *[
        F.coalesce(F.sum(F.when(F.col("k") < t, F.col("k"))), F.lit(0)).alias(f"_{t}") for t in RISK_STEPS])
    rows = F.array(*[F.struct(F.lit(t).alias("k"), F.col(f"_{t}").alias("n_at_risk"),
                              F.round(ratio(F.col(f"_{t}") * 100.0, F.col("_n")), 2).alias("pct_at_risk")) for t in RISK_STEPS])
    return sums.select(F.inline(rows))


def k_stats(df: DataFrame, qis: list[str]) -> DataFrame:
    """min, max, mean and median k over records, unique records and severity, from the k histogram."""
    hist = group_sizes(df, qis).groupBy("k").agg(F.sum("k").alias("n"))
    cum = running_totals(hist, "k", ["n"], rows=1)  # distinct group sizes: at most sqrt(2 * rows) values
    total = hist.agg(F.sum("n").alias("_total"))
    t = cum.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    start = F.col("cum_n") - F.col("n")
    lo, hi = F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2)
    mid = [F.max(F.when((start <= r) & (r < F.col("cum_n")), F.col("k"))) for r in (lo, hi)]
    unique = F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("n"))), F.lit(0))
    out = t.agg(F.max("_total").alias("n_records"), F.min("k").alias("min_k"), F.max("k").alias("max_k"),
                F.round(ratio(F.sum(F.col("k") * F.col("n")), F.max("_total")), 2).alias("mean_k"),
                ((mid[0] + mid[1]) / 2).cast("long").alias("median_k"), unique.alias("unique_records"),
                F.round(ratio(unique * 100.0, F.max("_total")), 2).alias("unique_pct"))
    return out.withColumn("severity", F.when(F.col("unique_pct") > 10, "CRITICAL").when(F.col("unique_pct") > 5, "HIGH")
                          .when(F.col("unique_pct") > 1, "MEDIUM").otherwise("LOW"))


def k_report(df: DataFrame, qis: list[str]) -> DataFrame:
    """Statistics with advice codes, the k to aim for and how strongly to generalise."""
    s = k_stats(df, qis)
    codes = F.concat_ws(",", F.when(F.col("unique_pct") > 5, "HIGH:unique_records"), F.when(F.col("mean_k") < 10, "MEDIUM:low_mean_k"),
                        F.when(F.col("min_k") == 1, "HIGH:min_k_one"))
    level = F.when(F.col("unique_pct") > 10, "HIGH").when((F.col("unique_pct") > 5) | (F.col("mean_k") < 5), "MEDIUM").otherwise("LOW")
    return s.select(F.lit(",".join(qis)).alias("quasi_identifiers"), *s.columns, codes.alias("advice"),
                    F.greatest(F.lit(TARGET_K).cast("long"), F.col("median_k")).alias("target_k"),
                    (F.col("unique_pct") > 5).alias("suppress_unique"), level.alias("generalization"))
