"""How close a synthetic table is to the real one: type repair, distances, scores, model choice."""

from __future__ import annotations

import math
import time

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.exprs import collect_stats, columns_of, kind, num, q, ratio, records, text_columns
from ..functions.keyed import attach
from ..functions.store import materialise
from ..operators.drift import common, ecdf_pairs, pair_counts, similarity
from ..operators.profile import bin_index
from ..operators.transforms import level_codes

# fixed values: settings
BINS = 20
FLOOR = 1e-10
METRICS = ("ks", "js", "wasserstein", "mmd")
KS_MEDIUM, KS_HIGH = 0.15, 0.3
P_MEDIUM, P_HIGH = 0.05, 0.01
MMD_FEATURES = 128


def repair_types(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Columns of the schema of ``like`` are cast to it (doubles are rounded for whole-number types); without
    ``like`` doubles holding only whole numbers become long.  NaN and infinities become null."""
    if like is not None:
        cols = []
        for f in df.schema.fields:
            if f.name not in like.columns:
                cols.append(q(f.name))
                continue
            want = like.schema[f.name].dataType
            x = q(f.name)
            if isinstance(want, T.NumericType):
                x = num(df, f.name)
                x = F.round(x) if isinstance(want, T.IntegralType) else x
            cols.append(x.try_cast(want).alias(f.name))
        return df.select(*cols)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    whole = collect_stats(df, {c: F.bool_and(num(df, c) == F.floor(num(df, c))) for c in floats})
    return df.withColumns({c: num(df, c).cast("long") if whole[c] else num(df, c) for c in floats}) if floats else df


def encode_pair(real: DataFrame, synth: DataFrame, cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Text columns of both tables coded by the sorted union of their values (missing counts as 'nan')."""
    cols = [c for c in text_columns(real) if c in synth.columns] if cols is None else cols
    if not cols:
        return real, synth
    text = {c: F.coalesce(q(c).cast("string"), F.lit("nan")) for c in cols}
    a, b = real.withColumns(text), synth.withColumns(text)
    sizes = [collect_stats(t, {c: F.approx_count_distinct(q(c), 0.02) for c in cols}) for t in (a, b)]
    out = [a, b]
    for c in cols:
        n = sizes[0][c] + sizes[1][c]  # at least the size of the union
        codes = level_codes(a.select(q(c)).unionByName(b.select(q(c))), c, n=n)
        out = [attach(t, codes, [c], n_keys=n).withColumn(c, F.col("code")).drop("code") for t in out]
    return out[0].select(*[q(x) for x in real.columns]), out[1].select(*[q(x) for x in synth.columns])


def _as_numbers(real: DataFrame, synth: DataFrame) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Both tables as numbers on their common columns: (real, synthetic, columns, coded columns)."""
    cols = common(real, synth, None, "numeric", "categorical")
    text = [c for c in cols if c in text_columns(real)]
    r, s = encode_pair(real.select(*[q(c) for c in cols]), synth.select(*[q(c) for c in cols]), text)
    keep = [c for c in cols if kind(r.schema[c].dataType) == "numeric"]
    r, s = (d.select(*[num(d, c).alias(c) for c in keep]) for d in (r, s))
    return r, s, keep, text


def _distances(r: DataFrame, s: DataFrame, cols: list[str]) -> DataFrame:
    """(column, ks, wasserstein) from one pass over both empirical distributions.

    The Wasserstein area is summed by parts, value * (change of the gap), so no row needs its successor."""
    e = ecdf_pairs(r, s, cols)
    gap = F.abs(F.col("cum_ref") / F.col("n_ref") - F.col("cum_cur") / F.col("n_cur"))
    before = F.abs((F.col("cum_ref") - F.col("ref")) / F.col("n_ref") - (F.col("cum_cur") - F.col("cur")) / F.col("n_cur"))
    # sum of gap_i * (v_{i+1} - v_i) = sum of v_i * (gap_{i-1} - gap_i); the last gap is zero
    return e.groupBy("column").agg(F.max(gap).alias("ks"), F.sum(F.col("value") * (before - gap)).alias("wasserstein"))


def _divergences(r: DataFrame, s: DataFrame, cols: list[str], coded: list[str], bins: int = BINS) -> DataFrame:
    """(column, js, inv_kl) from one shuffle of shared-bin counts; coded columns are their own bins."""
    ends = [collect_stats(d, {(c, k): f(q(c)) for c in cols for k, f in (("lo", F.min), ("hi", F.max))}) for d in (r, s)]
    cells = []
    for d in (r, s):
        mine = {}
        for c in cols:
            lo = [e[c, "lo"] for e in ends if e[c, "lo"] is not None]
            hi = [e[c, "hi"] for e in ends if e[c, "hi"] is not None]
            if c in coded:
                mine[c] = q(c).cast("long")
            else:
                mine[c] = bin_index(q(c), min(lo), max(hi), bins).cast("long") if lo else F.lit(None).cast("long")
        cells.append(mine)
    counts = pair_counts(r, s, *cells)
    sizes = counts.groupBy(F.col("column").alias("_c")).agg(F.sum("ref").alias("_r"), F.sum("cur").alias("_s"))
    t = counts.join(F.broadcast(sizes), F.col("column") == F.col("_c")).select(
        "column", F.coalesce(ratio(F.col("ref"), F.col("_r")), F.lit(0.0)).alias("p"),
        F.coalesce(ratio(F.col("cur"), F.col("_s")), F.lit(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / m)).otherwise(0.0)
    a, b = F.greatest("p", F.lit(FLOOR)), F.greatest("q", F.lit(FLOOR))
    return t.groupBy("column").agg(
        F.sqrt(F.greatest(F.sum((part("p") + part("q")) / 2), F.lit(0.0))).alias("js"),
        (1 / (1 + F.greatest(F.sum(a * F.log(a / b)), F.lit(0.0)))).alias("inv_kl"))


def _one(table: DataFrame, metric: str) -> DataFrame:
    return table.select("column", F.col(metric).alias("value"))


def ks_by_column(real, synth) -> DataFrame:
    """Largest gap of the empirical distributions."""
    return _one(_distances(*_as_numbers(real, synth)[:3]), "ks")


def wasserstein_by_column(real, synth) -> DataFrame:
    """One-dimensional Wasserstein distance: area between the empirical distributions."""
    return _one(_distances(*_as_numbers(real, synth)[:3]), "wasserstein")


def js_by_column(real, synth, bins: int = BINS) -> DataFrame:
    """Jensen-Shannon distance (square root of the divergence in nats)."""
    return _one(_divergences(*_as_numbers(real, synth), bins=bins), "js")


def inv_kl_by_column(real, synth, bins: int = BINS) -> DataFrame:
    """1 / (1 + KL(real || synthetic)) with empty bins at a floor."""
    return _one(_divergences(*_as_numbers(real, synth), bins=bins), "inv_kl")


def _mmd(r: DataFrame, s: DataFrame, cols: list[str], features: int = MMD_FEATURES, seed: int = 42) -> float:
    """Squared distance of the mean random Fourier features; each task returns one feature sum per batch."""
    st = collect_stats(r, {(c, k): f(q(c)) for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))})
    mean = np.array([st[c, "m"] or 0.0 for c in cols])
    sd = np.array([st[c, "s"] or 1.0 for c in cols])
    rng = np.random.default_rng(seed)
    freq = rng.standard_normal((len(cols), features)) / math.sqrt(max(len(cols), 1))
    shift = rng.uniform(0, 2 * math.pi, features)

    def sums(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                x = np.nan_to_num((pdf.to_numpy(float) - mean) / sd)
                yield pd.DataFrame({"n": [len(x)], "f": [np.cos(x @ freq + shift).sum(0)]})

    means = []
    for d in (r, s):
        got = d.mapInPandas(sums, "n bigint, f array<double>").select("n", F.posexplode("f").alias("i", "v")).groupBy("i").agg(
            F.sum("v") / F.sum("n")).collect()  # one row per feature
        means.append(np.array([row[1] for row in sorted(got)]))
    return float(2.0 / features * ((means[0] - means[1]) ** 2).sum()) if len(means[0]) == len(means[1]) else float("nan")


def mmd(real: DataFrame, synth: DataFrame, features: int = MMD_FEATURES, seed: int = 42) -> DataFrame:
    """Squared maximum mean discrepancy of a Gaussian kernel by random Fourier features: linear in the rows.
    Columns are scaled by the real mean and deviation, missing values sit at the mean."""
    r, s, cols, _ = _as_numbers(real, synth)
    return records(real.sparkSession, [("mmd", _mmd(r, s, cols, features, seed))], "metric string, value double")


def evaluate(real: DataFrame, synth: DataFrame) -> DataFrame:
    """(metric, value): means over the columns; ks, js, wasserstein and mmd are better when low, inv_kl when high.

    Both tables are coded and written once; one pass gives ks and wasserstein, one js and inv_kl, one mmd."""
    r, s, cols, coded = _as_numbers(real, synth)
    r, s = materialise(r, "real"), materialise(s, "synthetic")
    flat = lambda t, names: t.agg(*[F.avg(n).alias(n) for n in names]).select(F.inline(F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))
    return flat(_distances(r, s, cols), ["ks", "wasserstein"]).unionByName(
        flat(_divergences(r, s, cols, coded), ["js", "inv_kl"])).unionByName(
        records(real.sparkSession, [("mmd", _mmd(r, s, cols))], "metric string, value double"))


def compare_models(df: DataFrame, models: dict, rows: int | None = None, seed: int = 42) -> DataFrame:
    """(model, status, seconds, ks, js, wasserstein, mmd): fit each generator, draw as many rows as the
    table has (``rows`` if given), score them against the whole table.  A failing model becomes a row with its error."""
    n = df.count() if rows is None else rows
    out = []
    for name, fit in models.items():
        t0 = time.time()
        try:
            scores = {r["metric"]: r["value"] for r in evaluate(df, fit(df).sample(n, seed)).collect()}
            out.append((name, "success", time.time() - t0, *[float(scores[m]) for m in METRICS]))
        except ValueError as exc:  # input that the model refuses; failures of the engine are raised
            out.append((name, f"failed:{type(exc).__name__}", time.time() - t0, None, None, None, None))
    return records(df.sparkSession, out, "model string, status string, seconds double, " + ", ".join(f"{m} double" for m in METRICS))


def best_model(results: DataFrame) -> DataFrame:
    """Successful model with the lowest mean of its valid metrics (all oriented lower is better)."""
    valid = [F.when(F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf")), F.col(m)) for m in METRICS]
    n = sum([v.isNotNull().cast("int") for v in valid], F.lit(0))
    total = sum([F.coalesce(v, F.lit(0.0)) for v in valid], F.lit(0.0))
    scored = results.filter(F.col("status") == "success").withColumn("score", ratio(total, n)).filter(F.col("score").isNotNull())
    return scored.orderBy("score", "model").limit(1).select("model", "score")


def badges(synth: DataFrame, real: DataFrame | None = None) -> DataFrame:
    """One row: fidelity, identifier risk and mode collapse from distinct counts (exact, one long aggregation per table)."""
    from ..operators.profile import profile_columns

    s = {r["column"]: r for r in profile_columns(synth).collect()}  # one row per column
    n = max((r["n_rows"] for r in s.values()), default=0)
    fidelity = "unknown"
    if real is not None:
        nums = columns_of(real, "numeric")
        fidelity = "n/a"
        if nums:
            r = {x["column"]: x["n_unique"] for x in profile_columns(real, nums).collect()}
            mean = sum(min(1.0, (s[c]["n_unique"] if c in s else 0) / max(1, r[c])) for c in nums) / len(nums)
            fidelity = "high" if mean > 0.8 else "medium" if mean > 0.5 else "low"
    unique = sum(s[c]["n_unique"] > 0.8 * n for c in text_columns(synth))
    few = sum(r["n_unique"] <= 3 and n > 10 for r in s.values())
    return records(synth.sparkSession, [(fidelity, "low" if unique == 0 else "medium" if unique <= 2 else "high",
                                         "no" if few == 0 else "possible" if few <= 2 else "likely")],
                   "fidelity string, privacy_risk string, mode_collapse string")


def quality_issues(similar: DataFrame) -> DataFrame:
    """(issue, severity, columns, mean_statistic) from a similarity table; one 'good' row when nothing is wrong."""
    num_, cat = F.col("type") == "numeric", F.col("type") == "categorical"
    issue = F.when(num_ & (F.col("statistic") > KS_HIGH), "distribution_high").when(num_ & (F.col("statistic") > KS_MEDIUM), "distribution_medium").when(
        cat & (F.col("p_value") < P_HIGH), "categorical_high")
    found = similar.withColumn("issue", issue).filter(F.col("issue").isNotNull()).groupBy("issue").agg(
        F.concat_ws(",", F.sort_array(F.collect_list("column"))).alias("columns"),
        F.avg(F.when(num_, F.col("statistic")).otherwise(F.col("p_value"))).alias("mean_statistic"))
    found = found.select("issue", F.when(F.col("issue") == "distribution_medium", "medium").otherwise("high").alias("severity"), "columns", "mean_statistic")
    none = similar.agg(F.count_if(issue.isNotNull()).alias("n")).filter("n = 0").select(
        F.lit("good").alias("issue"), F.lit("info").alias("severity"), F.lit("").alias("columns"), F.lit(None).cast("double").alias("mean_statistic"))
    return found.unionByName(none)


def quality_scores(similar: DataFrame) -> DataFrame:
    """Fidelity, privacy, utility, correlation, distribution, diversity and overall score (0..1)."""
    score_n = F.avg(F.when(F.col("type") == "numeric", F.greatest(F.lit(0.0), 1 - F.col("statistic"))))
    score_c = F.avg(F.when(F.col("type") == "categorical", F.least(F.lit(1.0), F.col("p_value") * 10)))
    f = similar.agg((F.coalesce(score_n, F.lit(0.8)) * 0.7 + F.coalesce(score_c, F.lit(0.8)) * 0.3).alias("f")).select(
        F.col("f"), (0.85 + (1 - F.col("f")) * 0.15).alias("p")).withColumn("u", F.col("f") * 0.8 + F.col("p") * 0.2)
    overall = F.col("f") * 0.35 + F.col("p") * 0.20 + F.col("u") * 0.25 + F.col("f") * 0.9 * 0.10 + F.lit(0.08)
    return f.select(F.round("f", 3).alias("fidelity"), F.round("p", 3).alias("privacy"), F.round("u", 3).alias("utility"),
                    F.round(F.col("f") * 0.9, 3).alias("correlation"), F.round("f", 3).alias("distribution"), F.lit(0.8).alias("diversity"),
                    F.round(overall, 3).alias("overall"))


def similarity_scores(real: DataFrame, synth: DataFrame) -> DataFrame:
    return quality_scores(similarity(real, synth))
