"""Distribution fingerprints: family fits from moments, scored against a density histogram of all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import special
from ..functions.exprs import collect_stats, kurt_g2, num, records, resolve, skew_g1, tidy
from .profile import bin_index

# fixed values: settings
FAMILIES = ("norm", "lognorm", "expon", "gamma", "beta", "uniform", "chi2", "weibull_min", "t")
DENSITY_BINS = 50
MIN_ROWS = 10
SKEWED, HEAVY, VERY_SKEWED = 1.0, 3.0, 2.0
FIT_SCHEMA = ("column string, n bigint, family string, params array<double>, rss double, has_negatives boolean, "
              "skew double, kurtosis double, lo double, hi double")


def _moments(df: DataFrame, cols: list[str]) -> dict:
    stats = {}
    for c in cols:
        x = num(df, c)
        lx = F.log(F.when(x > 0, x))
        stats.update({(c, "n"): F.count(x), (c, "mean"): F.avg(x), (c, "sd"): F.stddev_pop(x), (c, "lo"): F.min(x),
                      (c, "hi"): F.max(x), (c, "lmean"): F.avg(lx), (c, "lsd"): F.stddev_pop(lx), (c, "npos"): F.count(lx),
                      (c, "skew"): skew_g1(x), (c, "kurt"): kurt_g2(x), (c, "neg"): F.count_if(x < 0)})
    return collect_stats(df, stats)


def estimate(family: str, m: dict) -> tuple | None:
    """Moment or closed-form parameters; None when the family cannot describe the data."""
    mean, sd, lo, hi, n = m["mean"], m["sd"], m["lo"], m["hi"], m["n"]
    if not sd or sd <= 0:
        return None
    positive = m["npos"] == n
    var = sd * sd
    if family == "norm":
        return mean, sd
    if family == "uniform":
        return lo, hi - lo
    if family == "expon":
        return lo, mean - lo
    if family == "lognorm":
        return (m["lmean"], m["lsd"]) if positive and m["lsd"] else None
    if family == "gamma":
        return (mean * mean / var, var / mean) if positive else None
    if family == "chi2":
        return (mean,) if positive else None
    if family == "beta":
        width = (hi - lo) * 1.0002
        base = lo - (hi - lo) * 0.0001
        u, v = (mean - base) / width, var / (width * width)
        k = u * (1 - u) / v - 1
        return (u * k, (1 - u) * k, base, width) if k > 0 else None
    if family == "weibull_min":
        if not positive or not m["lsd"]:
            return None
        shape = math.pi / (m["lsd"] * math.sqrt(6))  # log of a Weibull value is Gumbel
        return shape, math.exp(m["lmean"] + 0.5772156649015329 / shape)
    if family == "t":
        k = m["kurt"]
        if k is None or k <= 0:
            return None
        v = 6.0 / k + 4.0  # excess kurtosis of Student's t
        return v, mean, sd * math.sqrt((v - 2) / v)
    raise ValueError(f"unknown family: {family}")


def density_histogram(df: DataFrame, m: dict, cols: list[str], bins: int = DENSITY_BINS) -> dict[str, list[float]]:
    """Density per bin of every column, all columns in one shuffle of at most bins x columns rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), bin_index(num(df, c), m[c, "lo"], m[c, "hi"], bins).alias("bin")) for c in cols])
    got = df.select(F.inline(cells)).filter(F.col("bin").isNotNull()).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {c: [0.0] * bins for c in cols}
    for r in got:
        c = r["column"]
        width = (m[c, "hi"] - m[c, "lo"]) / bins
        out[c][r["bin"]] = r["n"] / (m[c, "n"] * width)
    return out


def fit_distributions(df: DataFrame, cols=None, families=FAMILIES, bins: int = DENSITY_BINS) -> DataFrame:
    """Best family per numeric column by the residual sum of squares between bin density and family
    density at the bin centres.  Uses every row: one aggregate of moments and one histogram."""
    cols = resolve(df, cols, "numeric")
    m = _moments(df, cols)
    usable = [c for c in cols if m[c, "n"] >= MIN_ROWS and m[c, "hi"] > m[c, "lo"]]
    hist = density_histogram(df, m, usable, bins) if usable else {}
    rows = []
    for c in cols:
        mine = {k: v for (col, k), v in m.items() if col == c}
        base = (bool(mine["neg"]), mine["skew"], mine["kurt"], mine["lo"], mine["hi"])
        if mine["n"] < MIN_ROWS:
            rows.append((c, mine["n"], "insufficient_data", [], None, *base))
            continue
        if c not in hist:
            rows.append((c, mine["n"], "constant", [], None, *base))
            continue
        width = (mine["hi"] - mine["lo"]) / bins
        centres = [mine["lo"] + (i + 0.5) * width for i in range(bins)]
        best = None
        for f in families:
            params = estimate(f, mine)
            if params is None:
                continue
            pdf = special.density(f, params, centres)
            rss = float(sum((a - b) ** 2 for a, b in zip(hist[c], pdf)))
            if best is None or rss < best[1]:
                best = (f, rss, [float(p) for p in params])
        rows.append((c, mine["n"], best[0], best[2], best[1], *base))
    return records(df.sparkSession, rows, FIT_SCHEMA)


def fingerprint(df: DataFrame, cols=None) -> DataFrame:
    """(column, n, has_negatives, skew, kurtosis)."""
    cols = resolve(df, cols, "numeric")
    xs = {c: num(df, c) for c in cols}
    return tidy(df, [F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), (F.count_if(x < 0) > 0).alias("has_negatives"),
                              skew_g1(x).alias("skew"), kurt_g2(x).alias("kurtosis")) for c, x in xs.items()])


def fit_summary(fits: DataFrame) -> DataFrame:
    """One row: families found, skewed and heavy-tailed columns."""
    families = fits.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    counts = families.agg(F.concat_ws(",", F.sort_array(F.collect_list(F.concat("family", F.lit(":"), F.col("n").cast("string"))))).alias("families"))
    def names(cond):
        return F.concat_ws(",", F.sort_array(F.collect_list(F.when(cond, F.col("column")))))
    flags = fits.agg(F.count(F.lit(1)).alias("n_columns"), names(F.abs("skew") > SKEWED).alias("skewed_columns"),
                     names(F.abs("kurtosis") > HEAVY).alias("heavy_tailed_columns"))
    return flags.withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k").drop("_k")


def fit_advice(fits: DataFrame) -> DataFrame:
    """(column, advice) codes."""
    codes = F.array(
        F.when(F.col("family") == "lognorm", "log_transform"), F.when(F.col("family") == "expon", "time_between_events"),
        F.when(F.abs("skew") > VERY_SKEWED, "power_transform"), F.when(F.col("family") == "beta", "check_proportion"))
    return fits.select("column", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("advice"))


def fit_curve(fits: DataFrame, column: str, points: int = 200) -> DataFrame:
    """(x, density) of the fitted family of one column on an even grid over its range."""
    r = fits.filter(F.col("column") == column).first()
    if r is None or not r["params"]:
        return records(fits.sparkSession, [], "x double, density double")
    step = (r["hi"] - r["lo"]) / (points - 1)
    xs = [r["lo"] + i * step for i in range(points)]
    return records(fits.sparkSession, [(x, float(d)) for x, d in zip(xs, special.density(r["family"], tuple(r["params"]), xs))],
                   "x double, density double")


def is_lognormal(df: DataFrame, cols=None) -> DataFrame:
    """(column, lognormal): positive data whose best of lognorm, norm and expon is lognorm."""
    fits = fit_distributions(df, cols, ("lognorm", "norm", "expon"))
    return fits.select("column", ((F.col("family") == "lognorm") & (F.col("lo") > 0)).alias("lognormal"))
