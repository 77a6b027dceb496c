"""Outlier detectors.  Each adds ``<column>_outlier`` flags; ``*_stats`` give one row per column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import collect_stats, num, q, ratio, records, resolve, tidy
from ..functions.keyed import attach
from ..functions.quantiles import quantiles
from ..functions.store import materialise

# fixed values: detector defaults
Z_LIMIT = 3.0
IQR_FACTOR = 1.5
MAD_LIMIT = 3.5
MAD_SCALE = 0.6745
COOK_FACTOR = 4.0
MIN_VALUES = {"zscore": 3, "iqr": 4, "mad": 3}


def zscore_fit(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """column -> (n, mean, sample std)."""
    xs = {c: num(df, c) for c in cols}
    s = collect_stats(df, {(c, k): f(x) for c, x in xs.items()
                           for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev))})
    return {c: (s[c, "n"], s[c, "m"], s[c, "s"]) for c in cols}


def zscore_flags(df: DataFrame, cols, limit: float = Z_LIMIT) -> dict[str, Column]:
    flags = {}
    for c, (n, mean, sd) in zscore_fit(df, cols).items():
        flags[c] = _never(df, c) if n < MIN_VALUES["zscore"] or not sd else _known(
            F.abs((num(df, c) - F.lit(mean)) / F.lit(sd)) > limit)
    return flags


def iqr_fences(df: DataFrame, cols, factor: float = IQR_FACTOR) -> dict[str, tuple]:
    """column -> (q1, q3, low fence, high fence)."""
    got = quantiles(df, {c: (num(df, c), [0.25, 0.75]) for c in cols})
    out = {}
    for c in cols:
        a, b = got[c]
        out[c] = (None,) * 4 if a is None else (a, b, a - factor * (b - a), b + factor * (b - a))
    return out


def iqr_flags(df: DataFrame, cols, factor: float = IQR_FACTOR) -> dict[str, Column]:
    counts = collect_stats(df, {c: F.count(num(df, c)) for c in cols})
    flags = {}
    for c, (a, b, lo, hi) in iqr_fences(df, cols, factor).items():
        x = num(df, c)
        flags[c] = _never(df, c) if counts[c] < MIN_VALUES["iqr"] or a == b else _known((x < F.lit(lo)) | (x > F.lit(hi)))
    return flags


def mad_fit(df: DataFrame, cols) -> dict[str, tuple]:
    """column -> (median, median absolute deviation)."""
    med = {c: v[0] for c, v in quantiles(df, {c: (num(df, c), [0.5]) for c in cols}).items()}
    dev = quantiles(df, {c: (F.abs(num(df, c) - F.lit(med[c])), [0.5]) for c in cols if med[c] is not None})
    return {c: (med[c], dev[c][0] if c in dev else None) for c in cols}


def mad_flags(df: DataFrame, cols, limit: float = MAD_LIMIT) -> dict[str, Column]:
    flags = {}
    for c, (med, dev) in mad_fit(df, cols).items():
        flags[c] = _never(df, c) if not dev else _known(
            F.abs(F.lit(MAD_SCALE) * (num(df, c) - F.lit(med)) / F.lit(dev)) > limit)
    return flags


def _known(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def _never(df: DataFrame, c: str) -> Column:
    return F.lit(False)


SUMMARY = "method string, column string, n bigint, n_outliers bigint, pct double, error string"
METHODS = {"zscore": zscore_flags, "iqr": iqr_flags, "mad": mad_flags}


def flag(df: DataFrame, cols=None, method: str = "zscore", **kw) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    cols = resolve(df, cols, "numeric")
    flags = METHODS[method](df, cols, **kw)
    return df.select("*", *[f.alias(f"{c}_outlier") for c, f in flags.items()])


def zscore(df, cols=None, limit: float = Z_LIMIT) -> DataFrame:
    return flag(df, cols, "zscore", limit=limit)


def iqr(df, cols=None, factor: float = IQR_FACTOR) -> DataFrame:
    return flag(df, cols, "iqr", factor=factor)


def mad(df, cols=None, limit: float = MAD_LIMIT) -> DataFrame:
    return flag(df, cols, "mad", limit=limit)


def flag_stats(df: DataFrame, cols, flags: dict[str, Column], method: str) -> DataFrame:
    """(method, column, n, n_outliers, pct): percentage of non-null values."""
    return tidy(df, [F.struct(
        F.lit(method).alias("method"), F.lit(c).alias("column"), F.count(num(df, c)).alias("n"),
        F.count_if(flags[c]).alias("n_outliers"),
        F.coalesce(ratio(F.count_if(flags[c]) * 100.0, F.count(num(df, c))), F.lit(0.0)).alias("pct")) for c in cols])


#: Methods that look at the columns together: they flag rows, not values.
JOINT = ("iforest", "lof")


def detect_all(df: DataFrame, cols=None, methods: list[str] | None = None, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with a flag per method and column, summary).

    ``methods`` from zscore, iqr, mad (a flag per column) and iforest, lof (one flag ``iforest`` / ``lof`` per row over all columns; rows with a
    missing value are never flagged, percentages are of the complete rows).  iforest needs ``key``, the columns that tell rows
    apart; without it the default leaves it out.  A method that refuses its input (too few rows) becomes a summary row with its error;
    failures of the engine are raised, and so is an unknown method."""
    cols = resolve(df, cols, "numeric")
    methods = methods or [*METHODS, *[m for m in JOINT if m == "lof" or key]]
    unknown = [m for m in methods if m not in METHODS and m not in JOINT]
    if unknown:
        raise ValueError(f"unknown methods: {unknown}")
    if "iforest" in methods and not key:
        raise ValueError("iforest needs key")
    flagged, summaries, joint = [], [], []
    for m in methods:
        try:
            if m in JOINT:
                points = _joint(df, cols, m, key)
                got = points.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("flag"), F.col("n")).otherwise(0)).alias("k")).first()
                part = records(df.sparkSession, [(m, ",".join(cols), got["n"], got["k"], 100.0 * got["k"] / got["n"], None)], SUMMARY)
                joint.append((m, points))
            else:
                flags = METHODS[m](df, cols)
                part = flag_stats(df, cols, flags, m).withColumn("error", F.lit(None).cast("string"))
                flagged += [f.alias(f"{c}_{m}") for c, f in flags.items()]
        except ValueError as exc:
            part = records(df.sparkSession, [(m, None, None, None, None, type(exc).__name__)], SUMMARY)
        summaries.append(part)
    out = df.select("*", *flagged)
    for m, points in joint:
        values = [num(df, c) for c in cols]
        place = F.when(reduce(lambda a, b: a & b, [v.isNotNull() for v in values]), F.to_json(F.array(*values)))
        marked = attach(out.withColumn("_place", place), points.select(F.col("place").alias("_place"), F.col("flag").alias(m)), ["_place"], how="left")
        out = marked.withColumn(m, F.coalesce(F.col(m), F.lit(False))).drop("_place")
    return out, reduce(DataFrame.unionByName, summaries)


def _joint(df: DataFrame, cols: list[str], method: str, key: list[str] | None) -> DataFrame:
    """(place, n, flag): every distinct complete row of the columns as text, its copies and whether the method flags it."""
    from .isolation import isolation_forest
    from .neighbours import lof

    marked, name = (isolation_forest(df, key, cols), "iforest_outlier") if method == "iforest" else (lof(df, cols), "lof_outlier")
    place = F.to_json(F.array(*[num(df, c) for c in cols]))
    return materialise(marked.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.max(name).alias("flag")), method)


def drop_outliers(df: DataFrame, cols, limit: float = Z_LIMIT) -> DataFrame:
    flags = zscore_flags(df, resolve(df, cols, "numeric"), limit)
    return df.filter(~reduce(lambda a, b: a | b, flags.values()))


def _gram(df: DataFrame, xs: list[Column], y: Column):
    """Means, count and centred cross products of (features, target) on complete rows."""
    import numpy as np

    names = [f"_x{i}" for i in range(len(xs))] + ["_y"]
    rows = df.select(*[x.alias(n) for x, n in zip([*xs, y], names)]).dropna()
    first = rows.agg(F.count(F.lit(1)), *[F.avg(n) for n in names]).first()
    n = first[0]
    if not n:
        return 0, None, None
    mean = [float(v) for v in first[1:]]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = rows.agg(*[F.sum((F.col(names[i]) - mean[i]) * (F.col(names[j]) - mean[j])) for i, j in pairs]).first()
    m = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, got):
        m[i, j] = m[j, i] = v
    return n, mean, m


def cooks(df: DataFrame, target: str, features: list[str], factor: float = COOK_FACTOR) -> DataFrame:
    """Adds leverage, Cook's distance and its flag (cut factor / n) for an ordinary least squares
    fit with intercept.  Only the (features+1)^2 cross-product matrix reaches the driver; leverage
    and distance are column expressions, so no row-by-row hat matrix exists."""
    import numpy as np

    resolve(df, [target, *features])
    xs, y = [num(df, c) for c in features], num(df, target)
    n, mean, m = _gram(df, xs, y)
    p = len(features)
    if n <= p + 1:
        raise ValueError("not enough complete rows")
    inv = np.linalg.pinv(m[:p, :p])
    beta = inv @ m[:p, p]
    sse = float(m[p, p] - beta @ m[:p, p])
    mse = max(sse, 0.0) / (n - p - 1)
    dev = [x - F.lit(mean[i]) for i, x in enumerate(xs)]
    quad = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            quad = quad + dev[i] * dev[j] * F.lit(float(inv[i, j]))
    fitted = F.lit(mean[p])
    for i in range(p):
        fitted = fitted + F.lit(float(beta[i])) * dev[i]
    h = F.least(F.greatest(F.lit(1.0 / n) + quad, F.lit(0.0)), F.lit(0.9999))
    resid = y - fitted
    # fixed values: leverage clipped at 0.9999, variance floored at 1e-10, division by the feature count
    student2 = resid * resid / F.greatest(F.lit(mse) * (1 - h), F.lit(1e-10))
    d = student2 / F.lit(float(p)) * h / (1 - h)
    whole = reduce(lambda a, b: a & b, [x.isNotNull() for x in [*xs, y]])
    return df.select("*", F.when(whole, h).alias("leverage"), F.when(whole, d).alias("cooks_d"),
                     _known(whole & (d > F.lit(factor / n))).alias("cooks_outlier"))
