"""Repairs: winsorise, cap, remove, bin and transform, with a log of what they changed."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import collect_stats, num, q, ratio, resolve, tidy
from ..functions.ordered import with_range
from ..functions.quantiles import order_statistics, quantiles
from ..functions.store import materialise
from .outliers import IQR_FACTOR, iqr_fences

# fixed values: defaults
WINSOR_LIMITS = (0.05, 0.05)
CAP_PERCENTILES = (1, 99)
BINS = 5
KMEANS_PIECES, KMEANS_ROUNDS = 4_096, 16
LAMBDA_RANGE = (-2.0, 2.0)


def _clamp(x: Column, lo, hi) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def winsor_bounds(df: DataFrame, cols: list[str], limits=WINSOR_LIMITS) -> dict[str, tuple]:
    """column -> the order statistics that replace the int(limit*n) extreme values on each side."""
    n = collect_stats(df, {c: F.count(num(df, c)) for c in cols})
    wanted = {}
    for c in cols:
        if n[c]:
            wanted[c] = (num(df, c), [int(limits[0] * n[c]), n[c] - 1 - int(limits[1] * n[c])])
    got = order_statistics(df, wanted) if wanted else {}
    out = {}
    for c in cols:
        out[c] = (None, None) if c not in got else tuple(got[c])
    return out


def bounds(df: DataFrame, cols, method: str, **kw) -> dict[str, tuple]:
    if method == "winsorize":
        return winsor_bounds(df, cols, kw.get("limits", WINSOR_LIMITS))
    if method == "iqr":
        return {c: f[2:] for c, f in iqr_fences(df, cols, kw.get("factor", IQR_FACTOR)).items()}
    if method == "percentile":
        lo, hi = kw.get("percentiles", CAP_PERCENTILES)
        return {c: tuple(v) for c, v in
                quantiles(df, {c: (num(df, c), [lo / 100.0, hi / 100.0]) for c in cols}).items()}
    raise ValueError(f"unknown method: {method}")


def clamp(df: DataFrame, cols, method: str, **kw) -> tuple[DataFrame, DataFrame]:
    """(repaired table, log).  Values outside the bounds are set to them; nulls stay null and
    are not counted as changed."""
    cols = resolve(df, cols, "numeric")
    limits = {c: b for c, b in bounds(df, cols, method, **kw).items() if b[0] is not None}
    changed = {c: (num(df, c) < F.lit(lo)) | (num(df, c) > F.lit(hi)) for c, (lo, hi) in limits.items()}
    log = tidy(df, [F.struct(
        F.lit(method).alias("action"), F.lit(c).alias("column"), F.lit(lo).alias("lower"), F.lit(hi).alias("upper"),
        F.count_if(changed[c]).alias("n_changed"),
        F.coalesce(ratio(F.count_if(changed[c]) * 100.0, F.count(num(df, c))), F.lit(0.0)).alias("pct_changed"))
        for c, (lo, hi) in limits.items()])
    return df.withColumns({c: _clamp(num(df, c), lo, hi) for c, (lo, hi) in limits.items()}), log


def winsorize(df, cols=None, limits=WINSOR_LIMITS):
    return clamp(df, cols, "winsorize", limits=limits)


def cap(df, cols=None, method: str = "iqr", factor: float = IQR_FACTOR, percentiles=CAP_PERCENTILES):
    return clamp(df, cols, method, factor=factor, percentiles=percentiles)


def remove(df: DataFrame, flags: list[str], how: str = "union") -> DataFrame:
    """Drop rows flagged in any (union) or in all (intersection) of the flag columns."""
    if how not in ("union", "intersection"):
        raise ValueError(f"unknown combination: {how}")
    op = (lambda a, b: a | b) if how == "union" else (lambda a, b: a & b)
    return df.filter(~reduce(op, [F.coalesce(q(f), F.lit(False)) for f in flags]))


def remove_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop rows whose key is in ``keys`` (its columns name the key)."""
    return df.join(keys.distinct(), keys.columns, "left_anti")


def bin_column(x: Column, edges: list[float], labels: list[str] | None = None) -> Column:
    """Right-closed bin number (or label); the lowest edge belongs to the first bin."""
    # Counting the inner edges below x keeps the generated code small, unlike a chain of cases.
    number = F.lit(0)
    for e in edges[1:-1]:
        number = number + (x > F.lit(e)).cast("int")
    inside = F.when(x.between(F.lit(edges[0]), F.lit(edges[-1])), number)
    if not labels:
        return inside
    named = F.lit(labels[-1])
    for i, v in reversed(list(enumerate(labels[:-1]))):
        named = F.when(inside == i, F.lit(v)).otherwise(named)
    return F.when(inside.isNotNull(), named)


def equal_width_edges(lo: float, hi: float, n: int) -> list[float]:
    """n right-closed bins; the first edge is moved left by 0.1 % of the range to take in ``lo``."""
    if lo == hi:
        pad = 0.001 * abs(lo) if lo else 0.001
        lo, hi = lo - pad, hi + pad
        return [lo + (hi - lo) * i / n for i in range(n + 1)]
    edges = [lo + (hi - lo) * i / n for i in range(n + 1)]
    edges[-1] = hi
    return [lo - 0.001 * (hi - lo), *edges[1:]]


def bin_edges(df: DataFrame, col: str, method: str = "quantile", n: int = BINS) -> list[float]:
    x = num(df, col)
    if method == "quantile":
        got = quantiles(df, {col: (x, [i / n for i in range(n + 1)])})[col]
        return [] if got[0] is None else sorted(set(got))
    if method == "uniform":
        lo, hi = df.agg(F.min(x), F.max(x)).first()
        return [] if lo is None else equal_width_edges(lo, hi, n)
    if method == "kmeans":
        return kmeans_edges(df, col, n)
    raise ValueError(f"unknown method: {method}")


def _best_split(w, s, t, k: int) -> list[int]:
    """Ends of the ``k`` runs of pieces (weight, sum, sum of squares) with the least sum of squares within runs: dynamic programme over
    the number of pieces, whose best last cut never moves left."""
    import numpy as np

    w, s, t = (np.concatenate([[0.0], np.cumsum(x)]) for x in (w, s, t))

    def cost(i, j):  # pieces i to j - 1
        n = w[j] - w[i]
        return (t[j] - t[i]) - np.divide((s[j] - s[i]) ** 2, n, out=np.zeros_like(n), where=n > 0)

    m = len(w) - 1
    best, cut = cost(np.zeros(m + 1, int), np.arange(m + 1)), []
    for _ in range(1, k):
        new, at, low = np.full(m + 1, np.inf), np.zeros(m + 1, int), 0
        for j in range(1, m + 1):
            i = np.arange(low, j)
            total = best[i] + cost(i, np.full(len(i), j))
            at[j] = low = int(i[total.argmin()])
            new[j] = total.min()
        best = new
        cut.append(at)
    ends = [m]
    for at in reversed(cut):
        ends.append(int(at[ends[-1]]))
    return [e for e in ends[::-1] if e > 0]


def kmeans_edges(df: DataFrame, col: str, n: int = BINS, pieces: int = KMEANS_PIECES) -> list[float]:
    """Edges midway between the ordered centres of the 1-D k-means with the least sum of squares.

    The optimum is a cut of the ordered values.  Up to ``pieces`` distinct values it is found exactly; beyond that the dynamic programme runs
    over ranges of the values, and those next to its cuts are cut finer, until single values lie on both sides of every cut."""
    x = df.select(num(df, col).alias("v")).dropna()
    values = materialise(x.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("w")), "values")
    lo, hi, distinct, middle = values.agg(F.min("v"), F.max("v"), F.count(F.lit(1)), F.sum(F.col("v") * F.col("w")) / F.sum("w")).first()
    if not distinct:
        return []
    d, cuts = F.col("v") - F.lit(middle), None
    if distinct > pieces:
        cuts = sorted(set(values.agg(F.percentile_approx("v", F.array(*[F.lit(i / pieces) for i in range(1, pieces)]), F.lit(10 * pieces))).first()[0]))
    for _ in range(KMEANS_ROUNDS):
        place = F.col("v") if cuts is None else F.col("range_id")
        ranged = values if cuts is None else with_range(values, "v", cuts)
        rows = ranged.groupBy(place.alias("r")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * d).alias("s"), F.sum(F.col("w") * d * d).alias("t"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        rows = sorted(rows.collect(), key=lambda r: r["lo"])  # at most a few times ``pieces`` rows
        ends = _best_split(*[[r[c] for r in rows] for c in ("w", "s", "t")], min(n, len(rows)))
        near = [(rows[e - 1], rows[e]) for e in ends[:-1]]
        if all(a["lo"] == a["hi"] and b["lo"] == b["hi"] for a, b in near):
            break
        fine = max(8, pieces // (2 * len(near)))
        cuts = sorted({*cuts, *(a["lo"] + (b["hi"] - a["lo"]) * i / fine for a, b in near for i in range(1, fine))})
        cuts = [c for c in cuts if lo < c <= hi]
    starts = [0, *ends[:-1]]
    centres = [middle + sum(r["s"] for r in rows[i:j]) / sum(r["w"] for r in rows[i:j]) for i, j in zip(starts, ends)]
    return [lo, *[(a + b) / 2 for a, b in zip(centres, centres[1:])], hi]


def bin(df: DataFrame, col: str, method: str = "quantile", n: int = BINS, labels: list[str] | None = None,
        out: str | None = None) -> DataFrame:
    edges = bin_edges(df, col, method, n)
    out = out or f"{col}_binned"
    if len(edges) == 1:
        edges = [edges[0], edges[0]]
    if not edges:
        return df.withColumn(out, F.lit(None).cast("string" if labels else "int"))
    if labels is not None and len(labels) != len(edges) - 1:
        raise ValueError(f"{len(labels)} labels for {len(edges) - 1} bins")
    return df.withColumn(out, bin_column(num(df, col), edges, labels))


def boxcox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, up).when(x < 0, down)


def best_lambda(df: DataFrame, x: Column, family, log_jacobian: Column, passes: int = 4, points: int = 15) -> float:
    """Maximum-likelihood power: the profile likelihood of a whole grid is one aggregate, and each
    further pass searches one step to either side of the best point (final step below 0.001)."""
    lo, hi = LAMBDA_RANGE
    best = 1.0
    for _ in range(passes):
        grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
        grid = [0.0 if abs(g) < 1e-12 else g for g in grid]
        s = collect_stats(df, {"n": F.count(x), "j": F.sum(log_jacobian),
                               **{i: F.var_pop(family(x, g)) for i, g in enumerate(grid)}})
        scores = [(-0.5 * s["n"] * math.log(s[i]) + (g - 1) * s["j"], -abs(g - 1), g)
                  for i, g in enumerate(grid) if s[i] and s[i] > 0]
        if not scores:
            return 1.0
        best = max(scores)[2]
        step = (hi - lo) / (points - 1)
        lo, hi = best - step, best + step
    return best


def transform(df: DataFrame, col: str, method: str, out: str | None = None, lam: float | None = None
              ) -> tuple[DataFrame, dict]:
    """log, sqrt, boxcox or zscore of one column with the offsets that keep the argument valid.
    Returns the table and the fitted parameters."""
    x = num(df, col)
    out = out or f"{col}_{method}"
    if method == "zscore":
        m, s = df.agg(F.avg(x), F.stddev(x)).first()
        y = F.when(x.isNotNull(), F.lit(0.0)) if not s else (x - F.lit(m)) / F.lit(s)
        return df.withColumn(out, y), {"mean": m, "std": s}
    lo = df.agg(F.min(x)).first()[0]
    lo = 0.0 if lo is None else lo
    if method == "sqrt":
        shift = -lo if lo < 0 else 0.0
        return df.withColumn(out, F.sqrt(x + F.lit(shift))), {"offset": shift}
    shift = 1.0 - lo if lo <= 0 else 0.0
    if method == "log":
        return df.withColumn(out, F.log(x + F.lit(shift) + 1)), {"offset": shift}
    if method == "boxcox":
        y = x + F.lit(shift)
        lam = best_lambda(df, y, boxcox, F.log(y)) if lam is None else lam
        return df.withColumn(out, boxcox(y, lam)), {"offset": shift, "lambda": lam}
    raise ValueError(f"unknown method: {method}")
