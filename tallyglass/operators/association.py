"""Correlation, contingency and mutual information between columns.

Results are long tables (col_a, col_b, value), each unordered pair once."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import cells, collect_stats, columns_of, num, q, ratio, records, resolve, spread, tidy
from ..functions.keyed import attach, long_counts
from ..functions.ordered import isolate, running_totals, with_range
from ..functions.quantiles import quantiles
from ..functions.special import digamma
from ..functions.store import materialise

# fixed values: association settings
CRAMER_LEVELS = (2, 80)
LEAKAGE = 0.99
STRONG = 0.8
TOP_PAIRS = 10
MI_BINS = 10
NONLINEAR_MI, NONLINEAR_R = 0.3, 0.3
KNN_NEIGHBOURS = 3
KNN_GRID = 1 << 30  # steps of a standard deviation: distances and ranges are whole numbers
MIN_MI_ROWS = 10
KENDALL_BLOCK_ROWS = 500_000
KENDALL_RANGES = 1_000  # the range contingency table has at most this many rows and columns


def _pairs(cols: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def _pair_rows(df: DataFrame, pairs, x, base: dict | None = None) -> DataFrame:
    """(col_a, col_b, n, r).  First the means, then plain sums of the centred values: sums of columns
    without nulls are shared by all their pairs, and the generated code stays small."""
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    base = base or collect_stats(df, {"n": F.count(F.lit(1)), **{(c, k): f(x[c]) for c in cols
                              for k, f in (("n", F.count), ("m", F.avg), ("lo", F.min), ("hi", F.max))}})
    at = {c: F.col(f"_c{i}") for i, c in enumerate(cols)}
    data = df.select(*[(x[c] - F.lit(base[c, "m"] or 0.0)).alias(f"_c{i}") for i, c in enumerate(cols)])
    whole = {c: base[c, "n"] == base["n"] for c in cols}
    flat = {c for c in cols if base[c, "lo"] == base[c, "hi"]}
    rows = []
    for a, b in pairs:
        va = at[a] if whole[b] else F.when(at[b].isNotNull(), at[a])
        vb = at[b] if whole[a] else F.when(at[a].isNotNull(), at[b])
        n = F.count(at[a] if whole[b] else va)
        d = n.cast("double")
        cov = F.sum(at[a] * at[b]) - F.sum(va) * F.sum(vb) / d
        va2, vb2 = F.sum(va * va) - F.sum(va) * F.sum(va) / d, F.sum(vb * vb) - F.sum(vb) * F.sum(vb) / d
        r = F.when((n > 0) & (va2 > 0) & (vb2 > 0), cov / (F.sqrt(va2) * F.sqrt(vb2))) if not {a, b} & flat else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), n.alias("n"),
                             F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r")))
    return tidy(data, rows)


def pearson(df: DataFrame, cols=None) -> DataFrame:
    """All pairs from the moments of one scan, pairwise complete; undefined is null."""
    cols = resolve(df, cols, "numeric")
    return _pair_rows(df, _pairs(cols), {c: num(df, c) for c in cols})


def spearman(df: DataFrame, cols=None) -> DataFrame:
    """Pearson correlation of average ranks over the complete rows of each pair.  Columns that miss the same rows share
    one set of ranks; only pairs that miss different rows are ranked over their own complete rows."""
    cols = resolve(df, cols, "numeric")
    x = df.select(*[num(df, c).alias(c) for c in cols])
    pairs = _pairs(cols)
    seen = collect_stats(x, {"n": F.count(F.lit(1)), **{("c", c): F.count(q(c)) for c in cols},
                             **{("k", c): F.approx_count_distinct(q(c), 0.02) for c in cols},
                             **{("p", a, b): F.count_if(q(a).isNotNull() & q(b).isNotNull()) for a, b in pairs}})
    keys = {c: seen["k", c] for c in cols}
    alike: list[list[str]] = []  # columns that miss the same rows
    for c in cols:
        home = next((g for g in alike if seen["c", g[0]] == seen["c", c] == seen["p", g[0], c]), None)
        home.append(c) if home else alike.append([c])
    parts = []
    for group in alike:
        if len(group) > 1:
            rows = x.select(*[q(c) for c in group])
            whole = seen["c", group[0]] == seen["n"]
            parts.append(_rank_correlation(rows if whole else rows.dropna(), group, seen["c", group[0]], keys, True))
    inside = {frozenset(p) for g in alike for p in _pairs(g)}
    parts += [_rank_correlation(x.select(q(a), q(b)).dropna(), [a, b], seen["p", a, b], keys) for a, b in pairs if frozenset((a, b)) not in inside]
    return reduce(DataFrame.unionByName, parts) if parts else _pair_rows(x, [], {})


def _rank_correlation(x: DataFrame, cols: list[str], rows: int, keys: dict[str, int], complete: bool = False) -> DataFrame:
    # the ranks of all columns in one long pass; counts (cuts, range totals and sums read them) and ranks are written once
    counts = materialise(long_counts(x, {c: q(c) for c in cols}).filter(F.col("value").isNotNull()), "rank-counts")
    cum = running_totals(counts, "value", ["n"], group=["column"], rows=sum(keys[c] for c in cols))
    ranks = materialise(cum.select("column", "value", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("rank")), "ranks")
    ranked = x
    for c in cols:
        mine = ranks.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("rank").alias(f"_rank_{c}"))
        ranked = attach(ranked, mine, [c], n_keys=keys[c])
    base = None
    if complete and rows:  # the mean rank is known
        base = {"n": rows, **{(c, k): v for c in cols for k, v in (("n", rows), ("m", (rows + 1) / 2), ("lo", 1), ("hi", keys[c]))}}
    return _pair_rows(ranked, _pairs(cols), {c: q(f"_rank_{c}") for c in cols}, base)


def _inversions(key, x_order, w):
    """Weight of pairs (i before j in ``x_order``) with key[i] > key[j], by splitting on key bits."""
    import numpy as np

    key, w = key[x_order].astype(np.int64), w[x_order].astype(float)
    total, top = 0.0, int(key.max()).bit_length() if len(key) else 0
    for b in range(top - 1, -1, -1):
        group = key >> (b + 1)
        o = np.argsort(group, kind="stable")
        g, bit, ww = group[o], (key[o] >> b) & 1, w[o]
        ones = np.cumsum(ww * bit)
        start = np.r_[True, g[1:] != g[:-1]]
        base = np.where(start, ones - ww * bit, 0.0)
        base = np.maximum.accumulate(np.where(start, base, -np.inf))
        total += float(np.sum(np.where(bit == 0, ww * (ones - base), 0.0)))
    return total


def _concordance(pdf, inner: str | None = None):
    """Concordant minus discordant weight among the rows of one block; with ``inner`` among those that differ in it:
    pairs that share it are counted at once, as keys led by it turn no pair of different ``inner``."""
    import numpy as np

    x, y, w = (pdf[c].to_numpy() for c in ("x", "y", "w"))
    _, yr = np.unique(y, return_inverse=True)
    flipped = yr.max() - yr

    def total(group):
        turned = []
        for key in (flipped, yr):
            _, whole = np.unique(group * (len(yr) + 1) + key, return_inverse=True)
            turned.append(_inversions(whole, np.lexsort((key, x, group)), w))
        return turned[0] - turned[1]

    among = total(np.zeros(len(yr), np.int64))
    return among - total(pdf[inner].to_numpy().astype(np.int64)) if inner else among


def _block_sum(rows: DataFrame, key: str, inner: str | None = None) -> float:
    """Sum of block concordances, without the pairs that share ``inner``.  Blocks with a single x or a single y
    contribute nothing and are left out, so a heavy value never becomes a task of its own."""
    import pandas as pd

    flat = rows.groupBy(F.col(key).alias("_k")).agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    flat = flat.filter("_x0 < _x1 AND _y0 < _y1").select("_k")  # one row per range
    live = rows.join(F.broadcast(flat), F.col(key) == F.col("_k"), "left_semi")

    def block(pdf):
        return pd.DataFrame({"s": [_concordance(pdf, inner)]})

    return live.groupBy(key).applyInPandas(block, "s double").agg(F.sum("s")).first()[0] or 0.0


def kendall(df: DataFrame, cols=None, block_rows: int = KENDALL_BLOCK_ROWS) -> DataFrame:
    """Exact tau-b.  Rows are reduced to weighted (x, y) cells, and both axes are cut into ranges.
    Cell pairs in different x ranges and different y ranges are counted from the range contingency
    table; pairs that share an x or a y range are counted inside that range, and pairs sharing both
    are taken out once, within the y range."""
    import numpy as np

    cols = resolve(df, cols, "numeric")
    spark = df.sparkSession
    out = []
    for a, b in _pairs(cols):
        cells = materialise(df.select(num(df, a).alias("x"), num(df, b).alias("y")).dropna()
                            .groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")), "cells")
        size, n_cells = cells.agg(F.sum("w"), F.count(F.lit(1))).first()
        if not size or size < 2:
            out.append((a, b, int(size or 0), None))
            continue
        ranges = min(KENDALL_RANGES, math.ceil(n_cells / block_rows))
        cut = {}
        for c in ("x", "y"):
            probs = [i / ranges for i in range(1, ranges)]
            cut[c] = isolate(cells.agg(F.percentile_approx(c, F.array(*[F.lit(p) for p in probs]),
                                                           F.lit(20 * ranges))).first()[0]) if probs else []
        rows = with_range(with_range(cells, "x", cut["x"], "bx"), "y", cut["y"], "by")
        s = _block_sum(rows, "bx")
        if ranges > 1:
            s += _block_sum(rows, "by", inner="bx")
            grid = np.zeros((len(cut["x"]) + 1, len(cut["y"]) + 1))
            for r in rows.groupBy("bx", "by").agg(F.sum("w").alias("w")).collect():  # ranges x ranges cells
                grid[r["bx"], r["by"]] = r["w"]
            below = np.cumsum(np.cumsum(grid, 0), 1)
            right = np.cumsum(grid[:, ::-1].cumsum(1)[:, ::-1], 0)
            s += float(np.sum(grid[1:, 1:] * below[:-1, :-1]) - np.sum(grid[1:, :-1] * right[:-1, 1:]))
        ties = {}
        for c in ("x", "y"):
            t = cells.groupBy(c).agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2)).first()[0]
            ties[c] = t
        n0 = size * (size - 1) / 2
        den = math.sqrt((n0 - ties["x"]) * (n0 - ties["y"]))
        out.append((a, b, int(size), s / den if den else None))
    return records(spark, out, "col_a string, col_b string, n bigint, r double")


METHODS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def corr_matrix(df: DataFrame, method: str = "pearson", cols=None) -> DataFrame:
    """(col_a, col_b, r) with undefined correlations as 0, rounded to 3 decimals."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    got = METHODS[method](df, cols)
    return got.select("col_a", "col_b", F.round(F.coalesce("r", F.lit(0.0)), 3).alias("r"))


def top_pairs(df: DataFrame, k: int = TOP_PAIRS, cols=None) -> DataFrame:
    return pearson(df, cols).filter(F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "col_a", "col_b").limit(k)


def leakage(df: DataFrame, limit: float = LEAKAGE, cols=None) -> DataFrame:
    return pearson(df, cols).filter(F.abs("r") > limit)


def strong_pairs(df: DataFrame, limit: float = STRONG, cols=None) -> DataFrame:
    return pearson(df, cols).filter(F.abs("r") >= limit)


def corr_diff(real: DataFrame, synth: DataFrame, cols=None) -> DataFrame:
    """|r_real - r_synth| on the common numeric columns."""
    common = cols or [c for c in columns_of(real, "numeric") if c in columns_of(synth, "numeric")]
    a = pearson(real, common).select("col_a", "col_b", F.coalesce("r", F.lit(0.0)).alias("r_real"))
    b = pearson(synth, common).select("col_a", "col_b", F.coalesce("r", F.lit(0.0)).alias("r_synth"))
    return a.join(F.broadcast(b), ["col_a", "col_b"]).withColumn("diff", F.abs(F.col("r_real") - F.col("r_synth")))


def _pair_counts(df: DataFrame, values: dict, pairs) -> DataFrame:
    """(col_a, col_b, a, b, n) of all pairs in one shuffle."""
    cols = list(values)
    coded = spread(df.select(*[values[c].alias(f"_v{i}") for i, c in enumerate(cols)]))
    at = {c: F.col(f"_v{i}") for i, c in enumerate(cols)}
    cells = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), at[a].alias("a"), at[b].alias("b")) for a, b in pairs])
    return (coded.select(F.inline(cells)).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
            .groupBy("col_a", "col_b", "a", "b").agg(F.count(F.lit(1)).alias("n")))


def _with_margins(counts: DataFrame) -> DataFrame:
    """Row, column and grand totals of each pair's (bounded) contingency table."""
    pair = ["col_a", "col_b"]
    return counts.select(
        "*", F.sum("n").over(Window.partitionBy(*pair, "a")).alias("n_a"),
        F.sum("n").over(Window.partitionBy(*pair, "b")).alias("n_b"),
        F.sum("n").over(Window.partitionBy(*pair)).alias("total"))


def categorical_levels(df: DataFrame, cols, lo: int, hi: int) -> list[str]:
    """Columns with lo..hi distinct values: sketched first, counted exactly when the sketch is near."""
    rough = collect_stats(df, {c: F.approx_count_distinct(q(c), 0.02) for c in cols})
    near = [c for c in cols if rough[c] <= 1.2 * hi + 5]
    exact = collect_stats(df, {c: F.count_distinct(q(c)) for c in near})
    return [c for c in near if lo <= exact[c] <= hi]


def cramers_v(df: DataFrame, cols=None) -> DataFrame:
    """Bias-corrected Cramer's V of categorical columns with 2..80 distinct values."""
    cols = categorical_levels(df, resolve(df, cols, "categorical"), *CRAMER_LEVELS)
    pairs = _pairs(cols)
    if not pairs:
        return records(df.sparkSession, [], "col_a string, col_b string, chi2 double, v double")
    t = _with_margins(_pair_counts(df, {c: q(c).cast("string") for c in cols}, pairs))
    n, o = F.col("total").cast("double"), F.col("n").cast("double")
    # A 2 x 2 table needs Yates' correction: |ad - bc| is the same from each of its cells, and its
    # margins are the smallest and largest row and column totals.
    agg = t.groupBy("col_a", "col_b").agg(
        F.max("total").cast("double").alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"),
        (F.sum(o * o / (F.col("n_a").cast("double") * F.col("n_b"))) - 1).alias("_phi"),
        F.max(F.abs(n * o - F.col("n_a").cast("double") * F.col("n_b"))).alias("_adbc"),
        (F.min("n_a") * F.max("n_a")).cast("double").alias("_ma"), (F.min("n_b") * F.max("n_b")).cast("double").alias("_mb"))
    return _cramer(agg)


def _cramer(agg: DataFrame) -> DataFrame:
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    plain = n * F.greatest(F.col("_phi"), F.lit(0.0))
    yates = ratio(n * F.pow(F.greatest(F.col("_adbc") - n / 2, F.lit(0.0)), F.lit(2.0)), F.col("_ma") * F.col("_mb"))
    chi2 = F.when((r == 2) & (k == 2), yates).otherwise(plain)
    t = agg.select("col_a", "col_b", "n", "r", "k", chi2.alias("chi2"))
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (k - 1) * (r - 1) / (n - 1))
    rr, kk = r - F.pow(r - 1, F.lit(2.0)) / (n - 1), k - F.pow(k - 1, F.lit(2.0)) / (n - 1)
    return t.select("col_a", "col_b", "chi2", F.coalesce(F.sqrt(ratio(phi, F.least(kk - 1, rr - 1))), F.lit(0.0)).alias("v"))


def crosstab(df: DataFrame, a: str, b: str, max_cells: int = 1_000_000) -> DataFrame:
    """(a, b, n) with zero cells; refused when the full grid would be too large."""
    counts = df.filter(q(a).isNotNull() & q(b).isNotNull()).groupBy(q(a).alias("a"), q(b).alias("b")).agg(
        F.count(F.lit(1)).alias("n"))
    na, nb = df.agg(F.approx_count_distinct(q(a), 0.02), F.approx_count_distinct(q(b), 0.02)).first()
    if na * nb > max_cells:
        raise ValueError(f"grid of about {na * nb} cells exceeds {max_cells}")
    levels = counts.groupBy().agg(F.collect_set("a").alias("_a"), F.collect_set("b").alias("_b"))  # bounded by the check
    grid = levels.select(F.explode("_a").alias("a"), "_b").select("a", F.explode("_b").alias("b"))
    return grid.join(counts, ["a", "b"], "left").fillna(0, ["n"])


def mi_matrix(df: DataFrame, cols=None, bins: int = MI_BINS, normalize: bool = True, method: str = "binned") -> DataFrame:
    """Mutual information (nats) of numeric pairs.

    ``binned``: quantile bins, all rows, one shuffle of at most bins^2 cells per pair.
    ``knn``: nearest-neighbour estimator (k = 3, largest axis distance) on all complete rows."""
    cols = resolve(df, cols, "numeric")
    if len(cols) < 2:
        raise ValueError("at least two numeric columns are needed")
    pairs = _pairs(cols)
    if method == "knn":
        got = _knn_mi(df, cols, pairs)
    elif method == "binned":
        got = _binned_mi(df, cols, pairs, bins)
    else:
        raise ValueError(f"unknown method: {method}")
    if not normalize:
        return got
    top = got.agg(F.max("mi").alias("_top"))
    return got.withColumn("_one", F.lit(1)).join(F.broadcast(top.withColumn("_one", F.lit(1))), "_one").select(
        "col_a", "col_b", F.coalesce(ratio(F.col("mi"), F.col("_top")), F.lit(0.0)).alias("mi"))


def _binned_mi(df, cols, pairs, bins):
    from .remediation import bin_column

    edges = quantiles(df, {c: (num(df, c), [i / bins for i in range(bins + 1)]) for c in cols})
    codes = {}
    for c in cols:
        e = sorted(set(edges[c])) if edges[c][0] is not None else []
        if len(e) == 1:
            codes[c] = F.when(num(df, c).isNotNull(), F.lit(0))
        else:
            codes[c] = bin_column(num(df, c), e) if e else F.lit(None).cast("int")
    binned = df.select(*[codes[c].alias(c) for c in cols])
    t = _with_margins(_pair_counts(binned, {c: q(c) for c in cols}, pairs))
    n, o = F.col("total").cast("double"), F.col("n").cast("double")
    mi = F.sum(o / n * F.log(o * n / (F.col("n_a").cast("double") * F.col("n_b"))))
    return t.groupBy("col_a", "col_b").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))


def _digamma_next(n):
    """digamma(n + 1) of a whole number from 0, as a column."""
    small = [digamma(i + 1.0) for i in range(5)]
    x = (n + 1).cast("double")
    f = 1 / (x * x)
    large = F.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))
    return F.when(n < len(small), F.element_at(F.array(*[F.lit(v) for v in small]), F.least(n, F.lit(len(small) - 1)).cast("int") + 1)).otherwise(large)


def _within(points: DataFrame, counts: DataFrame) -> DataFrame:
    """(pair, id, column, inside): how many rows are nearer than ``eps`` to ``value`` along ``column``, itself included.

    ``points``: pair, id, column, value, eps; ``counts``: column, value, n; whole numbers.  The ends of all ranges are put among the
    values as values of count 0; one running total over ranges of the order answers them."""
    ends = F.array(F.struct((F.col("value") + F.col("eps") - 1).alias("end"), F.lit(1).alias("sign")), F.struct((F.col("value") - F.col("eps")).alias("end"), F.lit(-1).alias("sign")))
    asked = points.select("pair", "id", "column", F.inline(ends))
    both = counts.unionByName(asked.select("column", F.col("end").alias("value"), F.lit(0).cast("long").alias("n")))
    freq = materialise(both.groupBy("column", "value").agg(F.sum("n").alias("n")), "range-ends")
    upto = running_totals(freq, "value", ["n"], group=["column"]).select(F.col("column").alias("_c"), F.col("value").alias("_v"), "cum_n")
    found = asked.join(upto, (F.col("column") == F.col("_c")) & (F.col("end") == F.col("_v")))
    return found.groupBy("pair", "id", "column").agg(F.sum(F.col("sign") * F.col("cum_n")).alias("inside"))


def _knn_mi(df, cols, pairs):
    """k-nearest-neighbour estimator: digamma(k) + digamma(n) - mean(digamma(n_x + 1) + digamma(n_y + 1)), where n_x and n_y count the rows
    that are nearer on one axis than the k-th neighbour of a row is on its farther axis.  Values are rounded to ``KNN_GRID`` steps of a
    standard deviation, so equal distances stay equal; rows that repeat are one point with a weight."""
    from .neighbours import neighbours

    x = df.select(*[num(df, c).alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
    s = collect_stats(x, {"n": F.count(F.lit(1)), **{(i, k): f(f"x{i}") for i in range(len(cols)) for k, f in (("m", F.avg), ("s", F.stddev_pop))}})
    n = s["n"]
    if n < MIN_MI_ROWS:
        raise ValueError(f"at least {MIN_MI_ROWS} complete rows are needed")
    steps = [F.round((F.col(f"x{i}") - F.lit(s[i, "m"])) / F.lit(s[i, "s"] or 1.0) * KNN_GRID).cast("long").alias(f"x{i}") for i in range(len(cols))]
    grid = materialise(x.select(*steps), "grid")
    place, asked = {c: i for i, c in enumerate(cols)}, None
    for k, (a, b) in enumerate(pairs):
        u, v = (F.col(f"x{place[c]}") for c in (a, b))
        points = materialise(grid.groupBy(F.array(u, v).alias("at")).agg(F.count(F.lit(1)).cast("double").alias("w")).withColumn("id", F.monotonically_increasing_id())
                             .withColumn("p", F.col("at").cast("array<double>")), "points")
        near = neighbours(points.select("id", "p", "w"), points.select("id", "p", (F.col("w") - 1).alias("self")), KNN_NEIGHBOURS, same=True, norm="max")
        reach = near.groupBy(F.col("id").alias("of")).agg(F.max("kdist").cast("long").alias("eps"))
        # a point with more than k copies has no neighbours listed: its distance is 0
        known = points.join(reach, F.col("id") == F.col("of"), "left").withColumn("eps", F.coalesce("eps", F.lit(0).cast("long")))
        axes = F.array(*[F.struct(F.lit(place[c]).alias("column"), F.element_at("at", i + 1).alias("value")) for i, c in enumerate((a, b))])
        part = known.select(F.lit(k).alias("pair"), "id", "w", "eps", F.inline(axes))
        asked = part if asked is None else asked.unionByName(part)
    asked = materialise(asked, "ranges")
    counts = cells(grid, {i: F.col(f"x{i}") for i in range(len(cols))}).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    inside = _within(asked.select("pair", "id", "column", "value", "eps"), counts)
    weighed = inside.join(asked.select("pair", "id", "column", "w"), ["pair", "id", "column"])
    total = weighed.groupBy("pair").agg(F.sum(F.col("w") * _digamma_next(F.greatest(F.col("inside") - 1, F.lit(0)))).alias("t"))
    names = records(df.sparkSession, [(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, col_a string, col_b string")
    mi = F.greatest(F.lit(digamma(float(KNN_NEIGHBOURS)) + digamma(float(n))) - F.col("t") / n, F.lit(0.0))
    return total.join(F.broadcast(names), "pair").select("col_a", "col_b", mi.alias("mi"))


def top_mi(df: DataFrame, k: int = TOP_PAIRS, **kw) -> DataFrame:
    return mi_matrix(df, **kw).orderBy(F.desc("mi"), "col_a", "col_b").limit(k)


def nonlinear_pairs(df: DataFrame, mi_limit: float = NONLINEAR_MI, r_limit: float = NONLINEAR_R, **kw) -> DataFrame:
    """Pairs with high mutual information and low |r|, widest gap first."""
    mi = mi_matrix(df, **kw)
    r = pearson(df, kw.get("cols")).select("col_a", "col_b", F.abs(F.coalesce("r", F.lit(0.0))).alias("abs_r"))
    return (mi.join(F.broadcast(r), ["col_a", "col_b"]).filter((F.col("mi") > mi_limit) & (F.col("abs_r") < r_limit))
            .withColumn("gap", F.col("mi") - F.col("abs_r")).orderBy(F.desc("gap"), "col_a", "col_b"))
