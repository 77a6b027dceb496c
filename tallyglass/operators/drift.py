"""Comparison of two tables: drift tests and real-versus-synthetic reports."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import special
from ..functions.exprs import cells, collect_stats, columns_of, num, q, records
from ..functions.ordered import running_totals
from ..functions.store import materialise
from ..functions.quantiles import SKETCH, _search, quantiles
from .profile import bin_index
from .remediation import bin_column, equal_width_edges

# fixed values: drift settings
KS_ALPHA = CHI_ALPHA = 0.05
PSI_BINS, PSI_MODERATE, PSI_SIGNIFICANT = 10, 0.1, 0.2
PSI_FLOOR = 1e-10
AUC_LIMIT = 0.7
FOREST_MB = 1024  # of node statistics a pass
FIT_ROW_TREES, FIT_TREES = 50_000_000, 10  # training rows times trees of one fit; trees of the smallest fit
TASK_ROWS = 250_000  # training rows of a task
MAX_BINS, BIN_STEPS = 32, 512  # bins of a feature, as the trainer has; quantiles of a table that place them
MAX_CELLS, CELL_ROWS, TASK_TREES = 500_000, 4, 4  # most cells of a forest, training rows per cell at least, trees of a task
EFFECT_KS = 0.2
MIN_VALUES = {"ks": 3, "chi_square": 5, "psi": 10}

MEASURE_SCHEMA = ("method string, column string, statistic double, p_value double, dof int, n_ref bigint, n_cur bigint, "
                  "drift boolean, level string, error string")


def common(ref: DataFrame, cur: DataFrame, cols, *kinds: str) -> list[str]:
    names = [c for c in columns_of(ref, *kinds) if c in columns_of(cur, *kinds)]
    if cols is None:
        return names
    return [c for c in cols if c in names]


def pair_counts(ref: DataFrame, cur: DataFrame, ref_cells: dict[str, Column], cur_cells: dict[str, Column],
                keep_null: bool = False) -> DataFrame:
    """(column, value, ref, cur): both tables reduced to value counts in one shuffle."""
    def one(df, exprs, side):
        flat = cells(df, exprs)
        if not keep_null:
            flat = flat.filter(F.col("value").isNotNull())
        return flat.select("column", "value", F.lit(int(side == "ref")).cast("long").alias("ref"),
                           F.lit(int(side == "cur")).cast("long").alias("cur"))

    both = one(ref, ref_cells, "ref").unionByName(one(cur, cur_cells, "cur"))
    return both.groupBy("column", "value").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))


def ecdf_pairs(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, ref, cur, cum_ref, cum_cur, n_ref, n_cur): both empirical distributions."""
    # written once: the range cuts, the running totals and the sizes all read the value counts
    counts = materialise(pair_counts(ref, cur, {c: num(ref, c) for c in cols}, {c: num(cur, c) for c in cols}), "value-counts")
    cum = running_totals(counts, "value", ["ref", "cur"], group=["column"])
    sizes = counts.groupBy(F.col("column").alias("_column")).agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"))
    return cum.join(F.broadcast(sizes), F.col("column") == F.col("_column")).drop("_column")


def ks_statistics(ref: DataFrame, cur: DataFrame, cols=None) -> DataFrame:
    """(column, n_ref, n_cur, statistic): largest distance of the two empirical distributions."""
    cols = common(ref, cur, cols, "numeric")
    e = ecdf_pairs(ref, cur, cols)
    gap = F.abs(F.try_divide(F.col("cum_ref"), F.col("n_ref")) - F.try_divide(F.col("cum_cur"), F.col("n_cur")))
    return e.groupBy("column").agg(F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), F.max(gap).alias("statistic"))


def ks(ref: DataFrame, cur: DataFrame, cols=None, alpha: float = KS_ALPHA) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test with means and sample deviations of both sides."""
    cols = common(ref, cur, cols, "numeric")
    schema = ("column string, n_ref bigint, n_cur bigint, statistic double, p_value double, drift boolean, "
              "mean_ref double, mean_cur double, std_ref double, std_cur double")
    if not cols:
        return records(ref.sparkSession, [], schema)
    stats = {r["column"]: r for r in ks_statistics(ref, cur, cols).collect()}  # one row per column
    moments = {}
    for side, df in (("ref", ref), ("cur", cur)):
        moments[side] = collect_stats(df, {(c, k): f(num(df, c)) for c in cols for k, f in (("m", F.avg), ("s", F.stddev))})
    rows = []
    for c in cols:
        r = stats.get(c)
        if r is None or min(r["n_ref"], r["n_cur"]) < MIN_VALUES["ks"]:
            continue
        p = special.ks_p_value(r["statistic"], r["n_ref"], r["n_cur"])
        rows.append((c, r["n_ref"], r["n_cur"], r["statistic"], p, p < alpha, moments["ref"][c, "m"],
                     moments["cur"][c, "m"], moments["ref"][c, "s"], moments["cur"][c, "s"]))
    return records(ref.sparkSession, rows, schema)


def chi_cells(ref: DataFrame, cur: DataFrame, cols: list[str], bins: int = 10, null_level: str | None = None) -> DataFrame:
    """Aligned category counts; numeric columns are cut into equal-width bins of the reference."""
    sides = {"ref": {}, "cur": {}}
    numeric = [c for c in cols if c in columns_of(ref, "numeric")]
    ends = collect_stats(ref, {(c, k): f(num(ref, c)) for c in numeric for k, f in (("lo", F.min), ("hi", F.max))})
    for c in cols:
        for side, df in (("ref", ref), ("cur", cur)):
            if c in numeric:
                lo, hi = ends[c, "lo"], ends[c, "hi"]
                edges = equal_width_edges(lo, hi, bins) if lo is not None else None
                sides[side][c] = bin_column(num(df, c), edges).cast("string") if edges else F.lit(None).cast("string")
            else:
                x = q(c).cast("string")
                sides[side][c] = F.coalesce(x, F.lit(null_level)) if null_level is not None else x
    return pair_counts(ref, cur, sides["ref"], sides["cur"])


def chi_statistics(counts: DataFrame) -> DataFrame:
    """(column, n_ref, n_cur, n_categories, dof, statistic) of the 2 x k tables; continuity-corrected at one
    degree of freedom.  Margins are joined as one row per column, so categories may be many."""
    sizes = counts.groupBy(F.col("column").alias("_column")).agg(
        F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"), F.count(F.lit(1)).alias("n_categories"))
    t = counts.join(F.broadcast(sizes), F.col("column") == F.col("_column")).drop("_column")
    both = (F.col("ref") + F.col("cur")).cast("double")
    total = (F.col("n_ref") + F.col("n_cur")).cast("double")
    corr = F.when(F.col("n_categories") == 2, F.lit(0.5)).otherwise(F.lit(0.0))
    parts = []
    for side in ("ref", "cur"):
        e = both * F.col("n_" + side) / total
        d = F.abs(F.col(side) - e)
        parts.append(F.try_divide(F.pow(d - F.least(corr, d), F.lit(2.0)), e))
    return t.groupBy("column").agg(
        F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), F.max("n_categories").alias("n_categories"),
        (F.max("n_categories") - 1).cast("int").alias("dof"), F.sum(parts[0] + parts[1]).alias("statistic"))


def chi_square(ref: DataFrame, cur: DataFrame, cols=None, bins: int = 10, alpha: float = CHI_ALPHA,
               null_level: str | None = None) -> DataFrame:
    cols = common(ref, cur, cols, "categorical") if cols is None else common(ref, cur, cols, "categorical", "numeric", "datetime")
    schema = ("column string, n_ref bigint, n_cur bigint, n_categories bigint, dof int, statistic double, p_value double, drift boolean")
    if not cols:
        return records(ref.sparkSession, [], schema)
    rows = []
    for r in chi_statistics(chi_cells(ref, cur, cols, bins, null_level)).collect():  # one row per column
        if min(r["n_ref"], r["n_cur"]) < MIN_VALUES["chi_square"] or r["n_categories"] < 2:
            continue
        p = special.chi2_sf(r["statistic"], r["dof"])
        rows.append((r["column"], r["n_ref"], r["n_cur"], r["n_categories"], r["dof"], r["statistic"], p, p < alpha))
    return records(ref.sparkSession, rows, schema)


def reference_edges(ref: DataFrame, cols: list[str], bins: int = PSI_BINS) -> dict[str, list[float]]:
    """Quantile edges of the reference; equal-width edges for a column too tied to cut."""
    got = quantiles(ref, {c: (num(ref, c), [i / bins for i in range(bins + 1)]) for c in cols})
    edges = {}
    for c in cols:
        if got[c][0] is None:
            continue
        e = sorted(set(got[c]))
        edges[c] = e if len(e) > 1 else equal_width_edges(e[0], e[0], bins)
    return edges


def psi(ref: DataFrame, cur: DataFrame, cols=None, bins: int = PSI_BINS) -> DataFrame:
    """Population stability index on reference quantile bins (proportions of in-range values)."""
    cols = common(ref, cur, cols, "numeric")
    schema = "column string, n_ref bigint, n_cur bigint, n_bins int, psi double, drift boolean, level string"
    if not cols:
        return records(ref.sparkSession, [], schema)
    n = {s: collect_stats(df, {c: F.count(num(df, c)) for c in cols}) for s, df in (("ref", ref), ("cur", cur))}
    edges = reference_edges(ref, cols, bins)
    keep = [c for c in cols if min(n["ref"][c], n["cur"][c]) >= MIN_VALUES["psi"] and c in edges]
    if not keep:
        return records(ref.sparkSession, [], schema)
    binned = pair_counts(ref, cur, {c: bin_column(num(ref, c), edges[c]) for c in keep},
                         {c: bin_column(num(cur, c), edges[c]) for c in keep})
    sizes = binned.groupBy(F.col("column").alias("_column")).agg(F.sum("ref").alias("_r"), F.sum("cur").alias("_c"))
    t = binned.join(F.broadcast(sizes), F.col("column") == F.col("_column"))
    r = F.greatest(F.coalesce(F.try_divide(F.col("ref"), F.col("_r")), F.lit(0.0)), F.lit(PSI_FLOOR))
    c = F.greatest(F.coalesce(F.try_divide(F.col("cur"), F.col("_c")), F.lit(0.0)), F.lit(PSI_FLOOR))
    # A bin empty on both sides adds nothing: both proportions sit at the floor.
    out = t.groupBy("column").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))
    counts = records(ref.sparkSession, [(k, n["ref"][k], n["cur"][k], len(edges[k]) - 1) for k in keep],
                     "column string, n_ref bigint, n_cur bigint, n_bins int")
    return out.join(F.broadcast(counts), "column").select(
        "column", "n_ref", "n_cur", "n_bins", "psi", (F.col("psi") >= PSI_SIGNIFICANT).alias("drift"),
        F.when(F.col("psi") < PSI_MODERATE, "none").when(F.col("psi") < PSI_SIGNIFICANT, "moderate")
        .otherwise("significant").alias("level"))


def _measure(df: DataFrame, method: str, statistic: str, p: bool, dof: bool, level: bool) -> DataFrame:
    null = F.lit(None)
    return df.select(
        F.lit(method).alias("method"), "column", F.col(statistic).alias("statistic"),
        (F.col("p_value") if p else null.cast("double")).alias("p_value"), (F.col("dof") if dof else null.cast("int")).alias("dof"),
        "n_ref", "n_cur", "drift", (F.col("level") if level else null.cast("string")).alias("level"),
        null.cast("string").alias("error"))


def analyze(ref: DataFrame, cur: DataFrame, cols=None, methods: list[str] | None = None) -> DataFrame:
    """One row per method and column.  Unknown methods are errors; a failing one becomes an error row."""
    methods = methods or ["ks", "psi"]
    runs = {"ks": lambda: _measure(ks(ref, cur, cols), "ks", "statistic", True, False, False),
            "chi_square": lambda: _measure(chi_square(ref, cur, cols), "chi_square", "statistic", True, True, False),
            "psi": lambda: _measure(psi(ref, cur, cols), "psi", "psi", False, False, True),
            "classifier": lambda: _classifier_rows(ref, cur, cols)}
    unknown = [m for m in methods if m not in runs]
    if unknown:
        raise ValueError(f"unknown methods: {unknown}")
    parts = []
    for m in methods:
        try:
            parts.append(runs[m]())
        except ValueError as exc:  # input that the method refuses; failures of the engine are raised
            parts.append(records(ref.sparkSession, [(m, None, None, None, None, None, None, None, None, type(exc).__name__)],
                                 MEASURE_SCHEMA))
    return reduce(DataFrame.unionByName, parts)


def drifted(measures: DataFrame) -> DataFrame:
    """Drifted columns per method with the number of columns analysed."""
    return measures.groupBy("method").agg(
        F.count("column").alias("n_columns"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("drift"), F.col("column"))))).alias("drifted_columns"))


def _classifier_rows(ref, cur, cols):
    got = drift_classifier(ref, cur, cols)
    top = got.groupBy("auc", "drift", "n_ref", "n_cur").agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("i"), "column"))),
                                         lambda s: s["column"])).alias("column"))
    return top.select(F.lit("classifier").alias("method"), "column", F.col("auc").alias("statistic"),
                      F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("int").alias("dof"), "n_ref", "n_cur", "drift",
                      F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("error"))


def _bin_edges(train: DataFrame, cols: list[str]) -> dict[str, list[float]]:
    """Thresholds per column, placed by the trainer's rule: at most ``MAX_BINS`` bins of about equal weight, both tables
    weighing the same.  The values come from sketches of all training rows, where the trainer samples them."""
    steps = F.split(F.lit(",".join(str(i / BIN_STEPS) for i in range(BIN_STEPS + 1))), ",").cast("array<double>")  # one literal, not hundreds
    got = collect_stats(train, {(c, x): F.when(F.count_if(F.col("label") == x) > 0, F.kll_sketch_get_quantile_double(
        F.kll_sketch_agg_double(F.when(F.col("label") == x, q(c)), F.lit(SKETCH)), steps)) for c in cols for x in (0.0, 1.0)})
    edges = {}
    for c in cols:
        values, n = np.unique(np.concatenate([got[c, x] or [] for x in (0.0, 1.0)]) + 0.0, return_counts=True)
        edges[c] = (values[:-1] / 2 + values[1:] / 2).tolist()
        if len(values) > MAX_BINS:
            stride, sums, kept = n.sum() / MAX_BINS, np.cumsum(n), []
            for i, edge in enumerate(edges[c]):
                target = stride * (len(kept) + 1)
                if abs(sums[i] - target) < abs(sums[i + 1] - target):
                    kept.append(edge)
            edges[c] = kept[:MAX_BINS - 1]
    return edges


def _cells(rows: DataFrame, cols: list[str], n_train: int):
    """(bins, training rows, held-out rows) of the cells that hold rows, counts by label; None where the cells are too many or
    save too little.  A forest that sees features in bins sees no more of the rows than their cell."""
    edges = _bin_edges(rows.filter("_p < 700"), cols)
    keys = [f"b{i}" for i in range(len(cols))]
    binned = rows.select(*[_search(q(c), [math.nextafter(e, math.inf) for e in edges[c]], 0, len(edges[c])).cast("tinyint").alias(b) for b, c in zip(keys, cols)],
                         "label", (F.col("_p") < 700).alias("train"))
    limit = min(MAX_CELLS, n_train // CELL_ROWS)
    if math.prod(len(e) + 1 for e in edges.values()) > limit and binned.agg(F.approx_count_distinct(F.struct(*keys), 0.02)).first()[0] > limit:
        return None
    counts = [F.count_if((F.col("label") == x) & (F.col("train") == t)).alias(f"n{x:.0f}{t}") for t in (True, False) for x in (0.0, 1.0)]
    got = binned.groupBy(*keys).agg(*counts).toPandas().sort_values(keys)  # at most about MAX_CELLS rows
    return got[keys].to_numpy("uint8"), *[got[[f"n0{t}", f"n1{t}"]].to_numpy("int64") for t in (True, False)]


def _gini(w: np.ndarray) -> np.ndarray:
    total = w.sum(-1)
    return 1 - (w * w).sum(-1) / np.where(total > 0, total * total, 1.0)


def _tree(bins: np.ndarray, rows: np.ndarray, weights, depth: int, width: int, rng: np.random.Generator):
    """(votes for label 1 per cell, importances) of one tree, grown as the trainer grows it: a Poisson draw of every row (of a
    cell's rows: one draw of their number), ``width`` random features a node, Gini gain; leaves that agree are joined."""
    drawn = rng.poisson(rows).astype(float)
    live = np.flatnonzero(drawn.sum(1))
    node, size, levels = np.zeros(len(bins), np.int64), 1, []
    for level in range(depth + 1):
        at = node[live]
        own = np.stack([np.bincount(at, drawn[live, k], size) for k in (0, 1)], 1) * weights
        total, impurity = own.sum(1), _gini(own)
        best, feature, cut = np.zeros(size), np.full(size, -1), np.zeros(size, np.int64)
        if level < depth and (impurity > 0).any():
            chosen = rng.random((size, bins.shape[1])).argsort(1).argsort(1) < width
            for f in range(bins.shape[1]):
                hist = np.stack([np.bincount(at * MAX_BINS + bins[live, f], drawn[live, k], size * MAX_BINS).reshape(size, MAX_BINS) for k in (0, 1)], 2)
                left = np.cumsum(hist, 1)
                left, right = left[:, :-1], left[:, -1:] - left[:, :-1]
                both = left.any(2) & right.any(2) & chosen[:, f, None]
                left, right = left * weights, right * weights
                lost = (left.sum(2) * _gini(left) + right.sum(2) * _gini(right)) / np.where(total > 0, total, 1.0)[:, None]
                gain = np.where(both, impurity[:, None] - lost, 0.0)
                top = gain.argmax(1)
                better = gain[np.arange(size), top] > best
                best[better], feature[better], cut[better] = gain[better, top[better]], f, top[better]
        split = feature >= 0
        first = np.where(split, 2 * (np.cumsum(split) - 1), -1)
        levels.append([own, best, feature, cut, first])
        if not split.any():
            break
        live = live[split[at]]
        at = node[live]
        node[live] = first[at] + (bins[live, feature[at]] > cut[at])
        size = 2 * int(split.sum())
    importance = np.zeros(bins.shape[1])
    for (own, best, feature, _, first), below in zip(levels[-2::-1], levels[:0:-1]):
        inner = np.flatnonzero(feature >= 0)
        one, two = first[inner], first[inner] + 1
        agree = (below[2][one] < 0) & (below[2][two] < 0) & ((below[0][one, 1] > below[0][one, 0]) == (below[0][two, 1] > below[0][two, 0]))
        feature[inner[agree]] = -1
        inner = inner[~agree]
        importance += np.bincount(feature[inner], best[inner] * own[inner].sum(1), bins.shape[1])
    votes, node, live = np.zeros(len(bins)), np.zeros(len(bins), np.int64), np.arange(len(bins))
    for own, _, feature, cut, first in levels:
        done = feature[node[live]] < 0
        ends = own[node[live[done]]]
        votes[live[done]] = ends[:, 1] / np.maximum(ends.sum(1), 1e-300)
        live = live[~done]
        at = node[live]
        node[live] = first[at] + (bins[live, feature[at]] > cut[at])
    return votes, importance / importance.sum() if importance.any() else importance


def _cell_forest(spark, cells, weights, trees: int, depth: int, seed: int):
    """(accuracy, AUC, importances) of a forest over cells; tasks grow ``TASK_TREES`` trees each and vote on every cell."""
    import pandas as pd

    bins, rows, held = cells
    width = math.ceil(math.sqrt(bins.shape[1])) if trees > 1 else bins.shape[1]

    def grow(batches):
        for pdf in batches:
            for i in pdf["id"]:
                mine = [_tree(bins, rows, np.asarray(weights), depth, width, np.random.default_rng([seed, k])) for k in range(i, min(i + TASK_TREES, trees))]
                votes, importance = (np.sum(v, axis=0) for v in zip(*mine))
                yield pd.DataFrame({"id": [i], "votes": [votes.tobytes()], "importance": [importance.tobytes()]})

    got = sorted(spark.range(0, trees, TASK_TREES, numPartitions=math.ceil(trees / TASK_TREES)).mapInPandas(grow, "id bigint, votes binary, importance binary").collect())
    votes, importance = (np.sum([np.frombuffer(r[k]) for r in got], axis=0) for k in ("votes", "importance"))
    n = held.sum(0)
    right = held[votes > trees - votes, 1].sum() + held[votes <= trees - votes, 0].sum()
    _, at = np.unique(votes, return_inverse=True)
    no, yes = (np.bincount(at, held[:, k]) for k in (0, 1))
    auc = float((yes * (np.cumsum(no) - no / 2)).sum() / (n[0] * n[1])) if n.all() else 0.0
    return right / n.sum() if n.sum() else None, auc, importance / max(importance.sum(), 1e-300)


def _forest_scores(train: DataFrame, test: DataFrame, trees: int, depth: int, seed: int):
    """(label, prediction, votes) of the test rows, and the importances of the features.

    Training keeps every row with its draws for all trees of a fit, so a forest over many rows is fitted in parts of
    at least ``FIT_TREES`` trees: votes add up, importances are averaged over the trees.  Only a forest of one fit keeps the nodes of the rows between passes.
    A task holds about ``TASK_ROWS`` rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = train.count()
    size = min(trees, max(FIT_TREES, FIT_ROW_TREES // max(n, 1)))
    parts = math.ceil(n / TASK_ROWS)
    spread = parts > train.sparkSession.sparkContext.defaultParallelism  # a scan has about that many tasks
    if spread:
        train = train.repartition(parts).persist()  # every fit reads it three times
    votes, weights = [], 0.0
    for i, at in enumerate(range(0, trees, size)):
        count = min(size, trees - at)
        forest = RandomForestClassifier(numTrees=count, maxDepth=depth, weightCol="weight", seed=seed + i, maxMemoryInMB=FOREST_MB, cacheNodeIds=size == trees,
                                        rawPredictionCol=f"_raw{i}", probabilityCol="", predictionCol="")  # many nodes a pass
        model = forest.fit(train)
        test = model.transform(test)
        votes.append(vector_to_array(f"_raw{i}"))
        weights = weights + count * model.featureImportances.toArray()
    if spread:
        train.unpersist()
    no, yes = (reduce(lambda a, b: a + b, [v[k] for v in votes]) for k in (0, 1))
    return test.select("label", (yes > no).cast("double").alias("prediction"), array_to_vector(F.array(no, yes)).alias("rawPrediction")), weights / trees


def drift_classifier(ref: DataFrame, cur: DataFrame, cols=None, trees: int = 100, depth: int = 10, top: int = 5,
                     seed: int = 42, limit: float = AUC_LIMIT) -> DataFrame:
    """Random forest told to separate the tables: (column, importance) of the strongest columns with the
    held-out accuracy and AUC on each row.  70/30 split per table by row hash; classes weighted to balance.

    Many rows are counted by cells of binned features first and the trees grown over the cells; where that saves nothing
    the trainer's forest is fitted in parts."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    cols = common(ref, cur, cols, "numeric")
    if not cols:
        raise ValueError("no common numeric columns")
    def side(df, label):
        return df.select(*[num(df, c).alias(c) for c in cols]).dropna().withColumn("label", F.lit(float(label)))
    # Equal rows fall on the same side; ids make the split independent of partitioning.
    part = F.pmod(F.xxhash64(*[q(c) for c in cols], "label", F.lit(seed)), F.lit(1000))
    both = materialise(side(ref, 0).unionByName(side(cur, 1)).withColumn("_p", part), "classifier-rows")
    counts = both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_p") < 700).alias("train")).collect()
    n, n_train = {r["label"]: r["n"] for r in counts}, sum(r["train"] for r in counts)
    if len(n) < 2:
        raise ValueError("both tables need complete rows")
    weights = [sum(n.values()) / (2.0 * n[x]) for x in (0.0, 1.0)]
    cells = _cells(both, cols, n_train) if n_train * trees > FIT_ROW_TREES else None
    if cells:
        acc, auc, best = _cell_forest(both.sparkSession, cells, weights, trees, depth, seed)
    else:
        weight = F.when(F.col("label") == 0.0, weights[0]).otherwise(weights[1])
        rows = VectorAssembler(inputCols=cols, outputCol="features").transform(both.withColumn("weight", weight)).select("features", "label", "weight", "_p")
        train, test = rows.filter("_p < 700"), rows.filter("_p >= 700")
        scored, best = _forest_scores(train, test, trees, depth, seed)
        scored = materialise(scored, "classifier-scores")
        auc = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(scored)
        acc = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    best = sorted(zip(best, cols), reverse=True)[:top]
    return records(ref.sparkSession, [(c, float(i), float(acc), float(auc), auc >= limit, n[0.0], n[1.0]) for i, c in best],
                   "column string, importance double, accuracy double, auc double, drift boolean, n_ref bigint, n_cur bigint")


# ---- real versus synthetic -------------------------------------------------


def compare_columns(real: DataFrame, synth: DataFrame, cols=None) -> DataFrame:
    """Mean, std and KS distance per numeric column."""
    return ks(real, synth, cols).select("column", F.col("mean_ref").alias("mean_real"), F.col("mean_cur").alias("mean_synth"),
                                        F.col("std_ref").alias("std_real"), F.col("std_cur").alias("std_synth"),
                                        F.col("statistic").alias("ks"))


def drift_flags(real: DataFrame, synth: DataFrame, cols=None, skip: list[str] | None = None, limit: float = EFFECT_KS) -> DataFrame:
    """Columns by effect size: KS above ``limit``; id columns are skipped."""
    cols = [c for c in common(real, synth, cols, "numeric") if c not in (skip or [])]
    return ks(real, synth, cols).select("column", "statistic", "p_value", (F.col("statistic") > limit).alias("drift"))


NULL_LEVEL = "___NA___"  # fixed value: category that stands for missing


def similarity(real: DataFrame, synth: DataFrame, cols=None) -> DataFrame:
    """(column, type, statistic, p_value): KS for numeric columns, chi-square for the others with
    missing as a category of its own."""
    numeric = common(real, synth, cols, "numeric")
    other = common(real, synth, cols, "categorical", "datetime")
    parts = []
    if numeric:
        parts.append(ks(real, synth, numeric).select("column", F.lit("numeric").alias("type"), "statistic", "p_value"))
    if other:
        stats = chi_statistics(chi_cells(real, synth, other, null_level=NULL_LEVEL)).collect()  # one row per column
        parts.append(records(real.sparkSession, [
            (r["column"], "categorical", r["statistic"], special.chi2_sf(r["statistic"], r["dof"]) if r["dof"] else 1.0)
            for r in stats], "column string, type string, statistic double, p_value double"))
    if not parts:
        raise ValueError("no common columns")
    return reduce(DataFrame.unionByName, parts)


def compare_hist(real: DataFrame, synth: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """(bin, lo, hi, source, n, density) on bins shared by both tables."""
    both = _both(real, synth, [col])
    lo, hi = both.agg(F.min(q(col)), F.max(q(col))).first()
    if lo is None:
        return records(real.sparkSession, [], "bin int, lo double, hi double, source string, n bigint, density double")
    width = (hi - lo) / bins if hi > lo else 1.0
    seen = both.select("source", bin_index(q(col), lo, hi, bins).alias("bin")).dropna().groupBy("source", "bin").agg(
        F.count(F.lit(1)).alias("n"))
    sizes = seen.groupBy(F.col("source").alias("_s")).agg(F.sum("n").alias("_n"))
    edge = F.lit(lo) + F.col("bin") * F.lit(width)
    return seen.join(F.broadcast(sizes), F.col("source") == F.col("_s")).select(
        "bin", edge.alias("lo"), (edge + F.lit(width)).alias("hi"), "source", "n",
        (F.col("n") / (F.col("_n") * F.lit(width))).alias("density"))


def compare_box(real: DataFrame, synth: DataFrame, col: str) -> DataFrame:
    from .profile import box_stats

    return box_stats(real, [col]).withColumn("source", F.lit("real")).unionByName(
        box_stats(synth, [col]).withColumn("source", F.lit("synthetic")))


def compare_pairs(real: DataFrame, synth: DataFrame, a: str, b: str, bins: int = 20) -> DataFrame:
    """Two-dimensional histogram (bin_a, bin_b, source, n) on shared bins."""
    both = _both(real, synth, [a, b])
    la, ha, lb, hb = both.agg(F.min(q(a)), F.max(q(a)), F.min(q(b)), F.max(q(b))).first()
    if la is None or lb is None:
        return records(real.sparkSession, [], "source string, bin_a int, bin_b int, n bigint")
    return both.select("source", bin_index(q(a), la, ha, bins).alias("bin_a"), bin_index(q(b), lb, hb, bins).alias("bin_b")
                       ).dropna().groupBy("source", "bin_a", "bin_b").agg(F.count(F.lit(1)).alias("n"))


def _both(real, synth, cols):
    parts = [df.select(*[num(df, c).alias(c) for c in cols], F.lit(s).alias("source"))
             for df, s in ((real, "real"), (synth, "synthetic"))]
    return parts[0].unionByName(parts[1])


def overview(real: DataFrame, synth: DataFrame) -> DataFrame:
    """(metric, real, synthetic, match) for the size and completeness of both tables."""
    from .profile import duplicate_rows, kpis

    out = []
    sides = []
    for df in (real, synth):
        k = kpis(df).select("n_rows", "n_columns", "pct_missing", "n_numeric", "n_categorical").first()
        d = duplicate_rows(df).select("n_duplicates").first()
        sides.append([float(v) for v in (*k, *d)])
    for name, a, b in zip(("rows", "columns", "pct_missing", "numeric_columns", "categorical_columns", "duplicate_rows"), *sides):
        out.append((name, a, b, a == b))
    return records(real.sparkSession, out, "metric string, real double, synthetic double, match boolean")
