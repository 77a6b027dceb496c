"""Isolation forest: trees grown on small hashed subsamples, rows scored in place."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import q, resolve, spread
from ..functions.quantiles import one_column
from ..functions.store import materialise
from .neighbours import CONTAMINATION, _matrix, standardised

# fixed values: detector defaults
TREES, SUBSAMPLE, MIN_ROWS = 100, 256, 10
EULER = 0.5772156649015329


def path_norm(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng, limit: int):
    """Node arrays (dim, cut, left, right, depth + rest path) of one random tree."""
    dim, cut, left, right, path = [], [], [], [], []

    def node(rows, depth):
        i = len(dim)
        for a, v in ((dim, -1), (cut, 0.0), (left, -1), (right, -1), (path, 0.0)):
            a.append(v)
        spread = rows.max(0) - rows.min(0) if len(rows) > 1 else np.zeros(x.shape[1])
        live = np.nonzero(spread > 0)[0]
        if depth >= limit or not len(live):
            path[i] = depth + path_norm(len(rows))
            return i
        d = int(rng.choice(live))
        c = float(rng.uniform(rows[:, d].min(), rows[:, d].max()))
        low = rows[:, d] <= c
        dim[i], cut[i] = d, c
        left[i], right[i] = node(rows[low], depth + 1), node(rows[~low], depth + 1)
        return i

    node(x, 0)
    return dim, cut, left, right, path


def forest(rows: DataFrame, key: list[str], trees: int, seed: int) -> list[tuple]:
    """Trees as arrays.  A pooled hash sample (bounded) feeds one subsample of 256 rows per tree."""
    import pandas as pd

    n = rows.count()
    unit = lambda salt: F.xxhash64(*[q(c) for c in key], salt).cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)
    pool_share = min(1.0, 4.0 * trees * SUBSAMPLE / n)
    pool = rows.filter(unit(F.lit(-1 - seed)) <= F.lit(pool_share)).select(*[q(c) for c in key], "p")
    share = min(1.0, 1.5 * SUBSAMPLE / (n * pool_share))
    picks = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn(
        "u", unit(F.col("tree") + F.lit(seed))).filter(F.col("u") <= F.lit(share)).select("tree", "u", "p").repartition(
        min(trees, rows.sparkSession.sparkContext.defaultParallelism), "tree")

    def grow(key_, pdf):
        pdf = pdf.sort_values("u").head(SUBSAMPLE)
        x = _matrix(pdf["p"])
        dim, cut, left, right, path = _grow(x, np.random.default_rng([seed, int(key_[0])]), math.ceil(math.log2(max(len(x), 2))))
        return pd.DataFrame({"tree": [key_[0]], "size": [len(x)], "dim": [dim], "cut": [cut], "left": [left], "right": [right], "path": [path]})

    got = picks.groupBy("tree").applyInPandas(grow, "tree int, size int, dim array<int>, cut array<double>, left array<int>, "
                                                    "right array<int>, path array<double>").orderBy("tree").collect()  # trees, not rows
    return [tuple(np.array(r[c]) for c in ("dim", "cut", "left", "right", "path")) + (r["size"],) for r in got]


def isolation_forest(df: DataFrame, key: list[str], cols=None, trees: int = TREES, contamination: float = CONTAMINATION,
                     seed: int = 42) -> DataFrame:
    """Complete rows with ``score`` (0..1, high is odd) and ``iforest_outlier``: scores above the
    (1 - contamination) quantile.  ``key`` identifies a row and makes the subsamples reproducible."""
    cols = resolve(df, cols, "numeric")
    rows, _ = standardised(df, cols)
    if rows.count() < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} complete rows are needed")
    grown = forest(rows, key, trees, seed)
    norm = np.mean([path_norm(t[5]) for t in grown]) or 1.0

    def score(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["p"])
            depth = np.zeros(len(x))
            every = np.arange(len(x))
            for dim, cut, left, right, path, _ in grown:
                at = np.zeros(len(x), int)
                live = every
                while len(live):
                    d = dim[at[live]]
                    live = live[d >= 0]
                    if not len(live):
                        break
                    low = x[live, dim[at[live]]] <= cut[at[live]]
                    at[live] = np.where(low, left[at[live]], right[at[live]])
                depth += path[at]
            out = pdf.drop(columns=["p"])
            out["score"] = 2.0 ** (-(depth / len(grown)) / norm)
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "p") + ", score double"
    # The cut needs the scores alone: a lean pass over the features writes 8 bytes per row.
    scores = materialise(spread(rows.select("p")).mapInPandas(score, "score double"), "scores")
    cut = one_column(scores, F.col("score"), [1 - contamination])[0]
    scored = spread(rows).mapInPandas(score, schema)
    return scored.withColumn("iforest_outlier", F.col("score") > F.lit(cut))


def score_stats(scored: DataFrame, score: str, flag: str) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("n_outliers"), F.avg(score).alias("mean_score"),
                      F.min(score).alias("min_score"), F.max(score).alias("max_score"))
