"""Differentially private Bayesian-network synthesiser.

Columns are discretised; the network is grown greedily by noisy mutual information and each conditional
table gets Laplace noise on every cell of its full domain.  Half the budget goes to each part.

Tables are sparse: occupied cells get their noise, and of the empty ones only those are made whose noise would pass a threshold.  How many
these are is one binomial draw and which is a draw of cell numbers, so the full grid is never built."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import collect_stats, q, records
from ..functions.special import normal_cdf
from .marginals import as_model, fit_marginals, model_schema, restore, seeds

NUMERIC_BINS = 12
#: Of a table: occupied cells, and empty cells that noise may fill.
MAX_CELLS, NOISE_CELLS = 1_000_000, 50_000
MAX_GRID = 1 << 62  # cell numbers are 64-bit
JOINED_LEVELS, MAX_LEVELS = 200, 100_000


def noisy(cells: np.ndarray, counts: np.ndarray, grid: int, scale: float, rng, empties: int = NOISE_CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(cells, noisy counts) above a threshold, of a grid of which ``cells`` are occupied; as if every cell had got Laplace noise.

    The threshold is 0, or so high that about ``empties`` empty cells pass; noise above it is the threshold plus an exponential draw."""
    empty = grid - len(cells)
    limit = scale * max(0.0, math.log(max(empty, 1) / (2.0 * empties)))
    passing = int(rng.binomial(empty, 0.5 * math.exp(-limit / scale))) if empty else 0
    occupied, new = np.sort(cells), np.zeros(0, np.int64)
    if 2 * passing > empty:  # a small grid: all its empty cells in a random order
        new = rng.permutation(np.setdiff1d(np.arange(grid), occupied))[:passing]
    while len(new) < passing:
        drawn = rng.integers(0, grid, 2 * (passing - len(new)) + 16)
        place = np.minimum(np.searchsorted(occupied, drawn), max(len(occupied) - 1, 0))
        fresh = drawn[occupied[place] != drawn] if len(occupied) else drawn
        new = np.concatenate([new, fresh])
        new = new[np.sort(np.unique(new, return_index=True)[1])][:passing]
    with_noise = counts + rng.laplace(0, scale, len(cells))
    keep = with_noise > limit
    return np.concatenate([cells[keep], new]), np.concatenate([with_noise[keep], limit + rng.exponential(scale, len(new))])


class Table:
    """Conditional distributions of a column: one per combination of its parents that has cells, one over all for the others."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, size: int):
        order = np.argsort(cells)
        cells, counts = cells[order], counts[order]
        rows, self.value = cells // size, (cells % size).astype(np.int64)
        self.rows, start = np.unique(rows, return_index=True)
        self.upto = np.concatenate([[0.0], np.cumsum(counts)])
        self.start = np.append(start, len(cells))
        whole = np.bincount(self.value, counts, size) if len(cells) else np.zeros(size)
        self.whole = np.cumsum(whole / whole.sum() if whole.sum() > 0 else np.full(size, 1 / size))

    def draw(self, row: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A value for each combination ``row`` of the parents, by the uniform number ``u``."""
        out = np.minimum(np.searchsorted(self.whole, u), len(self.whole) - 1)
        if len(self.rows):
            at = np.minimum(np.searchsorted(self.rows, row), len(self.rows) - 1)
            known = self.rows[at] == row
            lo, hi = self.start[at[known]], self.start[at[known] + 1]
            point = self.upto[lo] + u[known] * (self.upto[hi] - self.upto[lo])
            out[known] = self.value[np.clip(np.searchsorted(self.upto, point, "right") - 1, lo, hi - 1)]
        return out


class PrivBayes:
    def __init__(self, marginals, domains, order, tables, spark, limited=()):
        self.marginals, self.domains, self.order, self.tables, self.spark, self.limited = marginals, domains, order, tables, spark, list(limited)

    @classmethod
    def fit(cls, df: DataFrame, epsilon: float = 1.0, degree: int = 2, bins: int = NUMERIC_BINS, ids: list[str] | None = None,
            bounds: dict[str, tuple[float, float]] | None = None, seed: int | None = None, max_cells: int = MAX_CELLS) -> "PrivBayes":
        """``bounds`` gives public ranges of numeric columns; without them the data range is used, which the
        privacy budget does not cover.  Level lists are taken as public, and so is how many cells a table occupies.  The noise comes from
        the system's entropy; a ``seed`` is for tests alone: whoever knows it can draw the noise again, so nothing is private.  Columns whose
        tables would occupy more than ``max_cells`` cells get fewer parents and are listed in ``limited``."""
        if epsilon <= 0:
            raise ValueError("epsilon must be positive")
        rng = np.random.default_rng(seed)
        marginals = fit_marginals(df, ids, points=201, max_levels=MAX_LEVELS)
        live = [m for m in marginals if m.kind != "id"]
        exprs, domains = {}, {}
        ends = collect_stats(df, {(m.name, k): f(as_model(df, m.name, "numeric")) for m in live if m.kind == "numeric"
                                  for k, f in (("lo", F.min), ("hi", F.max))})
        for m in live:
            x = as_model(df, m.name, m.kind)
            if m.kind == "numeric":
                lo, hi = (bounds or {}).get(m.name, (ends[m.name, "lo"] or 0.0, ends[m.name, "hi"] or 0.0))
                width = (hi - lo) / bins if hi > lo else 1.0
                code = F.greatest(F.lit(0), F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1)))
                domains[m.name] = ("numeric", lo, width, bins + 1)
                exprs[m.name] = F.when(x.isNull(), F.lit(bins)).otherwise(code)
            else:
                if len(m.levels) > JOINED_LEVELS:
                    side = records(df.sparkSession, list(zip(m.levels, range(len(m.levels)))), f"`_l{len(domains)}` string, `_c{len(domains)}` int")
                    df = df.join(F.broadcast(side), x == F.col(f"_l{len(domains)}"), "left")  # levels are bounded
                    code = F.col(f"_c{len(domains)}")
                else:
                    code = F.create_map(*[F.lit(v) for i, l in enumerate(m.levels) for v in (l, i)])[x] if m.levels else F.lit(0)
                domains[m.name] = ("categorical", m.levels, None, len(m.levels) + 1)
                exprs[m.name] = F.when(x.isNull(), F.lit(len(m.levels))).otherwise(code)
        coded = df.select(*[e.cast("int").alias(c) for c, e in exprs.items()])
        names = [m.name for m in live]
        n = df.count()
        # sensitivity of mutual information for n rows (non-binary columns)
        sens = 2 / n * math.log((n + 1) / 2) + (n - 1) / n * math.log((n + 1) / (n - 1)) if n > 1 else 1.0
        order = [(names[int(rng.integers(len(names)))], ())]
        limited: list[str] = []
        eps1, eps2, steps = epsilon / 2, epsilon / 2, max(1, len(names) - 1)
        while len(order) < len(names):
            chosen = [o[0] for o in order]
            size = min(degree, len(chosen))
            cands = []
            for x in names:
                if x in chosen:
                    continue
                cands += [(x, p) for k in range(size, 0, -1) for p in combinations(chosen, k) if _cells(domains, (x, *p)) <= MAX_GRID]
                cands.append((x, ()))
            mi, occupied = _information(coded, cands, n)
            most = {x: max(len(p) for y, p in cands if y == x and (not p or occupied[x, p] <= max_cells)) for x in {c[0] for c in cands}}
            cands = [(x, p) for x, p in cands if len(p) == most[x] and (not p or occupied[x, p] <= max_cells)]
            gumbel = [mi[c] * eps1 / (2 * steps * sens) + rng.gumbel() for c in cands]  # exponential mechanism
            order.append(cands[int(np.argmax(gumbel))])
            if len(order[-1][1]) < size:
                limited.append(order[-1][0])
        scale = 2.0 * len(names) / eps2
        tables = {}
        joint = _joints(coded, order, domains)
        for x, parents in order:
            cells, counts = noisy(*joint[x, parents], _cells(domains, (*parents, x)), scale, rng)
            tables[x] = Table(cells, counts, domains[x][3])
        return cls(marginals, domains, order, tables, df.sparkSession, limited)

    def sample(self, n: int, seed: int = 42) -> DataFrame:
        """Ancestral sampling: each column looks its distribution up by the codes of its parents."""
        live = [m for m in self.marginals if m.kind != "id"]
        base = seeds(self.spark, n, 2 * len(live), seed)
        marginals, order, domains, tables = self.marginals, self.order, self.domains, self.tables

        def draw(batches):
            import pandas as pd

            for pdf in batches:
                codes, out = {}, {}
                for i, (x, parents) in enumerate(order):
                    u = normal_cdf(pdf[f"g{2 * i}"].to_numpy())
                    row = np.zeros(len(pdf), np.int64)
                    for p in parents:
                        row = row * domains[p][3] + codes[p]
                    codes[x] = tables[x].draw(row, u)
                    what, a, width, size = domains[x]
                    if what == "numeric":
                        v = a + (codes[x] + normal_cdf(pdf[f"g{2 * i + 1}"].to_numpy())) * width
                        out[x] = np.where(codes[x] == size - 1, np.nan, v)
                    else:
                        out[x] = np.array([*a, None], object)[codes[x]]
                for m in marginals:
                    if m.kind == "id":
                        out[m.name] = pdf["row_id"].astype(float)
                    elif m.kind == "numeric" and m.whole:
                        out[m.name] = np.rint(np.floor(out[m.name]))
                yield pd.DataFrame({m.name: out[m.name] for m in marginals})

        return restore(base.mapInPandas(draw, model_schema(self.marginals)), self.marginals)


def _cells(domains, cols) -> int:
    return math.prod(domains[c][3] for c in cols)


def _counts(coded: DataFrame, sets: list[tuple[str, ...]]):
    """Cell counts of every column set, all sets in one shuffle; cells are bounded by the domains."""
    arr = F.array(*[F.struct(F.lit(i).alias("set"), F.array(*[q(c) for c in cols]).alias("cell")) for i, cols in enumerate(sets)])
    return coded.select(F.inline(arr)).groupBy("set", "cell").agg(F.count(F.lit(1)).alias("n"))


def _information(coded: DataFrame, cands, n: int) -> tuple[dict, dict]:
    """Mutual information and number of occupied cells of each (column, parents) candidate."""
    from pyspark.sql import Window

    t = _counts(coded, [(x, *p) for x, p in cands]).withColumn("x", F.col("cell")[0]).withColumn("y", F.slice("cell", 2, 64))
    t = t.withColumn("nx", F.sum("n").over(Window.partitionBy("set", "x"))).withColumn("ny", F.sum("n").over(Window.partitionBy("set", "y")))
    o = F.col("n").cast("double")
    got = t.groupBy("set").agg(F.sum(o / n * F.log(o * n / (F.col("nx").cast("double") * F.col("ny")))).alias("mi"), F.count(F.lit(1)).alias("cells")).collect()
    mi, cells = {r["set"]: r["mi"] for r in got}, {r["set"]: r["cells"] for r in got}
    return {c: (mi.get(i) or 0.0) if c[1] else 0.0 for i, c in enumerate(cands)}, {c: cells.get(i, 0) for i, c in enumerate(cands)}


def _joints(coded: DataFrame, order, domains) -> dict:
    """(cell numbers, counts) of the occupied cells over the axes (parents..., column)."""
    found: dict = {o: ([], []) for o in order}
    for r in _counts(coded, [(*p, x) for x, p in order]).collect():  # at most MAX_CELLS per set
        o, number = order[r["set"]], 0
        for c, v in zip((*o[1], o[0]), r["cell"]):
            number = number * domains[c][3] + v
        found[o][0].append(number)
        found[o][1].append(r["n"])
    return {o: (np.array(c, np.int64), np.array(v, float)) for o, (c, v) in found.items()}
