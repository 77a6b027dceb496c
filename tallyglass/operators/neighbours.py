"""Exact k nearest neighbours, local outlier factor and neighbour imputation.

Equal points are merged into one weighted point, so a heavily repeated value costs nothing.  Space is cut
into boxes of similar size (cuts come from a sample; they decide placement only).  Pass 1 meets each query
with its own box and yields an upper bound of its k-distance; pass 2 sends the query to the other boxes
that this bound reaches.  No pair of points in far-apart boxes is ever formed, and the result is exact.

Local outlier factors cut space into larger tiles.  A tile finds the k-distances of its points through small leaves; points whose
reach crosses its border visit the other tiles.  Densities and factors are sums over the neighbours, made where the neighbours live:
a point asks each tile that its k-distance reaches, and no list of pairs is written or shuffled.

The neighbourhood is every point within the k-distance (ties included), as local outlier factors define it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import collect_stats, num, q, resolve
from ..functions.keyed import attach
from ..functions.ordered import running_totals
from ..functions.quantiles import _position
from ..functions.store import materialise

# fixed values: detector defaults
LOF_NEIGHBOURS, CONTAMINATION, LOF_FLOOR = 20, 0.1, 1e-10
IMPUTE_NEIGHBOURS = 3
BOX_POINTS = 256
GROUP_BOXES = 8  # neighbouring boxes that meet in one call
BOX_SAMPLE = 16
MAX_BOXES = 65_536
VISITORS = 20_000
TILE_BOXES, LEAF_POINTS = 64, 48  # boxes' worth of points in a tile; points of a leaf inside it
TILE_VISITORS = 100_000  # queries that meet a tile in one call
DISTANCE_DECIMALS = 9


class Boxes:
    """Binary space partition: arrays of split dimension, split value and children; leaves are boxes."""

    def __init__(self, sample: np.ndarray, boxes: int):
        self.dim, self.cut, self.left, self.right, self.leaf = [], [], [], [], []
        self.count = 0
        self._grow(sample, boxes)

    def _grow(self, rows, boxes):
        node = len(self.dim)
        for a in (self.dim, self.cut, self.left, self.right, self.leaf):
            a.append(-1)
        spread = rows.max(0) - rows.min(0) if len(rows) > 1 else np.zeros(rows.shape[1])
        if boxes <= 1 or spread.max(initial=0) <= 0:
            self.leaf[node] = self.count
            self.count += 1
            return node
        d = int(spread.argmax())
        cut = float(np.median(rows[:, d]))
        if cut >= rows[:, d].max():  # keep both sides non-empty: x <= cut goes left
            cut = float(rows[rows[:, d] < cut, d].max())
        low = rows[:, d] <= cut
        self.dim[node], self.cut[node] = d, cut
        self.left[node] = self._grow(rows[low], boxes // 2)
        self.right[node] = self._grow(rows[~low], boxes - boxes // 2)
        return node

    def _arrays(self):
        return [np.asarray(v) for v in (self.dim, self.cut, self.left, self.right, self.leaf)]

    def home(self, x: np.ndarray) -> np.ndarray:
        dim, cut, left, right, leaf = self._arrays()
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        while len(rows := rows[leaf[node[rows]] < 0]):
            at = node[rows]
            node[rows] = np.where(x[rows, dim[at]] <= cut[at], left[at], right[at])
        return leaf[node]

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest coordinates of every box; outer boxes have no end."""
        dim, cut, left, right, leaf = self._arrays()
        axes = dim.max() + 1
        low, high = (np.full((len(dim), axes), v) for v in (-np.inf, np.inf))
        for node in np.flatnonzero(leaf < 0):  # parents stand before their children
            for child, ends, other in ((left[node], high, low), (right[node], low, high)):
                ends[child], other[child] = ends[node], other[node]
                ends[child, dim[node]] = cut[node]
        at = np.flatnonzero(leaf >= 0)
        return low[at[leaf[at].argsort()]], high[at[leaf[at].argsort()]]

    def reached(self, x: np.ndarray, radius: np.ndarray, norm: str = "euclid"):
        """(row, box) pairs of boxes no farther than the radius."""
        dim, cut, left, right, leaf = self._arrays()
        rows_out, box_out = [], []
        rows, node, gap = np.arange(len(x)), np.zeros(len(x), int), np.zeros_like(x)
        while len(rows):
            done = leaf[node] >= 0
            rows_out.append(rows[done])
            box_out.append(leaf[node[done]])
            rows, node, gap = rows[~done], node[~done], gap[~done]
            d, each = dim[node], np.arange(len(rows))
            side = x[rows, d] - cut[node]
            parts = []
            for child, miss in ((left[node], np.maximum(side, 0)), (right[node], np.maximum(-side, 0))):
                g = gap.copy()
                g[each, d] = np.maximum(g[each, d], miss)
                near = (g.max(1) if norm == "max" else np.sqrt((g * g).sum(1))) <= radius[rows] + 1e-9
                parts.append((rows[near], child[near], g[near]))
            rows, node, gap = (np.concatenate(v) for v in zip(*parts))
        return np.concatenate(rows_out), np.concatenate(box_out)


def _matrix(series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(float) if len(series) else np.zeros((0, 1))


def _layout(data: DataFrame, n: int, points: int) -> Boxes:
    boxes = min(MAX_BOXES, max(1, math.ceil(n / points)))
    share = min(1.0, BOX_SAMPLE * boxes / max(n, 1)) if boxes > 1 else 0.0
    if share <= 0:
        return Boxes(np.zeros((1, 1)), 1)
    pick = F.pmod(F.xxhash64("p"), F.lit(1_000_000)) < F.lit(max(1, int(share * 1_000_000)))
    sample = data.filter(pick).select("p").toPandas()  # at most about BOX_SAMPLE rows per box
    return Boxes(_matrix(sample["p"]), boxes) if len(sample) else Boxes(np.zeros((1, 1)), 1)


def _placed(df: DataFrame, layout: Boxes, radius: bool, norm: str = "euclid") -> DataFrame:
    """Rows with the box they live in, or one copy for every box within their radius."""
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["p"])
            if radius:
                rows, box = layout.reached(x, pdf["r"].to_numpy(float), norm)
                out = pdf.iloc[rows].copy()
            else:
                out, box = pdf.copy(), layout.home(x)
            out["box"] = box
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", box int"
    return df.mapInPandas(run, schema)


def _near(d: np.ndarray, w: np.ndarray, own: np.ndarray, k: int, norm: str):
    """(row, column, distance, k-distance per row) of the points within the k-distance; a row whose box holds
    too little weight keeps all its points and an infinite k-distance.  ``d``: squared distances, or largest gaps."""
    def length(v):
        return np.round(v if norm == "max" else np.sqrt(v), DISTANCE_DECIMALS)

    rows_n, cols_n = d.shape
    keep = np.isfinite(d)
    if cols_n > k:
        edge = length(np.partition(d, k - 1, axis=1)[:, k - 1])  # every weight is at least one
        wide = edge * (1 + 1e-9) + 2 * 10.0 ** -DISTANCE_DECIMALS  # rounding comes after, for these few
        keep &= d <= (wide if norm == "max" else wide * wide)[:, None]
    r, c = np.nonzero(keep)
    d = length(d[r, c])
    if cols_n > k:
        keep = d <= edge[r]
        r, c, d = r[keep], c[keep], d[keep]
    order = np.lexsort((d, r))
    r, c, dist = r[order], c[order], d[order]
    weight = w[c]
    total = np.cumsum(weight)
    start = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(start, total - weight, 0.0)) if len(r) else total
    full = own[r] + total - base >= k
    kd = np.full(rows_n, np.inf)
    np.minimum.at(kd, r[full], dist[full])
    kd[own >= k] = 0.0
    return r, c, dist, kd


def _meet(data: DataFrame, queries: DataFrame, k: int, same: bool, bound: bool, boxes: int, norm: str) -> DataFrame:
    """Meets every query with the points of its box.  ``bound`` yields (id, r); otherwise the neighbours
    (id, self, nid, d, w[, v]) within r.  Neighbouring boxes share a call; crowded ones are split into chunks of queries."""
    import pandas as pd

    data, queries = (df.withColumn("part", F.floor(F.col("box") / GROUP_BOXES)) for df in (data, queries))
    crowd = queries.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).select(
        "part", F.greatest(F.lit(1), F.ceil(F.col("_n") / VISITORS)).cast("int").alias("_chunks"))
    crowd = F.broadcast(crowd)  # one row per group of boxes
    # An explicit partition count: the adaptive merge of small partitions would queue CPU-heavy boxes in one task.
    tasks = min(4_096, max(math.ceil(boxes / GROUP_BOXES), data.sparkSession.sparkContext.defaultParallelism))
    visitors = queries.join(crowd, "part").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int")).drop(
        "_chunks").repartition(tasks, "part", "chunk")
    points = data.join(crowd, "part").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop(
        "_chunks").repartition(tasks, "part", "chunk")
    cols = ["id", "r"] if bound else ["id", "self", "nid", "d", "w"] + (["v"] if "v" in data.columns else [])

    def meet(a, own, limit, qid, b, w, v, pid):
        """The rows of one box."""
        step = max(1, 4_000_000 // len(b))
        order = np.argsort(pid)
        for i in range(0, len(a), step):
            s = slice(i, i + step)
            d = np.zeros((len(a[s]), len(b)))
            for j in range(a.shape[1]):
                gap = a[s, j][:, None] - b[:, j]
                d = np.maximum(d, np.abs(gap)) if norm == "max" else d + gap ** 2
            if same:
                at = order[np.minimum(np.searchsorted(pid, qid[s], sorter=order), len(b) - 1)]
                mine = np.flatnonzero(pid[at] == qid[s])
                d[mine, at[mine]] = np.inf
            r, c, dist, kd = _near(d, w, own[s], k, norm)
            if bound:
                yield qid[s], kd
                continue
            ok = dist <= np.minimum(limit[s], kd)[r]
            r, c = r[ok], c[ok]
            yield (qid[s][r], own[s][r], pid[c], dist[ok], w[c]) + (() if v is None else (v[c],))

    def block(qs, ps):
        out = []
        if len(qs) and len(ps):
            qs, ps = qs.sort_values("box", kind="stable"), ps.sort_values("box", kind="stable")
            asked = [_matrix(qs["p"]), qs["self"].to_numpy(float), qs["r"].to_numpy(float), qs["id"].to_numpy()]
            given = [_matrix(ps["p"]), ps["w"].to_numpy(float), ps["v"].to_numpy(float) if "v" in cols else None, ps["id"].to_numpy()]
            qbox, pbox = qs["box"].to_numpy(), ps["box"].to_numpy()
            for box in np.unique(qbox):
                q0, q1, p0, p1 = *np.searchsorted(qbox, [box, box + 1]), *np.searchsorted(pbox, [box, box + 1])
                if p1 > p0:
                    out += meet(*[x[q0:q1] for x in asked], *[x if x is None else x[p0:p1] for x in given])
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(cols, zip(*out))} if out else {c: [] for c in cols})

    types = {"id": "bigint", "nid": "bigint"}
    return visitors.groupBy("part", "chunk").cogroup(points.groupBy("part", "chunk")).applyInPandas(
        block, ", ".join(f"{c} {types.get(c, 'double')}" for c in cols))


def neighbours(data: DataFrame, queries: DataFrame, k: int, same: bool, norm: str = "euclid") -> DataFrame:
    """(id, self, nid, d, w[, v], kdist): all points within the k-distance of every query point.

    ``data``: id, p array<double>, w (copies)[, v]; ``queries``: id, p, self (own further copies).  Both must be
    written tables, so their ids are stable.  ``same`` leaves out the data point with the id of the query.  ``norm``: euclid or max."""
    layout = _layout(data, data.count(), BOX_POINTS)
    asked = queries.withColumn("r", F.lit(float("inf")))
    home = _placed(data, layout, False)
    if layout.count > 1:
        home = materialise(home, "boxes")
        first = _meet(home, _placed(asked, layout, False), k, same, True, layout.count, norm)
        asked = queries.join(first, "id", "left").withColumn("r", F.coalesce("r", F.lit(float("inf"))))
    got = _meet(home, _placed(asked, layout, layout.count > 1, norm), k, same, False, layout.count, norm)
    # candidates of a query are few: at most the k nearest (with ties) of each box it visited
    w = Window.partitionBy("id").orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
    ranked = got.withColumn("_cum", F.col("self") + F.sum("w").over(w))
    kd = F.when(F.col("self") >= k, F.lit(0.0)).otherwise(F.min(F.when(F.col("_cum") >= k, F.col("d"))).over(Window.partitionBy("id")))
    return ranked.withColumn("kdist", kd).filter(F.col("d") <= F.col("kdist")).drop("_cum")


def standardised(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list]:
    """Complete rows with ``p``: columns scaled by population mean and std (zero std: 1)."""
    s = collect_stats(df.select(*[num(df, c).alias(c) for c in cols]).dropna(),
                      {(c, k): f(q(c)) for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))})
    parts = [(num(df, c) - F.lit(s[c, "m"] or 0.0)) / F.lit(s[c, "s"] if s[c, "s"] else 1.0) + F.lit(0.0) for c in cols]
    whole = None
    for c in cols:
        ok = num(df, c).isNotNull()
        whole = ok if whole is None else whole & ok
    return df.filter(whole).withColumn("p", F.array(*parts)), parts


def _leaves(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): points in leaves of at most ``size`` neighbours, cut at the middle of the widest axis."""
    order, starts, open_ = np.arange(len(x)), [], [(0, len(x))]
    while open_:
        a, b = open_.pop()
        if b - a <= size:
            starts.append(a)
            continue
        own, mid = x[order[a:b]], (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, (own.max(0) - own.min(0)).argmax()], mid)]
        open_ += [(a + mid, b), (a, a + mid)]
    return order, np.array(starts)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.subtract.outer(a[:, 0], b[:, 0])
    d *= d
    for j in range(1, a.shape[1]):
        gap = np.subtract.outer(a[:, j], b[:, j])
        gap *= gap
        d += gap
    return d


class Tile:
    """Points sorted into leaves; some queries meet the leaves within their reach."""

    def __init__(self, x: np.ndarray, size: int):
        self.order, self.starts = _leaves(x, size)
        self.x, self.every = x[self.order], np.arange(len(x))
        self.ends = np.r_[self.starts[1:], len(x)]
        self.low, self.high = (f.reduceat(self.x, self.starts, axis=0) for f in (np.minimum, np.maximum))

    def meet(self, a: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(ascending places among the sorted points, squared distances) of the leaves no farther than ``reach`` from the box of ``a``."""
        gap = np.maximum(np.maximum(self.low - a.max(0), a.min(0) - self.high), 0.0)
        near = np.flatnonzero(np.sqrt((gap * gap).sum(1)) <= reach)
        at = np.concatenate([self.every[:0], *[self.every[self.starts[i]:self.ends[i]] for i in near]])
        return at, _squares(a, self.x[at])


def _beyond(r):
    """A little more than a rounded distance."""
    return r * (1 + 1e-9) + 2 * 10.0 ** -DISTANCE_DECIMALS


def _kth(d: np.ndarray, w: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """k-distance per row of squared distances; infinite where there is too little weight."""
    if d.shape[1] <= k:
        return _near(d, w, own, k, "euclid")[3]
    edge = np.partition(d, k - 1, axis=1)[:, k - 1]
    kd = np.round(np.sqrt(edge), DISTANCE_DECIMALS)
    heavy = np.flatnonzero((own > 0) | (d[:, w > 1] <= edge[:, None]).any(1))  # elsewhere the k nearest weigh k
    if len(heavy):
        kd[heavy] = _near(d[heavy], w, own[heavy], k, "euclid")[3]
    return kd


def _k_distances(x: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """k-distance of every point among the points of its tile."""
    tile = Tile(x, max(LEAF_POINTS, 2 * k + 4))
    w, kd = w[tile.order], np.empty(len(x))
    for start, end in zip(tile.starts, tile.ends):
        todo, reach = np.arange(start, end), math.inf
        if end - start > k:  # the leaf alone bounds the k-distance of its middle
            d = _squares(tile.x[todo], tile.x[todo])
            np.fill_diagonal(d, math.inf)
            reach = 1.25 * math.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1].min())
        while len(todo):
            at, d = tile.meet(tile.x[todo], reach)
            d[np.arange(len(todo)), np.searchsorted(at, todo)] = math.inf
            kd[todo] = got = _kth(d, w[at], w[todo] - 1, k)
            todo = todo[got > reach]  # no leaf was left out that these need, or they meet more
            reach = _beyond(got.max())
    out = np.empty(len(x))
    out[tile.order] = kd
    return out


def _visits(df: DataFrame, axes: list[str], layout: Boxes) -> DataFrame:
    """Rows whose radius ``r`` crosses the border of their tile, once for every tile ``at`` that it reaches."""
    low, high = layout.spans()

    def run(batches):
        for pdf in batches:
            x, r, box = pdf[axes].to_numpy(float)[:, :low.shape[1]], _beyond(pdf["r"].to_numpy(float))[:, None], pdf["box"].to_numpy()
            pdf = pdf[((x - r <= low[box]) | (x + r >= high[box])).any(1)]
            if not len(pdf):
                continue
            rows, at = layout.reached(pdf[axes].to_numpy(float), pdf["r"].to_numpy(float))
            cross = np.bincount(rows, minlength=len(pdf))[rows] > 1
            out = pdf.iloc[rows[cross]].copy()
            out["at"] = at[cross]
            yield out

    return df.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", at int")


def _ask(points: DataFrame, asked: DataFrame, axes: list[str], tiles: int, answer, schema: str) -> DataFrame:
    """``answer(tile, points, queries, rows, reach)`` for every tile and block of queries ``rows``; yields columns of ``schema``.
    A tile that many ask is answered in chunks of its queries."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]
    crowd = F.broadcast(asked.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / TILE_VISITORS).cast("int").alias("_chunks")))  # one row per tile
    # An explicit partition count: the adaptive merge of small partitions would queue CPU-heavy tiles in one task.
    tasks = min(4_096, max(tiles, points.sparkSession.sparkContext.defaultParallelism))
    asked = asked.join(crowd, "at").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int")).drop("_chunks").repartition(tasks, "at", "chunk")
    # toDF: both sides may be the same written table
    points = points.toDF(*points.columns).withColumnRenamed("box", "at").join(crowd, "at").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop(
        "_chunks").repartition(tasks, "at", "chunk")

    def block(qs, ps):
        out = []
        if len(qs) and len(ps):
            tile = Tile(ps[axes].to_numpy(float), LEAF_POINTS)
            given = {c: ps[c].to_numpy()[tile.order] for c in ps.columns if c not in axes}
            x, asks = qs[axes].to_numpy(float), {c: qs[c].to_numpy() for c in qs.columns if c not in axes}
            order, starts = _leaves(x, LEAF_POINTS)
            for rows in np.split(order, starts[1:]):
                mine = {c: v[rows] for c, v in asks.items()}
                at, d = tile.meet(x[rows], _beyond(mine["r"].max()))
                if len(at):
                    out.append(answer({c: v[at] for c, v in given.items()}, mine, d))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(names, zip(*out))} if out else {c: [] for c in names})

    return asked.groupBy("at", "chunk").cogroup(points.groupBy("at", "chunk")).applyInPandas(block, schema)


def _summed(points: DataFrame, visits: DataFrame | None, axes: list[str], k: int, tiles: int, value) -> DataFrame:
    """(id, s, n): weighted sum of ``value(given, j, distance)`` over the neighbours, and their weight, of points without k own copies."""
    asked = points.select("id", *axes, "w", F.col("kd").alias("r"), F.col("box").alias("at"))
    asked = (asked if visits is None else asked.unionByName(visits.select(asked.columns))).filter(F.col("w") <= k).drop("w")

    def answer(given, mine, d):
        wide = _beyond(mine["r"])
        i, j = np.nonzero(d <= (wide * wide)[:, None])
        dist = np.round(np.sqrt(d[i, j]), DISTANCE_DECIMALS)
        ok = (dist <= mine["r"][i]) & (given["id"][j] != mine["id"][i])
        i, j, dist = i[ok], j[ok], dist[ok]
        w, n = given["w"][j], len(mine["id"])
        return mine["id"], np.bincount(i, w * value(given, j, dist), n), np.bincount(i, w, n)

    got = _ask(points, asked, axes, tiles, answer, "id bigint, s double, n double")
    return got.groupBy("id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def lof_scores(df: DataFrame, cols=None, k: int = LOF_NEIGHBOURS) -> tuple[DataFrame, DataFrame, list[str]]:
    """(complete rows with their point, (point, w copies, lof) per distinct point, the columns of a point)."""
    cols = resolve(df, cols, "numeric")
    rows, parts = standardised(df, cols)
    axes = [f"_x{i}" for i in range(len(cols))]
    rows = rows.withColumns(dict(zip(axes, parts))).drop("p")
    total = rows.count()
    if total < k + 1:
        raise ValueError(f"at least {k + 1} complete rows are needed")
    points = materialise(rows.groupBy(*axes).agg(F.count(F.lit(1)).cast("double").alias("w")).withColumn(
        "id", F.monotonically_increasing_id()), "points")
    layout = _layout(points.select(F.array(*axes).alias("p")), points.count(), TILE_BOXES * BOX_POINTS)
    tasks = min(4_096, max(layout.count, df.sparkSession.sparkContext.defaultParallelism))

    def place(batches):
        for pdf in batches:
            yield pdf.assign(box=layout.home(pdf[axes].to_numpy(float)))

    def bound(pdf):
        return pdf.assign(r=_k_distances(pdf[axes].to_numpy(float), pdf["w"].to_numpy(float), k))

    schema = ", ".join(f"{c} double" for c in axes) + ", w double, id bigint, box int"
    home = materialise(points.mapInPandas(place, schema).repartition(tasks, "box").groupBy("box").applyInPandas(bound, schema + ", r double"), "tiles")
    visits, known = None, home.withColumnRenamed("r", "kd")
    if layout.count > 1:
        def answer(given, mine, d):
            own = mine["w"] - 1
            d[given["id"] == mine["id"][:, None]] = math.inf
            i, j, dist, kd = _near(d, given["w"], own, k, "euclid")
            ok = dist <= np.minimum(mine["r"], kd)[i]
            return mine["id"][i[ok]], own[i[ok]], dist[ok], given["w"][j[ok]]

        asked = materialise(_visits(home, axes, layout), "visits")
        pairs = _ask(home.drop("r"), asked.drop("box"), axes, layout.count, answer, "id bigint, self double, d double, w double")
        # candidates of a query are few: at most the k nearest (with ties) of each tile it visited
        reached = F.col("self") + F.sum("w").over(Window.partitionBy("id").orderBy("d").rangeBetween(Window.unboundedPreceding, 0))
        kd = pairs.withColumn("_cum", reached).groupBy("id").agg(F.min(F.when(F.col("_cum") >= k, F.col("d"))).alias("kd"))
        known = materialise(home.join(kd, "id", "left").withColumn("kd", F.when(F.col("w") > k, 0.0).otherwise(F.coalesce("kd", "r"))).drop("r"), "k-distances")
        visits = materialise(_visits(known.withColumnRenamed("kd", "r"), axes, layout).filter("at <> box"), "visits")
    # own copies are neighbours at distance zero
    own = F.col("w") - 1
    near = _summed(known, visits, axes, k, layout.count, lambda given, j, dist: np.maximum(given["kd"][j], dist))
    dense = materialise(known.join(near, "id", "left").select(*known.columns, (F.coalesce("n", F.lit(0.0)) + own).alias("near"), (
        1 / ((F.coalesce("s", F.lit(0.0)) + own * F.col("kd")) / (F.coalesce("n", F.lit(0.0)) + own) + F.lit(LOF_FLOOR))).alias("lrd")), "densities")
    far = _summed(dense, visits, axes, k, layout.count, lambda given, j, dist: given["lrd"][j])
    mean = (F.coalesce("s", F.lit(0.0)) + own * F.col("lrd")) / F.col("near")
    return rows, materialise(dense.join(far, "id", "left").select(*axes, "w", (mean / F.col("lrd")).alias("lof")), "lof"), axes


def _weighted_quantile(df: DataFrame, col: str, weight: str, p: float) -> float:
    """Quantile of ``col`` where every row stands for ``weight`` rows."""
    sums = running_totals(df.groupBy(col).agg(F.sum(weight).alias("n")), col, ["n"])
    n = df.agg(F.sum(weight)).first()[0]
    h = _position(int(n), p)
    a, b = sums.agg(*[F.min(F.when(F.col("cum_n") > F.lit(float(r)), F.col(col))) for r in (math.floor(h), math.ceil(h))]).first()
    return a + (b - a) * (h - math.floor(h))


def lof(df: DataFrame, cols=None, k: int = LOF_NEIGHBOURS, contamination: float = CONTAMINATION) -> DataFrame:
    """Complete rows with ``lof`` and ``lof_outlier``: scores above the (1 - contamination) quantile."""
    rows, scores, axes = lof_scores(df, cols, k)
    cut = _weighted_quantile(scores, "lof", "w", 1 - contamination)
    scored = attach(rows, scores.drop("w"), axes, n_keys=scores.count())  # a repeated point is not gathered into one task
    return scored.drop(*axes).withColumn("lof_outlier", F.col("lof") > F.lit(cut))


def impute_knn(df: DataFrame, col: str, features: list[str] | None = None, k: int = IMPUTE_NEIGHBOURS) -> DataFrame:
    """Missing values of ``col`` become the mean over the rows within the k-distance in the feature
    space; rows without complete features, or a call without features, get the column mean."""
    x = num(df, col)
    mean = df.agg(F.avg(x)).first()[0]
    if mean is None:
        return df
    if not features:
        return df.withColumn(col, F.coalesce(x, F.lit(mean)))
    resolve(df, features)
    rows, parts = standardised(df, features)
    known = materialise(rows.filter(x.isNotNull()).groupBy("p").agg(F.count(F.lit(1)).cast("double").alias("w"), F.avg(x).alias("v"))
                        .withColumn("id", F.monotonically_increasing_id()), "points")
    asked = materialise(rows.filter(x.isNull()).select("p", F.lit(0.0).alias("self")).distinct().withColumn(
        "id", F.monotonically_increasing_id()), "queries")
    got = neighbours(known, asked, k, same=False).groupBy("id").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("_v"))
    got = got.join(asked.select("id", "p"), "id").drop("id")
    point = F.when(x.isNull(), F.array(*parts))
    keyed = df.withColumn("_p", point)
    filled = keyed.filter("_p IS NULL").drop("_p").withColumn(col, F.coalesce(x, F.lit(mean)))
    holes = attach(keyed.filter("_p IS NOT NULL"), got.withColumnRenamed("p", "_p"), ["_p"], how="left")
    holes = holes.withColumn(col, F.coalesce("_v", F.lit(mean))).drop("_p", "_v")
    return filled.unionByName(holes)
