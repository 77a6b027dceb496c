"""Operator 9: near-duplicate vectors by E8 lattice hashing.

A table projects a unit vector at random to two blocks of eight numbers and decodes each to the nearest point of the
lattice E8 (the closer of the nearest points of D8 and of D8 shifted by one half); the pair of points is the vector's
home cell.  It also visits the cells one minimal lattice vector away in one block, the ``PROBES`` nearest of the 240 per
block.  Two vectors meet in a cell that is home to at least one of them; all pairs that meet in any of the ``TABLES``
tables are verified by cosine in double precision.  At cosine 0.95, the worst case, a table lets a pair meet with
probability about 0.4, twelve with more than 0.99; closer pairs meet more often.

Equal vectors are one node with a count.  In a cell only counts of linked partners and a spanning forest are returned, so a
tight group costs its members, not its pairs.  A pair that meets in several cells is counted in the first one only, which
both sides can tell from their own cells.  Cells of up to ``SMALL`` members give their pairs, those of more than ``BLOCK`` are
compared in pairs of blocks.

Null or zero vectors, vectors with null or non-finite components: no links, own component.  Vectors of different lengths
never link.  Repeated rows are equal vectors.  Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.exprs import q
from ..functions.store import materialise
from .arrays import U, lean, mix
from .graph import components
from .ngram_join import _forest

TABLES, PROBES, SCALE, THRESHOLD = 12, 5, 0.7, 0.95
SMALL, BLOCK = 32, 1024


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out.extend(np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if np.prod(s) > 0)
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    gap = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(gap).argmax(axis=1)[odd]
    near[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where(((x - whole) ** 2).sum(axis=1, keepdims=True) <= ((x - half) ** 2).sum(axis=1, keepdims=True), whole, half)


class Hasher:
    """Cells of unit vectors of one length."""

    def __init__(self, size: int, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE):
        self.tables, self.probes, self.short = tables, probes, minimal_vectors()
        rng = np.random.default_rng([size, 8])
        self.project = [(rng.normal(size=(size, 8)) * scale, rng.random(8) * 2) for _ in range(2 * tables)]
        self.weights = [int(w) | 1 for w in mix(np.arange(8, dtype=U), 41)]
        self.size = size

    def _code(self, points: np.ndarray) -> np.ndarray:
        doubled = np.rint(points * 2).astype(np.int64).view(U)
        out = np.zeros(points.shape[:-1], U)
        with np.errstate(over="ignore"):
            for k in range(8):
                out += doubled[..., k] * U(self.weights[k])
        return mix(out, 42)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x tables homes, rows x tables x 2 PROBES visited cells)."""
        home = np.zeros((len(x), self.tables), U)
        visit = np.zeros((len(x), self.tables, 2 * self.probes), U)
        with np.errstate(over="ignore"):
            for t in range(self.tables):
                codes, near = [], []
                for matrix, shift in self.project[2 * t:2 * t + 2]:
                    y = x @ matrix + shift
                    point = decode(y)
                    order = np.argpartition(-((y - point) @ self.short.T), self.probes - 1, axis=1)[:, :self.probes]
                    codes.append(self._code(point))
                    near.append(self._code(point[:, None, :] + self.short[order]))
                seed = 1000 * self.size + t
                home[:, t] = mix(codes[0] + mix(codes[1], 43), seed)
                visit[:, t, :self.probes] = mix(near[0] + mix(codes[1], 43)[:, None], seed)
                visit[:, t, self.probes:] = mix(codes[0][:, None] + mix(near[1], 43), seed)
        return home, visit


_hashers: dict = {}


def _hasher(size: int, tables: int, probes: int) -> Hasher:
    key = (size, tables, probes)
    if key not in _hashers:
        _hashers[key] = Hasher(size, tables, probes)
    return _hashers[key]


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _prepare(batches):
    """Row key, node (null where nothing links) and bytes of the vector, in single precision where that is exact.  Rows of one length at once."""
    for batch in batches:
        column = batch.column(1)
        begin = column.offsets.to_numpy()[:-1].astype(np.int64)
        size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
        flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # a null component becomes not a number
        nodes, known, vectors = np.zeros(len(size), np.int64), np.zeros(len(size), bool), np.full(len(size), None, object)
        for n in np.unique(size[size > 0]).tolist():
            where = np.flatnonzero(size == n)
            x = flat[begin[where][:, None] + np.arange(n)]
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            where, x = where[good], np.ascontiguousarray(x[good])
            known[where] = True
            with np.errstate(over="ignore"):
                nodes[where] = mix(mix(x.view(U) + mix(np.arange(n, dtype=U), 51), 52).sum(axis=1) + U(n), 53).view(np.int64)
            small = x.astype(np.float32)
            exact = (small == x).all(axis=1)
            for mark, matrix, rows in ((4, small, exact), (8, x, ~exact)):
                body = np.ascontiguousarray(matrix[rows]).view(np.uint8).reshape(int(rows.sum()), n * matrix.itemsize)
                marked = np.concatenate([np.full((len(body), 1), mark, np.uint8), body], axis=1)
                vectors[where[rows]] = [v.tobytes() for v in marked]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, mask=~known), pa.array(vectors, pa.binary())], ["id", "node", "vector"])


def _read(vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Unit vectors by length: (positions, matrix)."""
    vectors, by = list(vectors), {}
    for i, v in enumerate(vectors):
        by.setdefault((v[0], len(v)), []).append(i)
    parts: dict[int, list] = {}
    for (mark, length), where in by.items():
        body = np.frombuffer(b"".join([vectors[i] for i in where]), np.uint8).reshape(len(where), length)[:, 1:]
        parts.setdefault((length - 1) // mark, []).append((np.array(where), np.ascontiguousarray(body).view(np.float32 if mark == 4 else np.float64).astype(np.float64)))
    out = {}
    for n, group in parts.items():
        where, x = (np.concatenate(p) for p in zip(*group))
        order = np.argsort(where)
        out[n] = (where[order], _unit(x[order]))
    return out


def _place(tables: int, probes: int):
    def run(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            values = batch.column(1).to_pylist()
            for at in range(0, len(nodes), 1000):
                for size, (where, x) in _read(values[at:at + 1000]).items():
                    home, visit = _hasher(size, tables, probes).cells(x)
                    cell = np.concatenate([home, visit.reshape(len(x), -1)], axis=1)
                    is_home = np.zeros(cell.shape, bool)
                    is_home[:, :tables] = True
                    yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().view(np.int64)), pa.array(np.repeat(nodes[at + where], cell.shape[1])), pa.array(is_home.ravel())],
                                                     ["cell", "node", "home"])

    return run


def _first_meeting(home, visit, i, j) -> np.ndarray:
    """The first cell in which each pair meets."""
    found = np.full(len(i), ~U(0))
    open_ = np.arange(len(i))
    for t in range(home[0].shape[1]):
        a, b = home[0][i[open_], t], home[1][j[open_], t]
        none = np.full(len(open_), ~U(0))
        first = np.where(a == b, a, none)
        first = np.minimum(first, np.where((visit[0][i[open_], t] == b[:, None]).any(axis=1), b, none))
        first = np.minimum(first, np.where((visit[1][j[open_], t] == a[:, None]).any(axis=1), a, none))
        met = first != ~U(0)
        found[open_[met]] = first[met]
        open_ = open_[~met]
        if not len(open_):
            break
    return found


def _compare(threshold: float, tables: int, probes: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, lo, hi = key
        out = []
        halves = [pdf[pdf["block"] == lo], pdf[pdf["block"] == hi]]
        sides = [_read(h["vector"]) for h in halves]
        for size in sides[0].keys() & sides[1].keys():
            (p, x), (q, y) = sides[0][size], sides[1][size]
            nodes = halves[0]["node"].to_numpy()[p], halves[1]["node"].to_numpy()[q]
            copies = halves[0]["copies"].to_numpy()[p], halves[1]["copies"].to_numpy()[q]
            live = (x @ y.T >= threshold) & (halves[0]["home"].to_numpy()[p][:, None] | halves[1]["home"].to_numpy()[q][None, :])
            if lo == hi:
                live &= np.arange(len(p))[:, None] < np.arange(len(q))[None, :]
            i, j = np.nonzero(live)
            if not len(i):
                continue
            hasher = _hasher(size, tables, probes)
            own = hasher.cells(x)
            cells = [own, own if lo == hi else hasher.cells(y)]
            home, visit = [c[0] for c in cells], [c[1] for c in cells]
            keep = np.concatenate([_first_meeting(home, visit, i[k:k + 100_000], j[k:k + 100_000]) for k in range(0, len(i), 100_000)]) == np.array([cell]).view(U)[0]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            for names, own, other in ((nodes[0], i, copies[1][j]), (nodes[1], j, copies[0][i])):
                count = np.bincount(own, other, len(names)).astype(np.int64)
                at = np.flatnonzero(count)
                out.append(pd.DataFrame({"a": names[at], "b": names[at], "links": count[at]}))
            names = nodes[0] if lo == hi else np.concatenate(nodes)
            label = _forest(i, j if lo == hi else j + len(p), len(names))
            moved = np.flatnonzero(label != np.arange(len(label)))
            out.append(pd.DataFrame({"a": names[moved], "b": names[label[moved]], "links": np.zeros(len(moved), np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})

    return run


def _verify(threshold: float, tables: int, probes: int):
    """Pairs that met in small cells, each once with those cells: both directions of those that link and met there first."""

    def run(batches):
        for batch in batches:
            a, b, more_a, more_b = (batch.column(k).to_numpy() for k in range(4))
            small, left, right = (batch.column(k).to_pylist() for k in range(4, 7))
            for at in range(0, len(a), 2000):
                part = slice(at, at + 2000)
                ours, theirs = _read(left[part]), _read(right[part])
                for size in ours.keys() & theirs.keys():
                    (p, x), (q, y) = ours[size], theirs[size]
                    both, u, v = np.intersect1d(p, q, assume_unique=True, return_indices=True)
                    linked = np.einsum("ij,ij->i", x[u], y[v]) >= threshold
                    if not linked.any():
                        continue
                    both, u, v = both[linked] + at, x[u[linked]], y[v[linked]]
                    hasher = _hasher(size, tables, probes)
                    cells, every = [hasher.cells(u), hasher.cells(v)], np.arange(len(both))
                    first = _first_meeting([c[0] for c in cells], [c[1] for c in cells], every, every).view(np.int64).tolist()
                    both = both[[f in small[i] for f, i in zip(first, both.tolist())]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[both], b[both]])), pa.array(np.concatenate([b[both], a[both]])),
                                                      pa.array(np.concatenate([more_b[both], more_a[both]]))], ["a", "b", "links"])

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """One row per row of ``df``: key, ``n_links``, ``component_id``, ``kept``."""
    base = df.select(q(key).alias("id"), q(vector).cast(T.ArrayType(T.DoubleType())).alias("v"))
    kind = base.schema["id"].dataType.simpleString()
    rows = materialise(base.mapInArrow(lean(_prepare), f"id {kind}, node long, vector binary"), "vectors")
    nodes = materialise(rows.filter("node is not null").groupBy("node").agg(F.first("vector").alias("vector"), F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "vector-nodes")
    places = materialise(nodes.select("node", "vector").mapInArrow(lean(_place(tables, probes)), "cell long, node long, home boolean"), "cells")
    cells = (places.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("home").alias("home"))
             .filter("home and lo <> hi").select("cell", "n"))
    full = materialise(places.join(cells, "cell"), "shared-cells")
    # cells of few members: their pairs, verified in batches
    few = full.filter(F.col("n") <= SMALL).select("cell", "node", "home")
    x, y = (few.select("cell", F.col("node").alias(s), F.col("home").alias(f"home_{s}")) for s in "ab")
    pairs = x.join(y, "cell").filter("a < b and (home_a or home_b)").groupBy("a", "b").agg(F.collect_set("cell").alias("cells"))  # at most the cells of a vector
    for s in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(s), F.col("vector").alias(f"vector_{s}"), F.col("copies").alias(f"copies_{s}")), s)
    near = pairs.select("a", "b", "copies_a", "copies_b", "cells", "vector_a", "vector_b").mapInArrow(lean(_verify(threshold, tables, probes)), "a long, b long, links long")
    # cells of many members: blocks
    dealt = (full.filter(F.col("n") > SMALL).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cell", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "home")
             .join(nodes.select("node", "vector", "copies"), "node"))
    far = dealt.groupBy("cell", "x", "y").applyInPandas(_compare(threshold, tables, probes), "a long, b long, links long")
    found = materialise(near.unionAll(far), "vector-links")
    counts = found.filter("links > 0").groupBy(F.col("a").alias("linked")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("a <> b")).select(F.col("node").alias("member"), "root")
    of = nodes.select("node", "id", "copies").join(counts, F.col("node") == F.col("linked"), "left").join(roots, F.col("node") == F.col("member"), "left").select(
        "node", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = of.join(of.groupBy("root").agg(F.min("id").alias("component")), "root").select(F.col("node").alias("of"), "n_links", "component")
    out = rows.select("id", "node").join(named, F.col("node") == F.col("of"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
