"""Operator 3: document quality from random-indexing word vectors and a small two-layer network.

Tokens are runs of letters, digits and non-ASCII bytes, and runs of other signs, case kept.  Every token has a sparse
ternary index vector that follows from its hash.  A word vector is the sum of the index vectors of its
neighbours (two to each side) over the whole corpus; words share ``BUCKETS`` rows by hash, so the table has a fixed
size (BUCKETS x DIMS) whatever the corpus.  The sums are integers, so a recomputed task gives the same table.  A
document is pooled to the mean of its centred, normalised word vectors, the mean product of adjacent ones, the length of
the former and the sum of the latter (the mean cosine of neighbours: repeated words show there).  A network
(one tanh layer, one logistic unit) is trained in numpy on a bounded sample of labelled rows (``SAMPLE``); a fifth of
that sample is kept back to fit the temperature of the probabilities.

Null and empty texts have a zero pooled vector and get the score of that vector.  Rows with a null label, or held
back by the caller, are not learned from; several labels of one document count as the smallest.  Without labels of
both kinds the score is the share of label 1 (one half without labels).  Other columns pass through; ``score``
and ``predicted`` are replaced if the table has them already.

Scale.  Two scans of all texts (vectors, scores) and one of the sampled rows; only the fixed table is shuffled, summed in
the map tasks first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.exprs import q
from .arrays import ALNUM, SPACE, U, lean, mix, runs, texts, word_hashes, words
from .rows import extend

BUCKETS, DIMS, NONZERO, WINDOW = 1 << 14, 64, 4, 2
POOLED = 2 * DIMS + 2
SAMPLE = 20_000
HIDDEN, EPOCHS = 32, 40
RUN = 1 << 18
SIGN = ~ALNUM & ~SPACE


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, number of tokens before each row)."""
    a = words(raw, offsets, ALNUM)
    b = words(raw, offsets, SIGN)
    start, end = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    return word_hashes(raw, start, end, fold=False), np.searchsorted(start, offsets)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS x DIMS, centred rows of length one (zero where no word fell)."""
    names = [f"v{i}" for i in range(DIMS)]

    def run(batches):
        total = np.zeros(BUCKETS * DIMS)
        for batch in batches:
            for _, _, raw, offsets in runs(texts(batch.column(0)), RUN):
                hashes, first = _tokens(raw, offsets)
                if len(hashes) < 2:
                    continue
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                base = _bucket(hashes) * DIMS
                bits = mix(hashes, 5)
                for k in range(NONZERO):
                    place = ((bits >> U(8 * k)) & U(DIMS - 1)).astype(np.int64)
                    sign = 1.0 - 2.0 * ((bits >> U(48 + k)) & U(1)).astype(np.float64)
                    for gap in range(1, min(WINDOW, len(hashes) - 1) + 1):
                        near = np.where(row[gap:] == row[:-gap], 1.0, 0.0)
                        total += np.bincount(base[:-gap] + place[gap:], near * sign[gap:], len(total))
                        total += np.bincount(base[gap:] + place[:-gap], near * sign[:-gap], len(total))
        table = total.reshape(BUCKETS, DIMS).astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        for at in range(0, len(used), 2048):
            rows = used[at:at + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *[pa.array(np.ascontiguousarray(table[rows, i])) for i in range(DIMS)]], ["b", *names])

    parts = docs.select(q(text)).mapInArrow(lean(run), "b int, " + ", ".join(f"{n} long" for n in names))
    got = parts.groupBy("b").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # BUCKETS rows at most
    table = np.zeros((BUCKETS, DIMS))
    if got.num_rows:
        at = got.column("b").to_numpy()
        table[at] = np.stack([got.column(n).to_numpy() for n in names], axis=1)
        used = table.any(axis=1)
        size = np.linalg.norm(table, axis=1, keepdims=True)
        table = np.divide(table, size, out=table, where=size > 0)
        table[used] -= table[used].mean(axis=0)
        size = np.linalg.norm(table, axis=1, keepdims=True)
        table = np.divide(table, size, out=table, where=size > 0)
    return table.astype(np.float32)


def _pool(table: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x POOLED: mean vector, mean product of adjacent vectors, length of one and sum of the other."""
    n = len(offsets) - 1
    out = np.zeros((n, POOLED), np.float32)
    hashes, first = _tokens(raw, offsets)
    if not len(hashes):
        return out
    every = table[_bucket(hashes)]
    some = np.flatnonzero(np.diff(first))
    size = np.diff(first)[some][:, None]
    out[some, :DIMS] = np.add.reduceat(every, first[:-1][some], axis=0) / size
    pair = np.zeros_like(every)
    pair[:-1] = every[:-1] * every[1:]
    pair[first[1:][some] - 1] = 0
    out[some, DIMS:2 * DIMS] = np.add.reduceat(pair, first[:-1][some], axis=0) / np.maximum(size - 1, 1)
    out[:, 2 * DIMS] = np.linalg.norm(out[:, :DIMS], axis=1)
    out[:, 2 * DIMS + 1] = out[:, DIMS:2 * DIMS].sum(axis=1)
    return out


class Network:
    """tanh layer and logistic unit on standardised inputs; ``probability`` divides the logit by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.constant = float(y.mean()) if len(y) else 0.5
        self.live = len(np.unique(y)) == 2
        if not self.live:
            return
        kept = rng.random(len(y)) < 0.2
        if len(np.unique(y[~kept])) < 2 or len(np.unique(y[kept])) < 2:
            kept[:] = False
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
             np.array(np.log(self.constant / (1 - self.constant)))]
        moment, square = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        fit, step = np.flatnonzero(~kept), 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                h = np.tanh(z[part] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[part]) / len(part)
                back = np.outer(d, w[2]) * (1 - h * h)
                grads = [z[part].T @ back + 1e-3 * w[0], back.sum(axis=0), h.T @ d + 1e-3 * w[2], d.sum()]
                step += 1
                for i, g in enumerate(grads):
                    moment[i] = 0.9 * moment[i] + 0.1 * g
                    square[i] = 0.999 * square[i] + 0.001 * g * g
                    w[i] = w[i] - 0.003 * (moment[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.999 ** step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if kept.any():
            logit, grid = self.logit(x[kept]), np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.logaddexp(0, -np.where(y[kept] > 0, logit, -logit) / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.live:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "quality",
          learn=None, sample: int = SAMPLE) -> Network:
    """``learn``: condition on the key that a labelled row must meet.  The sample takes rows by a hash of the key."""
    rows = labels.select(q(key).alias("k"), q(label).alias("y")).filter("y is not null and k is not null")
    if learn is not None:
        rows = rows.filter(learn(F.col("k")))
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    rows = rows.groupBy("k").agg(F.min("y").alias("y"))  # about `sample` rows: the bound of the broadcast
    picked = docs.select(q(key).alias("k"), q(text).alias("t")).join(F.broadcast(rows), "k")
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            for at, end, raw, offsets in runs(texts(batch.column(1)), RUN):
                x = _pool(held.value, raw, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(2).slice(at, end - at),
                                                  pa.array([r.tobytes() for r in x], pa.binary())], ["k", "y", "x"])

    kind = picked.schema["k"].dataType.simpleString()
    got = picked.select("k", "t", F.col("y").cast("int").alias("y")).mapInArrow(lean(run), f"k {kind}, y int, x binary").toPandas().sort_values(["k", "x"])
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]).astype(np.float64) if len(got) else np.zeros((0, POOLED))
    return Network(x, got["y"].to_numpy(np.float64))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learn=None,
             sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``score`` (0..1) and ``predicted`` (0 or 1)."""
    table = word_vectors(docs, text)
    context = docs.sparkSession.sparkContext
    held = context.broadcast((table, train(docs, labels, table, key, text, label, learn, sample)))

    def run():
        vectors, network = held.value

        def work(batch, place):
            for at, _, raw, offsets in runs(texts(batch.column(place[text])), RUN):
                score = network.probability(_pool(vectors, raw, offsets))
                yield at, [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

        return work

    return extend(docs, run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def _held_out(key):
    return F.crc32(key.cast("string")) % 3 == 1


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, learn=lambda k: ~_held_out(k)).select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of quality 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, learn=lambda k: ~_held_out(k)).filter("predicted = 1").select(*[q(c) for c in docs.columns])
