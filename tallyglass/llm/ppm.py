"""Operator 2: log-probability of texts by prediction by partial matching.

A text is its words (runs without ASCII white space, A-Z folded) joined by single blanks, closed by one end sign; null
is the empty text, which is the end sign alone.  The model is a trie of byte contexts of up to ``ORDER`` bytes,
counted over the training texts.  A byte is coded in the longest known context with probability n / (T + q), T and q the
number and the kinds of bytes seen there; otherwise an escape of probability q / (T + q) leads to the context one
byte shorter, where the bytes of the longer one are excluded from n, T and q (a context with nothing left is
passed at no cost).  Below order 0 the bytes never seen are equally likely.  As contexts are nested, what has
to be excluded in a context depends on the one longer context alone, so whole arrays of positions are coded at once.

The unigram base adds log10((c + 1) / (N + V + 1)) over the words and the end of a text.

Scale.  One scan counts words and byte grams, summed in the map tasks first; what it gathers follows the corpus.  The
trie is visited in shards of at most about ``SHARD`` grams (by the last two bytes of the context; orders 0
and 1, at most 65,536 grams, go with every shard), one scan of the texts per shard, so no broadcast outgrows its
bound.  Words with at least N / ``FREQUENT`` occurrences, of which there can be at most FREQUENT, are looked up in
the scan; the others, none of them hot, by a join.  Repeated rows give repeated results; a repeated key with other
text is another row.  Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.exprs import q
from ..functions.store import materialise
from .arrays import FOLD, SPACE, Members, U, lean, mix, runs, texts, word_hashes, words

ORDER = 5
SHARD, FREQUENT = 1_500_000, 2_000_000
END = int(mix(np.array([12345], U), 9)[0] >> U(1))
RUN = 1 << 18
HELD = 800_000
GRAM, WORD = 0, 1


def normal(raw: np.ndarray, offsets: np.ndarray):
    """(stream, where each row begins in it, word hashes, words before each row).  In the stream every row is
    ORDER zero bytes, its words joined by blanks, the end sign."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    wide = np.full(len(raw) + n, 0x20, np.uint8)
    wide[np.arange(len(raw)) + np.repeat(np.arange(n), size)] = FOLD[raw]
    edges = offsets + np.arange(n + 1)
    start, end, first = words(wide, edges, ~SPACE)
    hashes = word_hashes(wide, start, end, fold=False)
    keep = ~SPACE[wide]
    keep[end] = True
    wide[end] = 0x20
    count = np.diff(first)
    last = np.where(count > 0, end[np.maximum(first[1:], 1) - 1] if len(end) else 0, edges[1:] - 1)
    keep[last] = True
    wide[last] = 0x0A
    before = np.concatenate([[0], np.cumsum(keep)])[edges]
    data = wide[keep]
    stream = np.zeros(len(data) + ORDER * n, np.uint8)
    stream[np.arange(len(data)) + ORDER * (np.repeat(np.arange(n), np.diff(before)) + 1)] = data
    return stream, before + ORDER * np.arange(n + 1), hashes, first


def grams(stream: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ORDER + 1 bytes ending at each position, positions before each row); the pads are no positions."""
    wide = stream.astype(U)
    n = len(stream) - ORDER
    key = wide[:n].copy()
    for j in range(1, ORDER + 1):
        key <<= U(8)
        key |= wide[j:n + j]
    real = np.ones(n, bool)
    for k in range(ORDER):  # keys that end on a pad
        at = begins[1:-1] + k - ORDER
        real[at[at >= 0]] = False
    return key[real], begins - ORDER * np.arange(len(begins))


def _sum(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, int)
    return keys[at], np.add.reduceat(n, at) if len(at) else n[:0]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, int)
    return keys[at], np.diff(np.append(at, len(keys)))


def _count(batches):
    held: dict[int, list] = {GRAM: [], WORD: []}
    size = {GRAM: 0, WORD: 0}

    def give(kind):
        keys, n = _sum(np.concatenate([k for k, _ in held[kind]]), np.concatenate([c for _, c in held[kind]]))
        held[kind] = [(keys, n)]
        size[kind] = len(keys)

    def out(kind):
        keys, n = held[kind][0]
        held[kind], size[kind] = [], 0
        for at in range(0, len(keys), 50_000):
            part = keys[at:at + 50_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part), pa.array(n[at:at + 50_000].astype(np.int64))], ["kind", "key", "n"])

    for batch in batches:
        for _, _, raw, offsets in runs(texts(batch.column(0)), RUN):
            stream, begins, hashes, _ = normal(raw, offsets)
            ends = (np.array([END], U), np.array([len(offsets) - 1]))
            for kind, parts in ((GRAM, [_distinct(grams(stream, begins)[0])]), (WORD, [_distinct(hashes), ends])):
                for p in parts:
                    held[kind].append(p)
                    size[kind] += len(p[0])
                if size[kind] > 2 * HELD:
                    give(kind)
                    if size[kind] > HELD:
                        yield from out(kind)
    for kind in (GRAM, WORD):
        if held[kind]:
            give(kind)
            yield from out(kind)


class Table:
    """Open-addressing lookup of 64-bit keys: index into ``keys`` or -1."""

    def __init__(self, keys: np.ndarray):
        bits = max(10, int(len(keys) * 3).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        self.keys = keys
        left, at = np.arange(len(keys), dtype=np.int32), self.home(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def home(self, keys):
        with np.errstate(over="ignore"):
            return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self.home(keys)
        got = self.slot[at]
        todo = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            got[todo] = hit = self.slot[at]
            more = (hit >= 0) & (self.keys[hit] != keys[todo])
            todo, at = todo[more], at[more]
        return got


def _place(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in the sorted values, or -1."""
    if not len(values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[at] == wanted, at, -1)


def _slim(n: np.ndarray) -> np.ndarray:
    return n.astype(np.uint32) if not len(n) or n.max() < 1 << 32 else n


class Trie:
    """``keys``, ``n``: grams of ORDER + 1 bytes of one shard; ``low``, ``low_n``: all grams of two bytes.  A hash table
    finds the longest grams; only positions that miss it search the sorted levels."""

    def __init__(self, keys, n, low, low_n):
        self.levels = []
        for j in range(ORDER + 1):
            k, c = (keys, n) if j > 1 else (low, low_n)
            own, count = _sum(k & U((1 << 8 * (j + 1)) - 1), c)
            context = own >> U(8)
            at = np.flatnonzero(np.diff(context, prepend=~context[:1])) if len(own) else np.zeros(0, int)
            total = np.add.reduceat(count, at) if len(at) else count[:0]
            kinds = np.diff(np.append(at, len(own)))
            level = {"grams": own, "n": _slim(count), "contexts": context[at], "T": _slim(total), "q": kinds.astype(np.uint32)}
            del context
            if j:  # what this context excludes one order below
                below = self.levels[-1]
                seen = below["n"][_place(below["grams"], own & U((1 << 8 * j) - 1))].astype(np.int64) if len(own) else count[:0]
                level["out"] = _slim(np.add.reduceat(seen, at) if len(at) else seen)
            self.levels.append(level)
        self.table = Table(own)
        self.direct = np.log10((count - 0.5) / np.repeat(total, kinds)).astype(np.float32)
        self.rest = math.log10(1 / max(1, 256 - len(self.levels[0]["n"])))

    def logp(self, keys: np.ndarray) -> np.ndarray:
        hit = self.table.find(keys)
        out = self.direct[hit].astype(np.float64) if len(self.direct) else np.zeros(len(keys))
        todo = np.flatnonzero(hit < 0)
        if not len(todo):
            return out
        out[todo] = 0
        key = keys[todo]
        cut_n, cut_q = np.zeros(len(todo)), np.zeros(len(todo))
        for j in range(ORDER, -1, -1):
            level = self.levels[j]
            part = key & U((1 << 8 * (j + 1)) - 1)
            at = _place(level["contexts"], part >> U(8))
            known = np.flatnonzero(at >= 0)
            if not len(known):
                continue
            c = at[known]
            left, kinds = level["T"][c] - cut_n[known], level["q"][c] - cut_q[known]
            gram = _place(level["grams"], part[known])
            found = gram >= 0
            share = np.where(found, level["n"][gram] - 0.5, np.where(kinds > 0, kinds / 2, 1))
            out[todo[known]] += np.log10(share / np.where(kinds > 0, left, 1))
            cut_n[known] = level["out"][c] if j else 0
            cut_q[known] = level["q"][c]
            stay = np.ones(len(todo), bool)
            stay[known[found]] = False
            todo, key, cut_n, cut_q = todo[stay], key[stay], cut_n[stay], cut_q[stay]
            if not len(todo):
                return out
        out[todo] += self.rest
        return out


def _shard(key, shards: int):
    return ((key >> U(8)) & U(0xFFFF)) * U(40503) % U(65536) % U(shards)


def _collect(df: DataFrame, *columns: str):
    got = df.select(*columns).toArrow()
    return tuple(got.column(c).to_numpy() for c in columns)


def score(docs: DataFrame, learn, key: str = "doc_id", text: str = "text", shard: int = SHARD, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: key, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.
    ``learn``: condition for the rows to learn from."""
    spark = docs.sparkSession
    context = spark.sparkContext
    base = docs.select(q(key).alias("k"), q(text).alias("t"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = materialise(base.filter("learn").select("t").mapInArrow(lean(_count), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm")
    of = {r["kind"]: (r["n"], r["kinds"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()}
    tokens, vocabulary = of.get(WORD, (0, 0))
    n_grams = of.get(GRAM, (0, 0))[1]
    least = max(1, -(-tokens // frequent))
    tokens_table = counts.filter(F.col("kind") == WORD)
    keys, n = _collect(tokens_table.filter(F.col("n") >= least), "key", "n")  # at most `frequent` words
    order = np.argsort(keys.view(U))
    held = context.broadcast((keys.view(U)[order], n[order]))
    trie_rows = counts.filter(F.col("kind") == GRAM)
    low = _collect(trie_rows.groupBy((F.col("key").bitwiseAND(0xFFFF)).alias("key")).agg(F.sum("n").alias("n")), "key", "n")  # 65,536 rows at most
    shards = max(1, math.ceil(n_grams / shard))
    passes = []
    kind = base.schema["k"].dataType.simpleString()
    schema = f"k {kind}, h int, m int, n_tokens long, known long, base double, score double, rare array<bigint>"
    hashed = base.select("k", "t", F.hash("t").alias("h"))
    for s in range(shards):
        at = F.pmod((F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFF) * 40503).bitwiseAND(0xFFFF), F.lit(shards))
        part = _collect(trie_rows.filter(at == s), "key", "n")
        trie = context.broadcast((part[0].view(U), part[1], low[0].view(U), low[1]))
        passes.append(hashed.mapInArrow(lean(_scored(trie, held if s == 0 else None, s, shards, tokens, vocabulary, least)), schema))
    scored = materialise(reduce(DataFrame.unionAll, passes), "ppm-scored")
    rare = scored.select("k", "h", F.explode("rare").alias("key")).join(tokens_table.select("key", "n"), "key", "left").groupBy("k", "h").agg(
        F.count("n").alias("known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("base"))
    parts = scored.drop("rare").unionByName(rare.selectExpr("k", "h", "0 as m", "0L as n_tokens", "known", "base", "0D as score"))
    total = parts.groupBy("k", "h").agg(*[F.sum(c).alias(c) for c in ("m", "n_tokens", "known", "base", "score")])
    each = total.select(F.col("k").alias(key), "m", *[(F.col(c) / F.col("m")).alias(c) for c in ("n_tokens", "known", "base", "score")])
    return each.select(key, F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("_copy"), "n_tokens", "known", "base", "score").select(
        key, F.round("n_tokens").cast("long").alias("n_tokens"), F.round("known").cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score")


_ready: dict = {}


def _scored(trie, held, s: int, shards: int, tokens: int, vocabulary: int, least: int):
    unit = math.log10(tokens + vocabulary + 1)

    def run(batches):
        if _ready.get("id") != (id(trie), s):
            _ready.clear()
            _ready.update(id=(id(trie), s), trie=Trie(*trie.value))
        model = _ready["trie"]
        if held is not None:
            common, n = held.value
            members = Members(common)
        for batch in batches:
            for at, end, raw, offsets in runs(texts(batch.column(1)), RUN):
                rows = end - at
                stream, begins, hashes, first = normal(raw, offsets)
                key, before = grams(stream, begins)
                if shards == 1:
                    value = model.logp(key)
                else:
                    value = np.zeros(len(key))
                    own = np.flatnonzero(_shard(key, shards) == U(s))
                    value[own] = model.logp(key[own])
                score = np.add.reduceat(value, before[:-1])
                n_tokens, known, total, rare = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), None
                if held is not None:
                    hashes = np.insert(hashes, first[1:], U(END))
                    first = first + np.arange(rows + 1)
                    n_tokens = np.diff(first)
                    where, index = members.find(hashes)
                    row = np.searchsorted(first, where, "right") - 1
                    known = np.bincount(row, minlength=rows)
                    total = np.bincount(row, np.log10(n[index] + 1.0), rows) - n_tokens * unit
                    if least > 1:
                        other = np.ones(len(hashes), bool)
                        other[where] = False
                        cut = np.concatenate([[0], np.cumsum(other)])[first].astype(np.int32)
                        rare = pa.ListArray.from_arrays(pa.array(cut), pa.array(hashes[other].view(np.int64)))
                if rare is None:
                    rare = pa.nulls(rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), batch.column(2).slice(at, rows), pa.array(np.full(rows, int(s == 0), np.int32)), pa.array(n_tokens),
                                                  pa.array(known.astype(np.int64)), pa.array(total), pa.array(score), rare],
                                                 ["k", "h", "m", "n_tokens", "known", "base", "score", "rare"])

    return run


def _held_out(key):
    return F.crc32(key.cast("string")) % 7 == 2


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, ~_held_out(F.col("doc_id")))
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
