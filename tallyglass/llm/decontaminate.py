"""Operator 1: which short test items stand inside which documents.

Words are runs of ASCII letters and digits and of any character beyond ASCII, in lower case; an item and a document
are their sets of shingles of five consecutive words.  An item of one to four words is one shingle of its own length.
An item is contained in a document when at least ``threshold`` of the item's distinct shingles occur in it.

Search.  Signatures of whole documents cannot find an item of 15 shingles among 20,000 (their Jaccard similarity is
below 0.001), so the MinHash side is taken on the items: items are partitioned by size, and an item keeps its
k smallest shingle hashes, k set by the largest size of the partition, so that a document holding the threshold
share of the item must hold at least one of them (with at most m = n - ceil(t n) shingles missing, k >= m + 1
minima cannot all be missing).  A document is a candidate for the item when it holds at least k - m of its minima.
Candidates are verified by comparing shingle texts.  Nothing is missed and no false pair stays.

Scale.  Documents are read once and never shuffled; only items travel, in blocks of at most ``block_shingles``
shingles (another pass over the documents for each further block), so the broadcast has a fixed bound.

Null and empty texts hold nothing; an item without words is in no document; repeated items and documents are
separate rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.exprs import q
from ..functions.store import materialise
from .arrays import ALNUM, Members, lean, runs, shingles, texts, word_hashes, words
from .rows import text_hash, without

WIDTH, THRESHOLD = 5, 0.8
BLOCK_SHINGLES = 2_000_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _texts(parts: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(parts[i:i + width]) for i in range(len(parts) - width + 1)}


class Items:
    """One block of items: their minima in size partitions, and their shingles."""

    def __init__(self, ids: list, bodies: list[str], threshold: float):
        self.ids, self.sets, self.width = [], [], []
        column = pc.utf8_lower(pa.array([b or "" for b in bodies], pa.large_string()))
        sizes, hashed = [], []
        for at, _, raw, offsets in runs(column):
            start, end, first = words(raw, offsets, ALNUM)
            values, before = shingles(word_hashes(raw, start, end), first, WIDTH)
            for i in range(len(offsets) - 1):
                own = np.unique(values[before[i]:before[i + 1]])
                if not len(own):
                    continue
                parts = WORD.findall(raw[offsets[i]:offsets[i + 1]].tobytes())
                width = min(WIDTH, len(parts))
                self.ids.append(ids[at + i])
                self.width.append(width)
                self.sets.append(_texts(parts, width))
                sizes.append(len(own))
                hashed.append(own)
        n = np.array(sizes, dtype=np.int64)
        self.need = np.array([math.ceil(threshold * int(x) - 1e-9) for x in n], np.int64)
        largest = (1 << (np.floor(np.log2(n)).astype(int) + 1)) - 1 if len(n) else n
        # per size partition: one sketch length, enough for its largest item
        length = np.minimum(n, np.array([x - math.ceil(threshold * int(x) - 1e-9) + 1 for x in largest], np.int64))
        self.hits = np.maximum(1, length - (n - self.need))
        minima = [h[:k] for h, k in zip(hashed, length)]  # sorted: the smallest first
        every = np.concatenate(minima) if minima else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(minima)), [len(m) for m in minima])
        order = np.argsort(every, kind="stable")
        self.members = Members(every)
        self.owner = owner[order]
        self.span = np.searchsorted(every[order], self.members.values), np.searchsorted(every[order], self.members.values, "right")

    def candidates(self, found: np.ndarray) -> list[int]:
        """Items with enough minima among the distinct found values."""
        lo, hi = self.span
        owners = np.concatenate([self.owner[lo[v]:hi[v]] for v in np.unique(found)])
        item, count = np.unique(owners, return_counts=True)
        return item[count >= self.hits[item]].tolist()


def _blocks(items: DataFrame, item_key: str, text: str, limit: int):
    """(block, blocks) of the items by key hash; a block has about ``limit`` words, an upper bound of its shingles."""
    size = F.coalesce(F.length(q(text)), F.lit(0)) / 2 + 1
    total = items.agg(F.sum(size)).first()[0] or 0
    return F.pmod(F.xxhash64(q(item_key)), F.lit(max(1, math.ceil(total / limit)))), max(1, math.ceil(total / limit))


def _contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per contained pair: doc, hash of its text, item, n_shingles, n_found."""
    block, blocks = _blocks(items, item_key, item_text, block_shingles)
    few = items.select(q(item_key).alias("k"), q(item_text).alias("t"), block.alias("b"))
    base = docs.select(q(key).alias("doc"), q(text).alias("t"), text_hash(text).alias("hash"))
    schema = f"doc {base.schema['doc'].dataType.simpleString()}, hash long, item {few.schema['k'].dataType.simpleString()}, n_shingles long, n_found long"
    passes = []
    for b in range(blocks):
        part = few.filter(F.col("b") == b).select("k", "t").collect()  # at most block_shingles shingles
        held = docs.sparkSession.sparkContext.broadcast(Items([r[0] for r in part], [r[1] for r in part], threshold))
        passes.append(base.mapInArrow(lean(_search(held)), schema))
    return reduce(DataFrame.unionAll, passes)


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", **options) -> DataFrame:
    """One row per contained pair: the keys, ``n_shingles`` of the item, ``n_found`` of them in the document and
    ``containment``."""
    return _contained(docs, items, key, text, item_key, **options).select(
        F.col("doc").alias(key), F.col("item").alias(item_key), "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def _search(held):
    def run(batches):
        items: Items = held.value
        widths = sorted(set(items.width))
        for batch in batches if widths else ():
            column = pc.utf8_lower(texts(batch.column(1)))
            out = []
            for at, _, raw, offsets in runs(column):
                start, end, first = words(raw, offsets, ALNUM)
                hashes = word_hashes(raw, start, end)
                rows, values = [], []
                for width in widths:
                    own, before = shingles(hashes, first, width, whole_short=False)
                    where, value = items.members.find(own)
                    rows.append(np.searchsorted(before, where, "right") - 1)
                    values.append(value)
                row, value = np.concatenate(rows), np.concatenate(values)
                order = np.argsort(row, kind="stable")
                row, value = row[order], value[order]
                edge = np.flatnonzero(np.diff(row, prepend=-1)).tolist() + [len(row)]
                for lo, hi in zip(edge, edge[1:]):
                    candidates = items.candidates(value[lo:hi])
                    if not candidates:
                        continue
                    i = int(row[lo])
                    parts = WORD.findall(raw[offsets[i]:offsets[i + 1]].tobytes())
                    whole = {w: _texts(parts, w) for w in {items.width[c] for c in candidates}}
                    for c in candidates:
                        n = len(items.sets[c] & whole[items.width[c]])
                        if n >= items.need[c]:
                            out.append((at + i, items.ids[c], len(items.sets[c]), n))
            if out:
                where, ids, sizes, counts = zip(*out)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(where, pa.int64())) for c in (0, 2)], pa.array(ids), pa.array(sizes, pa.int64()),
                                                  pa.array(counts, pa.int64())], ["doc", "hash", "item", "n_shingles", "n_found"])

    return run


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that contain no item.  A row goes by its key and text, so other rows of its key stay."""
    dirty = materialise(_contained(docs, items, key, text, **options).select("doc", "hash").distinct(), "dirty")
    return without(docs, {"doc": q(key), "hash": text_hash(text)}, dirty)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP1_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
i AS (SELECT item_id, least(5, len(w)) AS n, unnest(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2),
      lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' ')))) AS s FROM b WHERE len(w) > 0),
width AS (SELECT DISTINCT n FROM i),
d AS (SELECT DISTINCT doc_id, n, s FROM (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
      FROM w, width)),
size AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM d JOIN i USING (n, s) JOIN size USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles - 1e-9
"""
