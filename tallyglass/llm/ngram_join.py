"""Operator 7: self-join of documents by the Jaccard similarity of their word shingles.

Words are runs without ASCII white space, A-Z folded; a document is its set of distinct shingles of four words, or its
whole sequence if shorter; without words it is empty and linked with nothing.  Two documents link when
100 |x & y| >= 85 |x | y|.  A set of n shingles can link only with sets that share one of its first n - ceil(0.85 n) + 1
shingles under any fixed order of all shingles, so candidates have to share one under each of several orders:

1. Order one puts shingles with a low hash first, rare before frequent, then the others, and shingles held by more than a
   fiftieth of the documents last.  Where unshared shingles fill a document's prefix it has no candidates.
2. Orders two and three are two other hashes; pairs from order one must share a prefix shingle under both.

What is left must pass a length and a bit-map bound (both exact) and is verified on the whole sets.  Documents of equal
sets are one node (64-bit set fingerprint), so copies cost nothing.  Of shingles shared by more than ``SMALL`` nodes in prefixes the
near copies are connected first, in blocks that share a few leaders, each set being sent once; then only pairs that are not
connected yet are compared, by bit maps, and verified like the others.

``doc_id`` may repeat: rows are nodes by their text; ``component_id`` is the smallest id reachable (nulls last; the own id for empty sets).
Extra columns are ignored.

Scale.  Texts are scanned three times and never shuffled while the surviving nodes' ids fit ``BROADCAST_IDS`` (their count is
checked; beyond it the third scan joins by shuffle).  The largest shuffle holds a quarter of the shingle hashes.  Whole sets are written once, by
the scan, and shuffled only of nodes that are left in a candidate pair (as long as these fit ``BROADCAST_IDS``); a hot shingle adds its members'
sets once, and their bit maps once per ``MAP_ROWS`` members that are outside its largest component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.exprs import q
from ..functions.store import materialise
from .arrays import SPACE, U, lean, lean_group, mix, runs, shingles, texts, word_hashes, words
from .graph import components
from .rows import text_hash, without

WIDTH, PERCENT = 4, 85
STAGE_WIDTH, STAGE_PERCENT = 5, 80  # near copies of the pipeline
LOW = 1 << 62  # a quarter of the hashes
HOT_SHARE = 50
SMALL, BLOCK_ROWS, LEADERS, MAP_ROWS = 256, 512, 16, 1024
BROADCAST_IDS = 2_000_000
SHARED = 1 << 20  # entries that are counted pair by pair at once
SKETCH_ROWS, SET_ROWS = 10_000, 1_000  # pairs that a task meets with two sketches, with two sets
MAP_WORDS = 32  # 2,048 bits


def prefix_length(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def _sets(column, width: int):
    """(row, sorted distinct shingle hashes) of every row."""
    for at, _, raw, offsets in runs(texts(column)):
        start, end, first = words(raw, offsets, ~SPACE)
        values, before = shingles(word_hashes(raw, start, end), first, width)
        for i in range(len(offsets) - 1):
            yield at + i, np.unique(values[before[i]:before[i + 1]])


def _fingerprint(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s, 21).sum() + U(len(s))], U), 22).view(np.int64)[0])


def _nodes(width: int):
    """Per row its key, node and size; per run of rows the shingles held by many of them."""

    def run(batches):
        low, rows = [], 0

        def heavy():
            keys, n = np.unique(np.concatenate(low), return_counts=True)
            keep = n * HOT_SHARE * 2 > max(rows, 64)
            return keys[keep], n[keep]

        def batch_of(keys, n):
            k = len(keys)
            return pa.RecordBatch.from_arrays([pa.nulls(k, key_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))],
                                              ["doc", "node", "n", "hash", "token", "hits"])

        key_type, size = pa.int64(), 0
        for batch in batches:
            key_type = batch.column(0).type
            nodes, sizes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, s in _sets(batch.column(1), width):
                sizes[i] = len(s)
                if len(s):
                    nodes[i] = _fingerprint(s)
                    low.append(s[:np.searchsorted(s, U(LOW))])
                    rows += 1
                    size += len(low[-1])
                if size > 1_500_000:
                    yield batch_of(*heavy())
                    low, rows, size = [], 0, 0
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, mask=sizes == 0), pa.array(sizes), batch.column(2), none, none], ["doc", "node", "n", "hash", "token", "hits"])
        if low:
            yield batch_of(*heavy())

    return run


def _tokens(hot, width: int, percent: int):
    """(token, node, tag) of the first shingles under order one as far as a scan can tell: all low ones, and of
    a document with too few of those the next ones.  tag: 2 (prefix length - low ones) + (0 low, 1 next)."""

    def run(batches):
        known = hot.value
        seen: set[int] = set()
        for batch in batches:
            parts, size = [], 0
            for _, s in _sets(batch.column(0), width):
                if not len(s):
                    continue
                node = _fingerprint(s)
                if node in seen:
                    continue
                seen.add(node)
                cold = ~np.isin(s, known, kind="sort") if len(known) else np.ones(len(s), bool)
                early = s[cold & (s < U(LOW))]
                missing = int(prefix_length(len(s), percent)) - len(early)
                tag = np.full(len(early), 2 * missing)
                if missing > 0:
                    later = np.concatenate([s[cold & (s >= U(LOW))], s[~cold]])[:missing]
                    early, tag = np.concatenate([early, later]), np.concatenate([tag, np.full(len(later), 2 * missing + 1)])
                parts.append((early, np.full(len(early), node), tag))
                size += len(early)
                if size > 200_000:
                    yield _flat(parts)
                    parts, size = [], 0
            if parts:
                yield _flat(parts)

    return run


def _flat(parts):
    token, node, tag = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node.astype(np.int64)), pa.array(tag.astype(np.int32))], ["token", "node", "tag"])


def _order(s: np.ndarray, seed: int, percent: int) -> np.ndarray:
    """The prefix under another order, as 32-bit values."""
    other = mix(s, seed)
    k = int(prefix_length(len(s), percent))
    return (np.partition(other, k - 1)[:k] if k < len(s) else other).astype(np.uint32).view(np.int32)


def _sketches(width: int, percent: int):
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            weight = 0
            for _, s in _sets(batch.column(0), width):
                if not len(s):
                    continue
                bits = np.zeros(MAP_WORDS * 64, np.uint8)
                bits[(mix(s, 33) >> U(53)).astype(np.int64)] = 1
                for column, value in zip(out, (_fingerprint(s), len(s), _order(s, 2, percent), _order(s, 3, percent), np.packbits(bits).view(np.int64), s.view(np.int64))):
                    column.append(value)
                weight += len(s)
                if weight > 500_000:
                    yield _sketch_batch(out)
                    out, weight = [[], [], [], [], [], []], 0
            if out[0]:
                yield _sketch_batch(out)

    return run


def _sketch_batch(out):
    def lists(values):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)), pa.array(np.concatenate(values)))

    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *[lists(x) for x in out[2:]]], ["node", "n", "second", "third", "map", "shingles"])


def _share(rows: list[np.ndarray], other: list[np.ndarray], step: int = 2048, dense: int = 4096) -> np.ndarray:
    """Number of common values of each pair of rows.  Values that few pairs share are counted pair by pair, the
    others by products of presence matrices over runs of values."""
    out = np.zeros((len(rows), len(other)), np.float32)
    sides = []
    for side in (rows, other):
        value, owner = np.concatenate(side), np.repeat(np.arange(len(side)), [len(x) for x in side])
        order = np.argsort(value, kind="stable")
        sides.append((value[order], owner[order]))
    (left, i), (right, j) = sides
    values = np.intersect1d(left, right)
    if not len(values):
        return out
    begins = [np.searchsorted(v, values) for v in (left, right)]
    counts = [np.searchsorted(v, values, "right") - b for v, b in zip((left, right), begins)]
    often = counts[0] * counts[1] > dense
    rare = np.flatnonzero(~often)
    part_of = np.cumsum(counts[0][rare] * counts[1][rare]) // SHARED
    for few in np.split(rare, np.flatnonzero(np.diff(part_of)) + 1) if len(rare) else ():
        at = _ranges(begins[0][few], counts[0][few])  # entries of the left side
        times = np.repeat(counts[1][few], counts[0][few])
        with_ = _ranges(np.repeat(begins[1][few], counts[0][few]), times)
        flat = np.repeat(i[at], times) * len(other) + j[with_]
        out += np.bincount(flat, minlength=out.size).reshape(out.shape)
    values = values[often]
    for at in range(0, len(values), step):
        part = values[at:at + step]
        matrices = []
        for (value, owner), side in zip(sides, (rows, other)):
            place = np.minimum(np.searchsorted(part, value), len(part) - 1)
            hit = part[place] == value
            m = np.zeros((len(side), len(part)), np.float32)
            m[owner[hit], place[hit]] = 1
            matrices.append(m)
        out += matrices[0] @ matrices[1].T
    return out


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] numbers, then those from begin[1] on, and so on."""
    before = np.cumsum(count) - count
    return np.repeat(begin - before, count) + np.arange(int(count.sum()))


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Label of each of ``size`` members: the smallest member reachable over the pairs."""
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _linked(percent: int):
    """Links inside one block of a hot shingle, its leaders with it, as a spanning forest."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, nodes = pdf["n"].to_numpy(), pdf["node"].to_numpy()
        sets = [np.asarray(v).view(U) for v in pdf["shingles"]]
        common = np.triu(_share(sets, sets), 1).astype(np.int64)
        i, j = np.nonzero(common)
        common = common[i, j]
        linked = 100 * common >= percent * (n[i] + n[j] - common)
        label = _forest(i[linked], j[linked], len(nodes))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": nodes[moved], "b": nodes[label[moved]]})

    return run


def _apart(percent: int):
    """Pairs of two blocks of a hot shingle (or of one) that are not connected yet and may link by their sizes and bit maps."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, lo, hi = key
        sides = []
        for block in (lo, hi):
            own = pdf[pdf["block"] == block]
            bits = np.unpackbits(np.concatenate([*own["map"], np.zeros(0, np.int64)]).astype(np.int64).view(np.uint8)).reshape(len(own), -1).astype(np.float32)
            sides.append((own["node"].to_numpy(), own["n"].to_numpy(), own["root"].to_numpy(), bits, bits.sum(1)))
        (a, n, r, x, p), (b, m, t, y, o) = sides
        differing = p[:, None] + o[None, :] - 2 * (x @ y.T)
        most = np.floor((n[:, None] + m[None, :]) * ((100 - percent) / (100 + percent)) + 1e-9)
        i, j = np.nonzero((differing <= most) & (r[:, None] != t[None, :]) & (100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])))
        return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j])}).drop_duplicates()

    return run


def _of(sets: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """The rows of ``sets`` for the distinct ``nodes`` (one column), taken where they are; all rows if the nodes are more than ``limit``."""
    nodes = nodes.toDF("of")
    return sets.join(F.broadcast(nodes), F.col("node") == F.col("of"), "left_semi") if nodes.count() <= limit else sets


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _pairs_that_link(pairs: DataFrame, sets: DataFrame, percent: int, limit: int) -> DataFrame:
    """Of distinct ``pairs`` (a, b) of nodes (written) those that link: filters of orders two and three, bounds, then the whole sets."""
    sketch = _of(sets.drop("shingles"), _ends(pairs), limit)
    x, y = (sketch.select(*[F.col(c).alias(f"{s}_{c}") for c in sketch.columns]) for s in "xy")
    most = F.floor((F.col("x_n") + F.col("y_n")) * F.lit(100 - percent) / F.lit(100 + percent) + 1e-9)  # of the symmetric difference
    differing = F.aggregate(F.zip_with("x_map", "y_map", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    candidates = (pairs.join(x, F.col("a") == F.col("x_node")).join(y, F.col("b") == F.col("y_node"))
                  .filter((100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")) & F.arrays_overlap("x_second", "y_second") & F.arrays_overlap("x_third", "y_third"))
                  .filter(differing <= most).select("a", "b"))
    candidates = materialise(candidates, "candidates", pairs.count(), SKETCH_ROWS)
    whole = _of(sets.select("node", "n", "shingles"), _ends(candidates), limit)
    x, y = (whole.select(F.col("node").alias(f"{s}_node"), F.col("n").alias(f"{s}_n"), F.col("shingles").alias(f"{s}_s")) for s in "xy")
    common = F.size(F.array_intersect("x_s", "y_s"))
    found = candidates.join(x, F.col("a") == F.col("x_node")).join(y, F.col("b") == F.col("y_node")).filter(
        100 * common >= percent * (F.col("x_n") + F.col("y_n") - common)).select("a", "b")
    return materialise(found, "links", candidates.count(), SET_ROWS)


def _hot_links(wide: DataFrame, sets: DataFrame, known: DataFrame, percent: int, limit: int) -> DataFrame:
    """Enough links between the nodes of hot shingles, ``wide`` (token, node), to connect all that are linked, beside the links ``known`` (written).

    First every node goes, with its set, to one block of its smallest hot shingle; a few leaders go to all blocks of theirs.  That connects
    most of each group of near copies.  Of every shingle then only pairs that are not connected yet are compared, by sizes and bit maps:
    nodes outside its largest component against all; what may link is verified like any other pair."""
    first = wide.groupBy("node").agg(F.min("token").alias("token"))
    size = first.groupBy(F.col("token").alias("of")).agg(F.count(F.lit(1)).alias("c"))
    place = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = first.join(size, F.col("token") == F.col("of")).withColumn("blocks", F.ceil(F.col("c") / BLOCK_ROWS).cast("int"))
    lead = F.pmod(F.xxhash64("node", "token"), F.col("c")) < LEADERS
    dealt = dealt.select("token", "node", F.explode(F.when(lead, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(place))).alias("block"))
    whole = _of(sets.select("node", "n", "shingles"), wide.select("node").distinct(), limit)
    near = dealt.join(whole, "node").groupBy("token", "block").applyInPandas(lean_group(_linked(percent)), "a long, b long")
    near = materialise(near, "hot-links")
    roots = materialise(components(known.unionAll(near)), "roots").select(F.col("node").alias("of"), "root")
    named = materialise(wide.join(roots, wide["node"] == roots["of"], "left").select("token", "node", F.coalesce("root", "node").alias("root")), "hot-roots", wide.count())
    parts = named.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
    parts = parts.groupBy(F.col("token").alias("of")).agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("c")).filter(F.col("all") > F.col("c"))
    sides = named.join(parts, F.col("token") == F.col("of")).withColumn("others", F.ceil((F.col("all") - F.col("c")) / MAP_ROWS).cast("int"))
    blocks = F.col("others") + F.ceil(F.col("c") / MAP_ROWS).cast("int")
    inside = F.col("root") == F.col("main")
    own = F.when(inside, F.col("others") + F.pmod(F.xxhash64("node"), blocks - F.col("others"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    met = F.sequence(F.lit(0), F.when(inside, F.col("others")).otherwise(blocks) - 1)
    tasks = sides.select("token", "node", "root", own.alias("block"), F.explode(met).alias("other")).select(
        "token", "node", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    maps = _of(sets.select("node", "n", "map"), wide.select("node").distinct(), limit)
    pairs = tasks.join(maps, "node").groupBy("token", "lo", "hi").applyInPandas(lean_group(_apart(percent)), "a long, b long")
    return near.unionAll(_pairs_that_link(materialise(pairs.distinct(), "hot-pairs"), sets, percent, limit))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, small: int = SMALL,
          broadcast_ids: int = BROADCAST_IDS) -> tuple[DataFrame, DataFrame]:
    """(rows, edges): doc, hash of the text, node and set size of every row; enough linked pairs of nodes to connect all that are linked."""
    base = docs.select(q(key).alias("doc"), q(text).alias("t"), text_hash(text).alias("hash"))
    kind = base.schema["doc"].dataType.simpleString()
    spark = docs.sparkSession
    first = materialise(base.mapInArrow(lean(_nodes(width)), f"doc {kind}, node long, n long, hash long, token long, hits long"), "nodes")
    rows = first.filter("token is null").select("doc", "hash", "node", "n")
    total = rows.filter("node is not null").count()
    # at most 100 times the mean number of low shingles: held by more than a fiftieth of the documents
    hot = first.filter("token is not null").groupBy("token").agg(F.sum("hits").alias("hits")).filter(F.col("hits") * HOT_SHARE > total).select("token").toArrow().column(0).to_numpy()
    held = spark.sparkContext.broadcast(np.sort(hot.view(U)))
    tokens = base.select("t").mapInArrow(lean(_tokens(held, width, percent)), "token long, node long, tag int")
    by = Window.partitionBy("token")
    shared = tokens.select("*", F.count(F.lit(1)).over(by).alias("df"), F.min("node").over(by).alias("lo"), F.max("node").over(by).alias("hi")).filter("lo <> hi")
    shared = shared.groupBy("node", "tag", "token").agg(F.max("df").alias("df"))
    late = F.col("tag").bitwiseAND(1)
    ranked = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(late.alias("late"), "df", "token"))).alias("every"), F.min(F.shiftright("tag", 1)).alias("missing"),
                                        F.sum(1 - late).alias("early"))
    sizes = rows.filter("node is not null").groupBy(F.col("node").alias("of")).agg(F.min("n").alias("n"))
    first = F.slice(F.transform("every", lambda e: e["token"]), 1, (F.col("missing") + F.col("early")).cast("int"))
    prefixes = ranked.filter("missing + early > 0").select("node", first.alias("prefix"))
    prefixes = materialise(prefixes.join(sizes, F.col("node") == F.col("of")).select("node", "n", "prefix"), "prefixes")
    places = prefixes.select("node", "n", F.explode("prefix").alias("token"))
    groups = places.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    places = materialise(places.join(groups, "token"), "places")
    tight = places.filter(F.col("members") <= small)
    a, b = tight.select("token", F.col("node").alias("a"), F.col("n").alias("na")), tight.select("token", F.col("node").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, "token").filter((F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b").distinct()
    pairs = materialise(pairs, "pairs")
    wide = places.filter(F.col("members") > small).select("token", "node")
    # sets of the nodes that are left, from one row of each
    left = _ends(pairs).unionAll(wide.select("node")).distinct()
    owner = rows.join(left, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc", "hash")).alias("row")).select(F.col("row.doc").alias("own"), F.col("row.hash").alias("own_hash"))
    owner = materialise(owner, "owners", total)
    few = owner.count() <= broadcast_ids
    kept = base.join(F.broadcast(owner) if few else owner, base["doc"].eqNullSafe(owner["own"]) & (base["hash"] == owner["own_hash"]), "left_semi").select("t")
    sets = kept.mapInArrow(lean(_sketches(width, percent)), "node long, n long, second array<int>, third array<int>, map array<long>, shingles array<long>")
    sets = materialise(sets, "sets")
    if sets.groupBy("node").count().filter("count > 1").limit(1).count():  # a row of the table that is there more than once
        sets = materialise(sets.dropDuplicates(["node"]), "sets")
    found = _pairs_that_link(pairs, sets, percent, broadcast_ids)
    if wide.limit(1).count():
        found = found.unionAll(_hot_links(wide, sets, found, percent, broadcast_ids))
    return rows, found


def _joined(docs: DataFrame, key: str, text: str, **options) -> tuple[DataFrame, int]:
    """doc, hash, n, root and component of every row; root is null for empty sets.  And how many rows."""
    rows, edges = links(docs, key, text, **options)
    roots = components(edges).select(F.col("node").alias("linked"), "root")
    least = rows.filter("node is not null").groupBy("node").agg(F.min("doc").alias("doc"))
    of = least.join(roots, least["node"] == roots["linked"], "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    named = of.join(of.groupBy("root").agg(F.min("doc").alias("component")), "root").select(F.col("node").alias("of"), "root", "component")
    found = rows.join(named, rows["node"] == named["of"], "left").select("doc", "hash", "n", "root", F.when(F.col("root").isNull(), F.col("doc")).otherwise(F.col("component")).alias("component"))
    return found, rows.count()


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: key, ``n_shingles``, ``component_id``."""
    return _joined(docs, key, text, **options)[0].select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component the row with the smallest id (nulls last), of its rows of that id the one with the smallest hash of its text;
    empty sets are linked with nothing and stay.  Rows that repeat an id and its text stay once."""
    found, total = _joined(docs, "doc_id", "text", width=STAGE_WIDTH, percent=STAGE_PERCENT)
    found = materialise(found, "components", total)
    heads = found.filter(F.col("root").isNotNull() & F.col("doc").eqNullSafe(F.col("component")))
    best = heads.groupBy(F.col("root").alias("of")).agg(F.min("hash").alias("best"))
    others = heads.join(best, (F.col("root") == F.col("of")) & (F.col("hash") != F.col("best")))
    gone = found.filter(F.col("root").isNotNull() & ~F.col("doc").eqNullSafe(F.col("component"))).select("doc", "hash").unionAll(others.select("doc", "hash"))
    names = {"doc": F.col("doc_id"), "hash": text_hash()}
    kept = without(docs, names, gone)
    again = materialise(found.groupBy("doc", "hash").count().filter("count > 1").select("doc", "hash"), "repeated", total)
    if not again.limit(1).count():
        return kept
    side = again.toDF("_id", "_hash")
    repeated = kept.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_hash() == F.col("_hash")), "left_semi").dropDuplicates(["doc_id", "text"])
    return without(kept, names, again).unionByName(repeated)
