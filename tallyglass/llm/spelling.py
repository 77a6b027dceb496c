"""Operator 11: spelling variants grouped by finite-state composition: vocabulary acceptor, one-edit transducer, acceptor again.

Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z folded, of at least ``LEAST`` code points and ``TWICE`` occurrences.  Two words are
near if they differ by exactly one inserted, deleted or replaced code point.  The form of a word is its most frequent near word (ties: the
first in code-point order) if that occurs ``TIMES`` times as often at least; its root is found by following forms to the last.

Composition.  A pair of near words whose shorter one has m code points shares its first m // 2 of them, or else its last m // 2.  So
the acceptor's paths are dealt out by the state that the shared part leads to (the shared part and m), and each of these initial states has an acceptor
of its own for what is left of the words.  A task builds the minimal acceptors of one initial state (words of m and of m + 1 code points), and
walks the composed machine from there: before the edit both tapes are in the same state, the transducer's edit arc replaces or inserts one code point,
behind it only words on which both states agree are accepted.  Pairs that share both parts are accepted under the first only.
An initial state with more than ``SPLIT`` words is dealt again by half of what is left, until at most one code point may be left, so
no task holds more than an alphabet squared or ``SPLIT`` words.

Nulls: a null text has no words, a null id counts as an empty text in the planted edits.  Empty tables give an empty result; repeated rows count as rows.  Extra
columns are ignored.

Scale.  Whole texts are read once; counts combine before the shuffle; then only words travel, four short rows each.  Roots take a
join per step of the longest chain of forms, at most the logarithm of the largest count to base ``TIMES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.exprs import q
from ..functions.store import materialise
from .arrays import lean

LETTERS = "A-Za-zÀ-ÿ"
LEAST, TWICE, TIMES = 7, 2, 10
PLANTED = 31
SPLIT = 20_000
ANYWHERE = 1 << 30
MAX_STEPS = 64


class Acceptors:
    """Minimal acceptors of sorted texts over one set of states: equal right languages are one state."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.arcs: list[tuple] = []
        self.final: list[bool] = []
        self.shared: dict[tuple[int, int], list[str]] = {}

    def add(self, texts: list[str]) -> int:
        """The initial state of the acceptor of ``texts`` (sorted, distinct)."""
        return self._state(texts, 0, len(texts), 0)

    def _state(self, texts, lo, hi, depth) -> int:
        final = len(texts[lo]) == depth
        lo += final
        arcs = []
        while lo < hi:
            symbol, end = texts[lo][depth], lo + 1
            while end < hi and texts[end][depth] == symbol:
                end += 1
            arcs.append((symbol, self._state(texts, lo, end, depth + 1)))
            lo = end
        key = (final, *arcs)
        got = self.number.get(key)
        if got is None:
            got = self.number[key] = len(self.arcs)
            self.arcs.append(tuple(arcs))
            self.final.append(final)
        return got

    def common(self, a: int, b: int) -> list[str]:
        """The texts that both states accept."""
        got = self.shared.get((a, b))
        if got is None:
            got = [""] if self.final[a] and self.final[b] else []
            if a == b:
                got = got + [c + t for c, to in self.arcs[a] for t in self.common(to, to)]
            elif self.arcs[a] and self.arcs[b]:
                other = dict(self.arcs[b])
                got = got + [c + t for c, to in self.arcs[a] if c in other for t in self.common(to, other[c])]
            self.shared[a, b] = got
        return got


def composed(short: list[str], long: list[str], within: int = ANYWHERE) -> Iterator[tuple[str, str]]:
    """Pairs of ``short`` that differ by one replacement and of ``short`` and ``long`` (texts one longer) by one insertion, each once; with
    ``within``, those only that differ in their first ``within`` code points.  Both sorted and distinct."""
    if not short or len(short) + len(long) < 2:
        return
    machine = Acceptors()
    stack = [(machine.add(short), machine.add(long) if long else -1, "")]
    arcs, common = machine.arcs, machine.common
    while stack:
        a, b, read = stack.pop()
        if len(read) >= within:
            continue
        own, more = arcs[a], arcs[b] if b >= 0 else ()
        for i, (c, x) in enumerate(own):
            for d, y in own[i + 1:]:
                for tail in common(x, y):
                    yield read + c + tail, read + d + tail
        for d, y in more:
            if not read or read[-1] != d:  # else the same text as by an insertion further left
                for tail in common(a, y):
                    if within >= ANYWHERE or (read + tail)[:within] != (read + d + tail)[:within]:
                        yield read + tail, read + d + tail
        ahead = dict(more)
        for c, x in own:
            stack.append((x, ahead.get(c, -1), read + c))


def _near(batches):
    """Rows (key, rest, long, word, n, within) in order of key and rest: both directions of every near pair."""
    names = ["word", "near", "near_n"]
    of, group, out = None, [], ([], [], [])

    def close():
        if len(group) > 1:
            held = ({}, {})
            for rest, long, word, n in group:
                held[long][rest] = (word, n)
            for x, y in composed(list(held[0]), list(held[1]), of[1]):
                a, b = held[0][x], held[len(y) > len(x)][y]
                for u, v in ((a, b), (b, a)):
                    out[0].append(u[0])
                    out[1].append(v[0])
                    out[2].append(v[1])

    def batch():
        done = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names)
        for column in out:
            column.clear()
        return done

    for rows in batches:
        for key, rest, long, word, n, within in zip(*(rows.column(i).to_pylist() for i in range(6))):
            if of is None or key != of[0]:
                close()
                of = (key, within)
                group.clear()
                if len(out[0]) > 50_000:
                    yield batch()
            group.append((rest, long, word, n))
    close()
    yield batch()


def runs_of(text: Column) -> Column:
    """Maximal runs of at least ``LEAST`` letters, A-Z folded."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.transform(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{LEAST},}}"), F.lit(0)), lambda r: F.translate(r, upper, upper.lower()))


def planted(key: Column, run: Column) -> Column:
    """The run, without one code point where 31 divides the crc32 of ``key:run``."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % PLANTED == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: bool = False) -> DataFrame:
    """(word, n) of all documents; ``edits``: with the planted ones of the query."""
    runs = docs.select(q(key).alias("key"), F.explode(runs_of(q(text))).alias("run"))
    word = planted(F.col("key"), F.col("run")) if edits else F.col("run")
    return runs.select(word.alias("word")).filter(F.length("word") >= LEAST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= TWICE)


def _halves(rows: DataFrame) -> DataFrame:
    """Every row (key, rest, size, long, word, n, within) by the first and by the last half of ``size``, what the shorter word has left."""
    half = F.floor(F.col("size") / 2).cast("int")
    rest, key = F.col("rest"), F.col("key")
    front = F.struct(F.concat(key, F.lit(">"), F.substr(rest, F.lit(1), half)).alias("key"), F.substr(rest, half + 1).alias("rest"), F.when(F.col("within") >= ANYWHERE, ANYWHERE).otherwise(F.col("within") - half).alias("within"))
    back = F.struct(F.concat(key, F.lit("<"), F.substr(rest, F.length(rest) - half + 1)).alias("key"), F.substr(rest, F.lit(1), F.length(rest) - half).alias("rest"), F.least("within", half).alias("within"))
    out = rows.select("long", "word", "n", (F.col("size") - half).alias("size"), F.explode(F.array(front, back)).alias("r"))
    return out.select("r.key", "r.rest", "size", "long", "word", "n", "r.within").filter("within > 0")


def _paths(words: DataFrame, split: int) -> DataFrame:
    """(key, rest, size, long, word, n, within): words by initial states, none of them with more than ``split`` words unless it is short."""
    size = F.length("word")
    lengths = F.filter(F.array(F.struct(size.alias("size"), F.lit(False).alias("long")), F.struct((size - 1).alias("size"), F.lit(True).alias("long"))), lambda s: s["size"] >= LEAST)
    each = words.select("word", "n", F.explode(lengths).alias("s")).select(F.col("s.size").cast("string").alias("key"), F.col("word").alias("rest"), "s.size", "s.long", "word", "n", F.lit(ANYWHERE).alias("within"))
    now = materialise(_halves(each), "paths")
    done = []
    while True:
        hot = now.filter("size > 1").groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > split).select(F.col("key").alias("hot"))
        hot = materialise(hot, "hot-states")
        if not hot.limit(1).count():
            break
        done.append(now.join(hot, now["key"] == hot["hot"], "left_anti"))
        now = materialise(_halves(now.join(hot, now["key"] == hot["hot"], "left_semi")), "paths")
    for part in done:
        now = now.unionByName(part)
    return now


def near_words(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """(word, near, near_n): both directions of all near pairs of ``words`` (word, n)."""
    dealt = _paths(words, split).select("key", "rest", "long", "word", "n", "within").repartition("key").sortWithinPartitions("key", "rest")
    return dealt.mapInArrow(lean(_near), "word string, near string, near_n long")


def variants(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """One row per word of ``words`` (word, n; a written table): form, root, n, n_near, form_n."""
    first = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near_words(words, split).groupBy(F.col("word").alias("of")).agg(F.count(F.lit(1)).alias("n_near"), first)
    formed = F.coalesce(-F.col("best.n") >= TIMES * F.col("n"), F.lit(False))
    all_ = words.join(near, words["word"] == near["of"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n"))
    all_ = materialise(all_, "forms")
    step = all_.filter("form is not null").select(F.col("word").alias("from"), F.col("form").alias("to"))
    now = materialise(step.select(F.col("from").alias("of"), F.col("to").alias("root"), F.lit(True).alias("open")), "roots")
    for _ in range(MAX_STEPS):  # counts grow tenfold with every step
        if not now.filter("open").limit(1).count():
            break
        moved = now.filter("open").join(step, F.col("root") == F.col("from"), "left").select("of", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("open"))
        now = materialise(moved.unionByName(now.filter("not open")), "roots")
    out = all_.join(now, all_["word"] == now["of"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(materialise(vocabulary(docs, edits=True), "words"))


OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL HAVING length(run) >= 7),
table_ AS (SELECT list(list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) ORDER BY b) AS v FROM range(256) r(b)),
h AS (SELECT run, times, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, v[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS h
      FROM (SELECT run, times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM t), table_),
w AS (SELECT word, sum(times)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM h)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
r AS (SELECT word, n, i, left(word, i - 1) || chr(0) || substr(word, i + 1) AS key, left(word, i - 1) || substr(word, i + 1) AS less FROM k),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM r a JOIN r b ON a.key = b.key AND a.word <> b.word
      UNION SELECT w.word, r.word, r.n FROM r JOIN w ON w.word = r.less UNION SELECT r.word, w.word, w.n FROM r JOIN w ON w.word = r.less),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS best, max(near_n) AS best_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.best_n >= 10 * w.n THEN b.best END AS form, CASE WHEN b.best_n >= 10 * w.n THEN b.best_n END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word)
SELECT f.word, f.form, z.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM f JOIN z USING (word)
"""
