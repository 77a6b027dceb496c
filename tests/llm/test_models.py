import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.llm import language, ppm, quality

from .conftest import SYLLABLES, make_docs, sentence


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def _learned(i):
    return zlib.crc32(str(i).encode()) % 7 != 2


def _brute_ppm(rows):
    order = ppm.ORDER
    counts, tokens = collections.defaultdict(collections.Counter), collections.Counter()
    stream = {}
    for i, text in rows:
        stream[i, text] = bytes(order) + " ".join(_words(text)).encode() + b"\n"
        if _learned(i):
            tokens.update([*_words(text), None])
            s = stream[i, text]
            for p in range(order, len(s)):
                for j in range(order + 1):
                    counts[s[p - j:p]][s[p]] += 1
    n, v = sum(tokens.values()), len(tokens)
    out = []
    for i, text in rows:
        s, total = stream[i, text], 0.0
        for p in range(order, len(s)):
            gone = set()
            for j in range(order, -2, -1):
                if j < 0:
                    total += math.log10(1 / (256 - len(gone)))
                    break
                seen = counts.get(s[p - j:p])
                if not seen:
                    continue
                live = {k: c for k, c in seen.items() if k not in gone}
                t, q = sum(live.values()), len(live)
                if s[p] in live:
                    total += math.log10((live[s[p]] - 0.5) / t)
                    break
                if q:
                    total += math.log10(q / 2 / t)
                gone = set(seen)
        own = [*_words(text), None]
        out.append((i, len(own), sum(tokens[w] > 0 for w in own), n, sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in own), total))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"shard": 2_000, "frequent": 30}])
def test_ppm_is_the_defined_sum(spark, options):
    texts = ["the cat sat on the mat", "The CAT sat", None, "", "  ", "a\tb\nc", "über the münchen " * 5, "zz top the hat", "of " * 200, "unseen βγ"] * 2 + ["the cat sat on the mat"]
    ids = [*range(len(texts) - 1), 0]  # the last row repeats the first
    got = ppm.score(make_docs(spark, texts, ids=ids), _spark_learned(), **options).collect()
    for a, b in zip(sorted(tuple(r) for r in got), _brute_ppm(list(zip(ids, texts))), strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-6, abs=1e-4)


def _spark_learned():
    return F.crc32(F.col("doc_id").cast("string")) % 7 != 2


def test_ppm_probabilities_sum_to_one(spark):
    docs = [b"abracadabra abra", b"bar bra cada"]
    raw = np.frombuffer(b"".join(docs), np.uint8)
    stream, begins, _, _ = ppm.normal(raw, np.array([0, len(docs[0]), len(raw)]))
    keys, n = ppm._distinct(ppm.grams(stream, begins)[0])
    low, low_n = ppm._sum(keys & np.uint64(0xFFFF), n)
    trie = ppm.Trie(keys, n, low, low_n)
    for context in (b"\0\0\0\0\0", b"abrac", b"xabra", b"qqqqq", b"a bra"):
        base = np.uint64(int.from_bytes(context, "big") << 8)
        assert (10 ** trie.logp(base + np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1, abs=1e-6)


def test_ppm_of_nothing(spark, nothing):
    assert ppm.score(nothing, _spark_learned()).count() == 0
    alone = ppm.score(make_docs(spark, ["a b", None]), F.lit(False)).collect()  # nothing to learn from
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in alone) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(r["score"] < 0 for r in alone)


def test_language_on_held_out_rows(spark, corpus):
    docs, rows = corpus
    got = language.identify(docs, condition=lambda k: ~language._held_out(k))
    assert [c for c in got.columns] == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append((r["lang_pred"], r["score"]))
        assert 0 <= r["score"] <= 1
    assert sum(map(len, by.values())) == len(rows)
    for i, t, lang in rows:
        letters = any(c.isalpha() for c in t or "")
        assert all((p == "und") == (not letters) and (letters or s == 0) for p, s in by[i])
    held = [(by[i][0][0], lang) for i, t, lang in rows[:120] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([p == lang for p, lang in held]) > 0.95


def test_language_without_training_rows(spark, nothing):
    assert language.identify(nothing).count() == 0
    got = language.identify(make_docs(spark, ["some text", None], [None, None])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2


def test_kernel_is_presence_overlap():
    import pyarrow as pa

    rows = ["abc abd", "ABC  abd!!", "zz", "", None]
    x = np.concatenate([m for _, m in language._matrices(pa.array(rows, pa.string()))])
    assert (x[0, :] == 1).sum() == len({"abc abd"[i:i + n] for n in range(1, 5) for i in range(7 - n + 1)})
    assert (x[0] * x[2]).sum() == 0 and not x[3].any() and not x[4].any()
    assert (x[0] * x[1]).sum() == x[0].sum()


def test_quality_on_held_out_rows(spark, corpus):
    import random

    from .conftest import sentence

    rng = random.Random(8)
    good = [sentence(rng, "en", rng.randint(20, 80)) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in sentence(rng, "en", rng.randint(20, 80)).split()) for _ in range(60)] + ["of " * 50 + "the " * 40 for _ in range(40)]
    docs = make_docs(spark, good + bad + [None, "", good[0]], ids=[*range(250), 250, 251, 0])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(250)] + [(0, 1, 0), (7, None, None), (None, 0, 0), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, learn=lambda k: ~quality._held_out(k))
    assert got.count() == 253
    rows = got.select("doc_id", "score", "predicted").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], int(r["doc_id"] < 150)) for r in rows if r["doc_id"] < 250 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.95
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs.repartition(5), labels, learn=lambda k: ~quality._held_out(k)).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-4 for r in rows)


def test_quality_without_labels(spark, corpus, nothing):
    docs, _ = corpus
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs, none).select("score").collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs, one).select("score").collect()} == {1.0}
    assert quality.classify(nothing, one).count() == 0


def test_word_vectors_and_pooling_against_loops(spark):
    rows = ["the cat sat on the mat.", "The dog; the cat!", "", None, "one", "a b a b a b", "naïve Ünï"]
    hashes = []
    for t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        hashes.append(quality._tokens(raw, np.array([0, len(raw)]))[0])
    table = np.zeros((quality.BUCKETS, quality.DIMS))
    for own in hashes:
        for i, h in enumerate(own):
            for j in range(max(0, i - quality.WINDOW), min(len(own), i + quality.WINDOW + 1)):
                if i == j:
                    continue
                bits = int(quality.mix(own[j:j + 1], 5)[0])
                for k in range(quality.NONZERO):
                    table[int(h) >> (64 - 14), bits >> (8 * k) & (quality.DIMS - 1)] += 1 - 2 * (bits >> (48 + k) & 1)
    used = [i for i in range(len(table)) if table[i].any()]
    unit = {i: table[i] / np.linalg.norm(table[i]) for i in used}
    middle = sum(unit.values()) / len(unit)
    want = np.zeros_like(table)
    for i in used:
        want[i] = (unit[i] - middle) / np.linalg.norm(unit[i] - middle)
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in rows], "text string").repartition(3))
    assert np.allclose(got, want, atol=1e-5)
    for t, own in zip(rows, hashes):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        v = [want[int(h) >> (64 - 14)] for h in own]
        mean = sum(v) / len(v) if v else np.zeros(quality.DIMS)
        pair = sum((a * b for a, b in zip(v, v[1:])), np.zeros(quality.DIMS)) / max(len(v) - 1, 1)
        assert np.allclose(quality._pool(got, raw, np.array([0, len(raw)]))[0], [*mean, *pair, np.linalg.norm(mean), pair.sum()], atol=1e-5)


def test_language_against_the_kernel_written_out(spark):
    rng = random.Random(12)
    texts = [(i, sentence(rng, lang, rng.randint(3, 30)), lang) for i, lang in enumerate(sorted(SYLLABLES) * 12)]
    asked = [(100 + i, sentence(rng, lang, 8), None) for i, lang in enumerate(sorted(SYLLABLES) * 3)] + [(200, "12 34", None), (201, "", "en")]
    docs = spark.createDataFrame(texts + asked, "doc_id long, text string, lang string")

    def held(t):
        raw = np.frombuffer((t or "").lower().encode(), np.uint8)
        return set(np.flatnonzero(language._presence(raw, np.array([0, len(raw)]))[0]).tolist())

    train = [(t, lang) for _, t, lang in texts] + [("", "en")]
    marks = [m for m in {frozenset(held(t)) for t, _ in train} if m]

    def kernel(a, b):
        return len(a & b) / np.sqrt(max(len(a), 1) * len(b))

    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(k)
    use = value > 1e-6 * value.max()

    def features(t):
        return np.array([kernel(held(t), m) for m in marks]) @ vector[:, use] / np.sqrt(value[use])

    names = sorted(SYLLABLES)
    f, y = np.array([features(t) for t, _ in train]), np.array([[lang == n for n in names] for _, lang in train], float)
    g = f - f.mean(0)
    beta = np.linalg.solve(g.T @ g + language.RIDGE * len(f) * np.eye(f.shape[1]), g.T @ (y - y.mean(0)))
    for r in language.identify(docs, landmarks=10_000).collect():
        out = (features(r["text"]) - f.mean(0)) @ beta + y.mean(0)
        if not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == names[int(out.argmax())] and abs(r["score"] - min(1.0, max(0.0, out.max()))) < 5e-3
