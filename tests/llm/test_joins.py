import collections
import re

import numpy as np
import pandas as pd
import pytest

from tallyglass.functions.store import materialise
from tallyglass.llm import graph, lattice, ngram_join

from .conftest import make_docs


def _components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _set(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(parts[i:i + 4]) for i in range(max(1, len(parts) - 3))} if parts else set()


def _brute_join(rows):
    sets = [(i, _set(t)) for i, t in rows]
    linked = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and 100 * len(s & t) >= 85 * len(s | t)]
    of = _components({i for i, _ in rows}, linked)
    return sorted((i, len(s), of[i] if s else i) for i, s in sets)


@pytest.mark.parametrize("options", [{}, {"small": 2}, {"broadcast_ids": 0}])
def test_join_against_brute_force(spark, corpus, options):
    docs, rows = corpus
    got = ngram_join.join_components(docs, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(tuple(r) for r in got.collect()) == _brute_join([(i, t) for i, t, _ in rows])


@pytest.mark.parametrize("leaders", [16, 0])
def test_join_of_a_tight_group(spark, monkeypatch, leaders):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        own = list(base)
        for k in rng.integers(0, 60, rng.integers(1, 4)):
            own[k] = f"x{rng.integers(0, 50)}"
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 30
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ngram_join, "MAP_ROWS", 8)
    monkeypatch.setattr(ngram_join, "LEADERS", leaders)
    got = ngram_join.join_components(make_docs(spark, texts), small=10).collect()
    assert sorted(tuple(r) for r in got) == _brute_join(list(enumerate(texts)))


def test_join_of_nothing(spark, nothing):
    assert ngram_join.join_components(nothing).count() == 0
    got = ngram_join.join_components(make_docs(spark, [None, "", "  "], ids=[5, None, 7])).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(5, 0, 5), (None, 0, None), (7, 0, 7)], key=str)


def test_stage_keeps_one_of_each_group(spark, corpus):
    docs, rows = corpus
    left = ngram_join.stage(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(_brute_stage([(i, t) for i, t, _ in rows]))


def test_stage_keeps_rows_that_share_a_key_with_a_copy(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = b.replace("b59", "other")
    rows = [(1, a), (5, a), (5, b), (None, a), (None, near), (7, c), (7, c), (8, None), (8, None), (9, c.upper())]
    docs = make_docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    left = sorted(((r["doc_id"], r["text"]) for r in ngram_join.stage(spark, docs, "").collect()), key=str)
    assert left == sorted([(1, a), (5, b), (7, c), (8, None)], key=str)
    twice = make_docs(spark, [b, near, near], ids=[5, 5, 6])
    left = ngram_join.stage(spark, twice, "").collect()
    assert [r["doc_id"] for r in left] == [5] and left[0]["text"] in (b, near)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (7, 3), (3, 7), (301, 300)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in _components({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]]).items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _vectors(spark, rows, path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "node": ["x"] * len(rows), "cell": [1] * len(rows)}), path)
    return spark.read.parquet(path)


def _brute_vectors(rows, threshold=0.95):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)]
    links, n = [], collections.Counter()
    for x, (a, u) in enumerate(ok):
        for b, v in ok[:x]:
            if len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    return links, n, _components({i for i, _ in rows}, links)


@pytest.mark.parametrize(("small", "block"), [(32, 1024), (3, 20)])
def test_lattice_recall_and_counts(spark, tmp_path, monkeypatch, small, block):
    monkeypatch.setattr(lattice, "SMALL", small)
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(200, 24))
    z -= (z * x[:200]).sum(axis=1, keepdims=True) * x[:200]
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.94, 0.99, 200)[:, None]
    y = c * x[:200] + np.sqrt(1 - c * c) * z
    tight = x[0] + rng.normal(size=(60, 24)) * 0.01
    vectors = [v.astype(np.float32).tolist() for v in [*x, *y, *tight, x[3], x[3] * 2, x[3]]]
    vectors += [None, [0.0] * 24, [1.0, None], [float("nan"), 1.0], [], [1.0, 0.0], [1.0, 0.1], [float("inf")] * 3]
    rows = list(enumerate(vectors))
    got = {r["vec_id"]: r for r in lattice.near_duplicates(_vectors(spark, rows, str(tmp_path / "v.parquet"))).collect()}
    links, n, of = _brute_vectors(rows)
    assert len(got) == len(rows)
    assert all(got[i]["n_links"] <= n[i] for i, _ in rows)  # none below the limit, none counted twice
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(n.values())
    assert np.mean([got[i]["component_id"] == of[i] for i, _ in rows]) > 0.99
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert all(got[i]["n_links"] == 0 for i in range(663, 668)) and got[668]["n_links"] == 1


def test_lattice_recall_by_cosine_at_the_size_of_the_table(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = np.repeat([0.9505, 0.96, 0.98], 300)[:, None] + rng.uniform(0, 0.005, (900, 1))
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *(c * x + np.sqrt(1 - c * c) * z)])]
    got = {r["vec_id"]: r["n_links"] for r in lattice.near_duplicates(_vectors(spark, rows, str(tmp_path / "v.parquet"))).collect()}
    recall = [np.mean([got[i] > 0 for i in range(band, band + 300)]) for band in (0, 300, 600)]
    assert recall[0] >= 0.93 and recall[1] >= 0.97 and recall[2] >= 0.99, recall


def test_lattice_of_nothing(spark, tmp_path):
    assert lattice.near_duplicates(_vectors(spark, [], str(tmp_path / "e.parquet"))).count() == 0


def test_lattice_points():
    short = lattice.minimal_vectors()
    assert short.shape == (240, 8) and np.allclose((short ** 2).sum(axis=1), 2) and len(np.unique(short, axis=0)) == 240
    x = np.random.default_rng(1).normal(size=(500, 8)) * 2
    point = lattice.decode(x)
    assert ((point * 2) % 1 == 0).all() and (point.sum(axis=1) % 2 == 0).all()
    near = ((x - point) ** 2).sum(axis=1)
    assert (near <= 1 + 1e-9).all()  # the covering radius of E8
    assert all(((x - point - v) ** 2).sum(axis=1).min() >= 0 and (((x - point - v) ** 2).sum(axis=1) >= near - 1e-9).all() for v in short)


def test_forest_labels():
    a, b = np.array([0, 1, 5, 7]), np.array([1, 2, 6, 5])
    assert ngram_join._forest(a, b, 9).tolist() == [0, 0, 0, 3, 4, 5, 5, 5, 8]
    assert pd.Series(ngram_join._forest(a[:0], b[:0], 3)).tolist() == [0, 1, 2]


def _brute_stage(rows, width=5, percent=80):
    sets = []
    for i, t in rows:
        parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(parts[k:k + width]) for k in range(max(1, len(parts) - width + 1))} if parts else set()))
    linked = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    return set(_components({i for i, _ in rows}, linked).values())


def test_stage_links_five_word_shingles_at_four_fifths(spark, corpus):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for changed in ((20, 60, 100, 140), (20, 60, 100, 140, 180), range(10, 190, 20)):
        texts.append(" ".join(f"x{len(texts)}y{i}" if i in changed else w for i, w in enumerate(base)))
    got = ngram_join.stage(spark, make_docs(spark, texts), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(_brute_stage(list(enumerate(texts)))) == [0, 2, 3]
    docs, rows = corpus
    assert sorted(r["doc_id"] for r in ngram_join.stage(spark, docs, "").collect()) == sorted(_brute_stage([(i, t) for i, t, _ in rows]))


def test_common_values_are_counted_in_bounded_parts(monkeypatch):
    rng = np.random.default_rng(3)
    rows, other = ([np.unique(rng.integers(0, 300, 40)).astype(np.uint64) for _ in range(30)] for _ in "ab")
    want = [[len(np.intersect1d(x, y)) for y in other] for x in rows]
    most, ranges = [], ngram_join._ranges
    monkeypatch.setattr(ngram_join, "_ranges", lambda begin, count: most.append(int(count.sum())) or ranges(begin, count))
    monkeypatch.setattr(ngram_join, "SHARED", 50)
    assert ngram_join._share(rows, other).tolist() == want
    assert max(most) < 50 + 30 * 30


def test_whole_sets_are_met_for_candidates_alone(spark, tmp_path, monkeypatch):
    """Documents that share a rare passage but do not link: their sets are not sent."""
    passage = " ".join(f"p{i}" for i in range(12))
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) + " " + passage for i in range(40)] + [" ".join(f"c{j}" for j in range(60))] * 2 + [" ".join(f"c{j}" for j in range(59))]
    rows, sent = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), []
    of = ngram_join._of
    monkeypatch.setattr(ngram_join, "_of", lambda sets, nodes, limit: sent.append((sets.columns, (out := of(sets, nodes, limit)).count())) or out)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(rows.unionAll(rows)).collect()}
    assert got == {**{i: i for i in range(40)}, 40: 40, 41: 40, 42: 40}
    assert [n for columns, n in sent if "shingles" in columns] == [2]
    assert ngram_join._of(spark.range(5).toDF("node"), spark.range(3).toDF("x"), 2).count() == 5  # more than the limit: all


def test_small_tables_are_written_in_few_files(spark):
    assert len(materialise(spark.range(0, 800, 1, 8), "t").inputFiles()) == 8
    got = materialise(spark.range(0, 800, 1, 8), "t", 800)
    assert len(got.inputFiles()) == 1 and got.count() == 800
    assert len(materialise(spark.range(0, 800, 1, 8), "t", 800, 300).inputFiles()) == 3
