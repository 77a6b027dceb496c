import collections
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from tallyglass.llm import spelling as s

from .conftest import make_docs


def _edit(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _words(rows, edits):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if edits and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def _brute(words):
    near = {w: [v for v in words if _edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def _rows(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaaaa", "aaaaaaa", "abababab", "babababa", "mississippi", "misissippi", "misisippi", "ÀÉÎÕÜßÿ"]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(base, weights=[200 / (k + 1) for k in range(len(base))], k=60))))
    return rows + [(None, "mississippi " * 3 + "Straße×÷Wörter 中文aaaaaaaa1aaaaaaa"), (100, None), (101, ""), (102, "short words only"), (103, "mississippi " * 9_000), (103, "mississippi-abababab"), (103, "mississippi-abababab")]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=3, max_size=3), max_size=12), st.sets(st.text(alphabet="abc", min_size=4, max_size=4), max_size=12), st.integers(1, 4))
def test_composition_against_all_pairs(short, long, within):
    pairs = [(x, y) for x in short for y in short if x < y] + [(x, y) for x in short for y in long]
    near = sorted((x, y) for x, y in pairs if _edit(x, y))
    assert sorted(s.composed(sorted(short), sorted(long))) == near
    assert sorted(s.composed(sorted(short), sorted(long), within)) == [(x, y) for x, y in near if x[:within] != y[:within]]


def test_acceptors_are_minimal():
    machine = s.Acceptors()
    machine.add(sorted(a + b + c for a in "abc" for b in "xy" for c in "uv"))
    assert len(machine.arcs) == 4


@pytest.mark.parametrize("split,edits", [(20_000, True), (2, True), (1, False)])
def test_variants_against_brute_force(spark, split, edits):
    rows = _rows()
    docs = make_docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = s.variants(s.materialise(s.vocabulary(docs, edits=edits), "words"), split)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = _brute(_words(rows, edits))
    assert sorted(tuple(r) for r in got.collect()) == expected
    assert any(r[1] for r in expected)


def test_chains_of_forms(spark):
    words = {"abcdefg": 1, "abcdefh": 10, "abcdeih": 100, "abcjeih": 999, "abkjeih": 9990, "zzzzzzz": 5, "zzzzzzzz": 5}
    table = s.materialise(spark.createDataFrame(list(words.items()), "word string, n long"), "words")
    got = sorted(tuple(r) for r in s.variants(table).collect())
    assert got == _brute(words) and [r[2] for r in got][0] == "abcdeih"


def test_nothing(spark, nothing):
    assert s.variants(s.materialise(s.vocabulary(nothing, edits=True), "words")).count() == 0
    assert s.variants(s.materialise(s.vocabulary(make_docs(spark, [None, "", "a b c", "unikatwort"])), "words")).count() == 0
