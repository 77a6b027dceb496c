import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tallyglass.llm.arrays import ALNUM, SPACE, Members, U, runs, shingles, texts, word_hashes, words
from tallyglass.llm.extract import RUN, covered, standing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n.x9", max_size=30)), max_size=12), st.integers(1, 40))
def test_words_follow_the_pattern(rows, limit):
    got = []
    for _, _, raw, offsets in runs(texts(pa.array(rows, pa.string())), limit):
        start, end, first = words(raw, offsets, ~SPACE)
        for i in range(len(offsets) - 1):
            got.append([raw[a:b].tobytes().decode() for a, b in zip(start[first[i]:first[i + 1]], end[first[i]:first[i + 1]])])
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in rows]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab AB", max_size=40), min_size=1, max_size=6), st.integers(1, 5))
def test_equal_shingles_have_equal_hashes(rows, width):
    seen = {}
    for _, _, raw, offsets in runs(texts(pa.array(rows, pa.string()))):
        start, end, first = words(raw, offsets, ~SPACE)
        values, before = shingles(word_hashes(raw, start, end), first, width)
        for i, text in enumerate(rows):
            parts = text.lower().split()
            expected = [tuple(parts[k:k + width]) for k in range(max(1, len(parts) - width + 1))] if parts else []
            own = values[before[i]:before[i + 1]].tolist()
            assert len(own) == len(expected)
            for value, gram in zip(own, expected):
                assert seen.setdefault(gram, value) == value
    assert len(set(seen.values())) == len(seen)


def test_members_find_exactly():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 500).astype(U)
    probe = np.concatenate([values[:50], rng.integers(0, 1 << 63, 500).astype(U)])
    at, index = Members(values).find(probe)
    assert at.tolist() == [i for i, v in enumerate(probe.tolist()) if v in set(values.tolist())]
    assert (np.unique(values)[index] == probe[at]).all()
    assert len(Members(values[:0]).find(probe)[0]) == 0
    assert ALNUM[ord("é".encode()[0:1])] and not ALNUM[ord("-")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=3 * RUN), min_size=1, max_size=6), st.integers(2, 3))
def test_standing_and_covered_against_brute_force(pages, least):
    hashes = np.array([x for p in pages for x in p], U)
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    grams = {}
    for i, p in enumerate(pages):
        for k in range(len(p) - RUN + 1):
            grams.setdefault(tuple(p[k:k + RUN]), set()).add(i)
    begins, counts, first = standing(hashes, page)
    offset = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
    expected = {int(offset[i]) + k: len(grams[tuple(p[k:k + RUN])]) for i, p in enumerate(pages) for k in range(len(p) - RUN + 1)}
    assert dict(zip(begins.tolist(), counts.tolist())) == expected
    assert int(first.sum()) == len(grams)
    inside = []
    for p in pages:
        own = [False] * len(p)
        for k in range(len(p) - RUN + 1):
            if len(grams[tuple(p[k:k + RUN])]) >= least:
                own[k:k + RUN] = [True] * RUN
        inside += own
    assert covered(begins[counts >= least], len(hashes)).tolist() == inside
