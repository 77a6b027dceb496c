import re

import pytest

from tallyglass.llm import decontaminate as d

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def _sets(text, width):
    parts = WORD.findall((text or "").lower())
    return {tuple(parts[i:i + width]) for i in range(len(parts) - width + 1)}


def _brute(docs, items, threshold=0.8):
    out = []
    for doc, text in docs:
        for item, body in items:
            width = min(5, len(WORD.findall((body or "").lower())))
            own = _sets(body, width) if width else set()
            n = len(own & _sets(text, width)) if own else 0
            if own and n >= threshold * len(own) - 1e-9:
                out.append((doc, item, len(own), n))
    return sorted(out)


@pytest.mark.parametrize("block", [d.BLOCK_SHINGLES, 40])
def test_finds_what_brute_force_finds(spark, corpus, block):
    docs, rows = corpus
    texts = [t for _, t, _ in rows]
    long = texts[1].split()
    items = [(i, t) for i, t in enumerate([texts[0], " ".join(long[2:20]), " ".join(long[2:16] + ["other"] * 3), "word", "fox the", None, "", "...", texts[0], "absent words are never found here"])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in d.contained(docs, table, block_shingles=block).collect())
    assert got == _brute([(i, t) for i, t, _ in rows], items)
    assert any(r[1] == 4 for r in got) and any(r[1] == 3 for r in got)


def test_empty_sides_and_clean(spark, corpus, nothing):
    docs, rows = corpus
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contained(docs, none).count() == 0
    assert d.contained(nothing, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    table = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    left = d.clean(docs, table)
    assert left.columns == docs.columns
    dirty = {r[0] for r in _brute([(i, t) for i, t, _ in rows], [(1, rows[0][1])])}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _, _ in rows if i not in dirty)


def test_clean_removes_rows_not_keys(spark):
    item, other = (" ".join(f"{x}{i}" for i in range(30)) for x in "io")
    rows = [(1, "before " + item), (5, item), (5, other), (None, item), (None, other), (6, None)]
    left = d.clean(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert sorted((tuple(r) for r in left.collect()), key=str) == sorted([(5, other), (None, other), (6, None)], key=str)
