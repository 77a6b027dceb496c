import random

import numpy as np
import pytest

from tallyglass.llm import licenses
from tallyglass.llm.arrays import U

from .conftest import make_docs, sentence


def _best(template, doc):
    """Best score of aligning the whole template with any part of the document."""
    rows = [[0] * (len(doc) + 1)]
    for i, w in enumerate(template):
        row = [rows[i][0] - 1]
        for j, x in enumerate(doc):
            row.append(max(rows[i][j] + (1 if w == x else -1), rows[i][j + 1] - 1, row[j] - 1))
        rows.append(row)
    return max(rows[-1])


def _score(template, part):
    """Best score of aligning the whole template with the whole part."""
    rows = [[-j for j in range(len(part) + 1)]]
    for i, w in enumerate(template):
        row = [rows[i][0] - 1]
        for j, x in enumerate(part):
            row.append(max(rows[i][j] + (1 if w == x else -1), rows[i][j + 1] - 1, row[j] - 1))
        rows.append(row)
    return rows[-1][-1]


def test_alignment_is_optimal_within_a_wide_band():
    rng = random.Random(6)
    for _ in range(400):
        template = [rng.randint(0, 5) for _ in range(rng.randint(1, 10))]
        doc = [rng.randint(0, 5) for _ in range(rng.randint(0, 18))]
        n, first, end = licenses.align(np.array(template, U), np.array(doc, U), -25, 40)
        assert 0 <= first <= end <= len(doc) and n <= min(len(template), end - first)
        assert _score(template, doc[first:end]) == _best(template, doc)


def test_notices_with_edits_and_spans(spark, nothing):
    rng = random.Random(7)
    filler = [sentence(rng, "en", 60) for _ in range(8)]
    mit = licenses.TEMPLATES["MIT"]
    edited = mit.split()
    del edited[10]
    edited.insert(30, "really")
    edited[40] = "CHANGED"
    texts = [f"{filler[0]} Licensed under the Apache License, Version 2.0. {filler[1]}", f"é {filler[2]}\n{mit}\n{filler[3]}", " ".join(edited), filler[4],
             "Released under the MIT License. x Released under the MIT license!", " ".join(mit.split()[:20]), None, "", "MIT",
             f"{filler[5]} this work is LICENSED under the gnu general public license -- version 3", ("word " * 60_000) + "Licensed under CC BY-NC 4.0."]
    got = licenses.scan(make_docs(spark, [*texts, texts[0]], ids=[*range(len(texts)), 0])).collect()
    by = {}
    for r in got:
        text = texts[r["doc_id"]]
        assert text[r["first"]:r["last"]] == r["notice"] and r["coverage"] >= 0.8 and r["matched"] <= r["n_words"]
        by.setdefault(r["doc_id"], []).append((r["license"], r["coverage"] == 1))
    assert {k: sorted(v) for k, v in by.items()} == {0: [("Apache-2.0 notice", True)] * 2, 1: [("MIT", True)], 2: [("MIT", False)], 4: [("MIT notice", True)] * 2,
                                                     9: [("GPL-3.0 notice", True)], 10: [("CC-BY-NC-4.0 notice", True)]}
    assert licenses.scan(nothing).count() == 0


def test_own_templates(spark):
    docs = make_docs(spark, ["one two", "x one two y", "one", "alpha beta gamma delta epsilon"])
    got = licenses.scan(docs, {"short": "One two.", "empty": "...", "long": "alpha beta gamma zeta epsilon"}).collect()
    assert sorted((r["doc_id"], r["license"], r["matched"]) for r in got) == [(0, "short", 2), (1, "short", 2), (3, "long", 4)]


@pytest.mark.parametrize("n", [5, 9, 30])
def test_any_long_run_of_a_template_is_hit(n):
    words = [f"w{i}" for i in range(n)]
    index = licenses.Index({"t": " ".join(words)})
    places = sorted(i for post in index.posts for _, i in post)
    run = licenses.KGRAM + licenses.WINDOW - 1
    for at in range(max(1, n - run + 1)):
        assert any(at <= p <= at + run - licenses.KGRAM for p in places)


def test_every_kind_of_notice_in_the_given_documents(spark, sf):
    kinds = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0 notice", "All rights reserved.": "All rights reserved", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0 notice",
             "Released under the MIT License.": "MIT notice", "Licensed under the Apache License, Version 2.0.": "Apache-2.0 notice"}
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    want = sorted((r["doc_id"], kinds[line]) for r in docs.select("doc_id", "text").collect() for line in (r["text"] or "").split("\n") if line in kinds)
    assert {k for _, k in want} == set(kinds.values())
    assert sorted((r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()) == want


def test_every_template_is_found_as_itself(spark):
    rng = random.Random(8)
    names = sorted(licenses.TEMPLATES)
    texts = [f"{sentence(rng, 'en', 12)}\n{licenses.TEMPLATES[n]}\n{sentence(rng, 'en', 12)}" for n in names]
    got = [(names[r["doc_id"]], r["license"], r["coverage"]) for r in licenses.scan(make_docs(spark, texts)).collect()]
    assert sorted(got) == [(n, n, 1.0) for n in names]


def test_an_edited_whole_text_is_not_its_opening(spark):
    edited = {}
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "Apache-2.0", "AGPL-3.0"):
        parts = licenses.TEMPLATES[name].split()
        parts[len(parts) * 9 // 10] = "changed"
        edited[name] = " ".join(parts)
    got = licenses.scan(make_docs(spark, list(edited.values()))).collect()
    assert sorted((r["doc_id"], r["license"], r["n_words"] - r["matched"] <= 2) for r in got) == [(i, n, True) for i, n in enumerate(edited)]


def test_the_word_bound_never_cuts_a_match():
    rng = random.Random(9)
    for _ in range(200):
        template = np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 10))], U)
        doc = np.array([rng.randint(0, 5) for _ in range(rng.randint(0, 18))], U)
        assert licenses.reach(np.unique(template, return_counts=True), doc) >= licenses.align(template, doc, -25, 40)[0]
