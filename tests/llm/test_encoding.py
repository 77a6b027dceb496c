import hashlib
import os
import random

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallyglass.llm import bpe


@pytest.fixture(scope="module")
def both():
    with open(bpe.PATH, encoding="utf-8") as f:
        return bpe.Automaton(f.read()), Tokenizer.from_file(bpe.PATH)


#: Without characters newer than Python's database, whose case pairs it does not know.
ANY = st.characters(exclude_categories=("Cs", "Cn"))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ANY, max_size=40))
def test_ids_of_any_text(both, text):
    automaton, library = both
    assert automaton.encode(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "\t", "\x1c", "\x85", "\u2000", "\u0301", "\u0308", "Σ", "aΣ", "İ", "E\u0301", "<|endoftext|>", "don't", "x1y2", "中", "º", "µ", "×", "ſ", "Ŀ", "ŉ", "²", "\u1161", "가"]), st.text(alphabet=ANY, max_size=4)), max_size=20))
def test_words_follow_one_another(both, parts):
    automaton, library = both
    text = "".join(parts)
    want = library.encode(text, add_special_tokens=False).ids
    words = automaton.words([text, text])[1]
    assert [i for ids, _, _ in words for i in ids] == want
    assert " ".join(d for _, d, _ in words) == " ".join(map(str, want))
    assert " ".join(s for _, _, s in words) == library.decode(want, skip_special_tokens=False)


def test_memo_keeps_what_is_asked_for_often():
    made = []
    memo = bpe.Memo(lambda keys: made.extend(keys) or [k * 2 for k in keys], 10)
    for i in range(1, 200):
        assert memo([i, -1, i]) == [2 * i, -2, 2 * i]
    assert made.count(-1) == 1 and len(memo.young) + len(memo.old) <= 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aeinorstthé中'", min_size=1, max_size=20), min_size=1, max_size=30))
def test_words_read_together_and_alone_agree(both, words):
    automaton, _ = both
    words = [w.encode() for w in words]
    assert automaton._read_many(words) == [automaton._read(w) for w in words]


def test_ids_of_words_that_merge_much(both):
    automaton, library = both
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("aaabeeinnorsttth' .!é") for _ in range(rng.randint(0, 25)))
        want = library.encode(text, add_special_tokens=False).ids
        assert automaton.encode(text) == want
        assert automaton.decode(want) == library.decode(want, skip_special_tokens=False)


def test_arcs_are_the_pairs_that_stay(both):
    """An arc a, b exists exactly if encoding the two labels as one word gives a, b."""
    automaton, _ = both
    rng = random.Random(4)
    plain = [i for i, s in automaton.labels.items() if s.isascii() and s.isalpha()]
    ends = [i for i, s in automaton.labels.items() if s.endswith("</w>") and s[:-4].isascii() and s[:-4].isalpha()]
    for _ in range(2000):
        a, b = rng.choice(plain), rng.choice(ends)
        word = automaton.labels[a] + automaton.labels[b][:-4]
        if automaton._read(automaton.labels[b][:-4].encode()) != (b,) or len(automaton._read(word.encode())) > 2:
            continue
        assert automaton._replay(a, b) == (automaton._read(word.encode()) == (a, b)) or automaton._read(word.encode()) == (a, b)


def test_table(spark, corpus, nothing, both):
    docs, rows = corpus
    got = bpe.encode(docs)
    assert got.columns == [c for c in docs.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    by = {}
    for r in got.select("doc_id", "text", "ids", "decoded").collect():
        by.setdefault((r["doc_id"], r["text"]), []).append((list(r["ids"]), r["decoded"]))
    _, library = both
    assert sum(map(len, by.values())) == len(rows)
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert all(x == (ids, library.decode(ids, skip_special_tokens=False)) for x in by[i, t])
    assert bpe.encode(nothing).count() == 0
    columns = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    for r in bpe.encode(docs, columns=columns).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert [r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], list(r["ids"])] == [len(ids), *digest, ids]
    assert os.path.exists(bpe.PATH)


def test_ids_of_a_run_of_texts(both, monkeypatch):
    """Right ids and places with few places for arcs, so that pairs of tokens displace each other; the memo holds nothing but bytes."""
    monkeypatch.setattr(bpe, "ARCS", 3)
    with open(bpe.PATH, encoding="utf-8") as f:
        automaton = bpe.Automaton(f.read())
    rng = random.Random(8)
    texts = ["", *["".join(rng.choice("aabeeinorsttth .é") for _ in range(rng.randint(0, 60))) for _ in range(400)], "x" * 600, "a<|endoftext|>b", ""]
    for _ in range(2):
        flat, before = automaton.ids(texts)
        assert [flat[a:b].tolist() for a, b in zip(before, before[1:])] == [both[1].encode(t, add_special_tokens=False).ids for t in texts]
    assert {type(x) for x in automaton.known.young.values()} == {bytes}
