import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, lang_pred string, ids string, decoded string, "
          "k int, t string, node string, n string, token string, component_id string, `a.b` string")
CLASH = ("x",) * 5 + (1,) + ("y",) * 6
SYLLABLES = {"en": "the an ing er on th ed re", "de": "der sch ung ein ich keit ver", "fr": "eau ou les que ment tion é"}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_texts():
    """Null, empty, blank, signs only, one word, repeated words, Unicode, special tokens, a very long text."""
    return [None, "", "   \n\t", "!!! ### ...", "word", "of " * 300, "Ünïcödé Σίσυφος 中文 ﬁ İstanbul", "a<|endoftext|>b <|startoftext|>", "\u0000 control \u001f",
            "long " + "the quick brown fox " * 20_000]


def make_docs(spark, texts, langs=None, ids=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", "src", len(t or ""), *CLASH) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def corpus(spark):
    """(docs, texts): three languages, near and exact copies, repeated rows, nulls and odd texts."""
    rng = random.Random(5)
    texts, langs = [], []
    for lang in SYLLABLES:
        for _ in range(40):
            texts.append(sentence(rng, lang, rng.randint(5, 120)))
            langs.append(lang)
    for i in range(0, 60, 3):
        parts = texts[i].split()
        parts[rng.randrange(len(parts))] = "changed"
        texts += [" ".join(parts), texts[i].upper()]
        langs += [langs[i], langs[i]]
    texts += odd_texts()
    langs += [None, "en", "en", None, "en", "en", "fr", "en", "en", "en"]
    ids = list(range(len(texts)))
    texts += [texts[3], texts[4], texts[4]]  # repeated rows
    langs += [langs[3], langs[4], langs[4]]
    ids += [3, 4, 4]
    return make_docs(spark, texts, langs, ids).cache(), list(zip(ids, texts, langs))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
