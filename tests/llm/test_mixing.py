import collections
import re

import pytest

from tallyglass.llm import mixing

from .conftest import make_docs

SCHEMA = "doc_id long, text string, source string, size string, taken int, _of string, bin int"


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _targets(sizes, weights=(5, 2, 1), ceiling=3):
    """Reshare the excess until no source is above its ceiling, step by step."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, out, left = set(names), {}, sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > ceiling * sizes[s]}
        out.update({s: share[s] for s in free})
        if not above:
            break
        out.update({s: ceiling * sizes[s] for s in above})
        left -= sum(ceiling * sizes[s] for s in above)
        free -= above
    return out


def _table(spark):
    rows = [(i, f"w{i} " * (i % 40 + 1), f"s{i % 7}") for i in range(300)]
    rows += [(1000 + i, "one two\tthree", None) for i in range(5)] + [(2000, "tiny", "a"), (2001, None, "a"), (2002, "", "empty"), (2003, " \n", "empty"), (None, "no id here", "s1")]
    rows += [(3000, "long " * 30_000, "s2"), (7, "w7 " * 8, "s0"), (7, "w7 " * 8, "s0"), (2000, "tiny", "Z"), (4000, "é ü " * 50, "ß")]
    return rows, spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("ordered", [100_000, 3])
def test_targets_and_words_taken(spark, ordered):
    rows, docs = _table(spark)
    got = mixing.mix(docs, ordered=ordered).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(_words(t))
    want = _targets(sizes)
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((i, len(_words(t))) for i, t, _ in rows if i is not None)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    repeats = collections.Counter((i, t, s) for i, t, s in rows)
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(1, max(c for k, c in repeats.items() if k[2] == s))
    for s in sizes:  # whole epochs first, then at most one document in part
        own = [r for r in got if r["source"] == s and r["size"]]
        if own:
            epochs = {r["taken"] // r["size"] for r in own}
            assert max(epochs) - min(epochs) <= 1 and len({(r["doc_id"], r["size"]) for r in own if r["taken"] % r["size"]}) <= 1


def test_rounds_do_not_change_the_result_and_reruns_agree(spark):
    _, docs = _table(spark)
    first = sorted(map(str, mixing.mix(docs).collect()))
    assert first == sorted(map(str, mixing.mix(docs.repartition(2), ordered=2).collect()))
    assert first != sorted(map(str, mixing.mix(docs, seed=1).collect()))


def test_better_documents_come_earlier(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "a b c d", "s", 1.0 if i % 2 else 0.2) for i in range(2000)], "doc_id long, text string, source string, good double")
    got = mixing.mix(docs, quality=F.col("good"), budget=2000).collect()
    assert sum(r["taken"] for r in got) == 2000
    good = sum(r["taken"] for r in got if r["doc_id"] % 2)
    assert 1400 < good < 1900
    odd = docs.withColumn("good", F.when(F.col("doc_id") < 3, F.lit(None)).when(F.col("doc_id") < 5, F.lit(float("nan"))).otherwise(-1.0))
    assert sum(r["taken"] for r in mixing.mix(odd, quality=F.col("good"), budget=10).collect()) == 10


def test_mixed_holds_the_words_that_are_taken(spark):
    rows, docs = _table(spark)
    plan = collections.Counter()
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"], r["source"]] += r["taken"]
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "copy"]
    got = collections.Counter()
    for r in out.collect():
        got[r["doc_id"], r["source"]] += len(_words(r["text"]))
    assert +got == +plan


def test_odd_tables(spark, corpus, nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    docs, rows = corpus
    assert mixing.mix(docs).count() == len(rows)
    empty = mixing.mix(make_docs(spark, [None, "", "  "])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 3
    assert mixing.mix(spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")).first()["taken"] == 2


def test_no_python_in_the_plan(spark, sf):
    plan = mixing.op13_mixing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
