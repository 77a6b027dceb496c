"""The pipeline and the registered queries on a small folder of tables, against the stages done one by one in Python."""

import hashlib

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tallyglass.llm import bpe, language, quality

from .test_decontaminate import _brute as leaks
from .test_joins import _brute_stage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, corpus):
    docs, rows = corpus
    path = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 != 0), 0) for i, _, _ in rows[:120]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, rows[10][1]), (1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_against_python(spark, folder, corpus):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet"), learn=lambda k: ~quality._held_out(k)).filter("predicted = 1").select("doc_id", "text").collect()
    first = corpus_pipeline.STAGES[0][1](spark, docs, folder).cache()
    assert sorted(tuple(r)[:1] for r in first.select("doc_id").collect()) == sorted((r["doc_id"],) for r in good)
    named = language.identify(first, condition=lambda k: ~language._held_out(k)).collect()
    second = corpus_pipeline.STAGES[1][1](spark, first, folder).cache()
    sure = [r for r in named if r["lang_pred"] != "und" and not (r["lang"] and r["lang_pred"] != r["lang"] and r["score"] >= language.SURE)]
    kept = sorted((r["doc_id"], r["text"]) for r in sure)
    assert sorted((r["doc_id"], r["text"]) for r in second.collect()) == kept
    third = corpus_pipeline.STAGES[2][1](spark, second, folder).cache()
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(_brute_stage(kept))
    rows = [(r["doc_id"], r["text"]) for r in third.collect()]
    fourth = corpus_pipeline.STAGES[3][1](spark, third, folder).cache()
    dirty = {d for d, *_ in leaks(rows, [(0, corpus[1][10][1]), (1, None)])}
    assert sorted(r["doc_id"] for r in fourth.collect()) == sorted(i for i, _ in rows if i not in dirty)
    assert all(df.columns == docs.columns for df in (first, second, third, fourth))
    library = Tokenizer.from_file(bpe.PATH)
    texts = dict(rows)
    last = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in fourth.collect())
    for r in last:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_registered_queries():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names


def test_contract_columns(spark, folder, corpus):
    wanted = {
        "op2_": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
        "op3_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op5_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op7_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op10_": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    }
    for name, query in entry.queries().items():
        for prefix, columns in wanted.items():
            if name.startswith(prefix):
                got = query(spark, folder)
                assert columns.items() <= dict(got.dtypes).items()
                assert got.count() == len(corpus[1])


def test_stages_send_small_batches(spark, nothing):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        corpus_pipeline.STAGES[4][1](spark, nothing, "")
        assert spark.conf.get(name) == "1000"
        spark.conf.set(name, "7")
        corpus_pipeline.STAGES[4][1](spark, nothing, "")
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, old)
