import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyglass.operators import distributions as dist, profile as prof, relational as rel
from tallyglass.plans import suggest
from tallyglass.sources import metadata, reports, tables as src


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(1, 1.0, None, "a", None), (2, float("nan"), None, "a", True), (3, float("inf"), None, "b", True), (4, 4.0, None, None, False), (5, 5.0, None, "c", None)]
    return spark.createDataFrame(rows, "id long, x double, empty double, c string, flag boolean")


def test_profile_counts_nulls_and_distinct(messy):
    p = {r["column"]: r for r in prof.profile_columns(messy).collect()}
    assert p["c"]["n_missing"] == 1 and p["c"]["n_unique"] == 3 and p["c"]["samples"] == "a | b | c"
    assert p["empty"]["n_missing"] == 5 and p["empty"]["n_unique"] == 0
    assert p["flag"]["n_unique"] == 2 and p["flag"]["dtype"] == "boolean"
    approx = {r["column"]: r["n_unique"] for r in prof.profile_columns(messy, approx=True).collect()}
    assert approx["c"] == 3


def test_profile_of_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "x double, c string")
    assert prof.kpis(empty).first()["n_rows"] == 0
    assert prof.duplicate_rows(empty).first()["n_duplicates"] == 0
    one = spark.createDataFrame([(1.0, "a")], "x double, c string")
    r = prof.profile_numeric(one).first()
    assert r["std"] == 0.0 and r["skew"] is None
    assert prof.profile_outliers(one).first()["n_outliers"] == 0
    assert prof.histogram(one, "x", bins=4).agg(F.sum("n")).first()[0] == 1
    assert prof.histogram(empty, "x").count() == 0


def test_duplicate_columns_need_every_cell(spark):
    df = spark.createDataFrame([(1, 1, 1, None), (2, 2, 2, None), (None, None, 3, None)], "a int, b int, c int, d int")
    assert [tuple(r) for r in prof.duplicate_columns(df).collect()] == [("b", "a")]


def test_summary_and_fixes(spark):
    df = spark.createDataFrame([(i, 1, None if i % 2 else float(i), "x") for i in range(20)], "id long, k int, v double, s string")
    s = prof.profile_summary(df).first()
    assert s["constant_columns"] == "k,s" and s["columns_with_missing"] == "v"
    fixes = {(r["column"], r["fix"]) for r in prof.suggest_fixes(df).collect()}
    assert {("v", "impute"), ("k", "drop_constant"), ("s", "review")} <= fixes


def test_quality_score_bands(spark):
    good = spark.range(50).toDF("a").withColumn("b", F.col("a") * 2)
    r = prof.quality_score(good).first()
    assert r["score"] == 100 and r["label"] == "excellent" and r["missing_issue"] == "none"
    bad = spark.createDataFrame([(None, "x")] * 10, "a int, b string")
    r = prof.quality_score(bad).first()
    assert r["duplicate_issue"] == "many" and r["missing_issue"] == "significant" and r["score"] == 100 - 30 - 20 - 5


def test_describe_matches_pandas(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    d = prof.describe(e, ["value"]).first()
    v = e.toPandas()["value"]
    for k, want in (("q1", v.quantile(0.25)), ("median", v.median()), ("std", v.std()), ("skew", v.skew()), ("kurtosis", v.kurt())):
        assert math.isclose(d[k], want, rel_tol=1e-9), k


def test_kde_integrates_to_one(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = prof.kde(e, "value").orderBy("x").toPandas()
    v = e.toPandas()["value"].to_numpy()
    h = v.std(ddof=1) * len(v) ** -0.2
    exact = np.exp(-0.5 * ((k["x"].to_numpy()[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))
    assert np.allclose(k["density"], exact, rtol=2e-3, atol=1e-6)


def test_filters(spark):
    df = spark.createDataFrame([(1, "Alpha"), (2, "beta"), (3, "ALPHABET"), (4, None)], "id int, s string")
    assert [r[0] for r in rel.search_values(df, "s", "alpha").collect()] == ["ALPHABET", "Alpha"]
    assert {r["id"] for r in rel.filter_search(df, "s", "alpha").collect()} == {1, 3}
    assert rel.cast(df, "s", "int").schema["s"].dataType.simpleString() == "string"
    assert rel.keep(df, ["nope"]).columns == ["id", "s"]
    got = df.select(rel.to_numeric(F.lit(" 4.5 ")).alias("a"), rel.to_numeric(F.col("s")).alias("b")).first()
    assert got["a"] == 4.5 and got["b"] is None


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 1 / 3, "a"), (2, None, "b")], "id long, x double, s string")
    path = str(tmp_path / "t.csv")
    src.write_table(df, path, "csv", decimals=6)
    back = src.read_table(spark, path, "csv").orderBy("id").collect()
    assert back[0]["x"] == 0.333333 and back[1]["x"] is None
    assert set(src.read_tables(spark, str(tmp_path), "csv")) == {"t"}
    with pytest.raises(ValueError):
        src.write_table(src.read_table(spark, path, "csv"), path, "csv")
    with pytest.raises(ValueError):
        src.read_table(spark, path, "xml")
    with pytest.raises(Exception):
        src.read_table(spark, str(tmp_path / "missing"), "csv").count()


def test_sample_is_reproducible(spark):
    df = spark.range(500).withColumn("x", F.when(F.col("id") == 3, F.lit(float("inf"))).otherwise(1.0))
    a = src.read_sample(df, ["id"], n=50, key=["id"]).collect()
    b = src.read_sample(df.repartition(7), ["id"], n=50, key=["id"]).collect()
    assert sorted(a) == sorted(b) and len(a) == 50
    assert src.read_sample(df).filter("x IS NULL").count() == 1


def test_reports_are_kept_apart(spark, tmp_path):
    root = str(tmp_path / "r")
    a = spark.createDataFrame([("x", 1.5), ("y", None)], "column string, v double")
    reports.save_report(a, root, "profile", "d1")
    reports.save_report(a.limit(1), root, "drift", "d1")
    reports.save_report(a, root, "profile", "d2")
    reports.save_report(a.limit(1), root, "profile", "d2")
    assert sorted(tuple(r) for r in reports.load_report(spark, root, "profile", "d1").collect()) == [("x", 1.5), ("y", None)]
    assert reports.load_report(spark, root, "profile", "d2").count() == 1
    assert reports.list_reports(spark, root).count() == 3
    with pytest.raises(LookupError):
        reports.load_report(spark, root, "pii", "d1")
    with pytest.raises(ValueError):
        reports.save_report(a, root, "gossip", "d1")


def test_metadata_kinds(spark):
    df = spark.createDataFrame([(i, f"u{i}", ["a", "b"][i % 2], f"2024-01-{i % 28 + 1:02d}", float(i % 7), True) for i in range(40)],
                               "id long, name string, g string, day string, v double, f boolean")
    kinds = {r["column"]: (r["kind"], r["role"]) for r in metadata.detect_metadata(df, {"v": "categorical"}, sequence_key="g", sequence_index="day").collect()}
    assert kinds == {"id": ("id", "value"), "name": ("id", "value"), "g": ("id", "sequence_key"), "day": ("datetime", "sequence_index"),
                     "v": ("categorical", "value"), "f": ("boolean", "value")}
    with pytest.raises(ValueError):
        metadata.detect_metadata(df, {"nope": "id"})


def test_relationships_need_inclusion(spark):
    parent = spark.range(5).toDF("p_key")
    child = spark.createDataFrame([(1, 0), (2, 4)], "c_key long, f_key long")
    lost = spark.createDataFrame([(1, 9)], "x_id2 long, l_key long")
    got = metadata.detect_relationships({"parent": parent, "child": child, "lost": lost}).collect()
    assert ("parent", "p_key", "child", "f_key") in [tuple(r) for r in got]
    assert all(r["child_table"] != "lost" for r in got)


def test_distribution_families_are_recognised(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"norm": rng.normal(5, 2, 4000), "expon": rng.exponential(3, 4000), "uniform": rng.uniform(2, 9, 4000), "lognorm": rng.lognormal(0.5, 0.6, 4000)})
    df = spark.createDataFrame(pdf)
    got = {r["column"]: r["family"] for r in dist.fit_distributions(df, families=("norm", "expon", "uniform", "lognorm")).collect()}
    assert got == {c: c for c in pdf}
    few = dist.fit_distributions(df.limit(5), ["norm"]).first()
    assert few["family"] == "insufficient_data" and few["rss"] is None
    ln = {r["column"]: r["lognormal"] for r in dist.is_lognormal(df).collect()}
    assert ln["lognorm"] and not ln["norm"]
    full = {r["column"]: r for r in dist.fit_distributions(df).collect()}
    assert all(full[c]["family"] in dist.FAMILIES for c in pdf)


def test_suggested_features_follow_the_rules(spark):
    df = spark.createDataFrame([(float(i ** 3 + 1), "word word word word") for i in range(30)], "x double, t string")
    got = [(r["column"], r["feature"]) for r in suggest.suggest_features(df, None).orderBy("position").collect()]
    assert got[0] == ("x", "log") and ("t", "tfidf") in got and ("t", "encode") in got
    assert suggest.suggest_features(df, 5).count() == 5


def test_robust_residuals_show_a_spike_that_hides_in_the_classical_ones(spark):
    from tallyglass.operators import timeseries as ts

    n, period = 120, 7
    rows = []
    for i in range(n):
        v = 10 + 0.05 * i + [0, 1, 2, 3, 2, 1, 0][i % period] + 0.05 * ((i * 37) % 11 - 5)
        rows.append((i, v + (3.0 if i in (50, 57, 64) else 0.0)))  # three spikes on one phase
    df = spark.createDataFrame(rows, "i long, v double").withColumn("t", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, int(i), 0, 0, 0)"))
    parts = {r["idx"]: r for r in ts.decompose_robust(df, "t", "v", period, rounds=4, block=20).collect()}
    classical = {r["idx"]: r["residual"] for r in ts.decompose(df, "t", "v", period).collect()}
    for i in (50, 57, 64):
        assert parts[i]["weight"] == 0 and abs(parts[i]["residual"] - 3) < 0.4 < abs(classical[i] - 3)
    assert max(abs(r["residual"]) for i, r in parts.items() if i not in (50, 57, 64)) < 0.6
    whole = {r["idx"]: r["trend"] for r in ts.decompose_robust(df, "t", "v", period, rounds=4).collect()}
    assert all(abs(whole[i] - r["trend"]) < 1e-9 for i, r in parts.items())
    flat = df.withColumn("v", F.lit(1.0))
    assert {(r["residual"], r["weight"]) for r in ts.decompose_robust(flat, "t", "v", period).select(F.round("residual", 9).alias("residual"), "weight").collect()} == {(0.0, 1.0)}
    assert ts.decompose_robust(df.limit(3), "t", "v", period).count() == 0
