import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyglass.operators import isolation, neighbours as nb, timeseries as ts, transforms as tf
from tallyglass.plans import impact, suggest
from tallyglass.plans.recipe import RecipeError, Step, apply_recipe, fit_recipe, load_recipe, recipe_summary, save_recipe, steps_of


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, 10.0, "red"), (2, None, "blue"), (3, 30.0, "red"), (4, -5.0, None), (5, 400.0, "green")], "id int, v double, c string")


def test_recipe_order_params_and_reasons(people):
    steps = steps_of([{"action": "redact", "column": "c", "params": {"replacement": "x"}}, {"action": "generalize", "column": "id", "min_frequency": 2, "replacement": "few"},
                      {"action": "log_transform", "column": "v"}, {"action": "rename", "column": "v", "params": {"to": "w"}}, {"action": "zscore", "column": "w"},
                      {"action": "zscore", "column": "v"}, {"action": "sqrt_transform", "column": "c"}, {"action": "cast", "column": "c", "params": {"dtype": "int"}}])
    got, log = apply_recipe(people, steps, on_error="skip")
    status = [(r["status"], r["reason"]) for r in log.orderBy("position").collect()]
    assert status == [("applied", None), ("applied", None), ("skipped", "negative_values"), ("applied", None), ("applied", None),
                      ("skipped", "missing_column"), ("skipped", "not_numeric"), ("skipped", "cast_loses_values")]
    assert got.columns == ["id", "w", "c", "id_generalized", "w_zscore"]
    assert {r["c"] for r in got.collect()} == {"x"} and {r["id_generalized"] for r in got.collect()} == {"few"}
    dry, _ = apply_recipe(people, steps, dry_run=True)
    assert dry.columns == people.columns
    assert recipe_summary(log).first()["n_applied"] == 4


def test_skipped_privacy_steps_never_return_the_table(people):
    steps = [Step("log_transform", "v"), Step("redact", "absent"), Step("mask", "id")]
    with pytest.raises(RecipeError, match="log_transform"):
        apply_recipe(people, steps)
    with pytest.raises(RecipeError, match="redact of absent: missing_column"):
        apply_recipe(people, steps, on_error="skip")
    got, _ = apply_recipe(people, steps, on_error="skip", unprotected=True)
    assert "id_masked" in got.columns
    apply_recipe(people, steps, dry_run=True)
    with pytest.raises(ValueError, match="on_error"):
        apply_recipe(people, [], on_error="ignore")


def test_numbers_are_masked(spark):
    got = tf.apply_op(spark.createDataFrame([(123456,), (None,)], "n int"), "mask", "n")
    assert [r["n_masked"] for r in got.collect()] == ["123***", None]


def test_one_hot_beyond_the_column_limit(spark):
    df = spark.range(1500).select(F.concat(F.lit("v"), F.lpad("id", 5, "0")).alias("c")).unionByName(spark.createDataFrame([(None,)], "c string"))
    got = tf.apply_op(df, "encode", "c", drop_first=False)
    assert got.columns == ["c_onehot"]
    rows = [tuple(r[0]) for r in got.collect()]
    assert sorted(i for n, i in rows if i is not None) == list(range(1500)) and {n for n, _ in rows} == {1500}
    assert sum(i is None for _, i in rows) == 1
    first = [tuple(r[0]) for r in tf.apply_op(df, "encode", "c").collect()]
    assert {n for n, _ in first} == {1499} and sum(i is None for _, i in first) == 2


def test_fitted_recipe_replays_on_other_rows(spark, people, tmp_path):
    steps = [Step("impute", "v", {"method": "mean"}), Step("minmax_scaler", "v"), Step("mask", "c")]
    apply, _ = fit_recipe(people, steps)
    other = spark.createDataFrame([(9, None, "violet")], "id int, v double, c string")
    r = apply(other).first()
    assert r["v"] == 108.75 and math.isclose(r["v_minmax"], (108.75 + 5) / 405) and r["c_masked"] == "vio***"
    save_recipe(spark, str(tmp_path / "r.json"), steps)
    assert load_recipe(spark, str(tmp_path / "r.json")) == steps


def test_independent_steps_share_one_group(people, monkeypatch):
    from tallyglass.plans import recipe

    calls = []
    real = recipe.collect_stats
    monkeypatch.setattr(recipe, "collect_stats", lambda df, e: calls.append(len(e)) or real(df, e))
    apply_recipe(people, [Step("standard_scaler", "v"), Step("minmax_scaler", "v"), Step("zscore", "id")])
    assert len(calls) == 1


def test_transforms_on_edge_values(spark, people):
    flat = spark.createDataFrame([(2.0,)] * 4, "v double")
    for action in ("standard_scaler", "zscore", "robust_scaler", "minmax_scaler"):
        assert {r[1] for r in tf.apply_op(flat, action, "v").collect()} == {0.0}
    with pytest.raises(ValueError):
        tf.apply_op(spark.createDataFrame([(0.0,)], "v double"), "inverse", "v")
    le = {r["c"]: r["c_le"] for r in tf.apply_op(people, "label_encode", "c").collect()}
    assert le == {"blue": 0, "green": 1, "red": 2, None: -1}
    top = {r["id"]: r["c"] for r in tf.apply_op(people, "top_categories", "c", n=1).collect()}
    assert top == {1: "red", 2: "Other", 3: "red", 4: "Other", 5: "Other"}
    mode = {r["id"]: r["c"] for r in tf.apply_op(people, "impute", "c", method="mode").collect()}
    assert mode[4] == "red"
    words = spark.createDataFrame([("  a  b\tc ",), ("",), (None,)], "t string")
    assert [r[1] for r in tf.apply_op(words, "word_count", "t").collect()] == [3, 0, None]


@pytest.mark.parametrize("per_range", [1_000_000, 20])
def test_level_codes_do_not_depend_on_ranges(spark, per_range):
    df = spark.range(300).select(F.concat(F.lit("k"), F.pmod(F.col("id") * 7, F.lit(150)).cast("string")).alias("c"))
    got = {r["c"]: r["code"] for r in tf.level_codes(df, "c", per_range).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))} and len(got) == 150


def test_skewed_column_gets_a_log_and_improves(spark):
    df = spark.createDataFrame([(float(2 ** i),) for i in range(16)], "v double")
    s = suggest.suggest_utility(df, lognormal=False).first()
    assert s["transformation"] == "log_transform"
    changes, _ = impact.compare_recipe(df, [Step("log_transform", "v")])
    d = {r["metric"]: r for r in changes.collect()}
    assert abs(d["skewness"]["after"]) < abs(d["skewness"]["before"])
    assert impact.improvement(changes).first()["score"] > 50
    assert impact.impact_kpis(changes, 1).first()["improved"] == 1


def test_email_column_is_redacted_and_conflicts_are_rated(spark):
    df = spark.createDataFrame([(i, f"u{i}@example.com", float(i % 60)) for i in range(300)], "row long, email string, age double")
    p = {r["column"]: r for r in suggest.suggest_privacy(df).collect()}
    assert p["email"]["transformation"] == "redact" and p["email"]["risk_level"] == "high"
    assert p["age"]["transformation"] == "bin" and p["age"]["n_bins"] == 3
    every = suggest.suggest_privacy(df, every=True).filter("column = 'email'").collect()
    assert {r["transformation"] for r in every} == {"redact", "hash"}
    r = suggest.suggest_all(df, lognormal=False)
    assert set(r) == {"utility", "privacy", "conflicts", "remaining", "conflict_summary", "totals"}
    c = r["conflicts"].collect()
    assert [x["column"] for x in c] == ["age"] and c[0]["severity"] == "high"
    grid = {x["column"]: x["status"] for x in suggest.protection_map(df, [Step("hash", "email")]).collect()}
    assert grid["email"] == "protected" and grid["age"] == "unprotected"


def test_insufficient_statistics(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double")
    r = impact.column_stats(df).first()
    assert r["error"] == "insufficient_data" and r["mean"] is None


def test_stratified_sample_is_exact(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 334, "hot").when(F.col("id") < 900, "mid").otherwise("low").alias("g"), F.lit("x").alias("k"))
    got = impact.sample_rows(df.select("id", "k", "g"), "stratified", 101, ["id"])
    assert {r["g"]: r["n"] for r in got.groupBy("g").agg(F.count("*").alias("n")).collect()} == {"hot": 34, "mid": 57, "low": 10}
    again = impact.sample_rows(df.repartition(9).select("id", "k", "g"), "stratified", 101, ["id"])
    assert {r["id"] for r in got.collect()} == {r["id"] for r in again.collect()}
    assert impact.sample_rows(df, "random", 37, ["id"]).count() == 37
    assert impact.sample_rows(df, "first", 5, ["id"]).agg(F.max("id")).first()[0] == 4
    assert impact.sample_rows(df, "first", 5000, ["id"]).count() == 1000


def brute_lof(x, k):
    d = np.round(np.sqrt(((x[:, None] - x) ** 2).sum(2)), 9)
    np.fill_diagonal(d, np.inf)
    kd = np.sort(d, 1)[:, k - 1]
    near = d <= kd[:, None]
    reach = np.maximum(kd[None, :], np.where(near, d, 0))
    lrd = 1 / ((reach * near).sum(1) / near.sum(1) + 1e-10)
    return (near * lrd[None, :]).sum(1) / near.sum(1) / lrd


def test_lof_over_many_boxes_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nb, "BOX_POINTS", 25)
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(0, 1, (150, 2)), rng.normal(6, 0.3, (60, 2)), [[30.0, -20.0]], np.tile([[2.0, 2.0]], (90, 1))]
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    got = nb.lof(df, ["a", "b"], k=10).orderBy("id").toPandas()
    z = (x - x.mean(0)) / x.std(0)
    want = brute_lof(z, 10)
    assert np.allclose(got["lof"], want, rtol=1e-4)
    assert got["lof_outlier"][210]
    with pytest.raises(ValueError):
        nb.lof(df.limit(5), ["a", "b"], k=10)


@pytest.mark.parametrize("boxes,leaf,visitors", [(1, 8, 40), (4, 8, 100_000)])
def test_lof_over_many_tiles_writes_no_pairs(spark, monkeypatch, boxes, leaf, visitors):
    for name, value in (("BOX_POINTS", 25), ("TILE_BOXES", boxes), ("LEAF_POINTS", leaf), ("TILE_VISITORS", visitors)):
        monkeypatch.setattr(nb, name, value, raising=False)
    sizes, write = [], nb.materialise

    def seen(df, *args):
        got = write(df, *args)
        sizes.append(got.count())
        return got

    monkeypatch.setattr(nb, "materialise", seen)
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(0, 1, (500, 2)), rng.normal(9, 0.2, (200, 2)), [[40.0, -30.0], [40.0, 60.0]], np.tile([[2.0, 2.0]], (30, 1)), np.tile([[3.0, 1.0]], (4, 1)),
              np.stack(np.meshgrid(np.arange(10.0), np.arange(10.0) + 20), -1).reshape(-1, 2)]
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1]})).withColumn("b", F.when(F.col("id") >= 0, F.col("b")))
    df = df.unionByName(spark.createDataFrame([(-1, 1.0, None)], "id long, a double, b double"))
    got = nb.lof(df, ["a", "b"], k=8, contamination=0.05).orderBy("id").toPandas()
    want = brute_lof((x - x.mean(0)) / x.std(0), 8)
    assert list(got["id"]) == list(range(len(x))) and np.allclose(got["lof"], want, rtol=1e-9)
    assert (got["lof_outlier"] == (got["lof"] > np.quantile(got["lof"], 0.95))).all() and got["lof_outlier"][700:702].all()
    points = len(np.unique(x, axis=0))
    assert max(sizes) <= 4 * points  # a neighbour list has at least eight rows a point


def test_quantile_of_weighted_rows(spark):
    df = spark.createDataFrame([(0.5, 3.0), (2.0, 1.0), (-1.0, 5.0), (0.5, 2.0)], "v double, w double")
    rows = np.repeat([0.5, 2.0, -1.0, 0.5], [3, 1, 5, 2])
    for p in (0.0, 0.3, 0.45, 0.9, 1.0):
        assert math.isclose(nb._weighted_quantile(df, "v", "w", p), np.quantile(rows, p), abs_tol=1e-12)


def test_boxes_know_their_spans():
    x = np.random.default_rng(3).normal(size=(400, 3))
    boxes = nb.Boxes(x, 13)
    low, high = boxes.spans()
    at = boxes.home(x)
    assert len(low) == boxes.count == 13 and ((x > low[at]) & (x <= high[at])).all()


def test_knn_imputation_over_boxes(spark, monkeypatch):
    monkeypatch.setattr(nb, "BOX_POINTS", 20)
    df = spark.range(200).select("id", F.col("id").cast("double").alias("f"), F.when(F.col("id") % 10 != 5, F.col("id") * 2.0).alias("v"))
    got = {r["id"]: r["v"] for r in nb.impute_knn(df, "v", ["f"], k=2).collect()}
    assert len(got) == 200 and all(got[i] == 2.0 * i for i in range(200))


def test_isolation_forest_ranks_planted_rows_first(spark):
    df = spark.range(400).select("id", F.when(F.col("id") == 11, 60.0).otherwise(F.randn(3)).alias("a"), F.when(F.col("id") == 200, -60.0).otherwise(F.randn(4)).alias("b"))
    df = spark.createDataFrame(df.collect(), df.schema)
    got = isolation.isolation_forest(df, ["id"], ["a", "b"], trees=50).orderBy(F.desc("score")).limit(2)
    assert {r["id"] for r in got.collect()} == {11, 200}
    a = isolation.isolation_forest(df, ["id"], ["a", "b"], trees=5).orderBy("id").toPandas()["score"]
    b = isolation.isolation_forest(df.repartition(3), ["id"], ["a", "b"], trees=5).orderBy("id").toPandas()["score"]
    assert np.allclose(a, b)


def days(spark, n=84, key=False):
    rows = [(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", "s1", d * 0.5 + [0, 1, 3, 1, 0, -2, -3][d % 7] + (40 if d == 50 else 0)) for d in range(n)]
    return spark.createDataFrame(rows, "d string, s string, v double")


def test_date_strings_and_parse_limit(spark):
    good = spark.createDataFrame([("2024-01-01",)] * 85 + [("?",)] * 15, "t string")
    bad = spark.createDataFrame([("2024-01-01",)] * 75 + [("?",)] * 25, "t string")
    assert ts.datetime_columns(good).count() == 1 and ts.datetime_columns(bad).count() == 0
    assert ts.primary_time(["zeit", "created_timestamp", "due_date"]) == "due_date"


@pytest.mark.parametrize("times,freq,conf", [
    (pd.date_range("2024-01-01", periods=30, freq="D"), "D", "high"), (pd.date_range("2024-01-01", periods=30, freq="h"), "H", "high"),
    (pd.date_range("2024-01-01", periods=30, freq="MS"), "MS", "high"), (pd.date_range("2024-01-31", periods=30, freq="ME"), "M", "high"),
    (pd.bdate_range("2024-01-01", periods=30), "B", "high"), (pd.date_range("2024-01-01", periods=40, freq="D").delete(20), "D", "medium"),
    (pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-09", "2024-02-20"]), None, "medium")])
def test_frequency_detection(spark, times, freq, conf):
    df = spark.createDataFrame(pd.DataFrame({"when": times, "v": np.arange(len(times), dtype=float)}))
    r = ts.detect_series(df).first()
    assert (r["frequency"], r["confidence"], r["is_regular"]) == (freq, conf, freq is not None)


def test_many_series_do_not_look_irregular(spark):
    a = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=20, freq="D"), "s": "a", "v": 1.0})
    df = spark.createDataFrame(pd.concat([a, a.assign(s="b")]))
    assert ts.detect_series(df).first()["frequency"] == "D"
    assert ts.detect_series(df, series_key="s").first()["frequency"] == "D"


@pytest.mark.parametrize("period", [7, 6])
@pytest.mark.parametrize("block", [100_000, 20])
def test_parts_add_up_and_the_spike_is_found(spark, period, block):
    df = days(spark)
    p = ts.decompose(df, "d", "v", period, block=block).toPandas()
    assert len(p) == 84 and np.allclose(p["observed"], p["trend"] + p["seasonal"] + p["residual"])
    if period == 7:
        o = ts.ts_outliers(df.withColumn("d", F.to_date("d")), "d", "v", freq="D").filter("outlier").collect()
        assert [r["idx"] for r in o] == [50]


def test_acf_of_one_and_many_series(spark):
    pdf = days(spark).toPandas()
    v = pdf["v"] - pdf["v"].mean()
    want = [(v[k:].to_numpy() * v[: len(v) - k].to_numpy()).sum() / (v ** 2).sum() for k in range(6)]
    one = ts.acf(days(spark), "d", "v", lags=5, block=10).orderBy("lag").toPandas()
    assert np.allclose(one["acf"], want)
    both = days(spark).unionByName(days(spark).withColumn("s", F.lit("s2")))
    many = ts.acf(both, "d", "v", lags=5, series_key="s").toPandas()
    assert len(many) == 12 and np.allclose(many.sort_values(["series", "lag"])["acf"], want * 2)
    p = ts.pacf(days(spark), "d", "v", lags=3).orderBy("lag").toPandas()["pacf"]
    assert p[0] == 1 and math.isclose(p[1], want[1]) and math.isclose(p[2], (want[2] - want[1] ** 2) / (1 - want[1] ** 2))
    assert ts.acf(days(spark, 8), "d", "v").count() == 0


def test_resample_rejects_unknown_names(spark):
    with pytest.raises(ValueError):
        ts.resample(days(spark), "d", "v", "Q")
    with pytest.raises(ValueError):
        ts.resample(days(spark), "d", "v", "D", "mode")
