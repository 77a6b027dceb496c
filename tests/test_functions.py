import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.functions import keyed, ordered, quantiles as qt, sequences as seq, special
from tallyglass.functions.exprs import collect_stats, kurt_g2, num, skew_g1
from tallyglass.functions.store import materialise


@pytest.fixture(scope="module")
def numbers(spark):
    # a third of the rows share one value, the others are spread
    return spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.pmod(F.col("id") * 7919, F.lit(1009)) / 10.0).alias("x"),
                                    F.pmod(F.col("id") * 31, F.lit(17)).cast("double").alias("y"))


PROBS = [0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("bracket", [5, 50, 100_000])
def test_bracketed_quantiles_equal_exact(numbers, bracket):
    x = numbers.toPandas()["x"]
    got = qt.quantiles(numbers, {"x": (F.col("x"), PROBS)}, bracket_values=bracket)["x"]
    assert np.allclose(got, np.quantile(x, PROBS))
    small = qt.quantiles(numbers, {"x": (F.col("x"), PROBS)})["x"]
    assert np.allclose(small, got)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "x double")
    assert qt.quantiles(empty, {"x": (F.col("x"), [0.5])})["x"] == [None]


def test_order_statistics(numbers):
    x = np.sort(numbers.toPandas()["x"])
    ranks = [0, 150, 1499, 2999]
    assert qt.order_statistics(numbers, {"x": (F.col("x"), ranks)})["x"] == [x[r] for r in ranks]


@pytest.mark.parametrize("per_range", [500_000, 100])
def test_running_totals_and_ranks_do_not_depend_on_ranges(numbers, monkeypatch, per_range):
    monkeypatch.setattr(ordered, "VALUES_PER_RANGE", per_range)
    got = {r["x"]: r["rank"] for r in ordered.average_ranks(numbers, "x").collect()}
    x = numbers.toPandas()["x"]
    assert got == dict(zip(x, x.rank()))


@pytest.mark.parametrize("per_range", [500_000, 100])
def test_grouped_quantiles(numbers, monkeypatch, per_range):
    monkeypatch.setattr(ordered, "VALUES_PER_RANGE", per_range)
    got = {r["y"]: r["m"] for r in ordered.grouped_quantiles(numbers, "y", "x", {"m": 0.3}).collect()}
    want = numbers.toPandas().groupby("y")["x"].quantile(0.3).to_dict()
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_heavy_value_gets_its_own_range():
    cuts = ordered.isolate([1.0, 7.0, 7.0, 7.0, 9.0])
    assert cuts == [1.0, 7.0, math.nextafter(7.0, math.inf), 9.0]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_attach_is_null_safe_and_keeps_every_row(spark, limit):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3) for i in range(100)], "id int, k int")
    stats = keyed.frequency(df, ["k"])
    got = keyed.attach(df, stats, ["k"], broadcast_bytes=limit)
    want = df.toPandas()["k"].value_counts(dropna=False).to_dict()
    rows = got.collect()
    assert len(rows) == 100 and sorted(r["id"] for r in rows) == list(range(100))
    assert {r["n"] for r in rows if r["k"] is None} == {25}
    assert all(r["n"] == want[r["k"]] for r in rows if r["k"] is not None)


def test_attach_without_hot_keys_and_with_missing_ones(spark):
    df = spark.range(2000).select("id", (F.col("id") + 0.5).alias("k"), F.lit(None).cast("string").alias("n"))
    stats = df.filter("id < 1500").select("k", (F.col("id") * 2).alias("twice"))
    inner = keyed.attach(df, stats, ["k"], broadcast_bytes=0)
    assert inner.count() == 1500 and inner.filter("twice = 2 * id").count() == 1500
    assert keyed.attach(df, stats, ["k"], how="left", broadcast_bytes=0).filter("twice IS NULL").count() == 500
    hot = df.withColumn("k", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("k")))
    got = keyed.attach(hot, stats, ["k"], how="left", broadcast_bytes=0)
    assert got.count() == 2000 and got.filter("k = 0.5 AND twice = 0").count() == 667
    assert got.columns == ["id", "k", "n", "twice"]


@pytest.mark.parametrize("per_range", [500_000, 40])
def test_row_index_with_hot_time(spark, per_range):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.lit(500.0)).otherwise(F.pmod(F.col("id") * 37, F.lit(1000)).cast("double")).alias("t"))
    pdf = df.toPandas().sort_values(["t", "id"])
    got = seq.row_index(df, ["t", "id"], per_range=per_range).orderBy("idx").toPandas()
    assert got["idx"].tolist() == list(range(900)) and got["id"].tolist() == pdf["id"].tolist()


@pytest.mark.parametrize("per_range", [500_000, 40])
@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_fill_across_ranges(spark, per_range, direction):
    df = spark.range(400).select("id", F.pmod("id", F.lit(3)).alias("g"), F.when(F.col("id") % 50 == 11, F.col("id").cast("double")).alias("v"))
    pdf = df.toPandas()
    for group in (None, ["g"]):
        got = seq.fill(df, "v", ["id"], direction, group, per_range=per_range).orderBy("id").toPandas()["v"]
        src = pdf["v"] if group is None else pdf.groupby("g")["v"]
        want = src.ffill() if direction == "forward" else src.bfill()
        assert np.allclose(got, want, equal_nan=True)


@pytest.mark.parametrize("per_range", [500_000, 40])
def test_backward_fill_has_no_shrinking_frame(spark, per_range):
    df = spark.range(400).select("id", (F.col("id") % 5).alias("t"), F.when(F.col("id") % 50 == 11, F.col("id")).alias("v"))
    got = seq.fill(df, "v", ["t", "id"], "backward", per_range=per_range)
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()  # each row would read the rest of its range
    pdf = df.toPandas().sort_values(["t", "id"])
    assert np.allclose(got.toPandas().set_index("id")["v"].sort_index(), pdf.assign(v=pdf["v"].bfill()).set_index("id")["v"].sort_index(), equal_nan=True)


def test_blocks_show_the_same_neighbours(spark):
    from pyspark.sql import Window

    df = spark.range(100).select(F.col("id").alias("idx"), (F.col("id") * F.col("id")).alias("v"))
    w = Window.partitionBy("_block").orderBy("idx")
    got = seq.blocks(df, 3, 2, block=7).withColumn("a", F.lag("v", 3).over(w)).withColumn("b", F.lead("v", 2).over(w)).filter("_own").orderBy("idx").collect()
    assert len(got) == 100
    assert all(r["a"] == (None if r["idx"] < 3 else (r["idx"] - 3) ** 2) and r["b"] == (None if r["idx"] > 97 else (r["idx"] + 2) ** 2) for r in got)


def test_moments_match_pandas(numbers):
    x = numbers.toPandas()["x"]
    s = collect_stats(numbers, {"g1": skew_g1(F.col("x")), "g2": kurt_g2(F.col("x"))})
    assert math.isclose(s["g1"], x.skew()) and math.isclose(s["g2"], x.kurt())


def test_moments_of_tiny_and_constant_columns(spark):
    two = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert collect_stats(two, {"a": skew_g1(F.col("x")), "b": kurt_g2(F.col("x"))}) == {"a": None, "b": None}
    flat = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert collect_stats(flat, {"a": skew_g1(F.col("x")), "b": kurt_g2(F.col("x"))}) == {"a": 0.0, "b": 0.0}


def test_num_drops_nan_and_infinity(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (1.0,), (None,)], "x double")
    assert df.agg(F.count(num(df, "x"))).first()[0] == 1


def test_special_functions_against_tables():
    assert math.isclose(special.chi2_sf(3.841459, 1), 0.05, rel_tol=1e-5)
    assert math.isclose(special.chi2_sf(18.307038, 10), 0.05, rel_tol=1e-5)
    assert math.isclose(special.chi2_sf(0.5, 4), 0.97350098, rel_tol=1e-6)
    assert math.isclose(special.kolmogorov_sf(1.3580986), 0.05, rel_tol=1e-4)
    assert math.isclose(special.normal_ppf(0.975), 1.959963985, rel_tol=1e-8)
    assert math.isclose(special.digamma(1.0), -0.5772156649, rel_tol=1e-8)
    grid = np.linspace(-60, 60, 240_001)
    step = grid[1] - grid[0]
    for family, params in (("norm", (1, 2)), ("lognorm", (0.2, 0.5)), ("expon", (0, 3)), ("gamma", (2.5, 1.5)), ("beta", (2, 3, 0, 5)),
                           ("uniform", (-1, 4)), ("chi2", (4,)), ("weibull_min", (1.5, 2)), ("t", (6, 0, 1))):
        assert math.isclose(special.density(family, params, grid).sum() * step, 1.0, abs_tol=2e-3), family


def test_materialise_keeps_rows(spark, numbers):
    assert materialise(numbers, "t").count() == 3000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_leaves_hot_rows_where_they_are(spark, how):
    from tallyglass.functions import keyed

    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 10 == 9, F.concat(F.lit("k"), F.col("id") % 500)).alias("c"))
    rows = rows.unionByName(spark.createDataFrame([(None,)] * 300 + [("alone",)], "c string"))
    stats = rows.filter("c <> 'alone'").unionByName(spark.createDataFrame([(None,)], "c string").limit(0)).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    if how == "left":
        stats = stats.filter("c <> 'hot'")
    got = keyed.attach(rows, stats, ["c"], how=how, broadcast_bytes=0)
    assert got.columns == ["c", "n"]
    by = {r["c"]: (r["n"], r["count"]) for r in got.groupBy("c", "n").count().collect()}
    want = {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()}
    assert {k: v[1] for k, v in by.items()} == {k: n for k, n in want.items() if how == "left" or k not in ("alone", None)}
    assert all(n in (None, want[k]) for k, (n, _) in by.items()) and by["hot"][0] == (None if how == "left" else 18_000)
