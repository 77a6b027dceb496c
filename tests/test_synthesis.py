import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyglass.operators.drift import ks
from tallyglass.synthesis import evaluate as ev
from tallyglass.synthesis.bayesnet import PrivBayes
from tallyglass.synthesis.copula import GaussianCopula, MultiTable
from tallyglass.synthesis.sequence import SequenceSynth
from tallyglass.synthesis.tree import TreeSynth


@pytest.fixture(scope="module")
def real(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=1500)
    pdf = pd.DataFrame({"id": range(1500), "x": np.exp(x), "y": np.round(10 + 3 * x + rng.normal(size=1500)).astype(int),
                        "g": np.where(x + rng.normal(size=1500) * 0.4 > 0.8, "hi", "lo"), "when": pd.date_range("2024-01-01", periods=1500, freq="h")})
    pdf.loc[::10, "g"] = None
    return spark.createDataFrame(pdf)


def check_schema(got, real):
    assert [(f.name, f.dataType) for f in got.schema.fields] == [(f.name, f.dataType) for f in real.schema.fields]


def test_copula_keeps_shapes_and_dependence(real):
    made = GaussianCopula.fit(real, ids=["id"]).sample(1500)
    check_schema(made, real)
    assert ks(real, made, ["x", "y"]).agg(F.max("statistic")).first()[0] < 0.08
    p, r = made.toPandas(), real.toPandas()
    assert abs(np.log(p["x"]).corr(p["y"]) - np.log(r["x"]).corr(r["y"])) < 0.1
    assert abs(p["g"].isna().mean() - 0.1) < 0.03 and set(p["g"].dropna()) == {"hi", "lo"}
    assert p["id"].is_unique and p["when"].between(r["when"].min(), r["when"].max()).all()
    assert p.groupby("g")["x"].mean()["hi"] > p.groupby("g")["x"].mean()["lo"] * 2


def test_copula_is_reproducible_and_refuses_crowded_text(spark, real):
    m = GaussianCopula.fit(real.select("x", "y"))
    assert m.sample(50, 3).collect() == m.sample(50, 3).collect()
    crowded = spark.range(20_000).select(F.col("id").cast("string").alias("t"))
    with pytest.raises(ValueError):
        GaussianCopula.fit(crowded)


def test_privbayes_budget_controls_noise(real):
    src = real.drop("when")
    close = PrivBayes.fit(src, epsilon=200.0, ids=["id"]).sample(1500)
    check_schema(close, src)
    noisy = PrivBayes.fit(src, epsilon=0.01, ids=["id"]).sample(1500)
    share = lambda d: d.filter("g = 'hi'").count() / 1500
    assert abs(share(close) - share(src)) < 0.06
    gap = lambda d: ks(src, d, ["y"]).first()["statistic"]
    assert gap(close) < gap(noisy)
    with pytest.raises(ValueError):
        PrivBayes.fit(src, epsilon=0)


def test_tree_synthesiser(real):
    src = real.drop("when")
    made = TreeSynth.fit(src, ids=["id"], trees=4, depth=5).sample(1500)
    check_schema(made, src)
    assert ks(src, made, ["x", "y"]).agg(F.max("statistic")).first()[0] < 0.12
    p = made.toPandas()
    assert np.log(p["x"]).corr(p["y"]) > 0.5


def test_sequences_keep_order_and_memory(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s in range(30):
        v, state = 0.0, "a"
        for t in range(40):
            v = 0.9 * v + rng.normal()
            state = state if rng.random() < 0.9 else ("b" if state == "a" else "a")
            rows.append((f"k{s}", t * 2, float(v), state))
    df = spark.createDataFrame(rows, "key string, t long, v double, state string")
    m = SequenceSynth.fit(df, "key", "t")
    assert 0.8 < m.lag["v"] < 0.97 and m.step == 2.0
    made = m.sample(20, 60).toPandas()
    assert made.groupby("key").size().eq(60).all() and made["key"].nunique() == 20
    made = made.sort_values(["key", "t"])
    stay = (made["state"] == made.groupby("key")["state"].shift()).sum() / (len(made) - 20)
    assert 0.82 < stay < 0.97


def test_child_keys_always_exist(spark):
    parents = spark.range(200).select(F.col("id").alias("pk"), F.randn(1).alias("x"))
    children = spark.range(600).select(F.col("id").alias("ck"), F.pmod(F.col("id") * 7, F.lit(150)).alias("fk"), F.randn(2).alias("v"))
    made = MultiTable.fit({"p": parents, "c": children}, {"c": ("fk", "p", "pk")}, {"p": "pk", "c": "ck"}).sample(1.5)
    assert made["p"].count() == 300
    c, p = made["c"].toPandas(), made["p"].toPandas()
    assert set(c["fk"]) <= set(p["pk"]) and c["ck"].is_unique
    assert 600 < len(c) < 1200
    with pytest.raises(ValueError):
        MultiTable.fit({"p": parents, "c": children}, {"c": ("nope", "p", "pk")}, {"p": "pk"})


def test_distances_of_equal_tables_are_zero(real):
    src = real.drop("id", "when")
    got = {r["metric"]: r["value"] for r in ev.evaluate(src, src).collect()}
    assert got["ks"] == got["js"] == got["wasserstein"] == 0.0 and got["mmd"] < 1e-20 and got["inv_kl"] == 1.0
    moved = src.withColumn("x", F.col("x") + 1)
    w = {r["column"]: r["value"] for r in ev.wasserstein_by_column(src, moved).collect()}
    assert abs(w["x"] - 1) < 1e-9 and w["y"] == 0


def test_joint_encoding(spark):
    a = spark.createDataFrame([("b",), (None,)], "c string")
    b = spark.createDataFrame([("a",), ("z",)], "c string")
    x, y = ev.encode_pair(a, b)
    assert sorted(r[0] for r in x.collect()) == [1, 2] and sorted(r[0] for r in y.collect()) == [0, 3]


def test_model_comparison_survives_a_failure(real):
    def broken(df):
        raise ValueError

    got = ev.compare_models(real.select("x", "y"), {"copula": GaussianCopula.fit, "broken": broken}, rows=300)
    rows = {r["model"]: r["status"] for r in got.collect()}
    assert rows == {"copula": "success", "broken": "failed:ValueError"}
    assert ev.best_model(got).first()["model"] == "copula"
    assert ev.best_model(got.filter("model = 'broken'")).count() == 0


def test_type_repair(spark):
    df = spark.createDataFrame([(1.0, 1.5, float("inf")), (2.0, None, 3.0)], "a double, b double, c double")
    assert [f.dataType.simpleString() for f in ev.repair_types(df).schema.fields] == ["bigint", "double", "bigint"]
    like = spark.createDataFrame([], "a int, b string")
    assert ev.repair_types(df, like).dtypes == [("a", "int"), ("b", "string"), ("c", "double")]


def test_badges_and_scores(spark, real):
    r = ev.badges(real.select("x", "y", "g"), real).first()
    assert (r["privacy_risk"], r["mode_collapse"]) == ("low", "possible") and r["fidelity"] == "medium"
    sim = spark.createDataFrame([("a", "numeric", 0.4, 0.0), ("b", "numeric", 0.2, 0.0), ("c", "categorical", 30.0, 0.0001)], "column string, type string, statistic double, p_value double")
    assert {r["issue"] for r in ev.quality_issues(sim).collect()} == {"distribution_high", "distribution_medium", "categorical_high"}
    good = sim.filter("column = 'none'")
    assert ev.quality_issues(good).first()["issue"] == "good"
    assert ev.quality_scores(good).first()["fidelity"] == 0.8


def test_noise_of_empty_cells_follows_the_full_grid():
    from tallyglass.synthesis.bayesnet import Table, noisy

    rng = np.random.default_rng(3)
    cells, counts = np.arange(0, 1000, 10), np.full(100, 50.0)
    scale, grid = 4.0, 10 ** 9
    got, values = noisy(cells, counts, grid, scale, rng, empties=5_000)
    new = ~np.isin(got, cells)
    limit = scale * np.log((grid - 100) / 10_000)
    assert abs(new.sum() - 5_000) < 5 * np.sqrt(5_000) and len(set(got.tolist())) == len(got)
    assert values.min() > limit and abs(values[new].mean() - limit - scale) < 0.3 and got[new].max() < grid
    small, noise = noisy(np.array([3]), np.array([5.0]), 2_000, 1.0, rng)  # no threshold: half of the empty cells
    assert abs(len(small) - 1_000) < 120 and abs(noise.mean() - 1.0) < 0.15 and len(noisy(np.zeros(0, np.int64), np.zeros(0), 4, 1.0, rng)[0]) <= 4
    table = Table(np.array([0, 1, 6, 4]), np.array([1.0, 3.0, 2.0, 2.0]), 3)  # rows 0: values 0, 1; 1: value 1; 2: value 0
    assert table.draw(np.array([0, 0, 1, 2, 9]), np.array([0.2, 0.9, 0.5, 0.5, 0.99])).tolist() == [0, 1, 1, 0, 1]


def test_private_network_of_a_wide_column(spark):
    wide = spark.range(30_000).select(F.concat(F.lit("v"), (F.col("id") % 20_000).cast("string")).alias("level"), (F.col("id") % 7).cast("string").alias("week"), (F.col("id") % 50).cast("double").alias("x"))
    model = PrivBayes.fit(wide, epsilon=50.0, seed=1)
    assert model.limited == []
    made = model.sample(2_000)
    assert made.count() == 2_000 and made.select("level").distinct().count() > 500
    assert made.filter("level IS NOT NULL").join(wide.select("level").distinct(), "level", "left_anti").count() == 0
