import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyglass.functions.exprs import records
from tallyglass.operators import (anonymity as anon, association as assoc, dependencies as dep, drift as dr, outliers as out, pii,
                                  remediation as rem)


def test_pearson_is_pairwise_complete_and_survives_constants(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, None, 6], "b": [2.0, 4, 5, 9, 1, None], "c": [1.0] * 6})
    df = spark.createDataFrame(pdf)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in assoc.pearson(df).collect()}
    assert math.isclose(got["a", "b"], pdf["a"].corr(pdf["b"]))
    assert got["a", "c"] is None
    assert {(r["col_a"], r["col_b"]): r["r"] for r in assoc.corr_matrix(df).collect()}["a", "c"] == 0.0


def test_spearman_ranks_each_pair_over_its_own_rows(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.integers(0, 6, 80).astype(float), "b": rng.normal(size=80), "c": rng.integers(0, 3, 80).astype(float)})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in assoc.spearman(df).collect()}
    for a, b in got:
        both = pdf[[a, b]].dropna()
        assert math.isclose(got[a, b], both[a].rank().corr(both[b].rank()), abs_tol=1e-9)


@pytest.mark.parametrize("block", [500_000, 60])
def test_kendall_blocks_match_brute_force(spark, block):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(400) < 0.35, 3, rng.integers(0, 40, 400)).astype(float)
    y = np.where(rng.random(400) < 0.35, x, rng.integers(0, 25, 400)).astype(float)
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    iu = np.triu_indices(400, 1)
    s = (sx * sy)[iu].sum()
    want = s / math.sqrt((sx[iu] != 0).sum() * (sy[iu] != 0).sum())
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    assert math.isclose(assoc.kendall(df, block_rows=block).first()["r"], want, abs_tol=1e-9)


def test_cramers_v_of_equal_columns_and_yates(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", "x" if i % 3 else "y", "p" if i % 2 else "q") for i in range(120)], "u string, v string, w string")
    got = {(r["col_a"], r["col_b"]): r for r in assoc.cramers_v(df).collect()}
    assert got["u", "v"]["v"] > 0.95 and got["u", "w"]["v"] == 0.0


def test_crosstab_has_zero_cells(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "a string, b string")
    got = {(r["a"], r["b"]): r["n"] for r in assoc.crosstab(df, "a", "b").collect()}
    assert got == {("a", "x"): 2, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 1}
    with pytest.raises(ValueError):
        assoc.crosstab(df, "a", "b", max_cells=2)


def test_mutual_information_finds_a_parabola(spark):
    df = spark.range(2000).select(((F.col("id") - 1000) / 1000).alias("x"), F.pmod(F.col("id") * 7919, F.lit(2003)).cast("double").alias("noise"))
    df = df.withColumn("y", F.col("x") * F.col("x"))
    for method in ("binned", "knn"):
        got = {(r["col_a"], r["col_b"]): r["mi"] for r in assoc.mi_matrix(df, ["x", "y", "noise"], method=method).collect()}
        assert got["x", "y"] == 1.0 and got["x", "noise"] < 0.3
    assert [tuple(r)[:2] for r in assoc.nonlinear_pairs(df, cols=["x", "y", "noise"]).collect()] == [("x", "y")]
    with pytest.raises(ValueError):
        assoc.mi_matrix(df, ["x"])


def planted(spark):
    return spark.range(200).select("id", F.when(F.col("id") == 17, 1000.0).when(F.col("id") == 90, -900.0).otherwise(F.pmod(F.col("id") * 37, F.lit(23)).cast("double")).alias("v"))


@pytest.mark.parametrize("method", ["zscore", "iqr", "mad"])
def test_planted_outliers_are_found(spark, method):
    got = out.flag(planted(spark), ["v"], method).filter("v_outlier")
    assert {r["id"] for r in got.collect()} == {17, 90}


def test_constant_and_tiny_columns_have_no_outliers(spark):
    flat = spark.createDataFrame([(1.0,)] * 9, "v double")
    tiny = spark.createDataFrame([(1.0,), (900.0,)], "v double")
    for df in (flat, tiny):
        for m in ("zscore", "iqr", "mad"):
            assert out.flag(df, ["v"], m).filter("v_outlier").count() == 0
    with pytest.raises(ValueError):
        out.flag(flat, ["v"], "guess")
    with pytest.raises(ValueError):
        out.flag(flat, ["w"])


def test_cooks_distance_matches_hat_matrix(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=60) * 0.3
    y[5] += 8
    df = spark.createDataFrame(pd.DataFrame({"id": range(60), "a": x[:, 0], "b": x[:, 1], "y": y}))
    got = out.cooks(df, "y", ["a", "b"]).orderBy("id").toPandas()
    full = np.c_[np.ones(60), x]
    hat = full @ np.linalg.inv(full.T @ full) @ full.T
    e = y - hat @ y
    h = np.diag(hat)
    mse = (e ** 2).sum() / 57
    assert np.allclose(got["leverage"], h) and np.allclose(got["cooks_d"], e ** 2 / (mse * (1 - h)) / 2 * h / (1 - h))
    assert got["cooks_outlier"][5]


def test_remediation_keeps_nulls_and_counts_changes(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "v double")
    fixed, log = rem.winsorize(df, ["v"])
    r = log.first()
    assert (r["lower"], r["upper"], r["n_changed"]) == (5.0, 94.0, 10)
    assert fixed.filter("v IS NULL").count() == 1
    assert rem.cap(df, ["v"], "percentile")[1].first()["n_changed"] == 2
    assert rem.cap(df, ["v"])[1].first()["n_changed"] == 0


def test_bins_agree_with_pandas(spark):
    v = pd.Series([1.0, 2, 2, 2, 3, 4, 5, 8, 13, 21, 34])
    df = spark.createDataFrame(v.to_frame("v"))
    q = rem.bin(df, "v", "quantile", 4).toPandas()
    assert (q["v_binned"] == pd.qcut(q["v"], 4, labels=False, duplicates="drop")).all()
    u = rem.bin(df, "v", "uniform", 5).toPandas()
    assert (u["v_binned"] == pd.cut(u["v"], 5, labels=False)).all()
    k = rem.bin(spark.createDataFrame([(x,) for x in (1.0, 1.1, 1.2, 9.0, 9.1, 50.0)], "v double"), "v", "kmeans", 3).toPandas()
    assert k["v_binned"].tolist() == [0, 0, 0, 1, 1, 2]


def test_power_transform_finds_the_log(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"v": np.exp(rng.normal(size=3000))}))
    _, fit = rem.transform(df, "v", "boxcox")
    assert abs(fit["lambda"]) < 0.06


def test_drift_of_a_table_with_itself_is_nothing(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert dr.psi(e, e, ["value"]).first()["psi"] == 0.0
    assert dr.ks(e, e, ["value"]).first()["statistic"] == 0.0
    c = dr.chi_square(e, e, ["event_type"]).first()
    assert c["statistic"] == 0.0 and math.isclose(c["p_value"], 1.0) and not c["drift"]


def test_ks_bounds_symmetry_and_disjoint(spark):
    a = spark.range(50).select(F.col("id").cast("double").alias("v"))
    b = spark.range(40).select((F.col("id") + 1000).cast("double").alias("v"))
    x, y = dr.ks(a, b).first(), dr.ks(b, a).first()
    assert x["statistic"] == y["statistic"] == 1.0 and x["drift"]
    assert dr.ks(a.limit(2), b).count() == 0
    with pytest.raises(ValueError):
        dr.analyze(a, b, methods=["chi2"])


def test_similarity_counts_missing_as_a_level(spark):
    a = spark.createDataFrame([("x",)] * 50 + [(None,)] * 50, "c string")
    b = spark.createDataFrame([("x",)] * 95 + [(None,)] * 5, "c string")
    assert dr.similarity(a, b).first()["p_value"] < 0.001


def test_classifier_separates_a_shift(spark):
    a = spark.range(600).select(F.randn(1).alias("v"), F.randn(2).alias("w"))
    b = spark.range(600).select((F.randn(3) + 2).alias("v"), F.randn(4).alias("w"))
    got = dr.drift_classifier(a, b, trees=20, depth=5).collect()
    assert got[0]["column"] == "v" and got[0]["auc"] > 0.85 and got[0]["drift"]
    same = dr.drift_classifier(a, a.select((F.col("v") + 0.0).alias("v"), "w"), trees=10, depth=3).first()
    assert not same["drift"]


def test_classifier_fits_a_large_forest_in_parts(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    fits, fit = [], RandomForestClassifier.fit

    def seen(self, data, *args):
        fits.append((self.getNumTrees(), self.getCacheNodeIds(), data.rdd.getNumPartitions()))
        return fit(self, data, *args)

    monkeypatch.setattr(RandomForestClassifier, "fit", seen)
    a = spark.range(600).select(F.randn(1).alias("v"), F.randn(2).alias("w"))
    b = spark.range(600).select((F.randn(3) + 2).alias("v"), F.randn(4).alias("w"))
    whole = dr.drift_classifier(a, b, trees=25, depth=5).collect()
    monkeypatch.setattr(dr, "FIT_ROW_TREES", 1_000)
    monkeypatch.setattr(dr, "TASK_ROWS", 100)
    parts = dr.drift_classifier(a, b, trees=25, depth=5).collect()
    assert [f[:2] for f in fits] == [(25, True), (10, False), (10, False), (5, False)]
    assert all(f[2] >= 8 for f in fits[1:])
    assert [r["column"] for r in parts] == [r["column"] for r in whole] == ["v", "w"]
    assert math.isclose(sum(r["importance"] for r in parts), 1.0)
    assert abs(parts[0]["auc"] - whole[0]["auc"]) < 0.02 and abs(parts[0]["accuracy"] - whole[0]["accuracy"]) < 0.03


def test_classifier_grows_a_large_forest_over_cells(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    rng = np.random.default_rng(5)
    a, b = ({"v": np.round(rng.normal(m, 1, n), 3), "w": rng.integers(0, 3, n).astype(float), "same": np.ones(n), "hole": np.where(rng.random(n) < 0.1, np.nan, 1.0)}
            for m, n in ((0, 9000), (1, 3000)))
    a, b = (spark.createDataFrame(pd.DataFrame(x)) for x in (a, b))
    whole = dr.drift_classifier(a, b, trees=25, depth=5).collect()
    monkeypatch.setattr(dr, "FIT_ROW_TREES", 1_000)
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *_: pytest.fail("a forest over all rows"))
    cells = dr.drift_classifier(a, b, trees=25, depth=5).collect()
    assert cells == dr.drift_classifier(a.repartition(7), b.repartition(3), trees=25, depth=5).collect()
    assert [r["column"] for r in cells[:2]] == [r["column"] for r in whole[:2]] == ["v", "w"] and {r["importance"] for r in cells[2:]} == {0.0}
    assert math.isclose(sum(r["importance"] for r in cells), 1.0) and abs(cells[0]["importance"] - whole[0]["importance"]) < 0.1
    assert [tuple(cells[0])[4:], cells[0]["drift"]] == [tuple(whole[0])[4:], True]
    assert abs(cells[0]["auc"] - whole[0]["auc"]) < 0.02 and abs(cells[0]["accuracy"] - whole[0]["accuracy"]) < 0.03
    monkeypatch.setattr(dr, "MAX_CELLS", 10)
    with pytest.raises(pytest.fail.Exception):  # too many cells: the trainer's forest, in parts
        dr.drift_classifier(a, b, trees=25, depth=5)


def test_tree_over_cells_splits_where_gini_falls_most():
    bins = np.array([[i, j] for i in range(4) for j in range(4)], "uint8")
    rows = np.array([[1000, 1000 * (i > 1) + 400 * (j > 2)] for i, j in bins])
    votes, importance = dr._tree(bins, rows, np.array([1.0, 1.0]), 1, 2, np.random.default_rng(1))
    assert list(importance) == [1.0, 0.0] and len(set(votes)) == 2
    assert abs(votes[0] - 400 / 4400) < 0.02 and abs(votes[-1] - 4400 / 8400) < 0.02
    same, nothing = dr._tree(bins, rows // [1, 10], np.array([1.0, 1.0]), 3, 2, np.random.default_rng(1))
    assert len(set(same)) == 1 and not nothing.any()  # leaves that agree are one leaf


PII = [("EMAIL", "write to jo.doe@example.org today", "jo at example"), ("PHONE_US", "call 415-555-0134 now", "call 12-34"),
       ("SSN", "id 078-05-1120 x", "id 078-051120"), ("CREDIT_CARD", "card 4111 1111 1111 1111 ok", "card 4111 1111"),
       ("IP_ADDRESS", "host 192.168.10.4 up", "v1.2.3"), ("URL", "see https://www.example.com/a?b=1 there", "see example dot com"),
       ("DATE_OF_BIRTH", "born 12/31/1980 here", "born 31/12/80"), ("ZIP_CODE", "at 94103-1234 city", "at 941")]


@pytest.mark.parametrize("family,hit,miss", PII)
def test_each_pattern_family(spark, family, hit, miss):
    df = spark.createDataFrame([(1, hit), (2, miss), (3, None), (4, "größe über ñandú")], "id int, t string")
    n = {r["pii_type"]: r["n_matches"] for r in pii.pii_by_value(df).collect()}
    assert n[family] == 1
    f = pii.pii_findings(df, ["t"], ["id"]).filter(F.col("pii_type") == family).collect()
    assert len(f) == 1 and f[0]["id"] == 1
    assert hit[f[0]["start"] - 1: f[0]["start"] - 1 + f[0]["length"]] == f[0]["match"]


def test_repeated_matches_have_their_own_place(spark):
    df = spark.createDataFrame([(1, "a@b.co, a@b.co and a@b.co")], "id int, t string")
    f = pii.pii_findings(df, ["t"], ["id"]).filter("pii_type = 'EMAIL'").orderBy("start").collect()
    assert [r["start"] for r in f] == [1, 9, 20]
    assert pii.finding_examples(pii.pii_findings(df, ["t"], ["id"]), ["id"], 2).count() == 2


def test_name_rules_and_summary(spark):
    df = spark.createDataFrame([("x", 1, "y")], "user_email string, paid int, note string")
    scan = {r["column"]: r for r in pii.pii_scan(df).collect()}
    assert scan["user_email"]["pii_types"] == "EMAIL" and scan["user_email"]["confidence"] == 0.7
    assert scan["paid"]["pii_types"] == "ID"
    assert {r["column"] for r in pii.pii_scan(df, whole_word=True).collect()} == {"user_email"}
    s = pii.pii_summary(df).first()
    assert s["direct_identifier_priority"] == "CRITICAL" and s["columns_with_pii"] == 2


def test_k_anonymity_groups_nulls_and_sums_up(spark):
    rows = [(i, None if i < 5 else "u" if i < 8 else f"r{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "id int, a string")
    k = {r["id"]: r["k"] for r in anon.k_anonymity(df, ["a"]).collect()}
    assert [k[0], k[6], k[11]] == [5, 3, 1]
    assert anon.k_distribution(df, ["a"]).agg(F.sum("n_records")).first()[0] == 12
    s = anon.k_stats(df, ["a"]).first()
    assert (s["min_k"], s["max_k"], s["median_k"], s["unique_records"], s["severity"]) == (1, 5, 3, 4, "CRITICAL")
    curve = {r["k"]: r["n_at_risk"] for r in anon.k_risk_curve(df, ["a"]).collect()}
    assert curve[1] == 0 and curve[2] == 4 and curve[100] == 12
    assert anon.vulnerable(df, ["a"], 4).count() == 7
    with pytest.raises(ValueError):
        anon.k_anonymity(df, ["nope"])


def test_partial_dependency_and_samples(spark):
    rows = [(f"z{i}", "c1" if i < 20 else "c2") for i in range(40)] * 2 + [("z3", "c9")]
    df = spark.createDataFrame(rows, "zip string, city string")
    got = dep.find_typed(df).collect()
    assert [(r["determinant"], r["dependent"], r["confidence"], r["type"]) for r in got] == [("zip", "city", 0.975, "M:1 (partial)")]
    assert dep.samples(df, "zip", "city").filter("value = 'z0'").first()["maps_to"] == "c1"
    fixed = dep.enforce(df, df, [("zip", "city")])
    assert dep.find(fixed).first()["confidence"] == 1.0
    assert dep.find(df, min_confidence=0.99).count() == 0


def test_dependency_validation_statuses(spark):
    fds = records(spark, [("a", "b", 1.0), ("a", "gone", 1.0), ("b", "a", 1.0)], "determinant string, dependent string, confidence double")
    other = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "a int, b int")
    got = {(r["determinant"], r["dependent"]): r["status"] for r in dep.validate(fds, other).collect()}
    assert got == {("a", "b"): "PRESERVED", ("a", "gone"): "MISSING_COLUMNS", ("b", "a"): "VIOLATED"}
    assert math.isclose(dep.preservation_rate(dep.validate(fds, other)).first()["pct_preserved"], 100 / 3)


def test_search_and_k_have_no_cap(spark):
    from tallyglass.operators import anonymity, relational

    df = spark.range(1500).select(F.concat(F.lit("Value "), F.col("id")).alias("c"), "id")
    assert relational.filter_search(df, "c", "VALUE").count() == 1500
    assert relational.search_values(df, "c", "value").count() == 1500 and relational.search_values(df, "c", "value", 7).count() == 7
    many = spark.range(1, 26).select(F.explode(F.sequence(F.lit(1), "id")).alias("x"), "id")
    assert [r["k"] for r in anonymity.k_distribution(many, ["id"]).collect()] == list(range(1, 26))
    assert anonymity.k_distribution(many, ["id"], rows=3).count() == 3


def test_foreign_keys_of_any_name(spark):
    from tallyglass.sources import metadata

    parent = spark.createDataFrame([(i, f"n{i}") for i in range(1, 30)], "id long, label string")
    child = spark.createDataFrame([(i % 29 + 1, i % 7, f"n{i % 5 + 1}") for i in range(100)], "customer_no long, small long, tag string")
    got = {tuple(r) for r in metadata.detect_relationships({"parent": parent, "child": child}, same_name=False).collect()}
    assert got == {("parent", "id", "child", "customer_no"), ("parent", "label", "child", "tag")}
    named = metadata.detect_relationships({"parent": parent.withColumnRenamed("id", "p_customer_no"), "child": child.withColumnRenamed("customer_no", "c_customer_no")})
    assert [tuple(r) for r in named.collect()] == [("parent", "p_customer_no", "child", "c_customer_no")]
    assert metadata.detect_relationships({"parent": parent, "child": child}, key_suffix="key").count() == 0


@pytest.mark.parametrize("boxes", [2_000, 15])
def test_nearest_neighbour_information_against_brute_force(spark, monkeypatch, boxes):
    from tallyglass.operators import association, neighbours
    from tallyglass.functions.special import digamma

    monkeypatch.setattr(neighbours, "BOX_POINTS", boxes)
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    rows = [(float(a), float(a * a + b), float(round(a)), None) for a, b in zip(x, rng.normal(size=300) / 5)] + [(0.0, 1.0, 2.0, None)] * 6
    rows += [(None, 1.0, 1.0, None), (float("nan"), 1.0, 1.0, None)]
    got = {(r["col_a"], r["col_b"]): r["mi"] for r in association.mi_matrix(spark.createDataFrame(rows, "a double, b double, c double, d double"), cols=["a", "b", "c"], method="knn", normalize=False).collect()}
    z = np.array([r[:3] for r in rows[:306]])
    z = np.round((z - z.mean(0)) / z.std(0) * (1 << 30))
    n = len(z)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        gaps = [np.abs(z[:, k][:, None] - z[:, k]) for k in (i, j)]
        d = np.maximum(*gaps)
        np.fill_diagonal(d, np.inf)
        eps = np.sort(d, axis=1)[:, 2]
        total = sum(digamma(max(int((g[r] < eps[r]).sum()) - 1, 0) + 1.0) for g in gaps for r in range(n))
        want = max(0.0, digamma(3.0) + digamma(float(n)) - total / n)
        assert got["abc"[i], "abc"[j]] == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("pieces", [4_096, 16])
def test_kmeans_bins_have_the_least_sum_of_squares(spark, pieces):
    from itertools import combinations

    rng = np.random.default_rng(8)
    x = np.round(np.concatenate([rng.normal(0, 1, 40), rng.normal(5, 1, 30), rng.normal(6.5, 0.3, 30)]), 2)
    edges = rem.kmeans_edges(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double"), "v", 3, pieces)
    order = np.sort(x)

    def within(groups):
        return sum(((g - g.mean()) ** 2).sum() for g in groups if len(g))

    best = min(within(np.split(order, c)) for c in combinations(range(1, len(order)), 2))
    assert within([order[(order > a) & (order <= b)] for a, b in zip([-np.inf, *edges[1:-1]], [*edges[1:-1], np.inf])]) == pytest.approx(best)
    assert rem.kmeans_edges(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 3) == [2.0, 2.0]


@pytest.mark.parametrize("norm", ["euclid", "max"])
@pytest.mark.parametrize("group", [1, 3])
def test_boxes_meet_in_groups(spark, monkeypatch, norm, group):
    from tallyglass.operators import neighbours

    monkeypatch.setattr(neighbours, "BOX_POINTS", 10)
    monkeypatch.setattr(neighbours, "GROUP_BOXES", group)
    monkeypatch.setattr(neighbours, "VISITORS", 40)
    x = np.random.default_rng(5).integers(0, 40, (300, 2)).astype(float)
    x = np.unique(x, axis=0)
    points = neighbours.materialise(spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "id long, p array<double>, w double"), "points")
    got = neighbours.neighbours(points, points.select("id", "p", F.lit(0.0).alias("self")), 4, same=True, norm=norm).collect()
    gap = np.abs(x[:, None] - x)
    d = np.round(gap.max(2) if norm == "max" else np.sqrt((gap ** 2).sum(2)), 9)
    np.fill_diagonal(d, np.inf)
    edge = np.sort(d, axis=1)[:, 3]
    assert {(r["id"], r["nid"], r["d"], r["kdist"]) for r in got} == {(i, j, d[i, j], edge[i]) for i, j in zip(*np.nonzero(d <= edge[:, None]))}
    assert len(got) == int((d <= edge[:, None]).sum())


def test_concordance_without_pairs_that_share_a_range():
    rng = np.random.default_rng(9)
    x, y, w = rng.integers(0, 20, 150), rng.integers(0, 12, 150), rng.integers(1, 4, 150)
    pdf = pd.DataFrame({"x": x * 1.0, "y": y * 1.0, "w": w * 1.0, "bx": x // 6})
    sign = np.sign(x[:, None] - x) * np.sign(y[:, None] - y) * w[:, None] * w
    other = (x // 6)[:, None] != x // 6
    assert assoc._concordance(pdf) == sign.sum() / 2
    assert assoc._concordance(pdf, "bx") == (sign * other).sum() / 2


def test_spearman_counts_values_once(spark, monkeypatch):
    written, write = [], assoc.materialise
    monkeypatch.setattr(assoc, "materialise", lambda df, name: written.append(name) or write(df, name))
    rows = spark.range(300).select((F.col("id") % 17).cast("double").alias("a"), F.randn(2).alias("b"))
    got, pdf = assoc.spearman(rows).first()["r"], rows.toPandas()
    assert "rank-counts" in written
    assert math.isclose(got, pdf["a"].rank().corr(pdf["b"].rank()), abs_tol=1e-9)
