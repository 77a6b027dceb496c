"""Tree-leaf synthesiser: a forest separates real rows from independently drawn ones; new rows are drawn
from the per-leaf column distributions of a randomly chosen tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import q
from ..functions.special import normal_cdf
from .copula import GaussianCopula
from .marginals import as_model, model_schema, restore, seeds

TREES, DEPTH, LEAF_POINTS, MAX_DOMAIN = 8, 6, 33, 1_000


class TreeSynth:
    def __init__(self, marginals, leaves, spark):
        self.marginals, self.leaves, self.spark = marginals, leaves, spark

    @classmethod
    def fit(cls, df: DataFrame, ids: list[str] | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> "TreeSynth":
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        base = GaussianCopula.fit(df, ids)
        live = base.modelled
        crowded = [m.name for m in live if len(m.levels) > MAX_DOMAIN]
        if crowded:
            raise ValueError(f"more than {MAX_DOMAIN} levels, name them as ids: {crowded}")
        fake = base.independent().sample(df.count(), seed)

        def coded(table):
            cols = []
            for m in live:
                x = as_model(table, m.name, m.kind)
                if m.kind == "categorical":
                    x = F.create_map(*[F.lit(v) for i, l in enumerate(m.levels) for v in (l, float(i))])[x] if m.levels else F.lit(0.0)
                cols.append(F.coalesce(x.cast("double"), F.lit(-1.0)).alias("f_" + m.name))
            return cols

        names = ["f_" + m.name for m in live]
        real = df.select(*coded(df), *[as_model(df, m.name, m.kind).alias(m.name) for m in live])
        both = real.select(*names).withColumn("label", F.lit(1.0)).unionByName(fake.select(*coded(fake)).withColumn("label", F.lit(0.0)))
        pack = VectorAssembler(inputCols=names, outputCol="features")
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5).fit(pack.transform(both))
        at = forest.setLeafCol("leaf").transform(pack.transform(real)).select(
            F.posexplode(vector_to_array("leaf")).alias("tree", "leaf"), *[q(m.name) for m in live])
        # per-leaf tables: leaves are bounded by trees x 2^depth
        numeric = [m for m in live if m.kind == "numeric"]
        texts = [m for m in live if m.kind == "categorical"]
        probs = F.array(*[F.lit(i / (LEAF_POINTS - 1)) for i in range(LEAF_POINTS)])
        stats = at.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(q(m.name), probs, F.lit(1000)).alias(f"t{i}")
                                               for i, m in enumerate(numeric)], *[F.avg(q(m.name).isNull().cast("double")).alias(f"z{i}") for i, m in enumerate(numeric)]).collect()
        leaves = {(r["tree"], int(r["leaf"])): {"n": r["n"], **{m.name: (r[f"t{i}"], r[f"z{i}"]) for i, m in enumerate(numeric)}} for r in stats}
        if texts:
            cells = F.array(*[F.struct(F.lit(i).alias("c"), q(m.name).alias("v")) for i, m in enumerate(texts)])
            for r in at.select("tree", "leaf", F.inline(cells)).groupBy("tree", "leaf", "c", "v").agg(F.count(F.lit(1)).alias("n")).collect():
                leaves[r["tree"], int(r["leaf"])].setdefault(texts[r["c"]].name, []).append((r["v"], r["n"]))
        return cls(base.marginals, leaves, df.sparkSession)

    def sample(self, n: int, seed: int = 42) -> DataFrame:
        live = [m for m in self.marginals if m.kind != "id"]
        base = seeds(self.spark, n, len(live) + 1, seed)
        marginals = self.marginals
        keys = sorted(self.leaves)
        weight = np.cumsum([self.leaves[k]["n"] for k in keys], dtype=float)
        weight /= weight[-1]
        tables = [self.leaves[k] for k in keys]

        def draw(batches):
            import pandas as pd

            grid = np.linspace(0, 1, LEAF_POINTS)
            for pdf in batches:
                leaf = np.minimum(np.searchsorted(weight, normal_cdf(pdf["g0"].to_numpy())), len(keys) - 1)
                out = {m.name: np.empty(len(pdf), object if m.kind == "categorical" else float) for m in live}
                order = np.argsort(leaf, kind="stable")
                bounds = np.searchsorted(leaf[order], np.arange(len(keys) + 1))
                for b in np.unique(leaf):
                    rows = order[bounds[b]: bounds[b + 1]]
                    for i, m in enumerate(live):
                        u = normal_cdf(pdf[f"g{i + 1}"].to_numpy()[rows])
                        t = tables[b][m.name]
                        if m.kind == "numeric":
                            table, null = t
                            if table is None:
                                out[m.name][rows] = np.nan
                                continue
                            x = np.interp(np.clip((u - null) / max(1 - null, 1e-12), 0, 1), grid, table)
                            out[m.name][rows] = np.where(u < null, np.nan, np.rint(x) if m.whole else x)
                        else:
                            share = np.cumsum([c for _, c in t], dtype=float)
                            out[m.name][rows] = np.array([v for v, _ in t], object)[np.minimum(np.searchsorted(share / share[-1], u), len(t) - 1)]
                for m in marginals:
                    if m.kind == "id":
                        out[m.name] = pdf["row_id"].astype(float).to_numpy()
                yield pd.DataFrame({m.name: out[m.name] for m in marginals})

        return restore(base.mapInPandas(draw, model_schema(self.marginals)), self.marginals)
