"""Gaussian copula synthesiser, alone and for parent/child tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.exprs import collect_stats, q
from ..functions.keyed import attach
from ..functions.store import materialise
from ..operators.association import pearson
from .marginals import Marginal, as_model, fit_marginals, model_schema, restore, seeds


class GaussianCopula:
    """``fit`` keeps one value table per column and the correlation of normal scores; ``sample`` draws
    correlated normals in the JVM and maps them back through the tables."""

    def __init__(self, marginals: list[Marginal], factor: np.ndarray, spark):
        self.marginals, self.factor, self.spark = marginals, factor, spark

    @property
    def modelled(self) -> list[Marginal]:
        return [m for m in self.marginals if m.kind != "id"]

    @classmethod
    def fit(cls, df: DataFrame, ids: list[str] | None = None) -> "GaussianCopula":
        marginals = fit_marginals(df, ids)
        live = [m for m in marginals if m.kind != "id"]
        corr = np.eye(len(live))
        if len(live) > 1:
            scored = cls(marginals, corr, df.sparkSession).scored(df)
            for r in pearson(scored).collect():  # column pairs
                i, j = int(r["col_a"][1:]), int(r["col_b"][1:])
                corr[i, j] = corr[j, i] = r["r"] or 0.0
        return cls(marginals, _factor(corr), df.sparkSession)

    def independent(self) -> "GaussianCopula":
        """The same columns without their dependence."""
        return GaussianCopula(self.marginals, np.eye(len(self.modelled)), self.spark)

    def scored(self, df: DataFrame, carry: list | None = None) -> DataFrame:
        """The columns ``carry`` and the normal scores s0, s1, ... of the modelled columns."""
        live, carry = self.modelled, carry or []
        model = df.select(*carry, *[as_model(df, m.name, m.kind).alias(f"x{i}") for i, m in enumerate(live)])
        kept = model.schema.fields[:len(carry)]

        def scores(batches):
            import pandas as pd

            for pdf in batches:
                yield pd.DataFrame({**{f.name: pdf[f.name] for f in kept}, **{f"s{i}": m.score(pdf[f"x{i}"]) for i, m in enumerate(live)}})

        return model.mapInPandas(scores, T.StructType([*kept, *[T.StructField(f"s{i}", T.DoubleType()) for i in range(len(live))]]))

    def sample(self, n: int, seed: int = 42, first_id: int = 0, rows: DataFrame | None = None, factor: np.ndarray | None = None, shift: list | None = None) -> DataFrame:
        """``n`` rows, or one row per row of ``rows`` (which then keeps its columns).  ``factor`` and ``shift`` (a column per modelled
        column) give other normal scores: shift + factor times independent normals."""
        live, carry = self.modelled, [] if rows is None else rows.columns
        if rows is None:
            base = seeds(self.spark, n, len(live), seed)
        else:
            base = rows.select("*", F.lit(0).cast("long").alias("row_id"), *[F.randn(seed + i).alias(f"g{i}") for i in range(len(live))])
        z, factor = [], self.factor if factor is None else factor
        for i in range(len(live)):
            total = F.lit(0.0) if shift is None else shift[i]
            for j in range(i + 1):
                if factor[i, j]:
                    total = total + F.lit(float(factor[i, j])) * F.col(f"g{j}")
            z.append(total.alias(f"z{i}"))
        drawn = base.select(*[q(c) for c in carry], "row_id", *z, *[(F.rand(seed + 1000 + i) < F.lit(float(m.null_share))).alias(f"n{i}")
                                                                    for i, m in enumerate(live)])
        marginals = self.marginals

        def invert(batches):
            import pandas as pd

            for pdf in batches:
                out, i = {c: pdf[c] for c in carry}, 0
                for m in marginals:
                    if m.kind == "id":
                        out[m.name] = pdf["row_id"].astype(float) + first_id
                        continue
                    x = pd.Series(m.invert(pdf[f"z{i}"].to_numpy()))
                    out[m.name] = x.mask(pdf[f"n{i}"].to_numpy())
                    i += 1
                yield pd.DataFrame(out)

        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in (rows.schema.fields if rows is not None else [])],
                            model_schema(marginals)])
        return restore(drawn.mapInPandas(invert, schema), marginals)


def _factor(corr: np.ndarray) -> np.ndarray:
    """Lower factor of the nearest usable correlation matrix."""
    if not len(corr):
        return corr
    w, v = np.linalg.eigh(corr)
    fixed = (v * np.maximum(w, 1e-6)) @ v.T
    d = np.sqrt(np.diag(fixed))
    return np.linalg.cholesky(fixed / d[:, None] / d[None, :])


class Family:
    """How the rows of a child table hang on their parent: shares of the parents' mean scores to keep, their centre, and the factor of
    what rows of one parent vary by."""

    def __init__(self, columns: list[str], keep: np.ndarray, centre: np.ndarray, factor: np.ndarray, most: int):
        self.columns, self.keep, self.centre, self.factor, self.most = columns, keep, centre, factor, most

    @staticmethod
    def moments(child: str, fk: str, df: DataFrame, model: GaussianCopula) -> tuple["Family", DataFrame]:
        """The family and (_k, number of children, mean score per column) of every parent with children."""
        k = len(model.modelled)
        names = [f"__{child}_{i}" for i in range(k)]
        scored = materialise(model.scored(df.filter(q(fk).isNotNull()), [q(fk).alias("_k")]), "scores")
        per = materialise(scored.groupBy("_k").agg(F.count(F.lit(1)).alias(f"__{child}_n"), *[F.avg(f"s{i}").alias(names[i]) for i in range(k)]), "moments")
        n = F.col(f"__{child}_n")
        s = collect_stats(per, {"parents": F.count(F.lit(1)), "rows": F.sum(n), "most": F.max(n), "noise": F.avg(1 / n),
                                **{(i, m): f(names[i]) for i in range(k) for m, f in (("centre", F.avg), ("var", F.var_pop))}})
        inside = np.zeros((k, k))
        if k and s["rows"]:
            apart = attach(scored, per, ["_k"], n_keys=s["parents"]).select(*[(F.col(f"s{i}") - F.col(names[i])).alias(f"d{i}") for i in range(k)])
            cov = collect_stats(apart, {(i, j): F.avg(F.col(f"d{i}") * F.col(f"d{j}")) for i in range(k) for j in range(i + 1)})
            for (i, j), v in cov.items():
                inside[i, j] = inside[j, i] = (v or 0.0) * s["rows"] / max(s["rows"] - s["parents"], 1)
        # the mean of few rows varies more than what the parent stands for
        keep = np.array([np.sqrt(max(0.0, 1 - inside[i, i] * s["noise"] / s[i, "var"])) if s[i, "var"] else 0.0 for i in range(k)])
        centre = np.array([s[i, "centre"] or 0.0 for i in range(k)])
        spread = np.sqrt(np.maximum(np.diag(inside), 1e-12))
        factor = spread[:, None] * _factor(inside / spread[:, None] / spread[None, :] * (1 - np.eye(k)) + np.eye(k)) if k else inside
        return Family(names, keep, centre, factor, int(s["most"] or 0)), per

    def shifts(self) -> list:
        """Normal scores that a parent's generated mean scores stand for."""
        return [F.coalesce((F.col(c) - F.lit(float(m))) * F.lit(float(b)), F.lit(0.0)) + F.lit(float(m)) for c, b, m in zip(self.columns, self.keep, self.centre)]


class MultiTable:
    """Parents, then children per parent.  ``links`` maps a child table to (child key, parent table, parent key).

    Hierarchical: every parent row is extended by the number of its children and their mean normal scores, the parent's copula is fitted
    on the extended row, and children are drawn around the generated means of their own parent, with the variation that rows of one
    parent have.  Tables are fitted from the last children up, so grandchildren reach their grandparents."""

    def __init__(self, models, families, sizes, links, keys, names):
        self.models, self.families, self.sizes, self.links, self.keys, self.names = models, families, sizes, links, keys, names

    @classmethod
    def fit(cls, tables: dict[str, DataFrame], links: dict[str, tuple[str, str, str]], keys: dict[str, str]) -> "MultiTable":
        for child, (fk, parent, pk) in links.items():
            if fk not in tables[child].columns or keys.get(parent) != pk:
                raise ValueError(f"bad link of {child}")
        whole, models, families, sizes = dict(tables), {}, {}, {}
        pending = list(tables)
        while pending:
            ready = [t for t in pending if not any(links[c][1] == t for c in pending if c in links)]
            if not ready:
                raise ValueError("links form a cycle")
            for t in ready:
                pending.remove(t)
                fk = links[t][0] if t in links else None
                models[t] = GaussianCopula.fit(whole[t].drop(fk) if fk else whole[t], [keys[t]] if t in keys else [])
                drawn = {c for child, f in families.items() if links[child][1] == t for c in f.columns}
                for m in models[t].marginals:
                    m.null_share = 0.0 if m.name in drawn else m.null_share  # a parent without children has none only because it has none
                sizes[t] = whole[t].count()
                if fk:
                    _, parent, pk = links[t]
                    families[t], per = Family.moments(t, fk, whole[t], models[t])
                    wide = whole[parent].join(per, q(pk) == F.col("_k"), "left").drop("_k")
                    whole[parent] = materialise(wide.withColumn(f"__{t}_n", F.coalesce(f"__{t}_n", F.lit(0).cast("long"))), "extended")
        return cls(models, families, sizes, links, keys, {t: df.columns for t, df in tables.items()})

    def sample(self, scale: float = 1.0, seed: int = 42) -> dict[str, DataFrame]:
        """Referentially valid tables: every child key exists in its generated parent."""
        out: dict[str, DataFrame] = {}
        pending = list(self.models)
        step = 0
        while pending:
            for t in [t for t in pending if t not in self.links or self.links[t][1] in out]:
                step += 1
                s = seed + 7_919 * step
                if t not in self.links:
                    out[t] = self.models[t].sample(max(1, round(self.sizes[t] * scale)), s)
                else:
                    out[t] = self._children(t, out[self.links[t][1]], s)
                pending.remove(t)
        return {t: df.select(*[q(c) for c in self.names[t]]) for t, df in out.items()}

    def _children(self, t: str, parents: DataFrame, seed: int) -> DataFrame:
        fk, parent, pk = self.links[t]
        family, model = self.families[t], self.models[t]
        count = F.greatest(F.coalesce(F.round(q(f"__{t}_n")), F.lit(0)), F.lit(0)).cast("int")
        rows = parents.select(q(pk).alias(fk), *[q(c) for c in family.columns], F.explode(F.sequence(F.lit(0), count)).alias("_i")).filter("_i > 0")
        made = model.sample(0, seed, rows=rows, factor=family.factor, shift=family.shifts())
        key = self.keys.get(t)
        if key:
            # child keys from parent key and position: unique and reproducible without a global order
            dtype = made.schema[key].dataType
            made = made.withColumn(key, (q(fk).cast("long") * F.lit(family.most + 1) + F.col("_i")).cast(dtype))
        return made.drop("_i", *family.columns)
