"""Sequence synthesiser: first-order models per column, pooled over the sequences of a key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import q, resolve
from ..functions.sequences import as_number, blocks, row_index
from ..functions.quantiles import one_column
from ..operators.association import pearson
from .marginals import Marginal, as_model, fit_marginals, model_schema, restore

MAX_STATES = 500


class SequenceSynth:
    def __init__(self, marginals, lag, chains, start, step, key, index, spark):
        self.marginals, self.lag, self.chains = marginals, lag, chains
        self.start, self.step, self.key, self.index, self.spark = start, step, key, index, spark

    @classmethod
    def fit(cls, df: DataFrame, key: str, index: str, tie: str | None = None) -> "SequenceSynth":
        """Numeric columns: value table and lag-1 correlation of normal scores.  Text columns: first-state and
        transition counts.  Neighbours come from the block scheme, so one long sequence is not one task."""
        resolve(df, [key, index])
        body = [c for c in df.columns if c not in (key, index, tie)]
        marginals = fit_marginals(df.select(*[q(c) for c in body]))
        crowded = [m.name for m in marginals if len(m.levels) > MAX_STATES]
        if crowded:
            raise ValueError(f"more than {MAX_STATES} states: {crowded}")
        order = [index, tie] if tie else [index]
        model = df.select(q(key).alias("_key"), *[q(c) for c in order], as_number(df, index).alias("_t"),
                          *[as_model(df, m.name, m.kind).alias(m.name) for m in marginals]).filter(F.col("_key").isNotNull() & q(index).isNotNull())
        idx = row_index(model, order, ["_key"])
        w = Window.partitionBy("_key", "_block").orderBy("idx")
        near = blocks(idx, 1, 0).select("*", F.lag("_t").over(w).alias("_pt"), *[F.lag(q(m.name)).over(w).alias("_p_" + m.name) for m in marginals]).filter("_own")
        numeric = [m for m in marginals if m.kind == "numeric"]
        texts = [m for m in marginals if m.kind == "categorical"]
        lag = {}
        if numeric:
            def scores(batches):
                import pandas as pd

                for pdf in batches:
                    yield pd.DataFrame({f"{s}{i}": m.score(pdf[pre + m.name]) for i, m in enumerate(numeric) for s, pre in (("a", ""), ("b", "_p_"))})

            follow = near.filter("idx > 0").select(*[q(pre + m.name) for m in numeric for pre in ("", "_p_")])
            scored = follow.mapInPandas(scores, ", ".join(f"{s}{i} double" for i in range(len(numeric)) for s in "ab"))
            got = {(r["col_a"], r["col_b"]): r["r"] for r in pearson(scored).collect()}
            lag = {m.name: float(np.clip(got.get((f"a{i}", f"b{i}")) or 0.0, -0.999, 0.999)) for i, m in enumerate(numeric)}
        chains = {}
        if texts:
            cells = F.array(*[F.struct(F.lit(i).alias("c"), q("_p_" + m.name).alias("a"), q(m.name).alias("b")) for i, m in enumerate(texts)])
            counts = near.select((F.col("idx") == 0).alias("first"), F.inline(cells)).filter(F.col("b").isNotNull()).groupBy("first", "c", "a", "b").agg(
                F.count(F.lit(1)).alias("n"))
            for m in texts:
                k = len(m.levels)
                chains[m.name] = (np.zeros(k), np.zeros((k, k)))
            pos = {m.name: {l: i for i, l in enumerate(m.levels)} for m in texts}
            for r in counts.collect():  # states x states per column
                m = texts[r["c"]]
                j = pos[m.name][r["b"]]
                if r["first"]:
                    chains[m.name][0][j] += r["n"]
                elif r["a"] is not None:
                    chains[m.name][1][pos[m.name][r["a"]], j] += r["n"]
        start = near.agg(F.min("_t")).first()[0] or 0.0
        step = one_column(near.filter("idx > 0").select((F.col("_t") - F.col("_pt")).alias("g")), F.col("g"), [0.5])[0] or 1.0
        ends = [Marginal(key, "id", df.schema[key].dataType), Marginal(index, "numeric", df.schema[index].dataType)]
        return cls(ends + marginals, lag, chains, start, step, key, index, df.sparkSession)

    def sample(self, sequences: int, length: int, seed: int = 42) -> DataFrame:
        """``sequences`` sequences of ``length`` rows; each is drawn from a generator seeded by its number."""
        marginals, lag, chains = self.marginals, self.lag, self.chains
        start, step, key, index = self.start, self.step, self.key, self.index
        parts = max(1, -(-sequences * length // 500_000))
        ids = self.spark.range(0, sequences, 1, parts)

        def draw(batches):
            import pandas as pd

            for pdf in batches:
                for s in pdf["id"]:
                    rng = np.random.default_rng([seed, int(s)])
                    out = {key: np.full(length, float(s)), index: start + step * np.arange(length)}
                    for m in marginals[2:]:
                        if m.kind == "numeric":
                            r, z = lag[m.name], rng.standard_normal(length)
                            for i in range(1, length):
                                z[i] = r * z[i - 1] + np.sqrt(1 - r * r) * z[i]
                            out[m.name] = m.invert(z)
                        else:
                            first, moves = chains[m.name]
                            out[m.name] = _walk(m.levels, m.shares, first, moves, length, rng)
                        if m.null_share:
                            out[m.name] = pd.Series(out[m.name]).mask(rng.random(length) < m.null_share).to_numpy()
                    yield pd.DataFrame({m.name: out[m.name] for m in marginals})

        return restore(ids.mapInPandas(draw, model_schema(self.marginals)), self.marginals)


def _walk(levels, shares, first, moves, length, rng):
    """One path of a Markov chain; a state without observed successors falls back to the shares."""
    p = first / first.sum() if first.sum() else shares
    total = moves.sum(1, keepdims=True)
    cdf = np.cumsum(np.where(total > 0, moves / np.where(total > 0, total, 1), shares), axis=1)
    state = int(rng.choice(len(levels), p=p))
    path = [state]
    for u in rng.random(length - 1):
        state = min(int(np.searchsorted(cdf[state], u)), len(levels) - 1)
        path.append(state)
    return np.array(levels, object)[path]
