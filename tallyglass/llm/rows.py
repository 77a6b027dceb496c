"""Rows of wide tables: columns added by Arrow functions, rows taken out by their keys."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.exprs import q
from .arrays import SLICE_ROWS, lean

BROADCAST_KEYS = 2_000_000


def small_batches(spark: SparkSession, rows: int = SLICE_ROWS) -> None:
    """From now on rows go to Python in Arrow batches of at most ``rows``: buffers of 10,000 whole texts (Spark's default) lie outside an
    executor's heap and stay with its process once they were needed.  The functions cut their batches to this size anyway."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def text_hash(text: str = "text"):
    """64-bit hash of a text; with the key it names a row, as keys may repeat."""
    return F.xxhash64(q(text))


def without(df: DataFrame, keys: dict, gone: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``df`` whose ``keys`` (name -> expression) are not among the columns of these names of ``gone`` (a written table), nulls
    equal.  Up to ``limit`` keys, counted here, are broadcast, so the rows stay where they are; more are joined by shuffle."""
    gone = gone.select(*[q(k).alias(f"_gone{i}") for i, k in enumerate(keys)]).distinct()
    side = F.broadcast(gone) if gone.count() <= limit else gone
    same = [e.eqNullSafe(side[f"_gone{i}"]) for i, e in enumerate(keys.values())]
    return df.join(side, reduce(lambda a, b: a & b, same), "left_anti")


def extend(df: DataFrame, run, fields: list[T.StructField], hidden: dict | None = None) -> DataFrame:
    """``df`` with the columns ``fields`` (those of ``df`` by these names go) that ``run(batch)`` gives as (first row, arrays)
    for runs of its rows.  The batch has the columns of ``df`` in order, then the expressions ``hidden``, for the function alone."""
    kept = [c for c in df.columns if c not in {f.name for f in fields}]
    every = kept + [c for c in df.columns if c not in kept]  # a column that is replaced may be read
    names = [f"c{i}" for i in range(len(every))]
    base = df.select(*[q(c).alias(n) for c, n in zip(every, names)], *[e.alias(f"h{i}") for i, e in enumerate((hidden or {}).values())])
    place = {c: i for i, c in enumerate([*every, *(hidden or {})])}
    given = [f"n{i}" for i in range(len(fields))]
    schema = T.StructType([*[T.StructField(n, base.schema[n].dataType) for n in names[:len(kept)]], *[T.StructField(n, f.dataType) for n, f in zip(given, fields)]])

    def over(batches):
        work = run()
        for batch in batches:
            for at, arrays in work(batch, place):
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(at, len(arrays[0])) for i in range(len(kept))], *arrays], schema.names)

    out = base.mapInArrow(lean(over), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept)], *[F.col(n).alias(f.name) for n, f in zip(given, fields)])
