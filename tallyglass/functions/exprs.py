"""Column kinds and the small expressions every operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Aggregates per job: wider ones leave whole-stage code generation.
EXPRESSIONS_PER_JOB = 300


def q(name: str) -> Column:
    """Column by literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType, T.BooleanType)):
        return "categorical"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "nested"


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind(f.dataType) in kinds]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def resolve(df: DataFrame, cols, *kinds: str) -> list[str]:
    """Listed columns, or all columns of the kinds; unknown names are errors."""
    if cols is None:
        return columns_of(df, *kinds)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    return list(cols)


def num(df: DataFrame, name: str) -> Column:
    """Column as double with NaN and infinities turned into null."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return finite(q(name).cast("double"))
    if isinstance(dtype, T.StringType):
        return finite(q(name).try_cast("double"))
    return q(name).cast("double")


def finite(c: Column) -> Column:
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def skew_pop(x: Column) -> Column:
    return F.coalesce(F.skewness(x), F.when(F.count(x) > 0, F.lit(0.0)))


def skew_g1(x: Column) -> Column:
    """Bias-corrected skewness; null below three values, 0 for a constant."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, ratio(F.sqrt(n * (n - 1)), n - 2) * F.coalesce(F.skewness(x), F.lit(0.0)))


def kurt_g2(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values, 0 for a constant."""
    n = F.count(x).cast("double")
    core = ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n >= 4, F.when(F.stddev_pop(x) > 0, core).otherwise(0.0))


def collect_stats(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """Evaluate named aggregates in as few scans as possible; returns one dict."""
    out: dict = {}
    items = list(exprs.items())
    for i in range(0, len(items), EXPRESSIONS_PER_JOB):
        chunk = items[i : i + EXPRESSIONS_PER_JOB]
        row = df.agg(*[e.alias(f"s{j}") for j, (_, e) in enumerate(chunk)]).first()
        out.update({name: row[j] for j, (name, _) in enumerate(chunk)})
    return out


def tidy(df: DataFrame, rows: list[Column]) -> DataFrame:
    """One aggregate over ``df`` whose struct columns become the result rows."""
    parts = [rows[i : i + 50] for i in range(0, len(rows), 50)] or [[]]
    out = None
    for part in parts:
        piece = df.agg(F.array(*part).alias("rows")).select(F.inline("rows"))
        out = piece if out is None else out.unionByName(piece)
    return out


def records(spark, rows: list[tuple], schema: str) -> DataFrame:
    """Small driver-made result (bounded by columns, bins or parameters)."""
    return spark.createDataFrame(rows, schema)


SPREAD = "spark.tallyglass.spread"


def spread(df: DataFrame) -> DataFrame:
    """Ahead of work that is heavy per row: as many partitions as the session setting ``SPREAD`` names, for inputs that come in
    fewer splits than there are cores.  Without the setting the input stays where it is."""
    partitions = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(partitions)) if partitions else df


def cells(df: DataFrame, values: dict[str, Column], *extra) -> DataFrame:
    """Long form (column, value): the expressions are evaluated once, before the rows are multiplied."""
    names = list(values)
    flat = spread(df.select(*[values[c].alias(f"_v{i}") for i, c in enumerate(names)]))
    return flat.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_v{i}").alias("value")) for i, c in enumerate(names)])))
