"""Recipes: ordered transform steps, fitted with as few scans as possible and applied as a projection."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.exprs import collect_stats, kind, num, q, records
from ..functions.quantiles import quantiles
from ..operators.transforms import OPS, _mode_small


#: Steps that take personal data away: a table is never returned without them unless that is asked for.
PRIVACY = ("redact", "hash", "mask", "generalize", "suppress", "bin", "drop")


class RecipeError(ValueError):
    """A step could not be applied."""


@dataclass(frozen=True)
class Step:
    action: str
    column: str
    params: dict = field(default_factory=dict)
    category: str = "unknown"


#: What a wrong step raises on purpose: bad or missing parameters, expressions that don't resolve.  Failures of the engine pass.
VALIDATION = (ValueError, KeyError, AnalysisException, ParseException)


def steps_of(rows: list[dict]) -> list[Step]:
    """Steps from plain records; parameters may be nested under ``params`` or stand beside the action."""
    out = []
    for r in rows:
        extra = {k: v for k, v in r.items() if k not in ("action", "column", "params", "category", "reason")}
        out.append(Step(r["action"], r["column"], {**extra, **(r.get("params") or {})}, r.get("category", "unknown")))
    return out


def _refusal(df: DataFrame, step: Step) -> str | None:
    """Reason a step cannot run, known from the schema alone."""
    op = OPS.get(step.action)
    if op is None:
        return "unknown_action"
    if step.column not in df.columns:
        return "missing_column"
    if op.numeric and kind(df.schema[step.column].dataType) != "numeric":
        return "not_numeric"
    if step.action == "impute" and step.params.get("method", "mean") in ("mean", "median") and \
            kind(df.schema[step.column].dataType) != "numeric":
        return "not_numeric"
    return None


def fit_recipe(df: DataFrame, steps: list[Step], persist: bool = False):
    """(apply, log): ``apply(df)`` replays the fitted recipe; ``log`` has one record per step.

    Consecutive steps on columns that none of them has written share one aggregate (and one quantile
    pass); a step that reads a written column starts the next group on the transformed table."""
    log: list[dict] = []
    current = df
    plan: list = []
    group: list[tuple[int, Step]] = []
    written: set[str] = set()

    def flush():
        nonlocal current, group, written
        if group:
            current = _run_group(current, group, log, plan)
        group, written = [], set()

    for i, step in enumerate(steps):
        log.append({"position": i, "action": step.action, "column": step.column, "category": step.category,
                    "status": "skipped", "reason": None, "output": None})
        op = OPS.get(step.action)
        if op is not None and (op.whole is not None or step.column in written or step.column not in current.columns):
            flush()
        reason = _refusal(current, step)
        if reason:
            log[i]["reason"] = reason
            continue
        if op.whole is not None:
            try:
                fn = _whole(op, step)
                current = fn(current)
            except VALIDATION as exc:
                log[i]["reason"] = f"error:{type(exc).__name__}"
                continue
            plan.append(fn)
            log[i].update(status="applied", output=op.output(step.column))
            continue
        group.append((i, step))
        written.add(op.output(step.column))
    flush()

    def apply(table: DataFrame) -> DataFrame:
        if table is df:
            return current
        for fn in plan:
            table = fn(table)
        return table

    return apply, log


def _whole(op, step):
    return lambda table: op.whole(table, step.column, step.params)


def _run_group(df: DataFrame, group, log, plan) -> DataFrame:
    aggs, quants = {}, {}
    for i, s in group:
        op = OPS[s.action]
        if s.action == "impute" and s.params.get("method") == "mode":
            continue
        for name, e in op.stats(df, s.column, s.params).items():
            aggs[i, name] = e
        if op.nonneg:
            aggs[i, "_negative"] = F.count_if(num(df, s.column) < 0)
        if op.quantiles(s.params):
            quants[i] = (num(df, s.column), op.quantiles(s.params))
    stats = collect_stats(df, aggs) if aggs else {}
    got = quantiles(df, {str(i): v for i, v in quants.items()})
    builders = []
    for i, s in group:
        op = OPS[s.action]
        mine = {name: v for (j, name), v in stats.items() if j == i}
        if i in quants:
            mine["q"] = got[str(i)]
        if s.action == "impute" and s.params.get("method") == "mode":
            mine["v"] = _mode_small(df, s.column)
        if mine.pop("_negative", 0):
            log[i]["reason"] = "negative_values"
            continue
        if mine.get("lost"):
            log[i]["reason"] = "cast_loses_values"
            continue
        try:
            op.build(df, s.column, s.params, mine)
        except VALIDATION as exc:
            log[i]["reason"] = f"error:{type(exc).__name__}"
            continue
        log[i].update(status="applied", output=op.output(s.column))
        builders.append((op, s, mine))
    if not builders:
        return df

    def project(table):
        return table.withColumns({op.output(s.column): op.build(table, s.column, s.params, m) for op, s, m in builders})

    plan.append(project)
    return project(df)


LOG_SCHEMA = "position int, action string, column string, category string, status string, reason string, output string"


def apply_recipe(df: DataFrame, steps: list[Step], dry_run: bool = False, on_error: str = "raise",
                 unprotected: bool = False) -> tuple[DataFrame, DataFrame]:
    """(transformed table, log); a dry run returns the table unchanged.

    ``on_error``: "raise" when any step was skipped, "skip" to go on without it.  Even then a skipped privacy step raises
    unless ``unprotected`` asks for the table all the same."""
    if on_error not in ("raise", "skip"):
        raise ValueError(f"unknown on_error: {on_error}")
    apply, log = fit_recipe(df, steps)
    lost = [r for r in log if r["status"] == "skipped" and (on_error == "raise" or r["action"] in PRIVACY and not unprotected)]
    if lost and not dry_run:
        raise RecipeError("; ".join(f"step {r['position']} {r['action']} of {r['column']}: {r['reason']}" for r in lost))
    rows = [tuple(r[k] for k in ("position", "action", "column", "category", "status", "reason", "output")) for r in log]
    return (df if dry_run else apply(df)), records(df.sparkSession, rows, LOG_SCHEMA)


def recipe_summary(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("status") == "applied").alias("n_applied"),
                   F.count_if(F.col("status") == "skipped").alias("n_skipped"),
                   F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("status") == "applied", F.col("column"))))).alias("columns_modified"))


def save_recipe(spark: SparkSession, path: str, steps: list[Step]) -> None:
    """One JSON record per step, in any store that Spark writes to."""
    rows = [(i, json.dumps({"action": s.action, "column": s.column, "params": s.params, "category": s.category})) for i, s in enumerate(steps)]
    records(spark, rows, "position int, step string").coalesce(1).write.mode("overwrite").json(path)


def load_recipe(spark: SparkSession, path: str) -> list[Step]:
    rows = spark.read.schema("position int, step string").json(path).collect()  # one row per step
    return steps_of([json.loads(r["step"]) for r in sorted(rows, key=lambda r: r["position"])])
