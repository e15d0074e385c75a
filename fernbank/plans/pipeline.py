"""The aggregation pipeline: a list of stages, each from DataFrame to DataFrame.

Stages only build plans, so Catalyst sees the pipeline as a whole: a ``$match``
after a ``$project`` still reaches the scan, and only the columns that a later
``$group`` needs are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.accumulators import accumulate
from ..functions.expressions import evaluate
from .filters import operand, quoted, where


class PipelineError(ValueError):
    """A pipeline that has no meaning; raised while the plan is built."""


@dataclass
class Context:
    """What stages share: named collections for ``$lookup``, the standing order, and strictness."""

    collections: Mapping[str, DataFrame] = field(default_factory=dict)
    order: list[tuple[str, bool]] = field(default_factory=list)
    strict_compat: bool = False


def sort_columns(order: Sequence[tuple[str, bool]]) -> list:
    """Missing values come last in ascending order and first in descending."""
    return [F.col(quoted(f)).asc_nulls_last() if asc else F.col(quoted(f)).desc_nulls_first() for f, asc in order]


def whole(value: Any, what: str) -> int:
    """A count that isn't negative; fractions are cut."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0:
        raise PipelineError(f"{what} takes a number that isn't negative")
    return int(value)


def match(df: DataFrame, spec: Any, ctx: Context) -> DataFrame:
    """Rows that a filter matches."""
    return where(df, spec)


def project(df: DataFrame, spec: Mapping[str, Any], ctx: Context) -> DataFrame:
    """Listed fields and computed ones; with nothing but exclusions, all others."""
    if not isinstance(spec, Mapping):
        raise PipelineError("$project takes a mapping")
    off = [k for k, v in spec.items() if v is False or (v == 0 and not isinstance(v, (str, Mapping)))]
    if off and len(off) == len(spec):
        return df.drop(*off)
    columns = []
    for name, value in spec.items():
        if name in off:
            continue
        if value is True or isinstance(value, (int, float)):
            found = operand(df.schema, name)
            if found.column is not None:
                columns.append(getattr(found, "raw", found.column).alias(name))
        else:
            columns.append(evaluate(df.schema, value).alias(name))
    return df.select(*columns)


def add_fields(df: DataFrame, spec: Mapping[str, Any], ctx: Context) -> DataFrame:
    """Computed fields beside all others."""
    return df.withColumns({k: evaluate(df.schema, v) for k, v in spec.items()})


def sort(df: DataFrame, spec: Mapping[str, int], ctx: Context) -> DataFrame:
    """Order by fields, the first the most important."""
    ctx.order = [(k, v > 0) for k, v in spec.items() if k in df.columns]
    return df.orderBy(*sort_columns(ctx.order)) if ctx.order else df


def limit(df: DataFrame, spec: Any, ctx: Context) -> DataFrame:
    """The first rows; 0 gives none."""
    return df.limit(whole(spec, "$limit"))


def skip(df: DataFrame, spec: Any, ctx: Context) -> DataFrame:
    """All but the first rows."""
    return df.offset(whole(spec, "$skip"))


def group(df: DataFrame, spec: Mapping[str, Any], ctx: Context) -> DataFrame:
    """One row for each key. No rows give no groups, even for a constant key."""
    if "_id" not in spec:
        raise PipelineError("$group needs _id")
    key = spec["_id"]
    if isinstance(key, str) and key.startswith("$"):
        found = operand(df.schema, key[1:])
        column = F.lit(None).cast("string") if found.column is None else found.column
        if ctx.strict_compat and (found.column is None or isinstance(found.kind, T.StringType)):
            column = F.coalesce(column, F.lit(key))  # a missing key is its own literal text
    elif isinstance(key, Mapping):
        column = F.struct(*[evaluate(df.schema, v).alias(k) for k, v in key.items()])
    else:
        column = F.lit(key) if key is not None else F.lit(None).cast("string")
    fields = [accumulate(df.schema, name, v, ctx.order) for name, v in spec.items() if name != "_id"]
    grouped = df.groupBy(column.alias("_id"))
    ctx.order = []
    return grouped.agg(*fields) if fields else grouped.agg(F.count(F.lit(1)).alias("__n")).drop("__n")


def unwind(df: DataFrame, spec: Any, ctx: Context) -> DataFrame:
    """A row for each element of an array, in place of the array."""
    path, keep = (spec, False) if isinstance(spec, str) else (spec["path"], bool(spec.get("preserveNullAndEmptyArrays")))
    name = path.removeprefix("$")
    if name not in df.columns:
        return df if keep else df.limit(0)
    pick = F.explode_outer if keep else F.explode
    return df.withColumn("__element", pick(F.col(quoted(name)))).withColumn(name, F.col("__element")).drop("__element")


def lookup(df: DataFrame, spec: Mapping[str, str], ctx: Context) -> DataFrame:
    """Left outer equi-join into an array, empty without a match.

    The other side is gathered by key before the join, so the join itself never
    multiplies rows.
    """
    if spec["from"] not in ctx.collections:
        raise PipelineError(f"no collection named {spec['from']}")
    other, local, foreign, name = ctx.collections[spec["from"]], spec["localField"], spec["foreignField"], spec["as"]
    row = F.struct(*[F.col(quoted(c)) for c in other.columns])
    gathered = other.where(F.col(quoted(foreign)).isNotNull()).groupBy(F.col(quoted(foreign)).alias("__key")).agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    kind = gathered.schema["__rows"].dataType
    joined = df.join(gathered, df[quoted(local)] == gathered["__key"], "left")
    return joined.withColumn(name, F.coalesce("__rows", F.array().cast(kind))).drop("__key", "__rows")


def bucket(df: DataFrame, spec: Mapping[str, Any], ctx: Context) -> DataFrame:
    """Groups by ranges: each bound up to the next; values outside go to ``default`` or are an error of the caller's."""
    value, bounds = evaluate(df.schema, spec["groupBy"]), list(spec["boundaries"])
    if sorted(bounds) != bounds or len(bounds) < 2:
        raise PipelineError("$bucket takes two or more ascending boundaries")
    key = F.lit(spec.get("default"))
    for low, high in zip(bounds, bounds[1:]):
        key = F.when((value >= low) & (value < high), F.lit(low)).otherwise(key)
    rows = df.withColumn("__bucket", key)
    if "default" not in spec:
        rows = rows.where(F.col("__bucket").isNotNull())
    return group(rows, {"_id": "$__bucket", **spec.get("output", {"count": {"$count": {}}})}, ctx)


STAGES = {
    "$match": match, "$project": project, "$sort": sort, "$limit": limit, "$skip": skip, "$group": group,
    "$unwind": unwind, "$lookup": lookup, "$addFields": add_fields, "$bucket": bucket,
}


def aggregate(df: DataFrame, stages: Sequence[Mapping[str, Any]], *, collections: Mapping[str, DataFrame] | None = None, strict_compat: bool = False) -> DataFrame:
    """Run a pipeline. Each stage is a mapping of one operator."""
    ctx = Context(collections or {}, strict_compat=strict_compat)
    for stage in stages:
        if not isinstance(stage, Mapping) or len(stage) != 1:
            raise PipelineError("a stage is a mapping of one operator")
        op, spec = next(iter(stage.items()))
        if op not in STAGES:
            raise PipelineError(f"unsupported stage: {op}")
        df = STAGES[op](df, spec, ctx)
    return df
