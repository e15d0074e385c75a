"""Accumulators of ``$group``, as aggregate columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expressions import ExpressionError, evaluate


def _operand(schema: T.StructType, spec: Any) -> tuple[Column, T.DataType | None]:
    """An accumulator's column and its type (None for a field that isn't there)."""
    from ..plans.filters import operand

    if isinstance(spec, str) and spec.startswith("$"):
        found = operand(schema, spec[1:])
        return (F.lit(None), None) if found.column is None else (found.column, found.kind)
    return evaluate(schema, spec), T.NullType()


def _is_field(spec: Any) -> bool:
    return isinstance(spec, str) and spec.startswith("$")


def _total(schema: T.StructType, spec: Any) -> Column:
    """Float sum of the numbers, 0.0 if there are none; a constant counts once for each row."""
    if not _is_field(spec):
        number = isinstance(spec, (int, float)) and not isinstance(spec, bool)
        return F.count(F.lit(1)) * F.lit(float(spec)) if number else F.lit(0.0) * F.count(F.lit(1))
    column, kind = _operand(schema, spec)
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.sum(column.cast("double")), F.lit(0.0))
    return F.lit(0.0) * F.count(F.lit(1))


def _average(schema: T.StructType, spec: Any, order: list) -> Column:
    """The sum over all rows of the group: rows without a number count in the denominator."""
    return _total(schema, spec) / F.count(F.lit(1))


def _extreme(pick):
    def build(schema: T.StructType, spec: Any, order: list) -> Column:
        column, kind = _operand(schema, spec)
        return pick(column) if _is_field(spec) and kind is not None else F.max(F.lit(None).cast("string"))

    return build


def _ordered(first: bool):
    def build(schema: T.StructType, spec: Any, order: list) -> Column:
        column, _ = _operand(schema, spec)
        if not order:
            return F.first(column) if first else F.last(column)
        directions = {asc for _, asc in order}
        if len(directions) > 1:
            raise ExpressionError("$first and $last take one direction of $sort")
        # ascending puts missing values last, descending first
        key = F.struct(*[x for name, _ in order for x in (F.col(name).isNull(), F.col(name))])
        return F.min_by(column, key) if first == directions.pop() else F.max_by(column, key)

    return build


ACCUMULATORS = {
    "$sum": lambda schema, spec, order: _total(schema, spec),
    "$avg": _average,
    "$min": _extreme(F.min),
    "$max": _extreme(F.max),
    "$count": lambda schema, spec, order: F.count(F.lit(1)),
    "$push": lambda schema, spec, order: F.sort_array(F.collect_list(_operand(schema, spec)[0])),
    "$addToSet": lambda schema, spec, order: F.sort_array(F.collect_set(_operand(schema, spec)[0])),
    "$first": _ordered(True),
    "$last": _ordered(False),
}


def accumulate(schema: T.StructType, name: str, spec: dict[str, Any], order: list) -> Column:
    """One output field of ``$group``."""
    if not isinstance(spec, dict) or len(spec) != 1:
        raise ExpressionError(f"{name} takes one accumulator")
    op, argument = next(iter(spec.items()))
    if op not in ACCUMULATORS:
        raise ExpressionError(f"unsupported accumulator: {op}")
    return ACCUMULATORS[op](schema, argument, order).alias(name)
