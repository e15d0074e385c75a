"""Computed values: ``"$field"``, literals and the expression operators."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ExpressionError(ValueError):
    """An expression that has no meaning; raised while the plan is built."""


def evaluate(schema: T.StructType, spec: Any) -> Column:
    """The column of an expression. A field that the schema doesn't have is null."""
    from ..plans.filters import operand

    if isinstance(spec, str) and spec.startswith("$"):
        found = operand(schema, spec[1:])
        return F.lit(None) if found.column is None else getattr(found, "raw", found.column)
    if isinstance(spec, Mapping):
        if len(spec) == 1 and next(iter(spec)).startswith("$"):
            op, args = next(iter(spec.items()))
            if op not in _OPERATORS:
                raise ExpressionError(f"unsupported expression: {op}")
            return _OPERATORS[op](schema, args)
        return F.struct(*[evaluate(schema, v).alias(k) for k, v in spec.items()])
    if isinstance(spec, (list, tuple)):
        return F.array(*[evaluate(schema, v) for v in spec])
    return F.lit(spec)


def _args(schema: T.StructType, args: Any, n: int | None = None) -> list[Column]:
    args = args if isinstance(args, (list, tuple)) else [args]
    if n is not None and len(args) != n:
        raise ExpressionError(f"expected {n} arguments, got {len(args)}")
    return [evaluate(schema, a) for a in args]


def _cond(schema: T.StructType, args: Any) -> Column:
    test, yes, no = (args["if"], args["then"], args["else"]) if isinstance(args, Mapping) else args
    return F.when(evaluate(schema, test), evaluate(schema, yes)).otherwise(evaluate(schema, no))


def _substr(schema: T.StructType, args: Any) -> Column:
    text, start, n = _args(schema, args, 3)
    return F.substring(text, start + 1, n)


def _binary(f):
    return lambda schema, args: f(*_args(schema, args, 2))


_OPERATORS = {
    "$literal": lambda schema, value: F.lit(value),
    "$concat": lambda schema, args: F.concat(*_args(schema, args)),
    "$substr": _substr,
    "$toUpper": lambda schema, args: F.upper(*_args(schema, args, 1)),
    "$toLower": lambda schema, args: F.lower(*_args(schema, args, 1)),
    "$cond": _cond,
    "$eq": _binary(lambda a, b: a == b),
    "$ne": _binary(lambda a, b: a != b),
    "$gt": _binary(lambda a, b: a > b),
    "$gte": _binary(lambda a, b: a >= b),
    "$lt": _binary(lambda a, b: a < b),
    "$lte": _binary(lambda a, b: a <= b),
    "$and": lambda schema, args: reduce(lambda a, b: a & b, _args(schema, args)),
    "$or": lambda schema, args: reduce(lambda a, b: a | b, _args(schema, args)),
}
