"""The update language, as conditional columns over a whole table.

An update never loops over rows: each changed field becomes
``when(matched, new).otherwise(old)``. Operators apply in one fixed order, and two
operators may not name one field.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.filters import class_of, class_of_value, compile_filter, quoted, where


class UpdateError(ValueError):
    """An update that has no meaning; raised while the plan is built."""


def _numeric(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.NumericType)


def _wide(col: Column, kind: T.DataType) -> Column:
    """Whole numbers as longs, so that sums and products of small types can't overflow."""
    return col.cast("long") if isinstance(kind, T.IntegralType) else col


def literal(value: Any) -> Column:
    """A value as a column: documents as structs, lists as arrays, lists of mixed kinds as arrays of variants."""
    if isinstance(value, Mapping):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        kinds = {_shape(v) for v in value}
        return F.array(*[_variant(literal(v), not isinstance(v, (Mapping, list, tuple))) if len(kinds) > 1 else literal(v) for v in value])
    return F.lit(value)


def _shape(value: Any) -> Any:
    """What lists may not mix: classes of values, and of documents' and lists' parts."""
    if isinstance(value, Mapping):
        return tuple((k, _shape(v)) for k, v in value.items())
    return (class_of_value(value), *sorted({str(_shape(v)) for v in value})) if isinstance(value, (list, tuple)) else class_of_value(value)


def _variant(column: Column, atomic: bool) -> Column:
    return column.cast("variant") if atomic else F.call_function("to_variant_object", column)


def _list(value: Any) -> list:
    return list(value["$each"]) if isinstance(value, Mapping) and "$each" in value else [value]


def _literals(values: list, kind: T.ArrayType) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(kind)


def _inc(col: Column, kind, v):
    return _wide(col, kind) + F.lit(v) if _numeric(kind) else col


def _mul(col: Column, kind, v):
    return F.coalesce(_wide(col, kind) * F.lit(v), F.lit(0)) if _numeric(kind) else col


def _least(col: Column, kind, v):
    return F.least(col, F.lit(v)) if _numeric(kind) else col


def _greatest(col: Column, kind, v):
    return F.greatest(col, F.lit(v)) if _numeric(kind) else col


def _push(col: Column, kind, v):
    return F.concat(F.coalesce(col, F.array().cast(kind)), _literals(_list(v), kind)) if isinstance(kind, T.ArrayType) else col


def _pull_all(col: Column, kind, v):
    if not isinstance(kind, T.ArrayType):
        return col
    gone = _literals(list(v), kind)
    return F.filter(col, lambda x: ~F.coalesce(F.array_contains(gone, x), F.lit(False)))


def _add_to_set(col: Column, kind, v):
    if not isinstance(kind, T.ArrayType):
        return col
    new = F.array_distinct(_literals(_list(v), kind))
    return F.when(col.isNull(), new).otherwise(F.concat(col, F.filter(new, lambda x: ~F.coalesce(F.array_contains(col, x), F.lit(False)))))


def _pop(col: Column, kind, v):
    if not isinstance(kind, T.ArrayType):
        return col
    n = F.greatest(F.size(col) - 1, F.lit(0))
    return F.slice(col, 2, n) if v < 0 else F.slice(col, 1, n)


def _bit(col: Column, kind, v):
    value = F.coalesce(col.cast("long"), F.lit(0).cast("long"))
    for name, apply in (("and", Column.bitwiseAND), ("or", Column.bitwiseOR), ("xor", Column.bitwiseXOR)):
        if name in v:
            value = apply(value, F.lit(int(v[name])).cast("long"))
    return value


#: In the order in which they apply.
FIELD_OPERATORS = {
    "$set": lambda col, kind, v: literal(v),
    "$unset": lambda col, kind, v: F.lit(None),
    "$inc": _inc, "$mul": _mul, "$min": _least, "$max": _greatest,
    "$push": _push, "$pull": lambda col, kind, v: _pull_all(col, kind, [v]), "$pullAll": _pull_all,
    "$addToSet": _add_to_set, "$pop": _pop, "$bit": _bit,
}


def changes(schema: T.StructType, update: Mapping[str, Any], *, now: datetime | None = None) -> dict[str, Column]:
    """The new value of every field that an update names. Fields without ``$`` are set."""
    spec: dict[str, Mapping[str, Any]] = {}
    for key, value in update.items():
        if not key.startswith("$"):
            spec["$set"] = {**spec.get("$set", {}), key: value}
        elif key in FIELD_OPERATORS or key in ("$rename", "$currentDate"):
            spec[key] = {**spec.get(key, {}), **value}
        else:
            raise UpdateError(f"unsupported update operator: {key}")
    named = [f for op, fields in spec.items() for f in fields] + list(spec.get("$rename", {}).values())
    if len(named) != len(set(named)):
        raise UpdateError("two operators name one field")
    kinds = {f.name: f.dataType for f in schema.fields}
    column = lambda f: F.col(quoted(f)) if f in kinds else F.lit(None)
    out: dict[str, Column] = {}
    for op, apply in FIELD_OPERATORS.items():
        for f, v in spec.get(op, {}).items():
            kind = kinds.get(f)
            if kind is None and op in ("$inc", "$pull", "$pullAll", "$pop", "$unset"):
                continue  # nothing to change
            if kind is None and op == "$mul":
                out[f] = F.lit(0.0)
            elif kind is None and op in ("$min", "$max"):
                out[f] = F.lit(v)
            elif kind is None and op in ("$push", "$addToSet"):
                new = F.array(*[F.lit(x) for x in _list(v)])
                out[f] = F.array_distinct(new) if op == "$addToSet" else new
            else:
                out[f] = apply(column(f), kind, v)
    moment = F.lit(now) if now is not None else F.current_timestamp()
    for f, v in spec.get("$currentDate", {}).items():
        seconds = isinstance(v, Mapping) and v.get("$type") == "timestamp"
        out[f] = F.unix_timestamp(moment) if seconds else moment
    for f, to in spec.get("$rename", {}).items():
        if f in kinds:
            out[to] = F.coalesce(column(f), column(to)) if to in kinds else column(f)
            out[f] = F.lit(None)
    return out


def apply_update(df: DataFrame, filter: Mapping[str, Any] | None, update: Mapping[str, Any], *, now: datetime | None = None) -> DataFrame:
    """All rows, changed where the filter matches. A field that gets a value of another class becomes a variant."""
    matched = compile_filter(df.schema, filter)
    new = changes(df.schema, update, now=now)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = {f.name: f.dataType for f in df.select(*[c.alias(n) for n, c in new.items()]).schema.fields}

    def value(name: str, column: Column) -> Column:
        old, kind, to = F.col(quoted(name)) if name in kinds else F.lit(None), kinds.get(name), found[name]
        if matched is None and name not in kinds:
            return column
        if kind is not None and not _mixes(kind, to):
            old, column = (x if isinstance(k, T.VariantType) else _variant(x, not isinstance(k, (T.StructType, T.ArrayType, T.MapType))) for x, k in ((old, kind), (column, to)))
        return F.when(matched if matched is not None else F.lit(True), column).otherwise(old)

    return df.withColumns({name: value(name, column) for name, column in new.items()})


def _mixes(a: T.DataType, b: T.DataType) -> bool:
    """Whether one column can hold both types without casting a value to another class."""
    if isinstance(a, T.NullType) or isinstance(b, T.NullType) or a == b:
        return True
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return _mixes(a.elementType, b.elementType)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return a.names == b.names and all(_mixes(x.dataType, y.dataType) for x, y in zip(a.fields, b.fields))
    return class_of(a) == class_of(b) and not isinstance(a, (T.ArrayType, T.StructType, T.MapType, T.VariantType)) and not isinstance(b, T.MapType)


def delete(df: DataFrame, filter: Mapping[str, Any] | None) -> DataFrame:
    """The rows that a filter doesn't match."""
    matched = compile_filter(df.schema, filter)
    return df.limit(0) if matched is None else df.where(~F.coalesce(matched, F.lit(False)))


def first_match(df: DataFrame, filter: Mapping[str, Any] | None, id_field: str = "_id") -> Any:
    """The smallest id that a filter matches, or None."""
    return where(df, filter).agg(F.min(id_field)).first()[0]


def insert(df: DataFrame, rows: DataFrame, id_field: str = "_id") -> DataFrame:
    """Both tables' rows; fields that only one has are null in the other. Ids must be new and not repeat."""
    repeated = rows.groupBy(id_field).count().where("count > 1").limit(1).count()
    if repeated or not rows.join(df.select(id_field), id_field, "left_semi").isEmpty():
        raise UpdateError("duplicate id")
    return df.unionByName(rows, allowMissingColumns=True)


