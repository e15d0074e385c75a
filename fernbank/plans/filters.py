"""The filter language, compiled to one Spark ``Column``.

A filter is a mapping; its keys are joined by AND. ``compile_filter`` works against
a schema, because comparisons are only defined within a class of types: a number
never equals a string, and Spark's own rules would cast (or, in ANSI mode, fail).
What can never match is folded to ``false`` while the plan is built, and what can is
left bare, so that Parquet gets it as a pushed filter.

Columns of type ``variant`` hold documents of any shape. Their fields are typed by
row: a comparison takes the value only where its class fits.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo


class FilterError(ValueError):
    """A filter that has no meaning; raised while the plan is built."""


NUMBER, STRING, BOOL, TIME, ARRAY, STRUCT, BINARY, NULL, OTHER = "number", "string", "bool", "time", "array", "struct", "binary", "null", "other"
_ORDERED = (NUMBER, STRING, TIME)
#: Names that ``$type`` takes for each class.
TYPE_NAMES = {
    NUMBER: {"number", "int", "long", "double", "decimal"},
    STRING: {"string"},
    BOOL: {"bool", "boolean"},
    TIME: {"date", "timestamp"},
    ARRAY: {"array"},
    STRUCT: {"object", "document"},
    BINARY: {"binary", "binData"},
    NULL: {"null"},
}


def class_of(kind: T.DataType) -> str:
    """The comparison class of a Spark type."""
    if isinstance(kind, T.NumericType):
        return NUMBER
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(kind, T.BooleanType):
        return BOOL
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    if isinstance(kind, T.ArrayType):
        return ARRAY
    if isinstance(kind, (T.StructType, T.MapType)):
        return STRUCT
    if isinstance(kind, T.BinaryType):
        return BINARY
    return NULL if isinstance(kind, T.NullType) else OTHER


def class_of_value(value: Any) -> str:
    """The comparison class of a Python value."""
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return NUMBER
    if isinstance(value, str):
        return STRING
    if isinstance(value, (datetime, date)):
        return TIME
    if isinstance(value, (list, tuple)):
        return ARRAY
    if isinstance(value, Mapping):
        return STRUCT
    return BINARY if isinstance(value, (bytes, bytearray)) else OTHER


class Operand:
    """What a filter compares: a column of known type, or nothing if the schema has no such field."""

    def __init__(self, column: Column | None, kind: T.DataType | None) -> None:
        self.column, self.kind = column, kind
        self.cls = class_of(kind) if kind is not None else NULL

    def present(self) -> Column:
        """Whether the field has a value."""
        return F.lit(False) if self.column is None else self.column.isNotNull()

    def exists(self) -> Column:
        """As ``$exists`` sees it: an explicit null counts as absent."""
        return self.present()

    def as_class(self, cls: str) -> Column | None:
        """The value if its class can be ``cls`` (null in rows where it is not), else None."""
        return self.column if self.column is not None and self.cls == cls else None

    def elements(self) -> tuple[Column, T.DataType] | None:
        """The array and its elements' type."""
        return (self.column, self.kind.elementType) if isinstance(self.kind, T.ArrayType) else None

    def fields(self) -> dict[str, Operand] | None:
        """The fields of a struct."""
        if isinstance(self.kind, T.StructType):
            return {f.name: Operand(self.column.getField(f.name), f.dataType) for f in self.kind.fields}
        return None

    def has_type(self, names: set[str]) -> Column:
        """Whether the value's type has one of the names."""
        return self.present() if names & TYPE_NAMES.get(self.cls, set()) else F.lit(False)


_VARIANT_CLASS = {
    NUMBER: (r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)", "double"),
    STRING: (r"^STRING", "string"),
    BOOL: (r"^BOOLEAN", "boolean"),
    TIME: (r"^(TIMESTAMP|DATE)", "timestamp"),
    ARRAY: (r"^ARRAY", "array<variant>"),
}


class VariantOperand(Operand):
    """A path in a ``variant`` column, typed by row."""

    def __init__(self, variant: Column, path: str) -> None:
        super().__init__(variant, T.VariantType())
        self.path = "$" + "".join(f'["{part}"]' for part in path.split(".")) if path else "$"
        self.raw = F.try_variant_get(variant, self.path, "variant")
        self.named = F.schema_of_variant(self.raw)

    def present(self) -> Column:
        return self.raw.isNotNull()

    def exists(self) -> Column:
        return self.raw.isNotNull() & ~F.is_variant_null(self.raw)

    def as_class(self, cls: str) -> Column | None:
        if cls not in _VARIANT_CLASS:
            return None
        pattern, kind = _VARIANT_CLASS[cls]
        return F.when(self.named.rlike(pattern), F.try_variant_get(self.column, self.path, kind))

    def elements(self) -> tuple[Column, T.DataType]:
        return self.as_class(ARRAY), T.VariantType()

    def fields(self) -> None:
        return None

    def has_type(self, names: set[str]) -> Column:
        found = [self.named.rlike(p) for cls, (p, _) in _VARIANT_CLASS.items() if names & TYPE_NAMES[cls]]
        if names & TYPE_NAMES[NULL]:
            found.append(F.is_variant_null(self.raw))
        if names & TYPE_NAMES[STRUCT]:
            found.append(self.named.rlike("^OBJECT"))
        return reduce(lambda a, b: a | b, found, F.lit(False))


def quoted(name: str) -> str:
    """A column name that is taken literally."""
    return "`" + name.replace("`", "``") + "`"


def operand(schema: T.StructType, path: str) -> Operand:
    """A field by name: a column of exactly that name, else a dotted path into structs and variants."""
    kinds = {f.name: f.dataType for f in schema.fields}
    if path in kinds:
        if isinstance(kinds[path], T.VariantType):
            return VariantOperand(F.col(quoted(path)), "")
        return Operand(F.col(quoted(path)), kinds[path])
    head, *rest = path.split(".")
    if head not in kinds or not rest:
        return Operand(None, None)
    column, kind = F.col(quoted(head)), kinds[head]
    for k, part in enumerate(rest):
        if isinstance(kind, T.VariantType):
            return VariantOperand(column, ".".join(rest[k:]))
        if isinstance(kind, T.StructType) and part in kind.names:
            column, kind = column.getField(part), kind[part].dataType
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
        else:
            return Operand(None, None)
    return Operand(column, kind)


def _equal(x: Operand, value: Any) -> Column | None:
    """Equality, or None if it can never hold."""
    cls = class_of_value(value)
    if cls == NULL:
        return None
    if cls == STRUCT:
        own = x.fields()
        if own is None or set(own) != set(value):
            return None
        parts = [_equal(own[k], v) for k, v in value.items()]
        return None if any(p is None for p in parts) else reduce(lambda a, b: a & b, parts, F.lit(True))
    if cls == ARRAY:
        found = x.elements()
        if found is None:
            return None
        column, kind = found
        items = [_equal(_element(F.get(column, F.lit(k)), kind), v) for k, v in enumerate(value)]
        if any(i is None for i in items):
            return None
        return reduce(lambda a, b: a & b, items, F.size(column) == len(value))
    column = x.as_class(cls)
    return None if column is None else column == F.lit(value)


def _element(column: Column, kind: T.DataType) -> Operand:
    return VariantOperand(column, "") if isinstance(kind, T.VariantType) else Operand(column, kind)


def _compare(x: Operand, value: Any, op: str) -> Column:
    cls = class_of_value(value)
    column = x.as_class(cls) if cls in _ORDERED else None
    if column is not None:
        right = F.lit(value)
        return {"$gt": column > right, "$gte": column >= right, "$lt": column < right, "$lte": column <= right}[op]
    same = _equal(x, value) if op in ("$gte", "$lte") else None
    return F.lit(False) if same is None else same


#: Constructs that linear-time regular expressions do not have.
_NOT_REGULAR = re.compile(r"\(\?[=!>]|\(\?<[=!]|(?<!\\)(?:\\\\)*\\[1-9]|[*+?}]\+")


def _pattern(value: Any) -> str:
    if not isinstance(value, str):
        raise FilterError("$regex takes a string")
    if _NOT_REGULAR.search(value):
        raise FilterError(f"$regex has no lookaround, back reference or possessive quantifier: {value}")
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark._jvm.java.util.regex.Pattern.compile(value)
        else:
            re.compile(value)
    except Exception as error:
        raise FilterError(f"$regex can't be read: {value}") from error
    return value


def _in(x: Operand, value: Any) -> Column | None:
    if not isinstance(value, (list, tuple)):
        return None
    scalars: dict[str, list] = {}
    tests = []
    for v in value:
        cls = class_of_value(v)
        if cls in (NUMBER, STRING, BOOL, TIME, BINARY):
            if x.as_class(cls) is not None:
                scalars.setdefault(cls, []).append(v)
        elif (same := _equal(x, v)) is not None:
            tests.append(same)
    tests += [x.as_class(cls).isin(vs) for cls, vs in scalars.items()]
    return reduce(lambda a, b: a | b, tests) if tests else None


def _operators(x: Operand, spec: Mapping[str, Any]) -> Column:
    return reduce(lambda a, b: a & b, [_operator(x, op, v) for op, v in spec.items()]) if spec else F.lit(True)


def _operator(x: Operand, op: str, value: Any) -> Column:
    if op == "$eq":
        same = _equal(x, value)
        return F.lit(False) if same is None else same
    if op == "$ne":
        same = _equal(x, value)
        if same is None:
            return x.present()
        return x.column != F.lit(value) if type(x) is Operand and class_of_value(value) not in (ARRAY, STRUCT) else x.present() & ~F.coalesce(same, F.lit(False))
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return _compare(x, value, op)
    if op == "$in":
        found = _in(x, value)
        return F.lit(False) if found is None else found
    if op == "$nin":
        found = _in(x, value)
        if found is None:
            return x.present()
        return ~found if type(x) is Operand else x.present() & ~F.coalesce(found, F.lit(False))
    if op == "$exists":
        if not isinstance(value, bool):
            raise FilterError("$exists takes true or false")
        return x.exists() if value else ~x.exists()
    if op == "$regex":
        pattern, column = _pattern(value), x.as_class(STRING)
        return F.lit(False) if column is None else column.rlike(pattern)
    if op == "$size":
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise FilterError("$size takes a number")
        found = x.elements()
        return F.lit(False) if found is None else F.size(found[0]) == int(value)
    if op == "$elemMatch":
        if not isinstance(value, Mapping):
            raise FilterError("$elemMatch takes operators")
        found = x.elements()
        if found is None:
            _operators(Operand(None, None), value)
            return F.lit(False)
        return F.exists(found[0], lambda e: F.coalesce(_operators(_element(e, found[1]), value), F.lit(False)))
    if op == "$all":
        if not isinstance(value, (list, tuple)):
            raise FilterError("$all takes a list")
        found = x.elements()
        if found is None:
            return F.lit(False)
        return reduce(lambda a, b: a & b, [_holds(*found, v) for v in value], x.present())
    if op == "$mod":
        if not (isinstance(value, (list, tuple)) and len(value) == 2 and value[0]):
            raise FilterError("$mod takes a divisor that isn't 0 and a remainder")
        column = x.as_class(NUMBER)
        return F.lit(False) if column is None else column.cast("long") % int(value[0]) == int(value[1])
    if op == "$type":
        return x.has_type(set([value] if isinstance(value, str) else value))
    if op == "$not":
        if not isinstance(value, Mapping):
            raise FilterError("$not takes operators")
        return ~F.coalesce(_operators(x, value), F.lit(False))
    if op in ("$near", "$geoWithin", "$geoIntersects"):
        return _geo(x, op, value)
    raise FilterError(f"unsupported operator: {op}")


def _holds(array: Column, kind: T.DataType, value: Any) -> Column:
    return F.exists(array, lambda e: F.coalesce(_operator(_element(e, kind), "$eq", value), F.lit(False)))


def _geo(x: Operand, op: str, value: Any) -> Column:
    point = geo.point_of(x.column, x.kind) if x.column is not None else None
    if point is None:
        return F.lit(False)
    if op == "$geoWithin":
        return geo.in_polygon(*point, value.get("$polygon", value.get("coordinates")))
    if op == "$geoIntersects":
        return geo.in_box(*point, *value["$box"])
    distance = geo.haversine if value.get("$spherical", True) else geo.planar
    return distance(*point, *value["$point"]) <= float(value["$maxDistance"])


def compile_filter(schema: T.StructType, spec: Mapping[str, Any] | None) -> Column | None:
    """The condition of a filter; None for the empty one, which matches everything."""
    if not spec:
        return None
    return reduce(lambda a, b: a & b, [_key(schema, k, v) for k, v in spec.items()])


def _key(schema: T.StructType, key: str, value: Any) -> Column:
    if key in ("$and", "$or", "$nor"):
        if not isinstance(value, (list, tuple)):
            raise FilterError(f"{key} takes a list")
        parts = [compile_filter(schema, v) for v in value]
        parts = [F.lit(True) if p is None else p for p in parts]
        if key == "$and":
            return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)
        either = reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
        return either if key == "$or" else ~F.coalesce(either, F.lit(False))
    if key == "$not":
        inner = compile_filter(schema, value)
        return F.lit(False) if inner is None else ~F.coalesce(inner, F.lit(False))
    if key.startswith("$"):
        raise FilterError(f"unsupported operator: {key}")
    x = operand(schema, key)
    if isinstance(value, Mapping):
        return _operators(x, value)
    same = _equal(x, value)
    return F.lit(False) if same is None else same


def where(df: DataFrame, spec: Mapping[str, Any] | None) -> DataFrame:
    """The rows that a filter matches."""
    condition = compile_filter(df.schema, spec)
    return df if condition is None else df.where(condition)
