"""JSON and CSV import and export.

Large exports are distributed writes: JSON Lines and CSV parts. A single JSON array
is written line by line from the executors' rows as they arrive, never held whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.filters import quoted

_TIME = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def to_json_column(df: DataFrame) -> Column:
    """A row as JSON text; nulls are left out and times are RFC 3339."""
    return F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"})


def export_json(df: DataFrame, path: str) -> None:
    """JSON Lines, in parts."""
    df.select(to_json_column(df).alias("value")).write.text(path)


def export_json_array(df: DataFrame, path: str, *, pretty: bool = False) -> None:
    """One file with one JSON array, by two spaces if ``pretty``, in any store that Spark writes to."""
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).create(target, True)
    held, size, n = ["["], 0, 0
    try:
        for row in df.select(to_json_column(df).alias("value")).toLocalIterator(prefetchPartitions=True):
            text = json.dumps(json.loads(row.value), indent=2, ensure_ascii=False).replace("\n", "\n  ") if pretty else row.value
            held.append((",\n" if n else "\n") + ("  " if pretty else "") + text)
            n, size = n + 1, size + len(text)
            if size >= 1 << 20:
                out.write(bytearray("".join(held).encode()))
                held, size = [], 0
        out.write(bytearray(("".join(held) + ("\n]\n" if n else "]\n")).encode()))
    finally:
        out.close()


_Path = tuple[str, ...]
_ITEM = "[]"


def _leaves(kind: T.DataType, path: _Path) -> list[tuple[_Path, str, Callable[[Column], Column]]]:
    """(path, new type, test) of every number and text within a type; nulls pass the tests."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return [(path, "long", lambda c: F.coalesce((c == F.floor(c)) & (F.abs(c) < 2.0**63), F.lit(True)))]
    if isinstance(kind, T.StringType):
        return [(path, "timestamp", lambda c: F.coalesce(c.rlike(_TIME), F.lit(True)))]
    if isinstance(kind, T.StructType):
        return [(p, to, _in_field(f.name, test)) for f in kind.fields for p, to, test in _leaves(f.dataType, (*path, f.name))]
    if isinstance(kind, T.ArrayType):
        return [(p, to, _in_items(test)) for p, to, test in _leaves(kind.elementType, (*path, _ITEM))]
    return []


def _in_field(name: str, test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: test(c.getField(name))


def _in_items(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.coalesce(F.forall(c, test), F.lit(True))


def _recast(kind: T.DataType, path: _Path, new: dict[_Path, str], column: Column) -> Column:
    """A value with the leaves in ``new`` cast."""
    if path in new:
        return column.cast(new[path])
    inside = [p for p in new if p[: len(path)] == path]
    if inside and isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[_recast(f.dataType, (*path, f.name), new, column.getField(f.name)).alias(f.name) for f in kind.fields]))
    if inside and isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _recast(kind.elementType, (*path, _ITEM), new, x))
    return column


def _retyped(df: DataFrame) -> DataFrame:
    """Floats that are whole throughout become long, and texts that are times throughout timestamps, at any depth; one pass decides."""
    leaves = [(p, to, test(F.col(quoted(f.name))), F.col(quoted(f.name))) for f in df.schema.fields for p, to, test in _leaves(f.dataType, (f.name,))]
    if not leaves:
        return df
    found = df.agg(*[F.bool_and(F.when(whole.isNotNull(), test)).alias(f"t{k}") for k, (_, _, test, whole) in enumerate(leaves)]).first()
    new = {p: to for k, (p, to, _, _) in enumerate(leaves) if found[f"t{k}"]}
    return df.select(*[_recast(f.dataType, (f.name,), new, F.col(quoted(f.name))).alias(f.name) for f in df.schema.fields])


def import_json(spark: SparkSession, path: str, *, schema: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """A JSON array (or JSON Lines) with whole floats as long and RFC 3339 text as timestamps."""
    reader = spark.read.option("multiLine", not lines)
    df = reader.schema(schema).json(path) if schema else reader.json(path)
    return df if schema else _retyped(df)


def import_json_variant(spark: SparkSession, path: str, column: str = "doc") -> DataFrame:
    """JSON Lines of any shape, as one variant column."""
    return spark.read.option("singleVariantColumn", column).json(path)


def csv_columns(df: DataFrame, fields: Sequence[str] | None = None) -> list[str]:
    """The given fields, else ``_id`` and then all others in order."""
    return list(fields) if fields else sorted(df.columns, key=lambda c: (c != "_id", c))


def _cell(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    column, kind = F.col(quoted(name)), df.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.coalesce(F.to_json(column), F.lit(""))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):  # digits without an exponent
        plain = F.regexp_replace(F.format_string("%.17f", column), r"\.?0+$", "")
        column = F.when(column.cast("string").contains("E"), plain).otherwise(F.regexp_replace(column.cast("string"), r"\.0$", ""))
    return F.coalesce(column.cast("string"), F.lit(""))


def export_csv(df: DataFrame, path: str, *, fields: Sequence[str] | None = None) -> None:
    """CSV parts with a header. Nulls and fields that aren't there are empty; nested values are JSON."""
    names = csv_columns(df, fields)
    df.select(*[_cell(df, n).alias(n) for n in names]).write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def import_csv(spark: SparkSession, path: str, *, headers: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """CSV with types by column, or with ``strict`` by cell into variants. Empty cells are null; ragged rows fail.

    ``headers`` name the columns of a file without a header row; columns beyond them are left out.
    """
    reader = spark.read.option("nullValue", "").option("mode", "FAILFAST").option("escape", '"')
    if headers:
        raw = reader.csv(path)
        raw = raw.select(*[F.col(c).alias(h) for c, h in zip(raw.columns, headers)])
    else:
        raw = reader.option("header", True).csv(path)
    if strict:
        return raw.select(*[variant_cell(F.col(quoted(c))).alias(c) for c in raw.columns])
    return _typed_text(raw)


def variant_cell(text: Column) -> Column:
    """A cell as a time, boolean, number or JSON value if it reads as one, else as text."""
    time = F.when(text.rlike(_TIME), text.try_cast("timestamp")).cast("variant")
    return F.when(text.isNotNull(), F.coalesce(time, F.try_parse_json(text), F.parse_json(F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2))))


def _typed_text(raw: DataFrame) -> DataFrame:
    """Text columns as boolean, long, double or timestamp where every value reads as such."""
    tests = {"boolean": r"^(true|false)$", "long": r"^[+-]?\d{1,18}$", "double": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", "timestamp": _TIME}
    found = raw.agg(*[F.bool_and(F.col(quoted(c)).rlike(p)).alias(f"{k}_{kind}") for k, c in enumerate(raw.columns) for kind, p in tests.items()]).first()
    kinds = {c: next((kind for kind in tests if found[f"{k}_{kind}"]), "string") for k, c in enumerate(raw.columns)}
    return raw.select(*[F.col(quoted(c)).cast(kind).alias(c) for c, kind in kinds.items()])


def write(df: DataFrame, path: str, format: str, **options: Any) -> None:
    """Export by format: json (with ``pretty`` given, one local file with one array), csv (``fields``) or parquet."""
    if format == "json" and "pretty" in options:
        export_json_array(df, path, pretty=options["pretty"])
    elif format == "json":
        export_json(df, path)
    elif format == "csv":
        export_csv(df, path, fields=options.get("fields"))
    elif format == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"unsupported format: {format}")


def read(spark: SparkSession, path: str, format: str, **options: Any) -> DataFrame:
    """Import by format: json (``lines`` false for an array), csv (``headers``, ``strict``) or parquet."""
    if format == "json":
        return import_json(spark, path, lines=options.get("lines", True))
    if format == "csv":
        return import_csv(spark, path, headers=options.get("headers"), strict=options.get("strict", False))
    if format == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format: {format}")

