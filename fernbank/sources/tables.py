"""Parquet tables by folder and name, whose schema is read once a session, as a catalog would have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``<folder>/<name>.parquet``. Reading a footer for the schema is a job of its own, so it is kept."""
    path = f"{folder}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)
