"""Expiry by age: a row expires once now is strictly after its time plus the time to live."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.filters import operand


def moment(df: DataFrame, field: str) -> Column:
    """A field as a timestamp: times as they are, whole numbers as Unix seconds, text as RFC 3339; null if it is none."""
    x = operand(df.schema, field)
    if x.column is None:
        return F.lit(None).cast("timestamp")
    if isinstance(x.kind, T.IntegralType):
        return F.timestamp_seconds(x.column)
    return x.column.try_cast("timestamp") if isinstance(x.kind, T.StringType) else x.column.cast("timestamp")


def expired(df: DataFrame, field: str, ttl_seconds: int, now: datetime | Column) -> Column:
    """Whether a row has expired; rows without a time never do."""
    now = now if isinstance(now, Column) else F.lit(now)
    return F.coalesce(moment(df, field) + F.make_interval(secs=F.lit(ttl_seconds)) < now.cast("timestamp"), F.lit(False))


def live(df: DataFrame, indexes: dict[str, int], now: datetime | Column) -> DataFrame:
    """The rows that no TTL index (field to seconds) has expired."""
    for field, ttl in indexes.items():
        df = df.where(~expired(df, field, ttl, now))
    return df


def swept(df: DataFrame, indexes: dict[str, int], now: datetime | Column) -> DataFrame:
    """The rows that any TTL index has expired."""
    gone = F.lit(False)
    for field, ttl in indexes.items():
        gone = gone | expired(df, field, ttl, now)
    return df.where(gone)
