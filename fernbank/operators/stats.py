"""Statistics: column profiles, histograms, percentiles, slow-query analytics and data quality."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.filters import quoted

#: Approximate quantiles are off by one part in so many at most.
_ACCURACY = 10_000


def analyze(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``field, entries, unique_keys, min, max`` for each column, exact; nulls are no entries.

    Columns are compared by their own types. ``min`` and ``max`` have the columns' type if
    all share one, are doubles if all are numbers, and text otherwise.
    """
    kinds = [df.schema[c].dataType for c in columns]
    if all(k == kinds[0] for k in kinds):
        to = kinds[0]
    else:
        to = T.DoubleType() if all(isinstance(k, T.NumericType) for k in kinds) else T.StringType()

    def one(c: str) -> DataFrame:
        distinct = df.select(F.col(quoted(c)).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        found = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count(F.lit(1)).alias("unique_keys"), F.min("v").cast(to).alias("min"), F.max("v").cast(to).alias("max"))
        return found.select(F.lit(c).alias("field"), "*")

    return reduce(DataFrame.unionByName, [one(c) for c in columns])


def histogram(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """``bucket, lower, upper, n, frequency``: buckets of equal width; the last takes the maximum.

    One value throughout gives one bucket. Empty buckets have no row.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("total"))
    width = (F.col("hi") - F.col("lo")) / buckets
    bucket = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(buckets - 1)))
    counted = values.crossJoin(F.broadcast(bounds)).groupBy(bucket.cast("long").alias("bucket"), "lo", "hi", "total").agg(F.count(F.lit(1)).alias("n"))
    one = F.col("hi") == F.col("lo")
    return counted.select(
        "bucket",
        (F.col("lo") + F.col("bucket") * width).alias("lower"),
        F.when(one, F.col("lo") + 1).otherwise(F.col("lo") + (F.col("bucket") + 1) * width).alias("upper"),
        "n",
        (F.col("n") / F.col("total")).alias("frequency"),
    )


def selectivity(histogram_rows: Sequence, low: float | None, high: float | None) -> float:
    """The part of all values in [low, high] by a collected histogram, each bucket spread evenly; 0.5 without one."""
    if not histogram_rows:
        return 0.5
    part = 0.0
    for r in histogram_rows:
        a, b = max(r.lower, low if low is not None else r.lower), min(r.upper, high if high is not None else r.upper)
        if b > a:
            part += r.frequency * (b - a) / (r.upper - r.lower)
    return min(1.0, part)


def latency_buckets(df: DataFrame, column: str) -> DataFrame:
    """``bucket, n`` for durations in milliseconds: below 1, 10, 100, 1000 and from there."""
    v = F.col(column)
    label = F.when(v < 1, "<1ms").when(v < 10, "1-10ms").when(v < 100, "10-100ms").when(v < 1000, "100-1000ms").otherwise(">=1000ms")
    return df.where(v.isNotNull()).groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(df: DataFrame, column: str, ranks: Sequence[int] = (50, 95, 99), by: str | None = None) -> DataFrame:
    """Nearest-rank percentiles: the value at position n*p/100 of the sorted values, exact.

    Approximate quantiles, whose error is bounded, bracket each rank. Values are only
    counted: those below a bracket together, those within by value, so what is put in
    order is a bracket's different values and no task sorts a group.
    """
    group = [by] if by else []
    values = df.where(F.col(column).isNotNull()).select(*[F.col(c).alias("g") for c in group], F.col(column).alias("v"))
    values = values if group else values.withColumn("g", F.lit(0))
    ends = {p: (max(0.0, p / 100 - 3 / _ACCURACY), min(1.0, p / 100 + 3 / _ACCURACY)) for p in ranks}
    cuts = sorted({x for pair in ends.values() for x in pair})
    found = values.groupBy("g").agg(F.percentile_approx("v", cuts, _ACCURACY).alias("cuts"), F.count(F.lit(1)).alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))
    found = found.withColumnRenamed("g", "of")
    near = values.join(found, F.col("g").eqNullSafe(F.col("of"))).drop("of")
    v, brackets = F.col("v"), []
    for p, (a, b) in ends.items():
        low = F.get("cuts", F.lit(cuts.index(a))) if a > 0 else F.col("least")
        high = F.get("cuts", F.lit(cuts.index(b))) if b < 1 else F.col("most")
        brackets.append(F.when(v <= high, F.struct(F.lit(p).alias("p"), F.when(v >= low, v).alias("key"))))
    counted = near.select("g", "total", F.explode(F.array_compact(F.array(*brackets))).alias("at")).groupBy("g", "total", "at.p", "at.key").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "p").orderBy(F.col("key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    at = counted.withColumn("upto", upto).where(F.col("upto") > F.least(F.floor(F.col("total") * F.col("p") / 100), F.col("total") - 1))
    best = at.groupBy("g", "p").agg(F.min_by("key", "upto").alias("v"))
    out = best.groupBy("g").agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in ranks])
    return out.withColumnRenamed("g", by) if by else out.drop("g")


def slow_queries(log: DataFrame, *, operation: str, collection: str, duration: str, at: str, since: datetime | None = None) -> dict[str, DataFrame]:
    """``overall, by_operation, by_collection`` of a slow-query log."""
    rows = log if since is None else log.where(F.col(at) >= F.lit(since))
    measures = [F.count(F.lit(1)).alias("n"), F.avg(duration).alias("avg"), F.min(duration).alias("min"), F.max(duration).alias("max")]
    return {"overall": rows.agg(*measures), "by_operation": rows.groupBy(operation).agg(*measures), "by_collection": rows.groupBy(collection).agg(*measures)}


def top_slow(log: DataFrame, duration: str, n: int, tie: str) -> DataFrame:
    """The n slowest entries."""
    return log.orderBy(F.desc(duration), tie).limit(n)


def validate(df: DataFrame, id_field: str = "_id") -> DataFrame:
    """``issue, n``: rows without an id and ids that repeat."""
    ids = df.groupBy(F.col(id_field).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    missing = F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0))
    repeated = F.coalesce(F.sum(F.when(F.col("id").isNotNull() & (F.col("n") > 1), F.col("n") - 1)), F.lit(0))
    found = ids.agg(missing.alias("missing_id"), repeated.alias("duplicate_id"))
    return found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("issue"), F.col(c).alias("n")) for c in found.columns])).alias("x")).select("x.*")


def repair(df: DataFrame, id_field: str = "_id") -> DataFrame:
    """Rows with an id, one for each."""
    return df.where(F.col(id_field).isNotNull()).dropDuplicates([id_field])
