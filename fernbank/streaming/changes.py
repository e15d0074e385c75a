"""Change streams over an operation log.

The log is a folder of JSON Lines with numbered entries. A stream reads new files as
they come, turns entries into events, filters them, and remembers where it was by its
checkpoint, so an event is delivered once and none is dropped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.filters import where

#: Operation numbers of the log.
OPERATIONS = ["insert", "update", "delete", "createCollection", "dropCollection", "createIndex", "dropIndex", "noop"]
SCHEMA = "op_id bigint, ts timestamp, op tinyint, db string, coll string, doc_id string, doc string, `update` string, filter string, index_def string"


def append(entries: DataFrame, log: str) -> None:
    """Add entries to the log. Documents, updates and filters are JSON text."""
    entries.write.mode("append").json(log)


def entries_since(spark: SparkSession, log: str, op_id: int = 0) -> DataFrame:
    """The entries after a number."""
    return spark.read.schema(SCHEMA).json(log).where(F.col("op_id") > op_id)


def _object(json: Column, path: str) -> Column:
    return F.from_json(F.get_json_object(json, path), "map<string,string>")


def events(entries: DataFrame, *, resume_after: int | None = None, start_at: Any = None) -> DataFrame:
    """Entries as change events; no-ops and unknown operations have none.

    ``updatedFields`` are the operands of ``$set`` and ``$inc`` as they stand, and
    ``removedFields`` the fields of ``$unset``. The resume token is the entry's number.
    """
    if resume_after is not None:
        entries = entries.where(F.col("op_id") > resume_after)
    if start_at is not None:
        entries = entries.where(F.col("ts") >= F.lit(start_at))
    op = F.col("op")
    known = entries.where(op.between(0, len(OPERATIONS) - 2))
    name = F.get(F.array(*[F.lit(o) for o in OPERATIONS]), op.cast("int"))
    none = F.create_map().cast("map<string,string>")
    changed = F.map_concat(F.coalesce(F.map_filter(_object(F.col("update"), "$.$set"), lambda k, v: ~F.coalesce(F.map_contains_key(F.coalesce(_object(F.col("update"), "$.$inc"), none), k), F.lit(False))), none), F.coalesce(_object(F.col("update"), "$.$inc"), none))
    removed = F.array_sort(F.coalesce(F.map_keys(_object(F.col("update"), "$.$unset")), F.array().cast("array<string>")))
    key = F.when(op == 0, F.get_json_object("doc", "$._id")).when(op.isin(1, 2), F.col("doc_id"))
    return known.select(
        F.col("op_id").alias("token"),
        name.alias("operationType"),
        F.col("ts").alias("clusterTime"),
        F.col("db").alias("database"),
        F.col("coll").alias("collection"),
        key.alias("documentKey"),
        F.when(op == 0, F.col("doc")).alias("fullDocument"),
        F.when(op == 1, changed).alias("updatedFields"),
        F.when(op == 1, removed).alias("removedFields"),
        F.when(op.isin(5, 6), F.col("index_def")).alias("indexDefinition"),
    )


def watch(found: DataFrame, *, database: str | None = None, collection: str | None = None, filter: Mapping[str, Any] | None = None, pipeline: Sequence[Mapping[str, Any]] = ()) -> DataFrame:
    """Events of a database or collection that a filter and the pipeline's ``$match`` stages keep.

    ``fullDocument`` is matched as a variant, so a filter can name its fields.
    """
    if database is not None:
        found = found.where(F.col("database") == database)
    if collection is not None:
        found = found.where(F.col("collection") == collection)
    conditions = [filter] if filter else []
    conditions += [stage["$match"] for stage in pipeline if "$match" in stage]
    if conditions:
        open_ = found.withColumn("__text", F.col("fullDocument")).withColumn("fullDocument", F.try_parse_json("fullDocument"))
        for c in conditions:
            open_ = where(open_, c)
        found = open_.withColumn("fullDocument", F.col("__text")).drop("__text")
    return found


def with_current(found: DataFrame, current: DataFrame, id_field: str = "_id") -> DataFrame:
    """``fullDocument`` of updates from the table as it is now, as JSON."""
    now = current.select(F.col(id_field).cast("string").alias("__id"), F.to_json(F.struct("*")).alias("__doc"))
    joined = found.join(now, (F.col("documentKey") == F.col("__id")) & (F.col("operationType") == "update"), "left")
    return joined.withColumn("fullDocument", F.coalesce("fullDocument", "__doc")).drop("__id", "__doc")


def stream(spark: SparkSession, log: str, sink: str, checkpoint: str, *, resume_after: int | None = None, available_now: bool = True, **options: Any) -> StreamingQuery:
    """Write events to a folder of Parquet as the log grows; ``options`` as for ``watch``."""
    found = watch(events(spark.readStream.schema(SCHEMA).json(log), resume_after=resume_after), **options)
    writer = found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()
