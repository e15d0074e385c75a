"""Shared working tables: lineage is cut with Parquet tables that every executor can read.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
local-mode session that names none gets a temporary folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tasks that one exchange is dealt to, at most: beyond that each takes more groups, one after the other.
MAX_TASKS = 100_000
_LOCAL: dict[str, str] = {}
_MADE: list[str] = []
_TABLES: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path for one working table. Nothing is created there yet."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.setdefault("dir", os.path.realpath(tempfile.mkdtemp(prefix="fernbank-")))
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = path or shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """Write ``df`` as a table bucketed by ``key`` in the shared folder: grouping by the key then needs no shuffle."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", shared_dir(spark, name)).saveAsTable(table)
    _TABLES.append(table)
    return spark.table(table)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a working table that no later plan reads."""
    if path in _MADE:
        _MADE.remove(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean(spark: SparkSession) -> int:
    """Delete every working table of this driver; how many. Call it when the results are written: lazy frames read them."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    n = len(_MADE)
    while _MADE:
        remove(spark, _MADE.pop())
    return n


def tasks(groups: int, each: int) -> int:
    """How many tasks take ``groups`` groups, ``each`` at a time."""
    return max(1, min(MAX_TASKS, -(-groups // each)))


def bytes_of(df: DataFrame) -> int:
    """Catalyst's size estimate of a written table: the check in front of every broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(name for k in range(len(taken) + 1) if (name := f"_{base}_{k}") not in taken)
