"""Folders for working tables, in the place that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a local session that names none gets a temporary folder. Nothing is created yet."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.setdefault("dir", "file://" + os.path.realpath(tempfile.mkdtemp(prefix="fernbank-")))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
