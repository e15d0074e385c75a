"""Flat token files without an index, and the separator scan that counts their documents.

A token file is nothing but little-endian ids, each document followed by the
end-of-document id. ``write_token_files`` makes them with Spark's own text writer:
a row's value is a file's ids and the line separator is the last end-of-document
id, so files are committed like any other output and a lost task leaves none. A
sidecar of document ids in file order is written beside them; it has no offsets.

``document_lengths`` reads files as they stand. Every file is cut into blocks of
``block`` ids, in which numpy finds all separators at once; a document that runs
over blocks is stitched by a prefix scan: the running maximum of the blocks' last
separators is where the next block's first document begins, and the running sum of
their separator counts is its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .bpe import tokenizer
from .memory import stream

#: Bytes of ids after which a token file is closed.
FILE_BYTES = 8 << 20
#: Ids in a block of the scan.
BLOCK = 1 << 16


def _shards(path: str, end_id: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = tokenizer(path)
        end = t.one(end_id)
        part = TaskContext.get().partitionId()
        held, ids, size, k = [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"{part:06d}-{k:06d}"
            tokens = end.join(held)  # the writer's line separator is the last end id
            names = ",".join("" if i is None else str(i) for i in ids).encode()
            return pa.RecordBatch.from_arrays([pa.array(["tokens", "docs"]), pa.array([name] * 2), pa.array([tokens, names], pa.binary())], ["kind", "shard", "content"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(t.encode(text or ""))
                ids.append(doc_id)
                size += len(held[-1]) + len(end)
                if size >= file_bytes:
                    yield close()
                    held, ids, size, k = [], [], 0, k + 1
        if ids:
            yield close()

    return run


def write_token_files(docs: DataFrame, target: str, path: str, *, end_id: int = 50256, doc: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Tokenise every document into flat token files under ``target``.

    A null text is a document of no tokens; a null id is an empty name in the
    sidecar. Repeated rows are documents of their own. An empty table writes no
    file. ``end_id`` must be one that no text gives, as 50256 here.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = source.mapInArrow(stream(_shards(path, end_id, file_bytes)), "kind string, shard string, content binary")
    separator = tokenizer(path).one(end_id).decode("latin-1")
    out = rows.select("kind", "shard", F.col("content").cast("string").alias("value"))
    out.write.partitionBy("kind", "shard").option("lineSep", separator).option("encoding", "ISO-8859-1").text(target)


def _files(spark: SparkSession, target: str, kind: str) -> DataFrame:
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(target)
    return read.where(F.col("path").contains(f"/kind={kind}/")).select(F.regexp_extract("path", r"/shard=([^/]+)/", 1).alias("shard"), "content")


def _scan(end_id: int, width: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.frombuffer(content.as_buffer(), f"<u{width}")
                cols: tuple[list, ...] = ([], [], [], [])
                for b, at in enumerate(range(0, len(tokens), block)):
                    found = np.flatnonzero(tokens[at : at + block] == end_id) + at
                    for c, v in zip(cols, (shard, b, int(found[-1]) if len(found) else None, found)):
                        c.append(v)
                arrays = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "block", "last", "ends"])

    return run


def document_lengths(spark: SparkSession, target: str, *, end_id: int = 50256, width: int = 2, block: int = BLOCK) -> DataFrame:
    """``shard, ordinal, start, n_tokens``: each document's place in its file and its tokens without the separator.

    Ids after a file's last separator are a document only with a separator, so
    they are not counted. Files without any give no rows.
    """
    ship(spark)
    blocks = _files(spark, target, "tokens").mapInArrow(stream(_scan(end_id, width, block)), "shard string, block long, last long, ends array<long>")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = blocks.select(
        "shard",
        "ends",
        F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("open"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("before"),
    )
    placed = stitched.select("shard", "ends", "open", "before", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.get("ends", F.col("k") - 1) + 1)
    return placed.select("shard", (F.col("before") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def document_names(spark: SparkSession, target: str, *, end_id: int = 50256, path: str) -> DataFrame:
    """``shard, ordinal, doc_id`` from the sidecars."""
    trimmed = F.expr(f"substring(content, 1, length(content) - {len(tokenizer(path).one(end_id))})").cast("string")
    names = _files(spark, target, "docs").select("shard", F.posexplode(F.split(trimmed, ",")).alias("ordinal", "name"))
    return names.select("shard", F.col("ordinal").cast("long").alias("ordinal"), F.when(F.col("name") != "", F.col("name")).cast("long").alias("doc_id"))


def token_counts(docs: DataFrame, path: str, *, end_id: int = 50256, block: int = BLOCK, target: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and count them again: ``doc_id, shard, ordinal, start, n_tokens``."""
    from .work import shared_dir

    spark = docs.sparkSession
    target = target or shared_dir(spark, "token-files")
    write_token_files(docs, target, path, end_id=end_id)
    if not list(_listed(spark, target)):
        return spark.createDataFrame([], "doc_id long, shard string, ordinal long, start long, n_tokens long")
    width = len(tokenizer(path).one(end_id))
    lengths = document_lengths(spark, target, end_id=end_id, width=width, block=block)
    names = document_names(spark, target, end_id=end_id, path=path)
    return lengths.join(names, ["shard", "ordinal"]).select("doc_id", "shard", "ordinal", "start", "n_tokens")


def _listed(spark: SparkSession, target: str) -> Iterator[str]:
    """Folders of token files; none after an empty table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p):
        if s.isDirectory():
            yield s.getPath().toString()
