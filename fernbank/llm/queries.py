"""The registered queries of the corpus operators, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lines, lm, packing, simhash, sketch, token_files, warc
from .work import materialise, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The vocabulary file that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as rows of a packed id matrix, with cumulative lengths and position resets."""
    return packing.pack_matrices(_table(spark, sf_dir, "documents"), vocabulary())


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed first-fit, piece by piece."""
    pieces = packing.pack_first_fit(_table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return lines.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its benchmark words."""
    hits = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted in flat token files that were written before."""
    return token_files.token_counts(_table(spark, sf_dir, "documents"), vocabulary())


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edits."""
    return sketch.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from two thirds of the labelled documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = langid.fit_documents(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a WARC archive, read back and assembled."""
    target = shared_dir(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), target)
    captures = warc.assemble(materialise(warc.read_records(spark, target), "warc-records"))
    pages = captures.select("response", warc.metadata_field("page_id").cast("long").alias("page_id"))
    pages = materialise(pages, "captures")
    original = pages.select(F.col("response.id").alias("oid"), F.col("page_id").alias("refers_to"))
    joined = pages.join(original, F.col("response.refers_to") == F.col("oid"), "left")
    return joined.select("page_id", "response.payload_bytes", F.col("response.payload_sha256").alias("payload_digest"), F.col("response.type").alias("record_type"), "refers_to")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learned from four fifths of them."""
    return lm.score(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and its component of near-duplicates."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


OP8_SQL = f"""
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN strlen(h) >= {warc.REVISIT_BYTES} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= {warc.REVISIT_BYTES} AND page_id > first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_matrices": op1_token_matrices,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_fingerprints": op6_fingerprints,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": lines.ORACLE_SQL,
    "op4_decontamination": decontaminate.ORACLE_SQL,
    "op8_warc": OP8_SQL,
}
