"""The corpus pipeline: from raw documents to packed token sequences in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept;
all but the last return the columns of ``documents``. Nulls in any column, empty
and repeated rows and empty tables pass through every stage as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernbank.llm import decontaminate, langid, lines, packing, queries, simhash, similar
from fernbank.llm.work import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts and texts without a letter go.

    The model is fitted on a sample of the labelled rows of ``docs``. A text with a letter
    stays whatever language it is given, and though the model finds it ambiguous: a
    short or mixed text is no junk. Without any labelled row no language can be told,
    and all texts with a letter stay.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit_documents(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.identify(docs, model).where(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; ``n_chars`` is counted again."""
    cut = lines.drop_boilerplate(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one with the smallest id.

    SimHash with pivot tables (``simhash.close_groups``) groups all documents that share a
    rare shingle; a set join adds alike ones that differ in more bits, and the shingle sets decide.
    """
    docs = docs.select(*COLUMNS)
    return simhash.one_of_each(docs, similar.similar(docs))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, packed: a row for each piece."""
    return packing.pack_first_fit(docs, queries.vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("decontamination", decontaminate_documents),
    ("packing", pack),
]

#: Language codes, fingerprints and token ids have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each over the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
