"""Full-text search: analysis, postings and BM25.

Postings are made in one pass, pre-aggregated by task. The stemmer is the only
Python, and it runs over the distinct vocabulary, whose stems are joined back. A
search reads only the postings of its own terms: the terms are literals, so the
filter comes before the shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.stemmer import stem
from ..plans.filters import quoted

#: BM25 parameters.
K1, B = 1.5, 0.75
# Words that are not indexed.
STOP_WORDS = """
a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with
i you he she we me him her us them what which who when where why how all each every both few more most other some
can could may might must shall should would am been being have has had do does did doing
""".split()
_BETWEEN = r"[^\p{L}\p{N}]+"


def combined(columns: Sequence[str]) -> Column:
    """The text of several fields, joined by spaces; nulls are left out."""
    return F.concat_ws(" ", *[F.col(quoted(c)) for c in columns])


def _indexed_word(word: Column) -> Column:
    return (F.octet_length(word) >= 2) & ~word.isin(STOP_WORDS)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, of two bytes at least, without stop words."""
    return F.filter(_words(text), _indexed_word)


def _words(text: Column) -> Column:
    """Runs of letters and digits in lower case. Where lower-casing makes no new sign between words, the whole text is lower-cased at once, which is cheaper."""
    return F.when(text.contains("\u0130"), F.transform(F.split(text, _BETWEEN), F.lower)).otherwise(F.split(F.lower(text), _BETWEEN))


def positions(df: DataFrame, columns: Sequence[str], id_field: str = "_id") -> DataFrame:
    """``id, position, token`` of every indexed token."""
    return df.select(F.col(quoted(id_field)).alias("id"), F.posexplode(tokens(combined(columns))).alias("position", "token"))


def query_tokens(query: str, stemmed: bool = True) -> list[str]:
    """The analysed words of a query, repeats included."""
    import regex

    words = [w.lower() for w in regex.split(_BETWEEN, query) if w]
    words = [w for w in words if len(w.encode()) >= 2 and w not in STOP_WORDS]
    return [stem(w) for w in words] if stemmed else words


def stems(vocabulary: DataFrame) -> DataFrame:
    """``token, stem`` for a table of distinct ``token``s."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(stem=batch["token"].map(stem))

    ship(vocabulary.sparkSession)
    return vocabulary.mapInPandas(run, "token string, stem string")


def indexed(df: DataFrame, columns: Sequence[str], id_field: str = "_id") -> DataFrame:
    """``id, tokens`` of rows that have any of the text fields."""
    has_text = F.coalesce(*[F.col(quoted(c)) for c in columns]).isNotNull()
    return df.where(has_text).select(F.col(quoted(id_field)).alias("id"), tokens(combined(columns)).alias("tokens"))


def postings(df: DataFrame, columns: Sequence[str], *, id_field: str = "_id", stemmed: bool = True) -> DataFrame:
    """``token, id, tf``: the inverted index as a table."""
    found = indexed(df, columns, id_field).select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    if not stemmed:
        return found.select("token", "id", "tf")
    table = stems(found.select("token").distinct())
    return found.join(table, "token").groupBy(F.col("stem").alias("token"), "id").agg(F.sum("tf").alias("tf"))


def build_index(df: DataFrame, columns: Sequence[str], *, id_field: str = "_id", stemmed: bool = True) -> tuple[DataFrame, int, float]:
    """Postings ``token, id, tf, dl`` sorted by token, with the number of documents and their mean length."""
    docs = indexed(df, columns, id_field).select("id", "tokens", F.size("tokens").cast("long").alias("dl"))
    n, length = docs.agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    found = docs.select("id", "dl", F.explode("tokens").alias("token")).groupBy("id", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    if stemmed:
        found = found.join(stems(found.select("token").distinct()), "token").groupBy(F.col("stem").alias("token"), "id", "dl").agg(F.sum("tf").alias("tf"))
    return found.select("token", "id", "tf", "dl").repartitionByRange("token").sortWithinPartitions("token", "id"), n, length


def _term_score(tf: Column, dl: Column, n: Column, found: Column, avgdl: Column, times: Column) -> Column:
    idf = times * F.ln((n - found + 0.5) / (found + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def index_scores(postings: DataFrame, query: str | Sequence[str], n: int, avgdl: float, *, stemmed: bool = True) -> DataFrame:
    """``id, score`` by an index that ``build_index`` made: only the postings of the query's tokens are read."""
    wanted = Counter(query_tokens(query, stemmed) if isinstance(query, str) else query)
    times = F.coalesce(*[F.when(F.col("token") == t, F.lit(float(k))) for t, k in wanted.items()], F.lit(0.0))
    own = postings.where(F.col("token").isin(list(wanted))) if wanted else postings.limit(0)
    found = own.groupBy("token").agg(F.count(F.lit(1)).cast("double").alias("found"))  # a row for each of the query's tokens
    scored = own.join(F.broadcast(found), "token").withColumn("part", _term_score(F.col("tf").cast("double"), F.col("dl"), F.lit(float(n)), F.col("found"), F.lit(float(avgdl)), times))
    return scored.groupBy("id").agg(F.sum("part").alias("score"))


def _words_of(df: DataFrame, columns: Sequence[str], wanted: Sequence[str]) -> dict[str, list[str]]:
    """The indexed words of each wanted stem. A stem has few words: they share all but its last letters and end in known suffixes."""
    starts = "|".join(re.escape(t[: max(1, len(t) - (2 if len(t) > 4 else 1))]) for t in wanted)
    token = F.explode(_words(combined(columns))).alias("token")
    near = df.select(token).where(F.col("token").rlike(f"^({starts})")).distinct()
    found: dict[str, list[str]] = {t: [] for t in wanted}
    for r in stems(near).where(F.col("stem").isin(list(wanted)) & _indexed_word(F.col("token"))).collect():
        found[r.stem].append(r.token)
    return found


def bm25(df: DataFrame, query: str | Sequence[str], columns: Sequence[str], *, id_field: str = "_id", stemmed: bool = True) -> DataFrame:
    """``id, score`` of rows with any query token. A token that the query repeats counts as often.

    One code-generated pass over the texts leaves a row for each document: its length
    and its counts of the query's tokens. Totals and scores come from that table.
    """
    wanted = Counter(query_tokens(query, stemmed) if isinstance(query, str) else query)
    has_text = F.coalesce(*[F.col(quoted(c)) for c in columns]).isNotNull()
    rows = df.where(has_text).select(F.col(quoted(id_field)).alias("id"), combined(columns).alias("text"))
    if not wanted:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    terms = list(wanted)
    words = _words_of(df, columns, terms) if stemmed else {t: [t] for t in terms}
    token = F.col("token")
    counts = [F.count_if(token.isin(words[t]) if words[t] else F.lit(False)).cast("double").alias(f"tf{k}") for k, t in enumerate(terms)]
    docs = rows.select("id", F.explode(_words(F.col("text"))).alias("token")).groupBy("id").agg(F.count_if(_indexed_word(token)).alias("dl"), *counts)
    totals = docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).cast("double").alias(f"df{k}") for k in range(len(terms))])
    score = F.lit(0.0)
    for k, t in enumerate(terms):
        score = score + _term_score(F.col(f"tf{k}"), F.col("dl"), F.col("n"), F.col(f"df{k}"), F.col("avgdl"), F.lit(float(wanted[t])))
    any_ = reduce(lambda a, b: a | b, [F.col(f"tf{k}") > 0 for k in range(len(terms))])
    return docs.where(any_).crossJoin(F.broadcast(totals)).select("id", score.alias("score"))


def text_search(
    df: DataFrame, query: str, columns: Sequence[str], *, id_field: str = "_id", projection: Mapping[str, bool] | None = None, skip: int = 0, limit: int = 0, stemmed: bool = True
) -> DataFrame:
    """Rows by relevance with ``_textScore``, ties by id."""
    return ranked(df, bm25(df, query, columns, id_field=id_field, stemmed=stemmed), id_field=id_field, projection=projection, skip=skip, limit=limit)


def ranked(df: DataFrame, scores: DataFrame, *, id_field: str = "_id", projection: Mapping[str, bool] | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
    """The rows of ``scores(id, score)`` by score with ``_textScore``, ties by id."""
    from ..plans.find import project

    scores = scores.select(F.col("id").alias("_scored_id"), F.col("score").alias("_textScore"))
    found = df.join(scores, F.col(quoted(id_field)) == F.col("_scored_id")).drop("_scored_id").orderBy(F.desc("_textScore"), quoted(id_field))
    found = project(found, projection, forced=(id_field,))
    if skip:
        found = found.offset(skip)
    return found.limit(limit) if limit else found
