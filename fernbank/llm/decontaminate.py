r"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's *windows* are its runs of ``window`` consecutive words (an item of
fewer words, but not none, is one window). A window is the ordered set of its
``shingle``-word shingles, and a document contains it where all of them occur at
the window's offsets.

1. One pass over the texts finds every occurrence of a benchmark shingle. The
   pass is a single code-generated stage: words are exploded next to their array,
   each position's shingle is hashed in place, probed against the benchmark's
   shingles and compared word for word, so nothing but matches leaves it.
2. Shingles are ordered by rarity (occurrences in all documents, ties by text).
   To contain a whole window a document must hold all its shingles, so the
   necessary prefix is the one rarest shingle: only it is joined.
3. Candidates outside ``0 <= start <= n_words - length`` are dropped (positional
   and length bounds), and the rest are verified shingle by shingle over the
   item-sized window, which is exact: the shingles were compared as words and
   cover every word of the window.

The benchmark's shingles are broadcast only if their written size is small;
otherwise positions are shuffled by shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import bytes_of, materialise

WINDOW = 10
SHINGLE = 3
#: Benchmark-derived tables of more bytes than this are joined by shuffle.
BROADCAST_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z alone; none for null."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _small(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if bytes_of(df) <= limit else df


def benchmark_windows(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(win, items, len)``: distinct windows as space-joined words, with the ids of the items that have them."""
    w = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    wins = w.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, F.lit(window)))).alias("win"))
    return wins.groupBy(F.concat_ws(" ", "win").alias("win"), F.size("win").alias("len")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def _occurrences(docs: DataFrame, shingles: DataFrame, k: int, limit: int, first: bool) -> DataFrame:
    """Rows (doc, th, n_words, pos, sh) where a benchmark shingle of k words stands, and if ``first`` one row for each document at least."""
    at = [F.get("w", F.col("pos") + i) for i in range(k)]
    n_words = F.size("w").cast("long").alias("n_words")
    placed = docs.select("doc", "th", "w", F.posexplode_outer("w").alias("pos", "_word")).withColumn("h", F.xxhash64(*at))
    own = shingles.where(F.col("k") == k).select(F.col("h").alias("rh"), "sh")
    if bytes_of(own) > limit:  # what is shuffled is a position's own words, never the document's
        moved = placed.where(F.get("w", F.col("pos") + k - 1).isNotNull()).select("doc", "th", n_words, "pos", "h", F.concat_ws(" ", *at).alias("here"))
        found = moved.join(own, (F.col("h") == F.col("rh")) & (F.col("here") == F.col("sh"))).select("doc", "th", "n_words", "pos", "sh", F.lit(False).alias("own"))
        whole = docs.select("doc", "th", n_words, F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("sh"), F.lit(True).alias("own"))
        return found.unionByName(whole) if first else found
    same = (F.col("h") == F.col("rh")) & (F.concat_ws(" ", *at) == F.col("sh"))
    found = placed.join(F.broadcast(own), same, "left" if first else "inner")
    if first:
        found = found.where(F.col("sh").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
    is_own = F.coalesce(F.col("pos") == 0, F.lit(True)) & F.lit(first)  # the one row that stands for the document itself
    return found.select("doc", "th", n_words, "pos", "sh", is_own.alias("own"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row for each document: ``doc, th, n_words, n_hit, items, spans``.

    ``th`` is the text's hash, so rows of one id with different texts are kept
    apart; rows that repeat both give a row each. ``spans`` are the hit windows as
    sorted ``(start, end)`` word positions, ``n_hit`` the number of words inside
    any, ``items`` the sorted ids of the items with occurring windows. Null and
    wordless texts have no words and no hits; a null item id marks words but is
    not listed. Other columns are ignored. An empty benchmark hits nothing; an
    empty table gives no rows.
    """
    windows = materialise(benchmark_windows(benchmark, item=item, text=text, window=window), "windows")
    size = F.least(F.lit(shingle), F.col("len"))
    word = F.split("win", " ")
    offsets = F.sequence(F.lit(0), F.col("len") - F.col("k"))
    parts = windows.withColumns({"k": size, "ws": word}).select(
        "win", "len", "items", "k", F.posexplode(F.transform(offsets, lambda i: F.array_join(F.slice(F.col("ws"), i + 1, F.col("k")), " "))).alias("off", "sh")
    )
    parts = materialise(parts, "window-shingles")
    shingles = parts.select("k", "sh").distinct().withColumn("h", F.col("k").cast("long"))
    sizes = sorted(r.k for r in shingles.select("k").distinct().collect()) or [shingle]
    hashed = None
    for k in sizes:
        one = shingles.where(F.col("k") == k).withColumn("h", F.xxhash64(*[F.get(F.split("sh", " "), F.lit(i)) for i in range(k)]))
        hashed = one if hashed is None else hashed.unionByName(one)
    hashed = materialise(hashed, "shingles")

    source = docs.select(F.col(doc).alias("doc"), F.xxhash64(F.col(text)).alias("th"), words(F.col(text)).alias("w"))
    found = None
    for k in reversed(sizes):
        one = _occurrences(source, hashed, k, broadcast_bytes, found is None)
        found = one if found is None else found.unionByName(one)
    found = materialise(found, "occurrences")
    matched = found.where(F.col("sh").isNotNull())

    rarity = matched.groupBy("sh").agg(F.count(F.lit(1)).alias("freq"))
    ordered = parts.join(rarity, "sh").groupBy("win", "len", "items").agg(F.min(F.struct("freq", "sh", "off")).alias("p"), F.count(F.lit(1)).alias("have"))
    complete = F.col("have") == F.col("len") - F.least(F.lit(shingle), F.col("len")) + 1
    prefix = materialise(ordered.where(complete).select("win", "len", F.col("p.sh").alias("sh"), F.col("p.off").alias("at")), "prefix")
    candidates = (
        matched.join(_small(prefix, broadcast_bytes), "sh")
        .withColumn("start", F.col("pos") - F.col("at"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
        .select("doc", "th", "start", "win", "len")
        .distinct()
    )
    needed = candidates.join(_small(parts.select("win", "off", "sh"), broadcast_bytes), "win").withColumn("pos", F.col("start") + F.col("off"))
    there = matched.select("doc", "th", "pos", "sh").distinct().alias("m")
    needed = needed.alias("n")
    on = F.col("n.doc").eqNullSafe(F.col("m.doc")) & F.col("n.th").eqNullSafe(F.col("m.th")) & (F.col("n.pos") == F.col("m.pos")) & (F.col("n.sh") == F.col("m.sh"))
    verified = (
        needed.join(there, on)
        .groupBy(F.col("n.doc").alias("doc"), F.col("n.th").alias("th"), F.col("n.start").alias("start"), F.col("n.win").alias("win"), F.col("n.len").alias("len"))
        .agg(F.count(F.lit(1)).alias("have"))
        .where(complete)
    )
    with_items = verified.join(_small(windows.select("win", "items"), broadcast_bytes), "win")
    hits = with_items.groupBy("doc", "th").agg(
        F.sort_array(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("len")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    rows = found.where("own").select("doc", "th", "n_words").alias("d")
    hits = hits.alias("h")
    joined = rows.join(hits, F.col("d.doc").eqNullSafe(F.col("h.doc")) & F.col("d.th").eqNullSafe(F.col("h.th")), "left")
    covered = F.aggregate(
        F.col("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"])).cast("long")).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach")),
        lambda a: a["n"],
    )
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("d.doc").alias("doc"),
        F.col("d.th").alias("th"),
        "n_words",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, w[i:i + least({WINDOW}, len(w)) - 1] AS win FROM (
    SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT len(win) AS n FROM bw
), dw AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), h AS (
  SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win
), hw AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns."""
    hits = decontaminate(docs, benchmark, doc=doc, text=text, broadcast_bytes=broadcast_bytes)
    hits = materialise(hits.where("n_hit > 0").select(F.col("doc").alias("hit_doc"), F.col("th").alias("hit_th")).distinct(), "contaminated")
    same = docs[doc].eqNullSafe(hits["hit_doc"]) & F.xxhash64(docs[text]).eqNullSafe(hits["hit_th"])
    return docs.join(_small(hits, broadcast_bytes), same, "left_anti")
