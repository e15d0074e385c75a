"""Line dedup by site-relative frequency, in DataFrame functions only.

For every site, a line's *ratio* is the number of the site's pages that hold
the line over the number of the site's pages. Lines whose ratio exceeds the
boilerplate ratio are dropped from every page of that site.

Scale: lines travel as ``(site, 64-bit hash)`` with map-side partial counts, so
a hot site or a hot line is pre-aggregated before the shuffle. A site can have
at most ``lines_per_page / ratio`` boilerplate lines, so the drop list is a few
hashes per site. It is broadcast only if its written size is small, else joined
by site, where adaptive execution splits a hot site. Texts are shuffled only in
that second case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import bytes_of, free_name, materialise

#: Lines on more than this part of a site's pages are boilerplate.
RATIO = 0.1
#: A line on fewer pages than this is never boilerplate, whatever the ratio.
MIN_PAGES = 5
#: A drop list of more bytes than this is joined by shuffle instead of broadcast.
BROADCAST_BYTES = 8 << 20


def boilerplate(docs: DataFrame, *, text: str = "text", site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(_site, _drop)``: for each site that has any, the hashes of its boilerplate lines.

    A page counts once for a line, however often the line repeats on it. Blank
    lines are never boilerplate. Pages with a null text have no lines but count
    as pages. A null site is a site of its own.
    """
    pages = docs.select(F.col(site).alias("_site"), F.col(text).alias("_text"))
    totals = pages.groupBy("_site").agg(F.count(F.lit(1)).alias("_pages"))
    lines = pages.select("_site", F.explode(F.array_distinct(F.split("_text", "\n"))).alias("_line")).where(F.trim("_line") != "")
    counts = lines.groupBy("_site", F.xxhash64("_line").alias("_hash")).agg(F.count(F.lit(1)).alias("_with")).where(F.col("_with") >= min_pages)
    frequent = counts.alias("c").join(totals.alias("t"), F.col("c._site").eqNullSafe(F.col("t._site"))).where(F.col("_with") / F.col("_pages") > ratio)
    return frequent.groupBy(F.col("c._site").alias("_site")).agg(F.collect_list("_hash").alias("_drop"))


def drop_boilerplate(
    docs: DataFrame, *, text: str = "text", site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, plus ``n_lines`` and ``n_dropped``.

    Every input row gives one row, in whatever other columns it has; columns
    named ``n_lines`` or ``n_dropped`` are replaced. A null text stays null with
    counts 0; an empty text has one (blank) line. If all lines go, the text is
    empty. Repeated rows are pages of their own. An empty table gives none.
    """
    drops = materialise(boilerplate(docs, text=text, site=site, ratio=ratio, min_pages=min_pages), "line-drops")
    if bytes_of(drops) <= broadcast_bytes:
        drops = F.broadcast(drops)
    own, drop, kept, cut = (free_name(docs, n) for n in ("site", "drop", "kept", "cut"))
    drops = drops.select(F.col("_site").alias(own), F.col("_drop").alias(drop))
    joined = docs.join(drops, docs[site].eqNullSafe(drops[own]), "left")
    lines = F.split(F.col(text), "\n")
    left = F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains(F.col(drop), F.xxhash64(line)))
    staged = joined.withColumn(kept, F.when(F.col(drop).isNull(), lines).otherwise(left))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    n_kept = F.coalesce(F.size(kept), F.lit(0))
    counted = staged.withColumns({
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("long"),
        "n_dropped": F.when(F.col(text).isNull(), 0).otherwise(n_lines - n_kept).cast("long"),
        cut: F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
    })
    return counted.withColumn(text, F.col(cut)).drop(own, drop, kept, cut)


ORACLE_SQL = f"""
WITH l AS (
  SELECT source, doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents
), t AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), b AS (
  SELECT l.source, l.line FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
  WHERE trim(l.line) <> '' GROUP BY l.source, l.line, t.pages
  HAVING count(*) >= {MIN_PAGES} AND count(*) / t.pages::DOUBLE > {RATIO}
), d AS (
  SELECT source, list(line) AS lines FROM b GROUP BY source
), k AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls,
         list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(d.lines, []::VARCHAR[]), x)) AS kept
  FROM documents LEFT JOIN d ON documents.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, len(ls)::BIGINT AS n_lines, (len(ls) - len(kept))::BIGINT AS n_dropped FROM k
"""
