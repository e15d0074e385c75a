"""Connected components of link tables, by alternating star contraction.

Every round re-hangs neighbours on the least node that they can see (first a node's
larger neighbours, then its smaller ones), so the edges shrink to stars around each
component's least node in about log(n) rounds. A round's minima are pre-aggregated
before the shuffle, and joins back to the edges are plain equi-joins that adaptive
execution can split where a node is hot. Every round is written to the shared
folder; nothing but two sums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import materialise, remove, shared_dir

ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, both["a"] == least["n"]).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    moved = down.join(least, down["a"] == least["n"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node that a link of ``links(a, b)`` joins to a smaller one: the least node it can reach.

    Links without direction; loops and repeats are ignored. Roots themselves and
    nodes without links are not listed.
    """
    spark = links.sparkSession
    path, state = shared_dir(spark, "edges"), None
    edges = materialise(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", path)
    for _ in range(ROUNDS):
        before, path = path, shared_dir(spark, "edges")
        edges = materialise(_small_star(_large_star(edges)), "edges", path)
        remove(spark, before)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
