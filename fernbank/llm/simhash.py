"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has a bit for each hash bit that is set in over half of its
shingles' hashes. Texts are grouped by fingerprint first, so exact copies cost one
row. The links between fingerprints at Hamming distance ``bits`` or less are found
without loss in three steps:

* *Keys.* The 64 bits are cut into blocks; a close pair is equal on all but ``bits`` of
  them, so each choice of that many blocks is a join key. There are as many blocks as
  give keys long enough for the number of fingerprints: a bucket of chance members
  holds about one, whatever the corpus size.
* *Pivots.* The distances to ``len(PIVOTS)`` fixed references are tabulated for each
  fingerprint, packed into one long. By the triangle inequality a pair that differs
  by more than ``bits`` in any coordinate cannot be close and is discarded.
* Survivors are verified by their exact distance.

Pivots alone can't bring pairs together: the distances of unlike fingerprints to one
reference differ by ``bits`` or less in nearly half of all cases, so a grid of pivot
coordinates fine enough to select would copy each fingerprint more often than it
divides the pairs.

No bucket is expanded into all its pairs. Its members are first held against its
least member only (a star), the stars' components are found, and then only members
outside the least member's component are paired with members of other components.
Since every link inside a component is implied, this loses none that matters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .graph import components
from .memory import stream
from .sketch import mix, word_bounds
from .work import free_name, materialise

SEED = 42
WORDS = 3
BITS = 3
#: Reference fingerprints of the distance table.
PIVOTS = [int(x) for x in mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def xxh64_shingles(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included; of all words if there are fewer; none without words."""
    flat = b" ".join(text.encode().lower().split())
    if not flat:
        return np.zeros(0, np.uint64)
    starts, ends = word_bounds(np.frombuffer(flat, np.uint8))
    k = min(words, len(starts))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist())])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero without any."""
    if not len(hashes):
        return 0
    by_byte = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 1000:
        counts = np.unpackbits(by_byte, axis=1).sum(0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(by_byte[:, j], minlength=256) @ _BITS for j in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, th, n, f0`` for every row: text hash, number of shingles and fingerprint as signed longs.

    Null and wordless texts have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [xxh64_shingles(text or "", words) for text in batch.column(2).to_pylist()]
            counts, prints = [len(h) for h in hashes], [fingerprint(h) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(prints, pa.int64())], ["doc_id", "th", "n", "f0"])

    ship(docs.sparkSession)
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    return source.mapInArrow(stream(run), "doc_id long, th long, n long, f0 long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pivot_table(f: Column) -> Column:
    """The distances to all pivots, a byte each, in one long."""
    table = None
    for k, p in enumerate(PIVOTS):
        d = F.shiftleft(F.bit_count(f.bitwiseXOR(F.lit(p))).cast("long"), 8 * k)
        table = d if table is None else table.bitwiseOR(d)
    return table


def _within(a: Column, b: Column, bits: int) -> Column:
    """Whether no coordinate of two pivot tables differs by more than ``bits``."""
    byte = lambda t, k: F.shiftrightunsigned(t, 8 * k).bitwiseAND(F.lit(255))
    return F.greatest(*[F.abs(byte(a, k) - byte(b, k)) for k in range(len(PIVOTS))]) <= bits


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def key_blocks(bits: int, fingerprints: int) -> int:
    """The least number of blocks whose keys have a bit more than it takes to number the fingerprints, as far as blocks have two bits."""
    for n in range(bits + 2, 33):
        if 64 * (n - bits) // n > max(fingerprints, 1).bit_length():
            return n
    return max(bits + 2, 32)


def block_masks(bits: int, n: int) -> list[int]:
    """Masks of each choice of ``n - bits`` of ``n`` blocks."""
    blocks = [sum(1 << k for k in range(64 * i // n, 64 * (i + 1) // n)) for i in range(n)]
    return [signed(sum(chosen)) for chosen in combinations(blocks, n - bits)]


def _link(nodes: DataFrame, keys: list[Column], bits: int) -> DataFrame:
    """``node, root`` of the components of fingerprints ``nodes.f0``."""
    # An exploded side has a row for each key, but is estimated as one row a fingerprint; the hints keep it from being broadcast.
    keyed = nodes.select("f0", F.explode(F.array(*keys)).alias("key"))
    reps = keyed.groupBy("key").agg(F.min("f0").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "rep")
    tabled = reps.withColumn("rep_table", _pivot_table(F.col("rep")))
    near = _within(_pivot_table(F.col("f0")), F.col("rep_table"), bits) & (_distance(F.col("f0"), F.col("rep")) <= bits) & (F.col("f0") != F.col("rep"))
    stars = keyed.hint("merge").join(tabled, ["key"]).where(near).select(F.col("f0").alias("a"), F.col("rep").alias("b")).distinct()
    roots = components(stars)
    # Links that the stars don't imply: members outside the main component of a key against members of other components.
    rooted = nodes.join(roots, nodes["f0"] == roots["node"], "left").withColumn("root", F.coalesce("root", "f0"))
    rooted = materialise(rooted.select("f0", "root", *[c for c in nodes.columns if c != "f0"]), "rooted")
    placed = rooted.select("f0", "root", F.explode(F.array(*keys)).alias("key"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by("root", "f0").alias("main")).where("lo <> hi").select("key", "main")
    right = placed.hint("merge").join(mixed, "key").where("root <> main")
    right = right.select(F.col("key").alias("k2"), F.col("f0").alias("fb"), _pivot_table(F.col("f0")).alias("t2"), F.col("root").alias("r2"))
    apart = (F.col("key") == F.col("k2")) & (F.col("root") != F.col("r2")) & _within(_pivot_table(F.col("f0")), F.col("t2"), bits) & (_distance(F.col("f0"), F.col("fb")) <= bits)
    rest = materialise(placed.hint("merge").join(right, apart).select(F.col("f0").alias("a"), F.col("fb").alias("b")).distinct(), "links")
    if rest.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest.select("a", "b")))


def close_groups(nodes: DataFrame, bits: int = BITS, blocks: int | None = None) -> DataFrame:
    """``node, root`` of the components of distinct fingerprints ``nodes.f0`` that differ in ``bits`` bits or fewer. ``nodes`` should be a written table."""
    masks = block_masks(bits, blocks or key_blocks(bits, nodes.count()))
    return _link(nodes, [F.xxhash64(F.lit(k), F.col("f0").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)], bits)


def grouped(prints: DataFrame, roots: DataFrame, node: str = "f0") -> DataFrame:
    """``prints`` with ``root`` and ``component_id``, the smallest id in the component."""
    least = prints.groupBy(F.col(node).alias("__node")).agg(F.min("doc_id").alias("least"))
    placed = least.join(roots, least["__node"] == roots["node"], "left").withColumn("root", F.coalesce("root", "__node"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(smallest, "root").select(F.col("__node").alias(node), "root", "component_id"), node)


def near_duplicates(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS, blocks: int | None = None) -> DataFrame:
    """``doc_id, th, n, f0, root, component_id`` for every row, linking fingerprints that differ in ``bits`` bits or fewer.

    ``component_id`` is the smallest id reachable over links, the row's own included; null ids
    never are, so it is null where all ids are. Null and wordless texts have
    fingerprint zero and link like any other. Repeated rows each give a row. An empty
    table gives none. Exact, whatever number of ``blocks``: no bucket is capped.
    """
    prints = materialise(fingerprints(docs, doc=doc, text=text, words=words), "fingerprints")
    nodes = materialise(prints.select("f0").distinct(), "nodes")
    return grouped(prints, close_groups(nodes, bits, blocks))


def one_of_each(docs: DataFrame, found: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one for each component of ``found``, the one with the smallest id.

    Rows without an id come last, ties go by text hash, and of rows that repeat id
    and text one stays. All columns pass through.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    best = found.groupBy("root").agg(F.min(order).alias("best")).select("root", "best.doc_id", "best.th").alias("k")
    found = found.alias("f")
    same = (F.col("f.root") == F.col("k.root")) & F.col("f.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("f.th") == F.col("k.th"))
    kept = found.join(best, same).groupBy(F.col("k.doc_id").alias("kept_id"), F.col("k.th").alias("kept_th")).agg(F.count(F.lit(1)).alias("n"))
    kept = materialise(kept, "kept")
    own = free_name(docs, "hash")
    hashed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = hashed.join(kept, hashed[doc].cast("long").eqNullSafe(kept["kept_id"]) & (hashed[own] == kept["kept_th"]), "left_semi")
    if not kept.where("n > 1").isEmpty():
        rows = rows.dropDuplicates([doc, own])
    return rows.drop(own)
