"""Near-duplicates at a similarity threshold: prefix filter, SimHash with pivot tables, candidates by key for the rest, exact sets.

A text is the set of its five-word shingles; two texts are alike if the sets' Jaccard
similarity is ``similarity`` or more, and groups are the connected components.

1. Texts become *blocks* of packed shingle keys, and how many sets hold a key is counted
   over the whole corpus (``exchange``). Only the power of two of that count goes back.
2. Two sets this much alike share one of each one's rarest ``n - ceil(similarity n) + 1``
   keys, whatever the order, if it is the same for both. With the true rarity as order
   those are nearly all keys of a single set, which join nothing and are left out; so
   few documents have any key left, and no link between alike texts is lost.
3. Texts that have one get SimHash fingerprints of 128 bits. Those that differ in at most
   ``CLOSE`` bits of the first 64 are grouped as in ``simhash``: block keys bring them
   together, pivot tables discard, the exact distance decides.
4. Texts at the threshold differ in more bits than block keys or pivots can bring
   together. So texts of several such groups that share a key are held together by all
   128 bits (six standard errors beyond what the threshold implies; sets of fewer than
   ``SHORT`` shingles always pass). Both kinds of links join texts to loose groups.
5. Within a loose group the shingle sets themselves decide, again as a spanning forest.

No group is expanded into its pairs. A key or loose group too large for one task is cut
into chunks that each have the group's first member, so a group of copies is linked
through it in linear time; only members that stay apart from the main component meet all
other chunks. Sets with equal shingles are one node from the start, so exact copies cost
one row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .exchange import gathered, names, pack, pack_sorted, rows, slices, unpack, unpack_sorted
from .graph import components
from .memory import cogroup, group, stream
from .simhash import close_groups, fingerprint, grouped, signed
from .sketch import distinct, mix, shingle_hashes
from .work import bucketed, bytes_of, materialise, tasks

WORDS, SIMILARITY = 5, 0.8
#: Standard errors by which the distance of two fingerprints may exceed what the threshold implies, and sets too small for fingerprints to tell.
LOOSE, SHORT = 6, 64
#: Differing bits of the first lane up to which pivot tables find a text's like.
CLOSE = 6
#: Shingles of a block of documents and, about, keys in a range.
BLOCK = 1 << 20
#: Texts that share a key and meet in one task, and shingles of a loose group that do; larger ones are cut into chunks.
CHUNK, CHUNK_SHINGLES = 4096, 1 << 20
#: A list of documents to compare of more bytes than this is joined by shuffle; on the driver a broadcast takes about six times its bytes.
BROADCAST_BYTES = 2 << 20
#: Bits, at most, of the bitmap that keeps other documents' texts out of that shuffle.
FILTER_BITS = 1 << 25
#: Buckets of up to so many members are compared in step with each other.
_FEW = 8
_LANES = [np.uint64(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1) for k in (1, 2)]


def set_hash(hashes: np.ndarray) -> int:
    """Hash of a set of hashes (ascending), signed; zero if it is empty."""
    return signed(xxhash.xxh64_intdigest(hashes.tobytes(), 42)) if len(hashes) else 0


# ---- candidates

_BLOCKS = "b long, doc_ids array<long>, ths array<long>, nodes array<long>, lengths array<long>, keys binary"
_ASKED = "p long, b long, n long, keys binary, numbers binary"
_ANSWERED = "b long, p long, n long, levels binary"
_PRINTS = "doc_id long, th long, node long, n long, f0 long, f1 long, prefix array<long>"


def _blocks(words: int, bits: int, block: int):
    mask = np.uint64((1 << 64) - (1 << 64 - bits))
    kinds = (pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 24, ([], [], [], []), 0

        def close() -> pa.RecordBatch:
            ids, ths, nodes, keys = held
            # each document's keys by their differences; its first by itself
            packed = pack(np.concatenate([np.diff(k, prepend=np.uint64(0)) for k in keys]))
            values = ([number], [ids], [ths], [nodes], [[len(k) for k in keys]], [packed])
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names(_BLOCKS))

        for batch in batches:
            for doc_id, th, text in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = distinct(shingle_hashes(text or "", words))
                for c, v in zip(held, (doc_id, th, set_hash(hashes), hashes & mask)):
                    c.append(v)
                size += len(hashes)
                if size >= block or len(held[0]) >= block // 16:
                    yield close()
                    number, held, size = number + 1, ([], [], [], []), 0
        if held[0]:
            yield close()

    return run


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, starts, all keys) of a block's documents."""
    lengths = np.array(row["lengths"], np.int64)
    ends = np.cumsum(lengths)
    keys = np.cumsum(unpack(row["keys"], int(lengths.sum())), dtype=np.uint64)
    starts = ends - lengths
    before = np.where(starts > 0, keys[np.maximum(starts, 1) - 1] if len(keys) else np.uint64(0), np.uint64(0))
    return lengths, starts, keys - np.repeat(before, lengths)


def _ask(ranges: int):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows(batch):
                lengths, _, keys = _unpacked(row)
                first = np.zeros(len(lengths), bool)
                first[np.unique(np.array(row["nodes"], np.int64), return_index=True)[1]] = True
                own, counts = np.unique(keys[np.repeat(first, lengths)], return_counts=True)  # a set counts once, whatever its copies
                found = [(p, row["b"], b - a, pack_sorted(own[a:b]), pack(counts[a:b])) for p, a, b in slices(own, ranges)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], names(_ASKED))

    return run


def _levels(table: pa.Table) -> pa.Table:
    """For every block that asked, the power of two of its keys' counts; zero for a single set's."""
    asked = table.to_pylist()
    keys, at = np.unique(np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in asked]), return_inverse=True)
    sums = np.bincount(at, np.concatenate([unpack(r["numbers"], r["n"]) for r in asked]).astype(np.float64), len(keys))
    levels, begin, out = np.log2(np.maximum(sums, 1)).astype(np.uint64), 0, []
    for r in asked:
        out.append((r["b"], r["p"], r["n"], pack(levels[at[begin : begin + r["n"]]])))
        begin += r["n"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names(_ANSWERED))


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many of its rarest keys a set of ``n`` needs to share one with any set this much alike."""
    return np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)


def _prefixes(similarity: float):
    kinds = (*[pa.int64()] * 6, pa.list_(pa.int64()))

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names(_PRINTS))
        row = table.to_pylist()[0]
        lengths, starts, keys = _unpacked(row)
        levels = gathered(answers, "levels").astype(np.int64)[np.unique(keys, return_inverse=True)[1]]
        doc = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(doc << 8 | levels, kind="stable")  # by rarity, ties by key
        place = np.arange(len(keys)) - starts[doc]
        picked = order[(place < prefix_length(lengths, similarity)[doc]) & (levels[order] > 0)]
        cuts = np.searchsorted(doc[picked], np.arange(len(lengths) + 1))
        values = keys.view(np.int64)
        prefixes, lanes = [], np.zeros((2, len(lengths)), np.int64)
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            prefixes.append(values[picked[a:b]])
            if b > a:
                own_keys = keys[starts[k] : starts[k] + lengths[k]]
                lanes[:, k] = [fingerprint(mix(own_keys ^ lane)) for lane in _LANES]
        columns = (row["doc_ids"], row["ths"], row["nodes"], lengths, *lanes, prefixes)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names(_PRINTS))

    return run


def _prints(docs: DataFrame, doc: str, text: str, words: int, similarity: float, block: int) -> DataFrame:
    """``doc_id, th, node, n, f0, f1, prefix`` for every row; fingerprints only where the prefix has keys of several sets."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    bits = min(64, max(24, size.bit_length() + 4))  # keys that fall together cost a comparison, never a link
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    blocks = bucketed(source.mapInArrow(stream(_blocks(words, bits, block)), _BLOCKS), "set_blocks", max(32, tasks(size, 8 * block)), "b")
    ranges = max(32, size // (8 * block))
    asked = blocks.select(*names(_BLOCKS)).mapInArrow(stream(_ask(ranges)), _ASKED)
    answers = materialise(asked.repartition(tasks(ranges, 4), "p").groupBy("p").applyInArrow(group(_levels), _ANSWERED), "levels")
    return materialise(blocks.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(cogroup(_prefixes(similarity)), _PRINTS), "prints")


# ---- loosely close fingerprints


class Loose:
    """Which sets' fingerprints and sizes allow the similarity."""

    def __init__(self, similarity: float) -> None:
        # two lanes of a pair at the threshold differ in 128 p bits on average
        p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
        self.similarity, self.limit = similarity, round(128 * p + LOOSE * (128 * p * (1 - p)) ** 0.5)

    def near(self, a: tuple, b: tuple) -> np.ndarray:
        """Whether columns ``(n, f0, f1)`` of ``a`` and ``b`` do."""
        less, more = np.minimum(a[0], b[0]), np.maximum(a[0], b[0])
        close = np.bitwise_count(a[1] ^ b[1]) + np.bitwise_count(a[2] ^ b[2]) <= self.limit
        return (close | (less < SHORT)) & (less >= (self.similarity - 1e-9) * more)

    def forest(self, columns: tuple) -> list[tuple[int, int]]:
        """Edges (positions) of a spanning forest."""
        edges: list[tuple[int, int]] = []
        todo, stack = np.arange(len(columns[0])), []
        while len(todo):
            if not stack:
                stack, todo = [int(todo[0])], todo[1:]
            x = stack.pop()
            near = self.near(tuple(c[todo] for c in columns), tuple(c[x] for c in columns))
            found = todo[near].tolist()
            edges += [(x, y) for y in found]
            stack += found
            todo = todo[~near]
        return edges

    def of_runs(self, key: np.ndarray, node: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges between nodes within the runs of equal keys."""
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        sizes = np.diff(np.append(starts, len(key)))
        few = np.repeat(sizes <= _FEW, sizes)
        left, right = [], []
        for s in range(1, min(_FEW, len(key))):
            at = np.flatnonzero(few[s:] & (key[s:] == key[:-s]))
            at = at[self.near(tuple(c[at] for c in columns), tuple(c[at + s] for c in columns))]
            left.append(node[at])
            right.append(node[at + s])
        for k in np.flatnonzero(sizes > _FEW):
            a, b = starts[k], starts[k] + sizes[k]
            edges = np.array(self.forest(tuple(c[a:b] for c in columns)), np.int64).reshape(-1, 2)
            left.append(node[a:b][edges[:, 0]])
            right.append(node[a:b][edges[:, 1]])
        return tuple(np.concatenate([*x, np.zeros(0, node.dtype)]) for x in (left, right))

    def of_mixed_runs(self, key: np.ndarray, close: np.ndarray, node: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges within the runs of equal keys whose members are of several groups ``close``."""
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        mixed = np.repeat(np.minimum.reduceat(close, starts) < np.maximum.reduceat(close, starts), np.diff(np.append(starts, len(key))))
        return self.of_runs(key[mixed], node[mixed], *(c[mixed] for c in columns))

    def across(self, left: pa.Table, right: pa.Table) -> Iterator[np.ndarray]:
        """For each row on the left, the positions on the right that are near."""
        a, b = ([t.column(c).to_numpy().view(np.uint64) for c in ("n", "f0", "f1")] for t in (left, right))
        for k in range(left.num_rows):
            yield np.flatnonzero(self.near(tuple(c[k] for c in a), tuple(b)))


def by_key(edges: Callable) -> Callable:
    """Apply ``edges`` to whole runs of equal keys, the first of several columns of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(table: pa.Table) -> pa.RecordBatch:
            a, b = edges(*(c.to_numpy().view(np.uint64) for c in table.columns))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[pa.RecordBatch] = []  # the rows of a key that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            other = np.flatnonzero(key != key[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and (cut or held[-1].column(0)[-1].as_py() != key[0]):
                yield flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield flush(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _loose_groups(nodes: DataFrame, loose: Loose, chunk: int) -> DataFrame:
    """``node, root``: components of ``nodes(node, n, f0, f1, prefix, close)`` that are in one SimHash group ``close``, or share a key and are loosely close."""
    kept = ("node", "n", "f0", "f1")
    least = nodes.groupBy("close").agg(F.min("node").alias("b"))
    by_print = nodes.join(least, "close").where("node <> b").select(F.col("node").alias("a"), "b")
    keyed = nodes.select(F.explode("prefix").alias("key"), "close", *kept).distinct()
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(*kept, "close")).alias("first")).where(F.col("members") > chunk)
    hot = materialise(counts.withColumn("chunks", F.ceil(F.col("members") / chunk)), "hot-keys")
    is_hot = not hot.isEmpty()
    salted = keyed
    if is_hot:
        chunks = hot.select("key", "chunks")
        own = keyed.join(chunks, "key", "left").withColumn("salt", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("node"), "chunks")))
        firsts = hot.select("key", "first.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("salt"))
        both = own.select("key", "salt", "close", *kept).unionByName(firsts.select("key", "salt", "close", *kept))
        salted = both.select(F.when(F.col("salt").isNull(), F.col("key")).otherwise(F.xxhash64("key", "salt")).alias("key"), "close", *kept)
    by_set = salted.select("key", "close", *kept).repartition("key").sortWithinPartitions("key").mapInArrow(stream(by_key(loose.of_mixed_runs)), "a long, b long")
    roots = components(by_print.unionByName(by_set).distinct())
    if is_hot:
        members = keyed.join(hot.select("key"), "key").join(roots, "node", "left")
        placed = members.select(F.col("key").alias("group"), *kept, F.coalesce("root", "node").alias("root"), F.lit(1).alias("weight"))
        roots = _with_rest(roots, placed, loose, chunk)
    return roots


# ---- exact sets


class Exact:
    """Which sets are alike."""

    def __init__(self, similarity: float) -> None:
        self.similarity = similarity

    @staticmethod
    def _sets(table: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), np.int64) for x in table.column("hashes")]

    @staticmethod
    def _index(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in sets], np.int64)
        values, owners = np.concatenate([*sets, np.zeros(0, np.int64)]), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        order = np.argsort(values, kind="stable")
        return sizes, values[order], owners[order]

    def _near(self, x: np.ndarray, index: tuple) -> np.ndarray:
        sizes, values, owners = index
        a, b = np.searchsorted(values, x), np.searchsorted(values, x, "right")
        n = b - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())  # the positions of all of x's values
        shared = np.bincount(owners[at], minlength=len(sizes))
        return (shared > 0) & (shared >= self.similarity * (sizes + len(x) - shared) - 1e-9)

    def forest(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Edges (positions) of a spanning forest; empty sets have none."""
        index = self._index(sets)
        edges: list[tuple[int, int]] = []
        todo, stack = np.ones(len(sets), bool), []
        for begin in range(len(sets)):
            if not todo[begin]:
                continue
            stack, todo[begin] = [begin], False
            while stack:
                x = stack.pop()
                found = np.flatnonzero(self._near(sets[x], index) & todo).tolist()
                todo[found] = False
                edges += [(x, y) for y in found]
                stack += found
        return edges

    def chunk(self, table: pa.Table) -> pa.Table:
        """Edges between a chunk's nodes."""
        node = table.column("node").to_numpy()
        edges = np.array(self.forest(self._sets(table)), np.int64).reshape(-1, 2)
        return pa.table({"a": node[edges[:, 0]], "b": node[edges[:, 1]]})

    def across(self, left: pa.Table, right: pa.Table) -> Iterator[np.ndarray]:
        """For each row on the left, the positions on the right that are alike."""
        index = self._index(self._sets(right))
        for x in self._sets(left):
            yield np.flatnonzero(self._near(x, index))


def _with_rest(roots: DataFrame, members: DataFrame, kernel: Loose | Exact, limit: int) -> DataFrame:
    """``roots`` with the links between ``members(group, node, root, weight, ...)`` of a group's different components.

    Only members outside a group's main component are held against its others, in
    chunks of about ``limit`` weight on either side.
    """
    groups = members.groupBy("group").agg(F.min_by("root", "node").alias("main"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum("weight").alias("all")).where("lo <> hi")
    groups = materialise(groups.select("group", "main", "all"), "mixed")
    if groups.isEmpty():
        return roots
    placed = members.join(groups, "group").withColumn("apart", F.col("root") != F.col("main"))
    lefts = placed.where("apart").groupBy("group").agg(F.ceil(F.sum("weight") / limit).alias("lefts"))
    placed = placed.join(lefts, "group").withColumn("rights", F.ceil(F.col("all") / limit))
    kept = [F.col(c) for c in members.columns]
    zero, h = F.lit(0).cast("long"), F.xxhash64("node")
    left = placed.where("apart").select(*kept, F.pmod(h, "lefts").alias("i"), F.explode(F.sequence(zero, F.col("rights") - 1)).alias("j"), F.lit(True).alias("left"))
    right = placed.select(*kept, F.explode(F.sequence(zero, F.col("lefts") - 1)).alias("i"), F.pmod(h, "rights").alias("j"), F.lit(False).alias("left"))

    def run(table: pa.Table) -> pa.Table:
        is_left = table.column("left")
        a, b = table.filter(is_left), table.filter(pc.invert(is_left))
        own, node, other, root = a.column("node").to_numpy(), b.column("node").to_numpy(), a.column("root").to_numpy(), b.column("root").to_numpy()
        pairs = []
        for k, near in enumerate(kernel.across(a, b) if a.num_rows and b.num_rows else ()):
            near = near[root[near] != other[k]]
            near = near[np.unique(root[near], return_index=True)[1]]  # one link to each component
            pairs.append(np.stack([np.full(len(near), own[k]), node[near]]))
        found = np.concatenate([*pairs, np.zeros((2, 0), np.int64)], 1).astype(np.int64)
        return pa.table({"a": found[0], "b": found[1]})

    rest = materialise(left.unionByName(right).groupBy("group", "i", "j").applyInArrow(group(run), "a long, b long").distinct(), "rest")
    return roots if rest.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest))


def _maybe(texts: DataFrame, wanted: DataFrame, bits: int | None = None) -> DataFrame:
    """The rows of ``texts`` that are in ``wanted`` by ``doc_id`` and ``th``, and a few others: a bitmap of hashes tells most of those."""
    bits = bits or min(FILTER_BITS, 1 << max(15, (16 * wanted.count()).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id", "th"), F.lit(bits)) + 1
    at, bucket = F.bitmap_bit_position(slot), F.bitmap_bucket_number(slot)
    maps = materialise(wanted.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(at).alias("bitmap")), "bitmap")
    byte = F.conv(F.hex(F.substring("bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = texts.withColumn("bucket", bucket).join(F.broadcast(maps), "bucket").where(F.getbit(byte, (at % 8).cast("int")) == 1)
    return found.select(*texts.columns)


def _sets(docs: DataFrame, wanted: DataFrame, doc: str, text: str, words: int, broadcast_bytes: int) -> DataFrame:
    """``group, node, weight, chunks, hashes``: the shingle sets of the documents ``wanted(group, node, weight, chunks, doc_id, th)``."""
    kept = ("group", "node", "weight", "chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                sets = [distinct(shingle_hashes(x or "", words)).tobytes() for x in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sets, pa.binary())], [*kept, "hashes"])

    texts = docs.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    if bytes_of(wanted) <= broadcast_bytes:
        wanted = F.broadcast(wanted)
    else:
        texts, wanted = _maybe(texts, wanted), wanted.hint("merge")
    wanted = wanted.select(*kept, F.col("doc_id").alias("wanted_id"), F.col("th").alias("wanted_th"))
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("th") == F.col("wanted_th")))
    return found.select(*kept, "text").mapInArrow(stream(run), "group long, node long, weight long, chunks long, hashes binary")


def similar(
    docs: DataFrame, *, doc: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK, chunk: int = CHUNK,
    chunk_shingles: int = CHUNK_SHINGLES, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``doc_id, th, n, root, component_id`` for every row, linking texts whose shingle sets have this Jaccard similarity.

    ``th`` is the text's hash, ``n`` its number of different shingles, ``root`` the
    group and ``component_id`` the smallest id in it (null ids never are, so it is null
    where all ids are). A text of fewer words is one shingle; null and wordless texts
    are copies of each other. Repeated rows each give a row, other columns are ignored,
    and an empty table gives no rows.
    """
    ship(docs.sparkSession)
    prints = _prints(docs, doc, text, words, similarity, block)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "n", "f0", "f1", "prefix"))
    nodes = prints.where(F.size("prefix") > 0).groupBy("node").agg(first.alias("s")).select("node", "s.*").drop("none")
    nodes = materialise(nodes, "nodes")
    close = close_groups(materialise(nodes.select("f0").distinct(), "fingerprints"), CLOSE).select(F.col("node").alias("print"), "root")
    nodes = materialise(nodes.join(close, nodes["f0"] == close["print"], "left").withColumn("close", F.coalesce("root", "f0")).drop("print", "root"), "close")
    loose = _loose_groups(nodes, Loose(similarity), chunk)
    # every node of a loose group, its least one included, with the chunks that the group is cut into
    roots = loose.select("root").distinct()
    members = loose.select("node", F.col("root").alias("group")).unionByName(roots.select(F.col("root").alias("node"), F.col("root").alias("group"))).distinct()
    wanted = members.join(nodes.select("node", "doc_id", "th", F.col("n").alias("weight")), "node")
    chunks = wanted.groupBy("group").agg(F.ceil(F.sum("weight") / chunk_shingles).alias("chunks"))
    wanted = materialise(wanted.join(chunks, "group").select("group", "node", "weight", "chunks", "doc_id", "th"), "wanted")
    sets = _sets(docs, wanted, doc, text, words, broadcast_bytes)
    if not prints.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        sets = sets.groupBy("group", "node").agg(F.first("weight").alias("weight"), F.first("chunks").alias("chunks"), F.first("hashes").alias("hashes"))
    sets = materialise(sets, "sets")
    own = F.array(F.pmod(F.xxhash64("node"), "chunks"))
    placed = sets.withColumn("chunk", F.explode(F.when(F.col("node") == F.col("group"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(own)))
    exact = Exact(similarity)
    links = placed.groupBy("group", "chunk").applyInArrow(group(exact.chunk), "a long, b long")
    roots = components(links.distinct())
    parted = sets.where("chunks > 1")
    if not parted.isEmpty():
        cut = parted.join(roots, "node", "left").select("group", "node", "weight", "hashes", F.coalesce("root", "node").alias("root"))
        roots = _with_rest(roots, cut, exact, chunk_shingles)
    return grouped(prints.select("doc_id", "th", "node", "n"), roots, "node").drop("node")
