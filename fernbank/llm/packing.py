"""Packing documents into token sequences of a fixed capacity.

Both packers share the flow. Texts are tokenised where they are read; an overlong
document is split losslessly into full pieces and a remainder; pieces go to
randomised groups by a hash of their document and task, so that a group holds about
``group_bytes`` of text whatever the corpus size and no key is hot, rows that repeat
everything included; and every group is packed on its own. Only ids move, once.

* ``pack_first_fit``: first-fit decreasing. A tournament tree over the bins'
  free capacities finds the first bin that has room in O(log bins).
* ``pack_best_fit``: best-fit decreasing. A segment tree over capacities
  0..capacity, holding how many bins have each, finds the least sufficient one in
  O(log capacity).

What padding is left is then traded for cuts: while padding exceeds
``max_padding`` of a group's tokens, its emptiest bin is cut up into the gaps of
the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .bpe import tokenizer
from .memory import group, stream
from .sketch import mix
from .work import tasks

CAPACITY = 2048
#: Text bytes that one group of documents holds on average.
GROUP_BYTES = 4 << 20
#: Padding that a group may keep before bins are cut up, as a part of its tokens.
MAX_PADDING = 0.002
#: Groups that one task packs, about.
TASK_GROUPS = 8
#: Sequence ids are the group's number times this, plus the bin's number.
BINS = 1 << 24

_PIECES = "grp long, doc_id long, start long, doc_tokens long, ids binary"
_PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Tournament:
    """First bin with enough room: a tree of maxima over the bins' free capacities."""

    def __init__(self, bins: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [0] * (2 * self.leaves)

    def set(self, b: int, free: int) -> None:
        """Give bin ``b`` this free capacity."""
        i = b + self.leaves
        self.tree[i] = free
        while i > 1:
            i >>= 1
            most = max(self.tree[2 * i], self.tree[2 * i + 1])
            if self.tree[i] == most:
                break
            self.tree[i] = most

    def first(self, need: int) -> int:
        """The first bin with at least ``need`` free, or -1."""
        if self.tree[1] < need:
            return -1
        i = 1
        while i < self.leaves:
            i *= 2
            i += self.tree[i] < need
        return i - self.leaves


class Capacities:
    """Least sufficient capacity: a segment tree of how many bins have each free capacity."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, free: int, n: int) -> None:
        i = free + self.leaves
        while i:
            self.tree[i] += n
            i >>= 1

    def push(self, b: int, free: int) -> None:
        """Bin ``b`` now has this free capacity."""
        self.bins[free].append(b)
        self._add(free, 1)

    def pop(self, need: int) -> tuple[int, int]:
        """Take out a bin with the least free capacity of at least ``need``: (bin, free), or (-1, 0)."""
        i = need + self.leaves
        while not self.tree[i]:
            while i & 1:
                i >>= 1
                if i <= 1:
                    return -1, 0
            i += 1
        while i < self.leaves:
            i *= 2
            i += not self.tree[i]
        free = i - self.leaves
        self._add(free, -1)
        return self.bins[free].pop(), free


def first_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``, which must not increase."""
    bins: list[list[int]] = []
    free: list[int] = []
    tree = Tournament(len(lengths))
    for k, n in enumerate(lengths):
        b = -1 if n == capacity else tree.first(n)
        if b < 0:
            b = len(bins)
            bins.append([])
            free.append(capacity)
        bins[b].append(k)
        free[b] -= n
        tree.set(b, free[b])
    return bins


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``, which must not increase."""
    bins: list[list[int]] = []
    tree = Capacities(capacity)
    for k, n in enumerate(lengths):
        b, free = tree.pop(n)
        if b < 0:
            b, free = len(bins), capacity
            bins.append([])
        bins[b].append(k)
        if free > n:
            tree.push(b, free - n)
    return bins


def fill_up(bins: list[list[tuple[int, int, int]]], capacity: int, max_padding: float) -> list[list[tuple[int, int, int]]]:
    """Cut the emptiest bins of (piece, from, to) into the gaps of the others until padding is small.

    A bin filled to a power of two counts as having no padding.
    """
    fills = [sum(b - a for _, a, b in x) for x in bins]
    total = sum(fills)
    padded = [(fill, i) for i, fill in enumerate(fills) if fill & (fill - 1)]
    waste = sum(capacity - fill for fill, _ in padded)
    padded.sort(reverse=True)
    gap = 0
    while padded and waste > max_padding * total:
        fill, i = padded.pop()
        if sum(capacity - f for f, _ in padded) < fill:
            break
        waste -= capacity
        rest = bins[i]
        bins[i] = []
        while rest:
            piece, a, b = rest.pop()
            while a < b:
                if gap >= len(padded):
                    raise AssertionError("gaps were counted before")
                f, j = padded[gap]
                take = min(b - a, capacity - f)
                if take:
                    bins[j].append((piece, a, a + take))
                    padded[gap] = (f + take, j)
                    a += take
                if padded[gap][0] == capacity:
                    gap += 1
        padded = padded[gap:]
        gap = 0
    return [x for x in bins if x]


def _pieces(path: str, end_id: int, capacity: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = tokenizer(path)
        end, width = t.one(end_id), len(t.one(end_id))
        step = capacity * width
        out: tuple[list, ...] = ([], [], [], [], [])
        held = 0
        task = int(mix(np.array([TaskContext.get().partitionId()], np.uint64))[0])
        repeats: dict[int, int] = {}  # how often a seed has come: whatever their order, rows that repeat get the same groups

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["grp", "doc_id", "start", "doc_tokens", "ids"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for doc_id, text, seed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = t.encode(text or "") + end
                n = len(ids) // width
                repeats[seed] = nth = repeats.get(seed, -1) + 1
                if len(repeats) > 1 << 20:
                    repeats.clear()
                for k, at in enumerate(range(0, len(ids), step)):
                    for c, v in zip(out, ((seed + task + nth + k) % groups, doc_id, at // width, n, ids[at : at + step])):
                        c.append(v)
                    held += min(step, len(ids) - at)
                    if held >= 8 << 20:
                        yield flush()
                        held = 0
        if out[0]:
            yield flush()

    return run


def _arranged(table: pa.Table, width: int, capacity: int, max_padding: float, best: bool) -> tuple[list, list[list[tuple[int, int, int]]]]:
    """The columns of a group's pieces and its bins of (piece, from, to)."""
    columns = [table.column(c).to_pylist() for c in ("grp", "doc_id", "start", "doc_tokens", "ids")]
    _, doc_id, start, _, ids = columns
    order = sorted(range(len(ids)), key=lambda i: (-len(ids[i]), doc_id[i] is None, doc_id[i] or 0, start[i], ids[i]))
    lengths = [len(ids[i]) // width for i in order]
    bins = (best_fit if best else first_fit)(lengths, capacity)
    return columns, fill_up([[(order[k], 0, lengths[k]) for k in b] for b in bins], capacity, max_padding)


def _pack(width: int, capacity: int, max_padding: float, best: bool):
    def run(table: pa.Table) -> pa.Table:
        (grp, doc_id, start, doc_tokens, ids), bins = _arranged(table, width, capacity, max_padding, best)
        cols: tuple[list, ...] = tuple([] for _ in range(7))
        for b, parts in enumerate(bins):
            at = 0
            for i, lo, hi in parts:
                part = np.frombuffer(ids[i], f"<u{width}")[lo:hi].astype("<u4").tobytes()
                for c, v in zip(cols, (doc_id[i], start[i] + lo, hi - lo, doc_tokens[i], grp[i] * BINS + b, at, part)):
                    c.append(v)
                at += hi - lo
        return pa.table([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def _groups(docs: DataFrame, path: str, end_id: int, doc: str, text: str, capacity: int, group_bytes: int) -> tuple[GroupedData, int]:
    """Pieces of all documents by randomised group, and the bytes of an id in them."""
    ship(docs.sparkSession)
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = source.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 2)).first()[0] or 0  # and the end id
    groups = max(1, -(-total // group_bytes))
    seeded = source.withColumn("seed", F.xxhash64("doc_id", "text"))
    pieces = seeded.mapInArrow(stream(_pieces(path, end_id, capacity, groups)), _PIECES)
    return pieces.repartition(tasks(groups, TASK_GROUPS), "grp").groupBy("grp"), len(tokenizer(path).one(0))


def _packed(docs: DataFrame, path: str, end_id: int, doc: str, text: str, capacity: int, group_bytes: int, max_padding: float, best: bool) -> DataFrame:
    grouped, width = _groups(docs, path, end_id, doc, text, capacity, group_bytes)
    return grouped.applyInArrow(group(_pack(width, capacity, max_padding, best)), _PACKED)


def pack_first_fit(
    docs: DataFrame, path: str, *, end_id: int = 1, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES, max_padding: float = MAX_PADDING
) -> DataFrame:
    """Pieces of all documents in sequences, by first-fit decreasing in randomised groups.

    One row for each piece: ``doc_id, start, length, doc_tokens, sequence_id,
    offset, ids``; ``ids`` are little-endian unsigned 32-bit. A document is its ids
    and then ``end_id``; each of its ids is in one piece. Offsets of a sequence have
    no gaps from 0. A null text is an empty one (the end id alone); a null id stays
    null; repeated rows are documents of their own; ties in length are taken in
    order of id, start and ids. An empty table gives no rows. Other columns are
    ignored.
    """
    return _packed(docs, path, end_id, doc, text, capacity, group_bytes, max_padding, False)


def pack_best_fit(
    docs: DataFrame, path: str, *, end_id: int = 1, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES, max_padding: float = MAX_PADDING
) -> DataFrame:
    """As ``pack_first_fit``, by best-fit decreasing."""
    return _packed(docs, path, end_id, doc, text, capacity, group_bytes, max_padding, True)


_MATRIX = "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, position_ids binary"


def _matrix_rows(width: int, capacity: int, max_padding: float, best: bool, pad_id: int):
    def run(table: pa.Table) -> pa.Table:
        (grp, doc_id, start, _, ids), bins = _arranged(table, width, capacity, max_padding, best)
        count = np.arange(capacity, dtype="<u2" if capacity <= 1 << 16 else "<u4")
        cols: tuple[list, ...] = tuple([] for _ in range(7))
        for b, parts in enumerate(bins):
            row, positions, ends = np.full(capacity, pad_id, "<u4"), count.copy(), [0]
            for i, lo, hi in parts:
                at, to = ends[-1], ends[-1] + hi - lo
                row[at:to] = np.frombuffer(ids[i], f"<u{width}")[lo:hi]
                positions[at:to] = count[: hi - lo]
                ends.append(to)
            positions[ends[-1] :] = count[: capacity - ends[-1]]
            values = (grp[0] * BINS + b, ends[-1], [doc_id[i] for i, _, _ in parts], [start[i] + lo for i, lo, _ in parts], ends, row.tobytes(), positions.tobytes())
            for c, v in zip(cols, values):
                c.append(v)
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "position_ids"])

    return run


def pack_matrices(
    docs: DataFrame, path: str, *, end_id: int = 1, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES, max_padding: float = MAX_PADDING,
    best: bool = True, pad_id: int = 0,
) -> DataFrame:
    """The packed id matrix: a row for each sequence, best-fit unless ``best`` is false. Cases as in ``pack_first_fit``.

    ``ids`` is the row itself: ``capacity`` little-endian unsigned 32-bit ids, padded
    with ``pad_id``. ``cu_seqlens`` are the cumulative segment lengths from 0 to
    ``n_tokens``. ``position_ids`` (unsigned 16-bit, 32-bit for capacities over 65,536)
    begin again from 0 at every segment and in the padding. ``doc_ids`` and ``starts``
    say which part of which document a segment is.
    """
    grouped, width = _groups(docs, path, end_id, doc, text, capacity, group_bytes)
    return grouped.applyInArrow(group(_matrix_rows(width, capacity, max_padding, best, pad_id)), _MATRIX)
