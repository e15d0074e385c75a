"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's shingles are its runs of five words (all of it, if it has fewer), after
ASCII lower-casing and with white space as one space. Each gets a 64-bit hash, and
the sketch keeps every hash below ``1/scaled`` of the range, and the ``LEAST`` least
ones in any case, so short texts keep all. Sketches of parts merge into the sketch of
the whole. A sketch itself tells the threshold below which it is complete; two are
compared below the smaller of theirs, and the part of one found in the other
estimates containment however unequal the texts are.

Hashes of all shingles of a text are made at once: a running polynomial over the
bytes gives any byte range's hash by one subtraction and one multiplication
modulo 2^64, and a bit mixer spreads it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .memory import stream

SHINGLE = 5
#: One hash in so many is kept.
SCALED = 2
#: So many of the least hashes are kept in any case.
LEAST = 64
#: Text bytes of a range of ids, about, and the most ranges.
RANGE_BYTES, MAX_RANGES = 8 << 20, 10_000
#: Bytes of a kept hash in the fingerprint string, the high ones.
KEPT_BYTES = 4
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: Powers that are kept for later texts; longer tables go with their text.
_KEPT_POWERS = 1 << 18


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _KEPT_POWERS:
        return tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)))) for base in (_BASE, _UNBASE))
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, ascending, by a sort."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (two rounds of shift and multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without 0x20 and 0x09-0x0D in UTF-8 ``data``."""
    visible = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(visible[1:] != visible[:-1]) + 1
    if len(data) and visible[0]:
        edge = np.concatenate(([0], edge))
    if len(data) and visible[-1]:
        edge = np.concatenate((edge, [len(data)]))
    return edge[0::2], edge[1::2]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range of ``data``; equal bytes have equal hashes wherever they stand."""
    power, inverse = _power_tables(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=run[1:])
    return mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(text: str, words: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of ``text``, repeats included; none if it has no word."""
    flat = b" ".join(text.encode().lower().split())
    if not flat:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(flat, np.uint8)
    starts, ends = word_bounds(data)
    k = min(words, len(starts))
    return range_hashes(data, starts[: len(starts) - k + 1], ends[k - 1 :])


def sketch(hashes: np.ndarray, scaled: int = SCALED) -> np.ndarray:
    """The kept hashes, sorted, cut to their high bytes."""
    return _cut(distinct(hashes >> np.uint64(8 * (8 - KEPT_BYTES))), scaled)


def _cut(high: np.ndarray, scaled: int) -> np.ndarray:
    """Of sorted, distinct high bytes those that a sketch keeps."""
    return high[: max(LEAST, int(np.searchsorted(high, np.uint64((1 << 8 * KEPT_BYTES) // scaled))))]


def complete_below(kept: np.ndarray, scaled: int = SCALED) -> int:
    """The bound below which a sketch has every hash of its text."""
    if len(kept) < LEAST:
        return 1 << 8 * KEPT_BYTES
    return max((1 << 8 * KEPT_BYTES) // scaled, int(kept[-1]) + 1)


def merge(a: np.ndarray, b: np.ndarray, scaled: int = SCALED) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    both = np.union1d(a, b)
    return _cut(both[both < np.uint64(min(complete_below(a, scaled), complete_below(b, scaled)))], scaled)


def to_string(kept: np.ndarray) -> str:
    """The sketch as text: big-endian hashes in base 64."""
    return base64.b64encode(kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEPT_BYTES :].tobytes()).decode()


def from_string(fingerprint: str) -> np.ndarray:
    """The sketch that ``to_string`` wrote."""
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, KEPT_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - KEPT_BYTES :] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray, scaled: int = SCALED) -> float:
    """The part of sketch ``a`` found in ``b``, below the bound to which both are complete; two empty sketches are alike, one is not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    bound = np.uint64(min(complete_below(a, scaled), complete_below(b, scaled)))
    a, b = a[a < bound], b[b < bound]
    if not len(a):
        return 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray, scaled: int = SCALED) -> float:
    """The larger of both containments: 1 if either text is wholly within the other."""
    return max(containment(a, b, scaled), containment(b, a, scaled))


def fingerprints(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", words: int = SHINGLE, scaled: int = SCALED) -> DataFrame:
    """``doc_id, fingerprint`` for every row. A null text is an empty one, which has an empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [to_string(sketch(shingle_hashes(t or "", words), scaled)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    ship(docs.sparkSession)
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(stream(run), "doc_id long, fingerprint string")


def _longs(values: list[int | None]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]).cast("array<bigint>")


def _ranges(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at or below ``value`` (0 for null), in two steps of about sqrt(n) comparisons."""
    if not cuts:
        return F.lit(0)
    fan = max(1, round(len(cuts) ** 0.5))
    chunks = [cuts[i : i + fan] for i in range(0, len(cuts), fan)]
    below = lambda bounds: F.size(F.filter(bounds, lambda c: c <= value))
    chunk = below(_longs([c[0] for c in chunks])) - 1
    inner = F.get(F.array(*[_longs(c) for c in chunks]), chunk)
    return F.when(value.isNull() | (value < cuts[0]), 0).otherwise(chunk * fan + below(inner))


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", partitions: int | None = None, words: int = SHINGLE, scaled: int = SCALED) -> DataFrame:
    """Fingerprints of every text and of its edit, whose last quarter is the next document's beginning.

    The next document is the next by ascending id (nulls first, ties by the text's hash
    and then the text; after the last comes the first). Texts are dealt out once, by
    ranges of ids, and by the text's hash within an id that fills several ranges; a
    range's last document finds its successor in a copy of the next range's first rows,
    whose keys a pass over ids and hashes has found. Null texts are empty. Repeated
    rows follow one another and stay in one range. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc).cast("long").alias("id"), F.xxhash64(body).alias("h"), body.alias("text"))
    total, missing, size = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull()), F.sum(F.octet_length("text"))).first()
    n = partitions or max(8, min(MAX_RANGES, (size or 0) // RANGE_BYTES))
    quantiles = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    # part 0 is the null ids, part k > 0 begins at the k-th of: the least long, the cuts. An id that is several cuts has as many ranges, by hash.
    heavy = {c: quantiles.count(c) for c in quantiles}
    cuts = sorted(heavy)
    shares = [max(1, round(n * missing / max(total, 1))), 0, *(heavy[c] if heavy[c] > 1 else 0 for c in cuts)]
    ids = [None, None, *cuts]
    offsets = [0]
    for k, m in enumerate(shares):
        offsets.append(offsets[-1] + m + (k > 0))  # beside the heavy id's ranges, one for the ids after it
    of = F.when(F.col("id").isNull(), 0).otherwise(_ranges(F.col("id"), cuts) + 1)
    m = F.get(_longs(shares), of)
    own = (m > 0) & F.col("id").eqNullSafe(F.get(_longs(ids), of))
    spread = F.shiftright(F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 33) * m, 31)  # ascending with the hash, 0 to m - 1
    placed = rows.withColumn("part", F.get(_longs(offsets), of) + F.when(own, spread).otherwise(m))
    firsts = placed.groupBy("part").agg(F.min(F.struct("id", "h")).alias("first")).collect()
    firsts = sorted((r.part, r["first"].id, r["first"].h) for r in firsts)
    first_ids, first_hs, previous = ([None] * offsets[-1] for _ in range(3))
    for k, (at, first, h) in enumerate(firsts):
        first_ids[at], first_hs[at], previous[at] = first, h, firsts[k - 1][0]
    part = F.col("part")
    is_first = F.col("id").eqNullSafe(F.get(_longs(first_ids), part)) & (F.col("h") == F.get(_longs(first_hs), part))
    copy = F.when(is_first, F.get(_longs(previous), part))
    stays = F.struct(part.alias("part"), F.lit(0).alias("copy"))
    wanted = F.array_compact(F.array(stays, F.when(copy.isNotNull(), F.struct(copy.alias("part"), F.lit(1).alias("copy")))))
    dealt = placed.select("id", "h", "text", F.explode(wanted).alias("to")).select(F.col("to.part").alias("part"), F.col("to.copy").alias("copy"), "id", "h", "text")
    ordered = dealt.repartition(offsets[-1], "part").sortWithinPartitions("part", "copy", F.col("id").asc_nulls_first(), "h", "text").select("part", "copy", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (part, id, text, sketch) that waits for its successor
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(7))
            for at, is_copy, doc_id, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if last is None or last[0] != at:
                    if last is not None:
                        raise AssertionError("a range ended without its successor")
                    if is_copy:
                        continue  # a further copy of a range's first id
                    last = (at, doc_id, body, sketch(shingle_hashes(body, words), scaled))
                    continue
                kept = sketch(shingle_hashes(body, words), scaled)
                _, own_id, own_text, own_kept = last
                quarter = len(own_text) // 4
                edited = own_text[: len(own_text) - quarter] + body[:quarter]
                edited_kept = own_kept if edited == own_text else sketch(shingle_hashes(edited, words), scaled)
                values = (own_id, len(own_text), hashlib.sha256(edited.encode()).hexdigest(), to_string(own_kept), to_string(edited_kept), likeness(own_kept, edited_kept, scaled), likeness(own_kept, kept, scaled))
                for c, v in zip(out, values):
                    c.append(v)
                last = None if is_copy else (at, doc_id, body, kept)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return ordered.mapInArrow(stream(run), _EDITED)
