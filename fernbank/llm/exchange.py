"""Questions of many blocks about shared keys, answered by ranges of the keys' hashes.

A *block* is a row that holds a run of documents. It asks about its distinct keys (64-bit
hashes, ascending) by one message for each range that it has keys in; a range adds up
what all blocks say of a key and answers each in the order it was asked. A key travels
once for each block however frequent it is, and messages are at most as many as keys.
Numbers travel as compressed byte planes, ascending keys as differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    return pa.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``pack`` wrote."""
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    """The ``n`` ascending keys that ``pack_sorted`` wrote."""
    return np.cumsum(unpack(data, n), dtype=np.uint64)


def slices(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of the hash ranges that ascending keys have."""
    if not len(keys):
        return
    where = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(where)]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(where[a]), int(a), int(b)


def rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows one by one, so that no more than one is unpacked."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def names(schema: str) -> list[str]:
    """The column names of a schema in words."""
    return [x.split()[0] for x in schema.split(", ")]


def gathered(answers: pa.Table, column: str) -> np.ndarray:
    """The answers to a block's keys, in the keys' order."""
    parts = sorted(zip(answers.column("p").to_pylist(), answers.column("n").to_pylist(), answers.column(column).to_pylist()))
    return np.concatenate([*(unpack(data, n) for _, n, data in parts), np.zeros(0, np.uint64)])
