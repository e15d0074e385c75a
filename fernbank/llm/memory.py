"""Memory that Python workers give back.

A worker outlives its task and waits for the next one, beside an executor's other
workers. Arrow's pool and the C library keep what they have freed, several times what a
kernel's constants need, so kernels return it: streams when they end, groups whenever
so many bytes have passed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of groups after which free memory is returned.
STEP = 32 << 20
_passed = [0]


def release() -> None:
    """Return free memory to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not every C library has it


def _count(n: int) -> None:
    _passed[0] += n
    if _passed[0] >= STEP:
        _passed[0] = 0
        release()


def stream(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel over batches that returns memory at its end."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A kernel over groups that returns memory now and then."""

    def tidy(table: pa.Table) -> pa.Table:
        _count(table.nbytes)
        return run(table)

    return tidy


def cogroup(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A kernel over pairs of groups that returns memory now and then."""

    def tidy(left: pa.Table, right: pa.Table) -> pa.Table:
        _count(left.nbytes + right.nbytes)
        return run(left, right)

    return tidy
