"""Shard routing as columns: where a row goes by hash or by range, and which shards a filter needs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship

#: The 64-bit FNV-1a offset and prime.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & (1 << 64) - 1
    return h


def key_bytes(value: Any) -> bytes:
    """The bytes that a shard key hashes as: integers big-endian in 8, several fields as text in order of their names."""
    if isinstance(value, bool) or value is None:
        return str(value).lower().encode() if value is not None else b"<nil>"
    if isinstance(value, int):
        return (value & (1 << 64) - 1).to_bytes(8, "big")
    if isinstance(value, float):
        return (int(value) & (1 << 64) - 1).to_bytes(8, "big")
    if isinstance(value, Mapping):
        return b"".join(str(value[k]).encode() for k in sorted(value))
    return value if isinstance(value, bytes) else str(value).encode()


def _fnv_step(hi: Column, lo: Column, byte: Column) -> tuple[Column, Column]:
    """One byte of FNV-1a on a hash in two halves of 32 bits: no product or sum leaves a long. The prime is 2^40 + 435."""
    mask = F.lit((1 << 32) - 1)
    x = lo.bitwiseXOR(byte)
    low = x * 435
    return (F.shiftrightunsigned(low, 32) + hi * 435 + F.shiftleft(x, 8)).bitwiseAND(mask), low.bitwiseAND(mask)


def _fnv_texts(values: pd.Series, shards: int) -> np.ndarray:
    """FNV-1a of texts modulo ``shards``, byte place by byte place over all texts that are long enough."""
    data = [key_bytes(v) for v in values]
    h, order = np.full(len(data), FNV_OFFSET, np.uint64), np.argsort([-len(b) for b in data], kind="stable")
    lengths = np.array([len(data[i]) for i in order], np.int64)
    flat, starts = np.frombuffer(b"".join(data[i] for i in order), np.uint8).astype(np.uint64), np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(data) else lengths
    for place in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -place))  # texts longer than the place come first
        h[:n] = (h[:n] ^ flat[starts[:n] + place]) * np.uint64(FNV_PRIME)
    out = np.empty(len(data), np.int32)
    out[order] = (h % np.uint64(shards)).astype(np.int32)
    return out


def hash_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """``df`` with ``shard``: FNV-1a of the key modulo the number of shards, without a shuffle. Whole numbers are hashed in the plan, others in Arrow batches."""
    column, kind = F.col(key), dict(df.dtypes)[key]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        value = column.cast("long")
        hi, lo = F.lit(FNV_OFFSET >> 32), F.lit(FNV_OFFSET & (1 << 32) - 1)
        staged = df
        for k, shift in enumerate(range(56, -8, -8)):  # a column for each byte: as one expression the halves would double with every step
            hi, lo = _fnv_step(hi, lo, F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(255)))
            staged = staged.withColumns({f"_fnv_hi{k}": hi, f"_fnv_lo{k}": lo})
            hi, lo = F.col(f"_fnv_hi{k}"), F.col(f"_fnv_lo{k}")
        shard = F.pmod(F.pmod(hi, F.lit(shards)) * ((1 << 32) % shards) + F.pmod(lo, F.lit(shards)), F.lit(shards)).cast("int")
        none = fnv1a(key_bytes(None)) % shards
        return staged.withColumn("shard", F.when(column.isNull(), F.lit(none)).otherwise(shard)).drop(*[f"_fnv_{x}{k}" for k in range(8) for x in ("hi", "lo")])
    ship(df.sparkSession)

    @F.pandas_udf("int")
    def shard(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            yield pd.Series(_fnv_texts(v.where(v.notna(), None), shards))

    return df.withColumn("shard", shard(column))


def range_shards(df: DataFrame, key: str, bounds: Sequence[Any]) -> DataFrame:
    """``df`` with ``shard``: the number of ascending ``bounds`` at or below the key; the ends are open."""
    shard: Column = F.lit(0)
    for k, low in enumerate(bounds, 1):
        shard = F.when(F.col(key) >= F.lit(low), k).otherwise(shard)
    return df.withColumn("shard", F.when(F.col(key).isNotNull(), shard))


def route(filter: Mapping[str, Any], key: Sequence[str], shards: int) -> list[int]:
    """The shards that a filter can find rows in: one if it fixes the whole key, else all."""
    if all(k in filter and not isinstance(filter[k], Mapping) for k in key):
        value = filter[key[0]] if len(key) == 1 else {k: filter[k] for k in key}
        return [fnv1a(key_bytes(value)) % shards]
    return list(range(shards))


def split_chunk(chunk: tuple[Any, Any, int], at: Any) -> list[tuple[Any, Any, int]]:
    """A chunk [low, high) on a shard as two; None bounds are open."""
    low, high, shard = chunk
    if (low is not None and at <= low) or (high is not None and at >= high):
        raise ValueError("the split point must be inside the chunk")
    return [(low, at, shard), (at, high, shard)]


def move_chunk(chunk: tuple[Any, Any, int], shard: int) -> tuple[Any, Any, int]:
    """The chunk on another shard."""
    return (*chunk[:2], shard)
