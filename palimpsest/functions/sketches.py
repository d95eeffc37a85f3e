"""Seeded murmur3 and changed-path filters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the filter format.
SEEDS = (0x293AE76F, 0x7E646E2C)
HASHES = 7
BITS_PER_ENTRY = 10
MOST_PATHS = 512
_M = 0xFFFFFFFF


def murmur3(data: bytes, seed: int, signed: bool = False) -> int:
    """32-bit murmur3; signed reads bytes as signed numbers, as the first version of the format did."""

    def byte(i: int) -> int:
        b = data[i]
        return b - 256 if signed and b > 127 else b

    h, n = seed, len(data)
    for i in range(0, n - n % 4, 4):
        k = (byte(i) | byte(i + 1) << 8 | byte(i + 2) << 16 | byte(i + 3) << 24) & _M
        k = k * 0xCC9E2D51 & _M
        k = (k << 15 | k >> 17) & _M
        h ^= k * 0x1B873593 & _M
        h = (h << 13 | h >> 19) & _M
        h = (h * 5 + 0xE6546B64) & _M
    k = 0
    for j in reversed(range(n - n % 4, n)):
        k ^= byte(j) << 8 * (j % 4)
    if n % 4:
        k = (k & _M) * 0xCC9E2D51 & _M
        k = (k << 15 | k >> 17) & _M
        h ^= k * 0x1B873593 & _M
    h ^= n
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & _M
    return h


def key_bits(path: str, size: int, signed: bool = False) -> list[int]:
    """The bits of a path in a filter of `size` bits."""
    a, b = (murmur3(path.encode(), s, signed) for s in SEEDS)
    return [((a + i * b) & _M) % size for i in range(HASHES)]


def build_filter(paths: set[str]) -> bytes:
    """The filter of a set of paths and their directories; of too many, the one that holds everything."""
    all_paths = {"/".join(p.split("/")[:i]) for p in paths for i in range(1, p.count("/") + 2)}
    if len(all_paths) > MOST_PATHS:
        return b"\xff"
    out = bytearray(max(1, -(-len(all_paths) * BITS_PER_ENTRY // 8)))
    for p in all_paths:
        for bit in key_bits(p, len(out) * 8):
            out[bit // 8] |= 1 << bit % 8
    return bytes(out)


def may_hold(data: bytes, path: str) -> bool:
    return all(data[bit // 8] >> bit % 8 & 1 for bit in key_bits(path, len(data) * 8))


def path_filters(changed: DataFrame, asked: str) -> DataFrame:
    """(oid, n_paths, filter, may_hold): from (oid, path) rows; a commit's changed paths are gathered by a native aggregate."""
    kind = changed.schema["oid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filters = [build_filter(set(p)) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(p) for p in batch.column(1)], pa.int64()), pa.array([f.hex() for f in filters]), pa.array([may_hold(f, asked) for f in filters])], names=["oid", "n_paths", "filter", "may_hold"]
            )

    return changed.groupBy("oid").agg(F.collect_set("path").alias("paths")).mapInArrow(run, f"oid {kind}, n_paths long, filter string, may_hold boolean")
