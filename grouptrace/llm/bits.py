"""A Bloom filter of fixed size, built by Spark, that thins rows before a shuffle.

It lets every listed key pass and, while it isn't full, few others. Full, it lets all pass: the join behind it stays right
whatever the number of keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grouptrace.llm import words

BITS = 1 << 26
HASHES = 2
_SLICES = 64
_SCHEMA = "slice int, bits binary"


def _places(key: np.ndarray):
    key = key.astype(np.int64).view(np.uint64)
    for k in range(HASHES):
        yield (words.mix(key ^ words.mix(np.array([k + 1], dtype=np.uint64))) % words.U(BITS)).astype(np.int64)


def _batch(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    codec = pa.Codec("zstd")
    blobs = [codec.compress(x.tobytes(), asbytes=True) for x in parts.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "bits"])


def _unpacked(blob: bytes) -> np.ndarray:
    size = BITS // 8 // _SLICES
    return np.frombuffer(pa.Codec("zstd").decompress(blob, size, asbytes=True), dtype=np.uint8)


def filter_of(keys: DataFrame) -> np.ndarray:
    """The bits of a table's keys (column key, long)."""

    def mark(batches):
        bits = np.zeros(BITS // 8, dtype=np.uint8)
        for batch in batches:
            for at in _places(np.asarray(batch.column("key"))):
                np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = {i: x for i, x in enumerate(bits.reshape(_SLICES, -1)) if x.any()}
        if parts:
            yield _batch(parts)

    def unite(batches):
        united: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, blob in zip(batch.column("slice").to_pylist(), batch.column("bits").to_pylist()):
                part = _unpacked(blob)
                united[number] = united[number] | part if number in united else part
        if united:
            yield _batch(united)

    parts = keys.select("key").mapInArrow(mark, _SCHEMA).repartition(_SLICES, "slice").mapInArrow(unite, _SCHEMA)
    out = np.zeros((_SLICES, BITS // 8 // _SLICES), dtype=np.uint8)
    for part in parts.collect():
        out[part["slice"]] = _unpacked(part["bits"])
    return out.ravel()


def may_be_in(key: np.ndarray, filter_bits: np.ndarray) -> np.ndarray:
    """Which keys pass the filter?"""
    found = np.ones(len(key), dtype=bool)
    for at in _places(key):
        found &= (filter_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found
