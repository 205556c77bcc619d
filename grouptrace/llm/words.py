"""Words of whole Arrow batches of texts and their 64-bit hashes, in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are polynomials over mixed bytes (for a
word) and over mixed words (for a window of words), so every window of a batch costs one subtraction and one product.
Equal windows have equal hashes; different ones collide with probability 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
CHUNK_BYTES = 500_000
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                for b in (self.base, self.inverse)
            )
        return self.up[:n], self.down[:n]


_bytes_powers, _words_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def _range_hash(values: np.ndarray, powers: _Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of some bytes."""
    return _range_hash(_BYTE_VALUES[data], _bytes_powers, start, end)


def sequence_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges of a sequence of 64-bit codes."""
    return _range_hash(codes, _words_powers, start, end)


class Words:
    """The words of some texts: per word its byte range, text number and hash; per text its word range."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, fold_case: bool = False):
        self.data, self.n_texts = data, len(bounds) - 1
        space = _SPACE[data]
        word = ~space
        first, last = word.copy(), word.copy()
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        cuts = bounds[(bounds > 0) & (bounds < len(data))]
        first[cuts] = word[cuts]
        last[cuts - 1] = word[cuts - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(bounds, self.start, side="right") - 1
        self.range = np.searchsorted(self.start, bounds)
        self.hash = _range_hash(
            _BYTE_VALUES[_LOWER[data] if fold_case else data], _bytes_powers, self.start, self.end
        )

    def counts(self) -> np.ndarray:
        return np.diff(self.range)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of n words that lie in one text."""
        start = np.arange(max(0, len(self.hash) - n + 1))
        start = start[self.text[start] == self.text[start + n - 1]]
        return start, _range_hash(self.hash, _words_powers, start, start + n)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _range_hash(self.hash, _words_powers, start, end)

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Words of text i joined by one space, without those whose keep is false."""
        a, b = self.range[i], self.range[i + 1]
        if a == b:
            return b""
        if keep is None:
            return b" ".join(self.data[self.start[a]: self.end[b - 1]].tobytes().split())
        chosen = a + np.flatnonzero(keep[a:b])
        return b" ".join(self.data[self.start[j]: self.end[j]].tobytes() for j in chosen)


def chunks(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, text bounds) of slices of a string column of about CHUNK_BYTES (or size); null is an empty text.

    A text is never cut: a longer one makes a chunk of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(pa.scalar("", column.type))
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + (size or CHUNK_BYTES), side="right")) - 1
        end = min(len(column), max(end, row + 1))
        yield row, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


def pack(column: pa.Array) -> pa.Array:
    """Texts compressed for a shuffle, each behind its length; null stays null."""
    codec = pa.Codec("zstd")
    raw = (None if x is None else x.encode() for x in column.to_pylist())
    out = [None if x is None else len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in raw]
    return pa.array(out, pa.binary())


def packed(text: Column) -> Column:
    return F.arrow_udf(pack, "binary")(text)


def met(texts: DataFrame, rows: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Packed texts joined with rows for a next Python step.

    Always by a shuffle: a broadcast would chain both Python steps in each task, which takes two workers at a time.
    """
    return texts.join(rows.hint("merge"), key, how)


def unpacked(column: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array(
        [None if x is None else codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)
         for x in column.to_pylist()],
        pa.large_binary(),
    )


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long: few of them at a time go to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def distinct_per_text(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, key), sorted by them."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    return text[new], key[new]


def contained(text: np.ndarray, key: np.ndarray, in_text: np.ndarray, in_key: np.ndarray) -> np.ndarray:
    """For each (text, key): is it among the (in_text, in_key)?"""
    if not len(in_key) or not len(key):
        return np.zeros(len(key), dtype=bool)
    order = np.lexsort((in_key, in_text))
    in_text, in_key = in_text[order], in_key[order]
    found = np.zeros(len(key), dtype=bool)
    bounds = np.searchsorted(in_text, np.arange(max(text.max(), in_text.max()) + 2))
    have = np.searchsorted(text, np.arange(len(bounds)))
    for t in np.unique(in_text):
        own = in_key[bounds[t]: bounds[t + 1]]
        asked = key[have[t]: have[t + 1]]
        at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
        found[have[t]: have[t + 1]] = own[at] == asked
    return found


def list_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row number, value) of the elements of an array<bigint> column as unsigned keys; null counts as empty."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    values = np.asarray(column.flatten()).astype(np.int64).view(np.uint64)
    return np.repeat(np.arange(len(column)), lengths), values
