"""Repeated word passages found through a sparse, sorted set of suffixes.

A passage of `length` words is anchored at the position, among its first `spread` words, whose short word group
has the smallest hash. Equal passages have equal anchors, so two documents that share the passage both keep the suffix
at that place, and these suffixes agree in at least `length - spread + 1` words. Sorting the kept suffixes therefore
brings the documents together. Neighbours that agree are then extended to the left (by each offset their anchor can
serve) and to the right (to the full length), and the extended passages are sorted and compared again: this last
comparison covers the whole passage, so the outcome doesn't depend on which suffixes were kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grouptrace.llm import words
from grouptrace.session import materialize

GRAM = 3


def anchors(w: words.Words, length: int, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all passages of `length` words, and the anchor of each."""
    start = np.arange(max(0, len(w.hash) - length + 1))
    start = start[w.text[start] == w.text[start + length - 1]]
    if not len(start):
        return start, start
    reach = np.arange(len(w.hash) - GRAM + 1)
    gram = w.hashes(reach, reach + GRAM)
    least, at = gram[start], start.copy()
    for step in range(1, spread):
        other = gram[start + step]
        less = other < least
        least[less] = other[less]
        at[less] = start[less] + step
    return start, at


def _rows(doc_id: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(doc_id.astype(np.int64))], names=["key", "doc_id"]
    )


def suffixes(documents: DataFrame, length: int, spread: int) -> DataFrame:
    """(key, doc_id): the fingerprint of the first length - spread + 1 words of every kept suffix, once per document."""

    def kept(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for row, data, bounds in words.chunks(batch.column("text")):
                w = words.Words(data, bounds)
                at = np.unique(anchors(w, length, spread)[1])
                text, key = words.distinct_per_text(w.text[at], w.hashes(at, at + length - spread + 1))
                yield _rows(ids[row + text], key)

    return documents.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(kept, "key long, doc_id long")


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows in order of (key, doc_id), dealt by ranges of both so that a hot key is spread over many tasks."""
    return rows.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")


def with_equal_neighbour(rows: DataFrame) -> DataFrame:
    """Rows whose key equals that of a neighbour in the order. The ends of a partition, whose neighbours lie in
    another one, stay as well: a superset that the extension decides exactly."""

    def compare(batches):
        held = None
        before = False
        for batch in batches:
            key, doc = np.asarray(batch.column("key")), np.asarray(batch.column("doc_id"))
            if not len(key):
                continue
            first = held is None
            if held is not None:
                key, doc = np.concatenate([[held[0]], key]), np.concatenate([[held[1]], doc])
            same = key[1:] == key[:-1]
            keep = np.zeros(len(key), dtype=bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= before or first
            held = (key[-1], doc[-1])
            before = bool(keep[-1])
            yield _rows(doc[:-1][keep[:-1]], key[:-1][keep[:-1]].view(np.uint64))
        if held is not None:
            yield _rows(np.array([held[1]]), np.array([held[0]], dtype=np.int64).view(np.uint64))

    return _sorted(rows).mapInArrow(compare, "key long, doc_id long")


def extended(documents: DataFrame, survivors: DataFrame, length: int, spread: int) -> DataFrame:
    """(key, doc_id) of all whole passages whose anchored suffix has an equal neighbour, once per document."""
    lists = survivors.groupBy("doc_id").agg(F.collect_list("key").alias("kept_keys"))

    def extend(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            list_text, list_key = words.list_column(batch.column("kept_keys"))
            for row, data, bounds in words.chunks(words.unpacked(batch.column("packed"))):
                w = words.Words(data, bounds)
                start, at = anchors(w, length, spread)
                own = (list_text >= row) & (list_text < row + w.n_texts)
                chosen = words.contained(
                    w.text[at], w.hashes(at, at + length - spread + 1), list_text[own] - row, list_key[own]
                )
                start = start[chosen]
                text, key = words.distinct_per_text(w.text[start], w.hashes(start, start + length))
                yield _rows(ids[row + text], key)

    texts = documents.where("doc_id IS NOT NULL").select("doc_id", words.packed(F.col("text")).alias("packed"))
    return words.met(texts, lists, "doc_id").mapInArrow(extend, "key long, doc_id long")


def later_occurrences(rows: DataFrame) -> DataFrame:
    """Rows (key, doc_id) whose key also belongs to a smaller doc_id.

    In the order of (key, doc_id) these are the rows whose doc_id differs from that of the first row with their key.
    That first row can lie in an earlier partition only for the first key of a partition; then that key is also the last
    one there. One key at either end of a partition is compared by a join.
    """
    schema = T.StructType.fromDDL("key long, doc_id long, end int")

    def compare(batches):
        head = None
        opening = None
        for batch in batches:
            key, doc = np.asarray(batch.column("key")), np.asarray(batch.column("doc_id"))
            if not len(key):
                continue
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            group = np.cumsum(new) - 1
            heads = doc[new]
            if head is None:
                opening = (key[0], doc[0])
            elif key[0] == head[0]:
                heads[0] = head[1]
            head = (key[-1], heads[-1])
            later = doc != heads[group]
            end = np.where((key == opening[0]) & (doc == opening[1]), 1, 0).astype(np.int32)
            keep = later | (end == 1)
            yield _ends(key[keep], doc[keep], end[keep])
        if head is not None:
            yield _ends(np.array([head[0]]), np.array([head[1]]), np.array([2], dtype=np.int32))

    compared = materialize(_sorted(rows).mapInArrow(compare, schema), "passages")
    firsts = compared.where("end = 1").select("key", "doc_id")
    lasts = compared.where("end = 2").groupBy("key").agg(F.min("doc_id").alias("least"))
    crossing = firsts.join(lasts, "key").where("least < doc_id").select("key", "doc_id")
    return compared.where("end = 0").select("key", "doc_id").unionByName(crossing)


def _ends(key: np.ndarray, doc_id: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(end, pa.int32())],
        names=["key", "doc_id", "end"],
    )


def repeated_passages(documents: DataFrame, length: int, spread: int) -> DataFrame:
    """(doc_id, keys): per document the fingerprints of its passages that also start in a smaller doc_id."""
    survivors = with_equal_neighbour(suffixes(documents, length, spread))
    later = later_occurrences(extended(documents, survivors, length, spread))
    return later.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def found_passages(w: words.Words, length: int, list_text: np.ndarray, list_key: np.ndarray) -> np.ndarray:
    """Starts of the passages whose key is among their text's keys."""
    start, key = w.windows(length)
    return start[words.contained(w.text[start], key, list_text, list_key)]


def runs(w: words.Words, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The passages' word ranges, joined where they overlap or touch within a text."""
    if not len(start):
        return start, start
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] > start[:-1] + length) | (w.text[start[1:]] != w.text[start[:-1]])
    return start[new], np.append(start[:-1][new[1:]], start[-1]) + length


def spans(w: words.Words, first: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    """Per text its number of words, of words in the given ranges, and these ranges as (first word, words)."""
    at = np.searchsorted(w.text[first], np.arange(w.n_texts + 1))
    removed = np.concatenate([[0], np.cumsum(end - first)])
    ranges = pa.StructArray.from_arrays(
        [pa.array(first - w.range[w.text[first]], pa.int64()), pa.array(end - first, pa.int64())], names=["first", "words"]
    )
    return [
        pa.array(w.counts(), pa.int64()), pa.array(removed[at[1:]] - removed[at[:-1]], pa.int64()),
        pa.ListArray.from_arrays(pa.array(at, pa.int32()), ranges),
    ]


def marked(documents: DataFrame, repeats: DataFrame) -> DataFrame:
    """(row, packed, keys): every document's other columns in one struct, so that no name can clash, its packed text and
    its keys (null: none)."""
    others = [f"`{c}`" for c in documents.columns if c != "text"]
    rows = documents.select(F.struct(*others).alias("row"), "doc_id", words.packed(F.col("text")).alias("packed"))
    return words.met(rows, repeats, "doc_id", "left").select("row", "packed", "keys")
