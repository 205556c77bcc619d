"""Benchmark decontamination by template windows.

Texts are brought to templates: tokens are lower-cased and freed of outer punctuation, and numbers, names and units of
measure become typed placeholders. Windows of ten tokens are hash-joined between documents and benchmark items. In each
run of overlapping windows along an alignment, a slot's value in the item must always stand for the same value in the document:
a question with new numbers or names is caught, a chance match of templates isn't.

Beside them, windows of the values themselves find verbatim copies, whatever share of them is literal. Windows of ten tokens
are compared without regard to case. An item of fewer tokens, which is one window, must agree in case too.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grouptrace.llm import words

WINDOW = 10
#: An item with fewer tokens than WINDOW is searched as a whole; its template down to this many, its values always.
SHORTEST = 5
#: Share of a window's tokens that must be literal, in percent.
LITERAL_PERCENT = 60
_FILTER_BITS = 24
_SLICES = 16

# Number words, and units that may follow a number.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "km m cm mm mi mile miles ft feet foot inch inches yard yards kg g mg lb lbs pound pounds ounce ounces ton tons l ml "
    "liter liters litre litres meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram "
    "kilograms second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees "
    "dollar dollars cent cents euro euros usd eur kmh mph hz khz mhz ghz w kw v a kb mb gb tb"
).split()

_CORE = np.zeros(256, dtype=bool)
_CORE[48:58] = _CORE[65:91] = _CORE[97:123] = True
_CORE[128:] = True
_ENDS_SENTENCE = np.zeros(256, dtype=bool)
_ENDS_SENTENCE[[ord(c) for c in ".!?:"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
NUMBER, NAME, UNIT = (words.mix(np.array([k], dtype=np.uint64))[0] for k in (11, 12, 13))


def _known(listed: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(listed).encode(), dtype=np.uint8)
    ends = np.cumsum([len(x) for x in listed])
    return np.sort(words.range_hash(data, np.concatenate([[0], ends[:-1]]), ends))


_NUMBER_WORDS, _UNITS = _known(NUMBER_WORDS), _known(UNITS)


def _in(sorted_keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)] == key


class Template:
    """Tokens of some texts: text number, value (hash of the token), slot (is it a placeholder?), code (the template's)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        w = words.Words(data, bounds)
        core = np.flatnonzero(_CORE[data])
        core = np.append(core, len(data))
        first = core[np.searchsorted(core, w.start)]
        last = core[np.maximum(np.searchsorted(core, w.end) - 1, 0)]
        real = first < w.end
        start, end, text = first[real], last[real] + 1, w.text[real]
        self.text, n = text, len(text)
        self.value = words.range_hash(_FOLD[data], start, end)
        lead = data[start] if n else np.zeros(0, np.uint8)
        # A sentence begins with a text's first token, after a line feed, or after a token that ends like a sentence.
        opens = np.ones(n, dtype=bool)
        closing = _ENDS_SENTENCE[data[w.end[real] - 1]] if n else opens
        feeds = np.concatenate([[0], np.cumsum(data == 0x0A)])
        opens[1:] = (text[1:] != text[:-1]) | closing[:-1] | (feeds[start[1:]] != feeds[end[:-1]])
        number = ((lead >= 48) & (lead <= 57)) | _in(_NUMBER_WORDS, self.value)
        name = (lead >= 65) & (lead <= 90) & ~opens & ~number
        unit = np.zeros(n, dtype=bool)
        unit[1:] = number[:-1] & (text[1:] == text[:-1]) & _in(_UNITS, self.value[1:]) & ~number[1:]
        self.slot = number | name | unit
        self.code = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, self.value)))
        self.range = np.searchsorted(text, np.arange(len(bounds)))
        self.bytes = data, start, end

    @cached_property
    def row(self) -> np.ndarray:
        """Per text a hash of its values, which tells apart rows that share an id."""
        return words.sequence_hash(self.value, self.range[:-1], self.range[1:])

    @cached_property
    def exact(self) -> np.ndarray:
        """Hashes of the tokens in their own case."""
        return words.range_hash(*self.bytes)

    def windows(self, size: int, verbatim: bool) -> tuple[np.ndarray, np.ndarray]:
        """Starts and keys of the windows of so many tokens: verbatim ones, or templates with enough literals among them."""
        start = np.arange(max(0, len(self.code) - size + 1))
        start = start[self.text[start] == self.text[start + size - 1]]
        if verbatim:
            codes = self.value if size == WINDOW else self.exact
        else:
            codes = self.code
            literal = np.concatenate([[0], np.cumsum(~self.slot)])
            start = start[100 * (literal[start + size] - literal[start]) >= LITERAL_PERCENT * size]
        return start, words.sequence_hash(codes, start, start + size) ^ words.U(size)

    def slots(self, start: np.ndarray, size: int, verbatim: bool) -> pa.Array:
        """Per window the values in its slots; a verbatim window has none."""
        at = start[:, None] + np.arange(size)
        inside = self.slot[at] & (not verbatim)
        ends = np.concatenate([[0], np.cumsum(inside.sum(axis=1))])
        return pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(self.value[at][inside].view(np.int64), pa.int64()))


_COLUMNS = ("key", "id", "row", "place", "size", "verbatim", "slots")
_SCHEMA = "key long, id long, row long, place int, size int, verbatim boolean, slots array<bigint>"


def _rows(
    ids: np.ndarray, row: int, t: Template, start: np.ndarray, key: np.ndarray, size: int, verbatim: bool
) -> pa.RecordBatch:
    place = start - t.range[t.text[start]]
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(ids[row + t.text[start]], pa.int64()),
         pa.array(t.row[t.text[start]].view(np.int64)), pa.array(place, pa.int32()), pa.array(np.full(len(start), size), pa.int32()), pa.array(np.full(len(start), verbatim)),
         t.slots(start, size, verbatim)],
        names=list(_COLUMNS),
    )


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(key, id, row, place, size, verbatim, slots) of all items' windows of both kinds; short items are one window."""

    def cut(batches):
        for batch in batches:
            ids = np.asarray(batch.column("item_id"))
            for row, data, bounds in words.chunks(batch.column("text")):
                t = Template(data, bounds)
                lengths = np.diff(t.range)
                for verbatim, least in ((False, SHORTEST), (True, 1)):
                    for size in range(least, WINDOW + 1):
                        start, key = t.windows(size, verbatim)
                        if size < WINDOW:
                            whole = lengths[t.text[start]] == size
                            start, key = start[whole], key[whole]
                        yield _rows(ids, row, t, start, key, size, verbatim)

    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    return rows.mapInArrow(cut, _SCHEMA)


def _filter(items: DataFrame) -> np.ndarray:
    """A bit for each key modulo 2**24: a filter of fixed size, whatever the benchmark's."""
    per_slice = (1 << _FILTER_BITS) // _SLICES

    def mark(batches):
        bits = np.zeros(1 << _FILTER_BITS, dtype=np.uint8)
        for batch in batches:
            bits[np.asarray(batch.column("key")).view(np.uint64) >> words.U(64 - _FILTER_BITS)] = 1
        if bits.any():
            parts = [np.packbits(x).tobytes() for x in bits.reshape(_SLICES, per_slice)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "bits"])

    def unite(batches):
        united: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, bits in zip(batch.column("slice").to_pylist(), batch.column("bits").to_pylist()):
                own = united.setdefault(number, np.zeros(per_slice // 8, dtype=np.uint8))
                own |= np.frombuffer(bits, dtype=np.uint8)
        if united:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(united), pa.int32()), pa.array([x.tobytes() for x in united.values()], pa.binary())],
                names=["slice", "bits"])

    schema = "slice int, bits binary"
    parts = items.select("key").mapInArrow(mark, schema).repartition(_SLICES, "slice").mapInArrow(unite, schema)
    out = np.zeros((_SLICES, per_slice // 8), dtype=np.uint8)
    for part in parts.collect():
        out[part["slice"]] = np.frombuffer(part["bits"], dtype=np.uint8)
    return out.ravel()


def document_windows(documents: DataFrame, bits: np.ndarray, kinds: list[tuple[bool, int]]) -> DataFrame:
    """(key, id, row, place, size, verbatim, slots) of the documents' windows of some kinds and sizes that pass the filter."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def cut(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for row, data, bounds in words.chunks(batch.column("text")):
                t = Template(data, bounds)
                for verbatim, size in kinds:
                    start, key = t.windows(size, verbatim)
                    bit = key >> words.U(64 - _FILTER_BITS)
                    hit = (shared.value[(bit >> words.U(3)).astype(np.int64)] >> (7 - (bit & words.U(7))).astype(np.uint8)) & 1
                    start, key = start[hit == 1], key[hit == 1]
                    if len(start):
                        yield _rows(ids, row, t, start, key, size, verbatim)

    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return rows.mapInArrow(cut, _SCHEMA)


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, first_token, n_tokens): each item that a document contains, once.

    first_token and n_tokens span all its passages, n_windows counts the windows that agree. Windows that don't overlap, or
    come from different rows, needn't agree with each other. Rows without an id or a text have no windows. What is found
    for rows that share an id is taken together. Empty tables give an empty result.
    """
    items = item_windows(benchmark)
    kinds = sorted((r["verbatim"], r["size"]) for r in items.select("verbatim", "size").distinct().collect())
    found = document_windows(documents, _filter(items), kinds)
    joined = found.join(
        items.select("key", "size", "verbatim", F.col("id").alias("item_id"), F.col("row").alias("item_row"), F.col("place").alias("item_place"),
                     F.col("slots").alias("item_slots")),
        ["key", "size", "verbatim"],
    ).select(
        F.col("id").alias("doc_id"), "item_id", "row", "item_row", "place", "size", "verbatim", (F.col("place") - F.col("item_place")).alias("shift"),
        "slots", "item_slots",
    )
    alignment = ["doc_id", "item_id", "shift", "row", "item_row", "verbatim"]
    ordered = Window.partitionBy(*alignment).orderBy("place")
    apart = F.coalesce(F.col("place") >= F.lag("place").over(ordered) + F.col("size"), F.lit(False))
    runs = joined.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(ordered))
    pairs = F.transform(F.arrays_zip("item_slots", "slots"), lambda p: F.xxhash64(p["item_slots"], p["slots"]))
    passages = runs.groupBy(*alignment, "run").agg(
        F.collect_set("place").alias("places"), F.min("place").alias("first"), F.max(F.col("place") + F.col("size")).alias("end"),
        F.flatten(F.collect_list("item_slots")).alias("values"), F.flatten(F.collect_list(pairs)).alias("pairs"))
    # As many pairs as values: each value stands for one other.
    agreed = passages.where(F.size(F.array_distinct("values")) == F.size(F.array_distinct("pairs")))
    agreed = agreed.select("doc_id", "item_id", "shift", "first", "end", F.explode("places").alias("place"))
    agreed = agreed.groupBy("doc_id", "item_id", "shift").agg(
        F.countDistinct("place").alias("n"), F.min("first").alias("first"), F.max("end").alias("end"))
    return agreed.groupBy("doc_id", "item_id").agg(
        F.sum("n").alias("n_windows"), F.min("first").cast("long").alias("first_token"),
        (F.max("end") - F.min("first")).cast("long").alias("n_tokens"),
    )
