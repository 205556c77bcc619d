"""Spelling variants of a corpus's words, found through an index of variable-length grams.

The gram dictionary holds every gram of SHORTEST letters and each extension by one letter of a frequent gram, up to LONGEST
letters: rare grams are pruned, i.e. not extended. It is stored as the set of its frequent grams, whose number is
bounded by a parameter. A word is decomposed into the longest gram of the dictionary from each of its places, without those that lie
inside an earlier one. For each word a bound says how many of its grams one edit can affect, at whatever place; all others
are also grams of the edited word. So two words one edit apart share a gram among the rarest `bound + 1` of either, and only
the posting lists of these are merged. Whatever lies outside of a shared gram, on the side away from the edit, is equal
too, and is part of the lists' keys. Merged pairs are verified by their edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grouptrace.llm import words
from grouptrace.session import materialize

SHORTEST_WORD = 6
LEAST_COUNT = 5
FORM_RATIO = 5
DELETED = 199

SHORTEST = 2
LONGEST = 5
#: At most so many frequent grams; a gram is frequent if more words hold it than this leaves room for, and than RARE.
FREQUENT_GRAMS = 100_000
RARE = 20
#: Words counted in a task before their counts go on to the shuffle.
HELD_WORDS = 400_000
WORDS_A_TASK = 10_000
SLICE_BYTES = 2_000_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)


def letter_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the maximal runs of A-Z, a-z and U+00C0-U+00FF (in UTF-8 0xC3 and one more byte)."""
    letter = _LETTER[data]
    letter[1:] |= data[:-1] == 0xC3
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    first[cuts] = letter[cuts]
    last[cuts - 1] = letter[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(bounds, start, side="right") - 1


def checksums(prefix: np.ndarray, text: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """crc32 of prefix + run for all runs, from the crc32 of each text's prefix and of each run alone."""
    out = own.copy()
    order = np.argsort(size, kind="stable")
    at = np.searchsorted(size[order], np.arange(1, size.max() + 2 if len(size) else 1))
    moved = prefix.copy()
    for a, b in zip(at[:-1], at[1:]):
        moved = _CRC[moved & 0xFF] ^ (moved >> 8)
        if a < b:
            out[order[a:b]] ^= moved[text[order[a:b]]]
    return out


def _tally(ids: list, data: np.ndarray, bounds: np.ndarray, counts: Counter) -> None:
    start, end, text = letter_runs(data, bounds)
    if not len(start):
        return
    low = _LOWER[data]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    length = chars[end] - chars[start]
    _, sample, code = np.unique(words.range_hash(low, start, end), return_index=True, return_inverse=True)
    raw = low.tobytes()
    named = [raw[a:b] for a, b in zip(start[sample].tolist(), end[sample].tolist())]
    own = np.array([zlib.crc32(x) for x in named], dtype=np.uint32)
    prefix = np.array([zlib.crc32(f"{d}:".encode()) for d in ids], dtype=np.uint32)
    known = np.array([d is not None for d in ids])
    checksum = checksums(prefix, text, end - start, own[code])
    changed = (checksum % DELETED == 0) & known[text]
    plain = np.bincount(code[~changed], minlength=len(named))
    for i in np.flatnonzero((plain > 0) & (length[sample] >= SHORTEST_WORD)).tolist():
        counts[named[i]] += int(plain[i])
    for i in np.flatnonzero(changed & (length > SHORTEST_WORD)).tolist():
        word, at = named[code[i]].decode(), int(checksum[i] % length[i])
        counts[(word[:at] + word[at + 1:]).encode()] += 1


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n): words of at least SHORTEST_WORD letters with at least LEAST_COUNT occurrences over all documents."""

    def count(batches):
        counts: Counter = Counter()

        def tallied():
            found = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return found

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for row, data, bounds in words.chunks(batch.column("text"), SLICE_BYTES):
                _tally(ids[row: row + len(bounds) - 1], data, bounds, counts)
                if len(counts) > HELD_WORDS:
                    yield tallied()
        yield tallied()

    counted = documents.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def frequent_grams(vocabulary: DataFrame) -> dict[str, int]:
    """The grams of SHORTEST to LONGEST - 1 letters that are frequent, with the number of words that hold them.

    With G grams in all words together, a gram is frequent beyond G / FREQUENT_GRAMS words, so at most FREQUENT_GRAMS are.
    """
    sizes = range(SHORTEST, LONGEST)

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                counts.update({word[a: a + q] for q in sizes for a in range(len(word) - q + 1)})
                if len(counts) > HELD_WORDS:
                    yield pa.RecordBatch.from_pydict({"gram": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pa.RecordBatch.from_pydict({"gram": list(counts), "n": list(counts.values())})

    total = vocabulary.agg(F.sum(F.length("word") * len(sizes))).first()[0] or 0
    grams = vocabulary.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    frequent = grams.where(F.col("n") > max(RARE, -(-total // FREQUENT_GRAMS)))
    return {r.gram: r.n for r in frequent.collect()}


class Grams:
    """The gram dictionary: decompositions of words and the bounds on what an edit affects."""

    def __init__(self, frequent: dict[str, int]):
        self.frequent = frequent
        self.tails = {gram[i:] for gram in frequent for i in range(1, len(gram))}

    def decomposed(self, word: str, longest: int) -> list[tuple[int, int]]:
        """(start, end) of a word's grams, none inside another."""
        found, reached, size = [], 0, len(word)
        for a in range(size - SHORTEST + 1):
            b = a + SHORTEST
            while b < size and b - a < longest and word[a:b] in self.frequent:
                b += 1
            if b > reached:
                found.append((a, b))
                reached = b
        return found

    def most_affected(self, word: str, grams: list[tuple[int, int]], longest: int, inserting: bool) -> int:
        """The largest number of a word's grams that one edit can affect.

        An edit affects the grams that it cuts, and those to its right that a gram over the edited place may now enclose:
        the dictionary has one that ends where they end, or later, only if the letters between begin the rest of a
        frequent gram. To its left a gram depends on its own letters alone, except where the word's end cut it short.
        """
        most, low, size = 0, 0, len(word)
        for p in range(size + inserting):
            after = p if inserting else p + 1
            while low < len(grams) and grams[low][1] <= p:
                low += 1
            affected = 0
            for a, b in grams[low: low + 2 * longest]:
                if a < after:
                    affected += 1
                elif b > p + longest - inserting:
                    break
                else:
                    affected += word[after: b - 1] in self.tails
            if p == size:
                affected += sum(b == size and b - a < longest and word[a:b] in self.frequent for a, b in grams[-longest:])
            most = max(most, affected)
        return most

    def rarity(self, gram: str) -> tuple[int, str]:
        """One order of all grams, from rare to frequent; of those that aren't counted, by the grams inside them."""
        n = self.frequent.get(gram)
        if n is None:
            n = min(self.frequent.get(gram[:-1], RARE), self.frequent.get(gram[1:], RARE)) // 26
        return n, gram

    def sought(self, word: str, longest: int, inserting: bool) -> list[tuple[int, int, int, int]]:
        """(start, end) of the first and of the last occurrence of the word's grams whose lists are merged.

        These are the rarest, one more than an edit can affect, and all equal to them. If an occurrence to the left of an edit
        is left alone, so is the gram's first one; if one to the right is, so is its last one.
        """
        grams = self.decomposed(word, longest)
        bound = self.most_affected(word, grams, longest, inserting)
        places: dict[str, tuple] = {}
        for a, b in grams:
            places[word[a:b]] = (*places.get(word[a:b], (a, b))[:2], a, b)
        rarities = sorted(self.rarity(word[a:b]) for a, b in grams)
        last = rarities[min(bound, len(rarities) - 1)]
        return [place for gram, place in places.items() if self.rarity(gram) <= last]


_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _key(outside: int, place: int, kind: int) -> int:
    x = (outside ^ (place * 0xD1342543DE82EF95) ^ (kind * 0xBF58476D1CE4E5B9)) & _MASK
    x = (x ^ (x >> 29)) * 0x94D049BB133111EB & _MASK
    return (x ^ (x >> 32)) - (1 << 63)


def postings(vocabulary: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """(key, word, short): the lists to merge. A list belongs to words of one length and the shorter ones (short) of one
    letter less; its key is a gram with all letters to its left, or with all to its right."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(frequent)

    def listed(batches):
        grams = Grams(shared.value)
        for batch in batches:
            keys, named, shorts = [], [], []
            for word in batch.column("word").to_pylist():
                size = len(word)
                left, right = [0], [0]
                for c in word:
                    left.append((left[-1] * _BASE + ord(c) + 1) & _MASK)
                for c in reversed(word):
                    right.append((right[-1] * _BASE + ord(c) + 1) & _MASK)
                for longer, short in ((size, False), (size + 1, True)):
                    # Grams of at most half the shorter word's length: then an edit never affects all.
                    longest = min(LONGEST, max(SHORTEST_WORD, longer - 1) // 2)
                    for a, b, c, d in grams.sought(word, longest, short):
                        keys += _key(left[b], a, 2 * longer), _key(right[size - c], size - d, 2 * longer + 1)
                        named += word, word
                        shorts += short, short
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(named, pa.string()), pa.array(shorts, pa.bool_())], names=["key", "word", "short"])

    return vocabulary.select("word").mapInArrow(listed, "key long, word string, short boolean")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, b): all pairs of words, a before b, that differ by one inserted, deleted or replaced letter; each once."""
    spread = vocabulary.repartition(1 + vocabulary.count() // WORDS_A_TASK, "word")
    lists = materialize(postings(spread, frequent_grams(spread)), "gram-lists")
    a, b = (lists.select("key", F.col("word").alias(x), F.col("short").alias(f"{x}_short")) for x in "ab")
    merged = a.join(b, "key").where("a < b AND NOT (a_short AND b_short) AND levenshtein(a, b, 1) = 1")
    return merged.select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of the chain of forms. Each round doubles the steps taken; a form is at least
    FORM_RATIO times as frequent as its word, so a chain has few steps."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = materialize(after, "roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def grouped(documents: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the corpus.

    Words are runs of letters as `vocabulary` finds them. A run whose crc32 with its document's id is a multiple of DELETED
    loses one letter; without doc_id none does. form: the most frequent near word (of equally frequent ones the first in code
    point order) if it is FORM_RATIO times as frequent, else null. root: the last of the chain of forms, the word itself
    without one. A null or empty text has no words; a text of any length is read whole; repeated rows count each time; an
    empty table gives an empty result; other columns are not read.
    """
    known = materialize(vocabulary(documents), "words")
    pairs = materialize(near_words(known), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counted = both.join(known.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    formed = F.col("best.n") * -1 >= FORM_RATIO * F.col("n")
    rows = materialize(
        known.join(best, "word", "left").select(
            "word", F.when(formed, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, -F.col("best.n")).alias("form_n"),
        ), "forms")
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
