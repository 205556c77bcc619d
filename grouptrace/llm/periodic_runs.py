"""Periodic runs of words by the branching tandem test on an enhanced suffix array.

The words of a slice of texts get one suffix array, by prefix doubling, in which no two texts share a symbol. Its LCP
intervals are pairs of bounds in arrays; no tree is built. An interval of depth q with suffix i in any child but its largest
asks whether suffix i + q or i - q lies in another child of the same interval (its place is ISA[i +- q]): then a square of
two equal halves of q words starts at the lower of the two, and the word after it breaks the period. Every run ends with
such a square, so rotating it to the left as far as the words allow gives the whole run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grouptrace.llm import words

MIN_LENGTH = 6
MIN_EXPONENT = 4


class SuffixArray:
    """Suffixes of a sequence cut into texts: order (the suffix array), place (its inverse), lcp with the suffix before.

    levels[k]: a number for each position, equal where the next 2**k words are equal (in the same text).
    """

    def __init__(self, symbols: np.ndarray, end: np.ndarray):
        """symbols: equal for equal words of a text, and never equal across texts; end: where each position's text ends."""
        n = len(symbols)
        self.end = end
        order = np.argsort(symbols, kind="stable")
        rank = np.empty(n, dtype=np.int32)
        rank[order] = _heads(symbols[order])
        self.levels = [rank]
        active = order[_shared(rank[order])]
        width = 1
        while len(active):
            after = active + width
            second = np.where(after < end[active], rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
            key = rank[active].astype(np.int64) * (n + 1) + second
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            old = rank[active]
            inside = _heads(key) - _heads(old)
            rank = rank.copy()
            rank[active] = old + inside
            self.levels.append(rank)
            active = active[_shared(rank[active])]
            width *= 2
        self.place = rank
        self.order = np.empty(n, dtype=np.int64)
        self.order[rank] = np.arange(n)
        self.lcp = np.zeros(n + 1, dtype=np.int64)
        linked = np.flatnonzero(self.levels[0][self.order[1:]] == self.levels[0][self.order[:-1]]) + 1
        self.lcp[linked] = self._common(self.order[linked - 1], self.order[linked])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words two different suffixes of one text share."""
        common = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            x, y = a + common, b + common
            inside = np.maximum(x, y) < self.end[a]
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            common += (inside & (self.levels[k][x] == self.levels[k][y])).astype(np.int64) << k
        return common

    def rotations(self, start: np.ndarray, period: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How far squares can move to the left, not below the first word of their text."""
        moved = np.zeros(len(start), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            x = start - moved - (1 << k)
            inside = x >= first
            x = np.where(inside, x, 0)
            y = np.where(inside, x + period, 0)
            moved += (inside & (self.levels[k][x] == self.levels[k][y])).astype(np.int64) << k
        return moved

    def intervals(self) -> tuple[np.ndarray, ...]:
        """(first, end, depth) of the LCP intervals, as places in the suffix array, and their children as (interval, first, end)."""
        lcp = self.lcp
        at = np.flatnonzero(lcp > 0)
        value = lcp[at]
        least, reach = [lcp], _longest(lcp > 0)
        while (2 << len(least)) <= reach + 1:
            half, width = least[-1], 1 << len(least) - 1
            least.append(np.minimum(half, np.append(half[width:], np.zeros(width, half.dtype))))
        low, high = at.copy(), at.copy()
        for k in reversed(range(len(least))):
            step = 1 << k
            # least[k][p]: the smallest value of step places from p on.
            for _ in range(2):
                fits = low - step >= 0
                fits &= np.where(fits, least[k][np.where(fits, low - step, 0)], 0) >= value
                low = np.where(fits, low - step, low)
                fits = high + 1 + step <= len(lcp)
                fits &= np.where(fits, least[k][np.where(fits, high + 1, 0)], 0) >= value
                high = np.where(fits, high + step, high)
        # The interval around place p holds the suffixes from low - 1 to high.
        pair = (low - 1) * (len(lcp) + 1) + high + 1
        same, sample, number = np.unique(pair, return_index=True, return_inverse=True)
        first, end, depth = (low - 1)[sample], (high + 1)[sample], value[sample]
        by = np.argsort(number, kind="stable")
        owner = np.concatenate([np.arange(len(same)), number[by]])
        starts = np.concatenate([first, at[by]])
        by = np.lexsort((starts, owner))
        owner, starts = owner[by], starts[by]
        ends = np.append(starts[1:], 0)
        last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
        ends[last] = end[owner[last]]
        return first, end, depth, owner, starts, ends


def _heads(ordered: np.ndarray) -> np.ndarray:
    """For sorted values, the place of the first equal one."""
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _shared(ordered: np.ndarray) -> np.ndarray:
    """Which of some sorted values occur more than once."""
    same = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(ordered), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    return shared


def _longest(flags: np.ndarray) -> int:
    """The longest stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def squares(sa: SuffixArray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of the squares whose next word breaks the period. first: where each position's text starts."""
    low, high, depth, owner, starts, ends = sa.intervals()
    if not len(low):
        return low, low
    size = ends - starts
    by = np.lexsort((-size, owner))
    largest = by[np.append(True, owner[by][1:] != owner[by][:-1])]
    small = np.ones(len(size), dtype=bool)
    small[largest] = False
    child = np.repeat(np.flatnonzero(small), size[small])
    rank = np.arange(len(child)) - np.repeat(np.cumsum(size[small]) - size[small], size[small]) + starts[child]
    suffix, half, around = sa.order[rank], depth[owner[child]], owner[child]
    found = []
    for step in (half, -half):
        other = suffix + step
        inside = (other < sa.end[suffix]) & (other >= first[suffix])
        place = sa.place[np.where(inside, other, 0)]
        inside &= (place >= low[around]) & (place < high[around]) & ((place < starts[child]) | (place >= ends[child]))
        found.append(np.stack([np.minimum(suffix, other), half])[:, inside])
    start, half = np.unique(np.concatenate(found, axis=1), axis=1)
    return start, half


def runs(symbols: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of at least two periods, by start, end and period."""
    if not len(symbols):
        return (np.zeros(0, np.int64),) * 3
    sa = SuffixArray(symbols, end)
    at, period = squares(sa, first)
    start = at - sa.rotations(at, period, first[at])
    stop = at + 2 * period
    by = np.lexsort((period, stop, start))
    start, stop, period = start[by], stop[by], period[by]
    # A run also shows with multiples of its period; the smallest comes first.
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return start[new], stop[new], period[new]


def found(documents: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(row, n_words, runs, collapsed) per document.

    row: the document's own columns but the text. runs: (start, length, period) in words, by start and period, of the maximal
    stretches of at least min_length words and min_exponent (2 or more) periods. collapsed: the words that lie in no run beyond
    that run's first period, joined by one space. A null text, or one without words, has none and an empty collapsed
    text; repeated rows give equal results; an empty table an empty one. A text of any length is worked on whole, in memory of
    some 100 bytes a word and doubling of its longest repeat.
    """
    others = [f"`{c}`" for c in documents.columns if c != "text"]
    rows = documents.select(F.struct(*others).alias("row"), "text")

    def detect(batches):
        for batch in batches:
            for row, data, bounds in words.chunks(batch.column("text")):
                w = words.Words(data, bounds)
                symbols = words.mix(w.hash + (w.text.astype(np.uint64) + words.U(1)) * words.U(0x9E3779B97F4A7C15))
                start, end, period = runs(symbols, w.range[w.text], w.range[w.text + 1])
                chosen = end - start >= np.maximum(min_length, min_exponent * period)
                start, end, period = start[chosen], end[chosen], period[chosen]
                by = np.lexsort((period, start))
                start, end, period = start[by], end[by], period[by]
                at = np.searchsorted(w.text[start], np.arange(w.n_texts + 1))
                cover = np.zeros(len(w.hash) + 1, dtype=np.int64)
                np.add.at(cover, start + period, 1)
                np.add.at(cover, end, -1)
                keep = np.cumsum(cover)[:-1] == 0
                collapsed = [w.joined(i, keep if at[i] < at[i + 1] else None) for i in range(w.n_texts)]
                listed = pa.StructArray.from_arrays(
                    [pa.array(x, pa.int64()) for x in (start - w.range[w.text[start]], end - start, period)],
                    names=["start", "length", "period"],
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(row, w.n_texts), pa.array(w.counts(), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), listed), pa.array(collapsed, pa.binary())],
                    names=["row", "n_words", "runs", "collapsed"],
                )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(
        detect, f"row {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"
    )
