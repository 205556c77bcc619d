"""Token counts from a byte-level BPE vocabulary compiled to two deterministic transducers.

The first reads characters by class and marks where the pre-tokenizer's pattern starts a piece. A slice of texts is cut
into chunks of equal length; every chunk gets its state map (each state it may be entered in -> the state it is left in),
the maps are composed by a parallel prefix scan, and each chunk is read once more from the state it is really entered in.

The second reads the bytes of a piece. Its runs are places in the vocabulary's trie, each with the last token before it; two
tokens may follow each other if no merge across their border fires while they are built. One run at a time is the encoding
of what was read, so determinising the runs gives a transducer whose transitions carry the change in the number of emitted
tokens, and a piece's count is the sum along its path. States are compiled when a text first needs them. Pieces are
read side by side; a long one is cut into lanes whose state maps are composed.
"""

from __future__ import annotations

import json
import re
import struct
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grouptrace.llm import words

SLICE_BYTES = 1_000_000
#: Characters of a chunk, and bytes of a lane.
CHUNK = 64
LANE = 256
#: Pieces read side by side, and compiled states kept (about 250 bytes each) before those no piece stands in are forgotten.
LANES = 16_384
STATES = 600_000

OTHER, QUOTE, NUMBER, BLANK, SPACE, LETTER, STMD, RV, EL, EE, END = range(11)
START, LETTERS, NUMBERS, MARKS, QUOTED, QUOTED_RV, QUOTED_L, BLANK_1, BLANK_N, SPACE_1, SPACE_N = range(11)
BEFORE, BEFORE_LAST = 1, 2
_IN_LETTERS = {LETTER, STMD, RV, EL, EE}
_WHITE = {BLANK, SPACE}


def _fresh(kind: int) -> int:
    """The state after a piece's first character."""
    named = {OTHER: MARKS, QUOTE: QUOTED, NUMBER: NUMBERS, BLANK: BLANK_1, SPACE: SPACE_1, END: START}
    return named.get(kind, LETTERS)


def _step(state: int, kind: int) -> tuple[int, int]:
    """(next state, whether a piece starts BEFORE this character or BEFORE_LAST one) of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    new = _fresh(kind), BEFORE
    if state in (QUOTED_RV, QUOTED_L):
        if kind == (EE if state == QUOTED_RV else EL):
            return START, 0
        then, marks = _step(LETTERS, kind)
        return then, marks | BEFORE_LAST
    if kind == END or state == START:
        return new
    if state == LETTERS:
        return (LETTERS, 0) if kind in _IN_LETTERS else new
    if state == NUMBERS:
        return (NUMBERS, 0) if kind == NUMBER else new
    if state == MARKS:
        return (MARKS, 0) if kind in (OTHER, QUOTE) else new
    if state == QUOTED:
        goes_on = {STMD: START, RV: QUOTED_RV, EL: QUOTED_L, OTHER: MARKS, QUOTE: MARKS}
        return (goes_on[kind], 0) if kind in goes_on else new
    if kind in _WHITE:
        return (BLANK_N if kind == BLANK else SPACE_N), 0
    last = BEFORE_LAST if state in (BLANK_N, SPACE_N) else 0
    if state in (SPACE_1, SPACE_N):
        return new[0], BEFORE | last
    return {NUMBER: NUMBERS, OTHER: MARKS, QUOTE: MARKS}.get(kind, LETTERS), last


_KINDS = 11
_NEXT = np.array([[_step(s, k)[0] for k in range(_KINDS)] for s in range(11)], dtype=np.uint8).ravel()
_MARKS = np.array([[_step(s, k)[1] for k in range(_KINDS)] for s in range(11)], dtype=np.uint8).ravel()
#: The states that a character of a class can lead to (at most three), and each state's place among them.
_AFTER = [sorted({int(_NEXT[s * _KINDS + k]) for s in range(11)}) for k in range(_KINDS)]
_ENTRY = np.array([(x * 3)[:3] if len(x) < 3 else x for x in _AFTER], dtype=np.uint8)
_PLACE = np.array([[x.index(s) if s in x else 0 for s in range(11)] for x in _AFTER], dtype=np.uint8)


def piece_marks(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pieces start in a sequence of classes; every END starts one as well."""
    n = len(kinds)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, END, dtype=np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    before = np.concatenate([[END], grid[-1, :-1]])
    state = _ENTRY[before].astype(np.intp)
    for kind in grid:
        state = _NEXT[state * _KINDS + kind[:, None]].astype(np.intp)
    # From here on a map sends places among a chunk's entry states to places among the next chunk's.
    scan = _PLACE[grid[-1][:, None], state].astype(np.intp)
    step = 1
    while step < rows:
        scan[step:] = np.take_along_axis(scan[step:], scan[:-step].copy(), axis=1)
        step *= 2
    entry = np.zeros(rows, dtype=np.intp)
    entry[1:] = scan[:-1, 0]
    state = _ENTRY[before, entry].astype(np.intp)
    marks = np.zeros(grid.shape, dtype=np.uint8)
    for row, kind in zip(marks, grid):
        at = state * _KINDS + kind
        row[:] = _MARKS[at]
        state = _NEXT[at].astype(np.intp)
    marks = marks.T.ravel()
    starts = (marks[:n] & BEFORE).astype(bool)
    starts[:-1] |= (marks[1:n] & BEFORE_LAST).astype(bool)
    return starts


class Vocabulary:
    """What a tokenizer file fixes: the trie of its tokens, their merges and its special strings. Made by the driver."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, splits = said["model"], said["pre_tokenizer"]
        plain = splits and splits["type"] == "ByteLevel" and splits["use_regex"] and not splits["add_prefix_space"]
        odd = said["normalizer"] or model["type"] != "BPE" or any(
            model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or odd or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in said["added_tokens"]):
            raise ValueError("only byte-level BPE with the usual pattern and plain special strings is compiled")
        self.special = sorted((x["content"].encode() for x in said["added_tokens"]), key=len, reverse=True)
        letters = {}
        for b in range(256):
            letters[chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(256 + len(letters) - sum(ord(x) < 256 for x in letters))] = b
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        number = {t: i for i, t in enumerate(raw)}
        #: By token: the merge that makes it (-1: a byte), and its two parts.
        self.made = [-1] * len(raw)
        self.left, self.right = [-1] * len(raw), [-1] * len(raw)
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = number[a + b]
            self.merges[number[a], number[b]] = rank
            if self.made[made] < 0:
                self.made[made], self.left[made], self.right[made] = rank, number[a], number[b]
        #: Trie: node << 8 | byte -> node; by node its token (-1: none) and whether it goes on.
        self.trie: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for text, name in raw.items():
            i = number[text]
            if self.made[i] < 0 and len(name) > 1:
                continue
            node = 0
            for b in name:
                self.inner[node] = True
                node = self.trie.setdefault(node << 8 | b, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = i
        for node, i in enumerate(self.token):
            if i >= 0 and self.made[i] >= 0 and not self._stands(i):
                self.token[node] = -1

    def _edge(self, token: int, side: list[int]) -> list[tuple[int, int, int]]:
        """(token, when it is made, when it is merged into the next) of the tokens at one edge while a token is built."""
        chain, until = [], 1 << 60
        while token >= 0:
            chain.append((token, self.made[token], until))
            token, until = side[token], self.made[token]
        return chain

    def first_across(self, a: int, b: int) -> int | None:
        """The first merge across the border of two tokens that fires before both are built; of equal merges the left one."""
        found = None
        for x, x_from, x_until in self._edge(a, self.right):
            for y, y_from, y_until in self._edge(b, self.left):
                if x_from < y_until and y_from < x_until:
                    rank = self.merges.get((x, y))
                    if rank is not None and rank < x_until and rank <= y_until and (found is None or rank < found):
                        found = rank
        return found

    def _stands(self, token: int) -> bool:
        """Do a token's bytes on their own become this token?"""
        a, b = self.left[token], self.right[token]
        return self.first_across(a, b) == self.made[token]


#: A run of the second transducer in one number: trie node, last token before it + 1, and _NONE + tokens before it less those
#: of the whole text read. A state is its runs as bytes.
_NODE, _LAST, _NONE = 36, 16, 1 << 15
_REST = (1 << _NODE) - 1
_FIRST = struct.pack("q", _NONE)


class Transitions:
    """(state << 8 | byte) -> next state and gain, in one open hash table that whole arrays are looked up in."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.next, self.gain = np.zeros(1 << bits, dtype=np.int32), np.zeros(1 << bits, dtype=np.int16)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        """Each key's slot, or the free one where it belongs."""
        mixed = key.astype(np.uint64) * words.U(0x9E3779B97F4A7C15)
        slot = (mixed >> words.U(64 - self.bits)).astype(np.int64)
        rest = np.arange(len(key))
        while len(rest):
            held = self.keys[slot[rest]]
            rest = rest[(held != key[rest]) & (held >= 0)]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
        return slot

    def of(self, key: np.ndarray, compiled) -> tuple[np.ndarray, np.ndarray]:
        slot = self._slots(key)
        missing = self.keys[slot] < 0
        if missing.any():
            for k in np.unique(key[missing]).tolist():
                self._put(k, *compiled(k))
            slot = self._slots(key)
        return self.next[slot], self.gain[slot]

    def _put(self, key: int, to: int, gain: int) -> None:
        if 2 * self.used > len(self.keys):
            old = self.keys >= 0
            key_, next_, gain_ = self.keys[old], self.next[old], self.gain[old]
            self.__init__(self.bits + 1)
            for k, t, g in zip(key_.tolist(), next_.tolist(), gain_.tolist()):
                self._put(k, t, g)
        slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
        keys, last = self.keys, len(self.keys) - 1
        while keys[slot] >= 0:
            slot = slot + 1 & last
        keys[slot], self.next[slot], self.gain[slot] = key, to, gain
        self.used += 1


class Counter:
    """The compiled tokenizer of a worker process."""

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers import pre_tokenizers

        self.words = vocabulary
        self.pieces_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.special = re.compile(b"|".join(map(re.escape, vocabulary.special))) if vocabulary.special else None
        self.kinds = np.full(0x110000, 255, dtype=np.uint8)
        for text, kind in (("'", QUOTE), (" ", BLANK), ("stmd", STMD), ("rv", RV), ("l", EL), ("e", EE)):
            self.kinds[[ord(c) for c in text]] = kind
        self.apart: dict[int, bool] = {}
        self._forget(np.zeros(0, np.int64))

    def _learn_kinds(self, points: np.ndarray) -> None:
        """Classes of characters as the library's own pattern has them: a piece of letters, of digits or of marks goes on."""
        new = np.unique(points[self.kinds[points] == 255])
        if not len(new):
            return
        kinds = np.full(len(new), SPACE, dtype=np.uint8)
        for before, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            text = "".join(f"{before}{chr(c)}\n" for c in new)
            split = np.zeros(len(text) + 1, dtype=bool)
            split[[start for _, (start, _) in self.pieces_of(text)]] = True
            kinds[~split[1:-1:3]] = kind
        self.kinds[new] = kinds

    def _forget(self, keep: np.ndarray) -> np.ndarray:
        """Forgets all states but the start and those to keep, which get new numbers in their order."""
        old = [_FIRST] + [self.runs[i] for i in keep]
        self.runs, self.numbers, self.moves = [], {}, Transitions()
        return np.array([self._number(x) for x in old])[1:]

    def _number(self, runs: bytes) -> int:
        number = self.numbers.setdefault(runs, len(self.runs))
        if number == len(self.runs):
            self.runs.append(runs)
        return number

    def _may_follow(self, last: int, token: int) -> bool:
        pair = last << 20 | token
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) > 300_000:
                self.apart.clear()
            known = self.apart[pair] = self.words.first_across(last, token) is None
        return known

    def _compile(self, key: int) -> tuple[int, int]:
        """(next state, gain) of a state and a byte."""
        byte, runs = key & 255, self.runs[key >> 8]
        trie, token, inner = self.words.trie, self.words.token, self.words.inner
        moved, ended, gain = [], -1, 0
        for run in struct.unpack(f"{len(runs) // 8}q", runs):
            to = trie.get(run >> _NODE << 8 | byte)
            if to is None:
                continue
            if inner[to]:
                moved.append(to << _NODE | run & _REST)
            new = token[to]
            if new >= 0:
                last = (run >> _LAST & 0xFFFFF) - 1
                if last < 0 or self._may_follow(last, new):
                    ended, gain = new, (run & 0xFFFF) - _NONE + 1
        moved = [run - gain for run in moved]
        return self._number(struct.pack(f"{len(moved) + 1}q", *moved, ended + 1 << _LAST | _NONE)), gain

    def _read(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, entry: list[bytes] | None = None):
        """(runs after it, tokens gained) for byte ranges that are read from given runs; without these from the start, and
        only what they gain."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state = np.array([self._number(entry[i]) for i in order] if entry else np.zeros(len(order)), dtype=np.int64)
        gained = np.zeros(len(order), dtype=np.int64)
        live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        out: list = [None] * len(order)
        done = len(order)
        for place, n in enumerate([*live, 0]):
            for i in range(n, done) if entry else ():
                out[order[i]] = self.runs[state[i]]
            done = n
            if not n:
                break
            if len(self.runs) > STATES:
                state[:n] = self._forget(state[:n])
            to, gain = self.moves.of(state[:n] * 256 + data[start[:n] + place], self._compile)
            gained[:n] += gain
            state[:n] = to
        back = np.empty(len(order), dtype=np.int64)
        back[order] = gained
        return out, back

    def _short(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(start), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        for o in range(0, len(start), LANES):
            block = order[o: o + LANES]
            counts[block] = self._read(data, start[block], length[block])[1]
        return counts

    def _long(self, data: np.ndarray, start: int, length: int) -> int:
        """A piece of many lanes. A lane's map grows by the entry states that turn out to be asked for: first the start
        and what the lane before leaves from there, then whatever the walk from the piece's start meets."""
        cuts = [*range(start, start + length, LANE), start + length]
        content: dict[bytes, int] = {}
        lanes = [content.setdefault(data[a:b].tobytes(), len(content)) for a, b in pairwise(cuts)]
        places = {lane: (a, b - a) for lane, (a, b) in zip(lanes, pairwise(cuts))}
        maps: dict = {}

        def extend(asked) -> None:
            asked = [x for x in dict.fromkeys(asked) if x not in maps]
            for o in range(0, len(asked), LANES):
                block = asked[o: o + LANES]
                at = np.array([places[lane] for lane, _ in block])
                after, gained = self._read(data, at[:, 0], at[:, 1], [x for _, x in block])
                maps.update(zip(block, zip(after, gained.tolist())))

        extend((lane, _FIRST) for lane in lanes)
        extend((lane, maps[before, _FIRST][0]) for before, lane in pairwise(lanes))
        state, total = _FIRST, 0
        for lane in lanes:
            extend([(lane, state)])
            state, gained = maps[lane, state]
            total += gained
        return total

    def count(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of each text of a slice."""
        n_texts = len(bounds) - 1
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        self._learn_kinds(points)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        kinds = self.kinds[points]
        chars = np.searchsorted(at, bounds)
        text = np.repeat(np.arange(n_texts), np.diff(chars))
        totals = np.zeros(n_texts, dtype=np.int64)
        for found in self.special.finditer(data.tobytes()) if self.special else ():
            a, b = np.searchsorted(at, found.span())
            if text[a] == text[b - 1]:
                kinds[a:b] = END
                totals[text[a]] += 1
        # Every text is followed by an END of its own.
        place = np.arange(len(points)) + text
        spread = np.full(len(points) + n_texts, END, dtype=np.uint8)
        spread[place] = kinds
        byte = np.full(len(spread) + 1, len(data), dtype=np.int64)
        byte[place] = at
        byte[chars[1:] + np.arange(n_texts)] = bounds[1:]
        starts = np.flatnonzero(piece_marks(spread))
        ends = np.append(starts[1:], len(spread))
        chosen = spread[starts] != END
        starts, ends = starts[chosen], ends[chosen]
        owner = np.searchsorted(chars[1:] + np.arange(n_texts), starts)
        first, last = byte[starts], byte[ends]
        _, sample, same = np.unique(words.range_hash(data, first, last), return_index=True, return_inverse=True)
        first, length = first[sample], (last - first)[sample]
        counts = np.zeros(len(sample), dtype=np.int64)
        short = length <= LANE
        counts[short] = self._short(data, first[short], length[short])
        for i in np.flatnonzero(~short):
            counts[i] = self._long(data, int(first[i]), int(length[i]))
        return totals + np.bincount(owner, weights=counts[same], minlength=n_texts).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}


def _counter(tokenizer: str, vocabulary) -> Counter:
    """The worker process's counter: tasks that follow each other in it share what is compiled."""
    if tokenizer not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[tokenizer] = Counter(vocabulary.value)
    return _COUNTERS[tokenizer]


def counted(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(row, n_bytes, n_tokens) per document: the text's length in UTF-8 and its tokens as the library gives them.

    row: the document's own columns but the text. tokenizer: a file of byte-level BPE that the driver reads; its special strings
    inside texts count as one token each. A null or empty text has no bytes and no tokens; a text of any length is read
    whole, in memory in proportion to its length; repeated rows count alike; an empty table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer))
    others = [f"`{c}`" for c in documents.columns if c != "text"]
    rows = documents.select(F.struct(*others).alias("row"), "text")

    def count(batches):
        counter = _counter(tokenizer, shared)
        for batch in batches:
            for row, data, bounds in words.chunks(batch.column("text"), SLICE_BYTES):
                found = counter.count(data, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(row, len(found)), pa.array(np.diff(bounds)), pa.array(found)],
                    names=["row", "n_bytes", "n_tokens"],
                )

    return rows.mapInArrow(count, f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, n_tokens long")
