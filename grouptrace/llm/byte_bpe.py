"""Byte-level BPE with DuckDB: recursive queries over token-position rows encode, an ordered aggregation decodes.

Every task holds its own in-memory database with the vocabulary and its merge table: a row (l, r, rank) for each two
tokens whose bytes together are a token. A text is cut into pieces by the tokenizer's pattern; the pieces a task hasn't
seen yet become rows (word, pos, id), one per byte, and each step of the recursion joins neighbours with the merge
table and contracts, in every word that still has one, the leftmost pair of minimum rank.

A long piece is encoded in overlapping windows, each a word of its own, that are joined where two neighbours have a token in
common. That is exact: a sequence of tokens is the encoding of its bytes if each two neighbours in it are the encoding of
theirs, and each two neighbours of the joined sequence stand together in a window. Windows without a common token are made
wider, up to the whole piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces up to this many bytes keep all steps of the recursion (a quadratic number of rows). Longer ones are cut into
#: windows of so many bytes that overlap by half.
SHORT = 64
CHUNK_CHARS = 2_500_000
#: Rows of a recursion; pieces whose ids a worker holds (about 110 bytes each), and how many of them, the most used, it
#: holds on to when there are more. A worker process outlives its tasks, and its memory counts as the executor's.
ROWS = 2_000_000
CACHED_PIECES = 800_000
KEPT_PIECES = 500_000

_STEPS = """
WITH RECURSIVE step AS (
  SELECT 0 AS round, word, pos, id, lead(id) OVER o AS next, lead(pos) OVER o AS after
  FROM start WINDOW o AS (PARTITION BY word ORDER BY pos)
  UNION ALL
  SELECT s.round + 1, s.word, s.pos, CASE WHEN s.pos = b.pos THEN b.rank ELSE s.id END,
    CASE WHEN s.pos = b.pos THEN d.next WHEN s.after = b.pos THEN b.rank ELSE s.next END,
    CASE WHEN s.pos = b.pos THEN d.after ELSE s.after END
  FROM step s
  JOIN (
    SELECT word, min(rank) AS rank, arg_min(pos, rank::BIGINT * 4294967296 + pos) AS pos,
      arg_min(after, rank::BIGINT * 4294967296 + pos) AS gone
    FROM step JOIN merges ON l = id AND r = next GROUP BY word
  ) b ON b.word = s.word
  JOIN step d ON d.word = b.word AND d.pos = b.gone
  WHERE s.pos <> b.gone
)
SELECT word, pos, id FROM step QUALIFY round = max(round) OVER (PARTITION BY word) ORDER BY word, pos
"""

# One row per (word, pos), changed in place; a token swallowed by its left neighbour keeps its row with a null id. Of a
# word's pairs of minimum rank, all that don't overlap are contracted at once where no merge with the new token ranks
# lower (safe): they would follow each other anyway, from left to right. Otherwise only the leftmost is.
_STEPS_IN_PLACE = """
WITH RECURSIVE step(word, pos, id) USING KEY (word, pos) AS (
  SELECT word, pos, id FROM start
  UNION
  SELECT word, unnest([pos, after]), unnest([rank, NULL])
  FROM (
    SELECT *, row_number() OVER (PARTITION BY word, island ORDER BY place) AS in_island,
      row_number() OVER (PARTITION BY word ORDER BY place) AS in_word
    FROM (
      SELECT *, place - row_number() OVER (PARTITION BY word ORDER BY place) AS island
      FROM (
        SELECT t.*, m.rank, m.safe, min(m.rank) OVER (PARTITION BY t.word) AS best
        FROM (
          SELECT *, lead(id) OVER o AS next, lead(pos) OVER o AS after, row_number() OVER o AS place
          FROM recurring.step WHERE id IS NOT NULL WINDOW o AS (PARTITION BY word ORDER BY pos)
        ) t JOIN merges m ON m.l = t.id AND m.r = t.next
      ) WHERE rank = best
    )
  ) WHERE in_word = 1 OR safe AND in_island % 2 = 1
)
SELECT word, pos, id FROM step WHERE id IS NOT NULL ORDER BY word, pos
"""

_DECODE = """
SELECT text, string_agg(letters, '' ORDER BY pos) AS letters FROM tokens JOIN vocabulary USING (id) GROUP BY text
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a file with a base64 token and its rank on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class _Codes(dict):
    """Piece -> code, in the order of codes. A piece asked for the first time gets the next code and is noted in new."""

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        self.new.append(piece)
        return code


class Coder:
    """A vocabulary in an in-memory DuckDB. encode() and decode() work on many pieces or texts in one query."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: str = "150MB"):
        import regex

        self.ranks, self.split, self.memory, self._db = ranks, regex.compile(pattern).findall, memory, None
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.size[list(ranks.values())] = [len(token) for token in ranks]
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [
            (ranks[token[:i]], ranks[token[i:]], rank) for token, rank in ranks.items()
            for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        ]
        left, right, rank = (np.array(x, dtype=np.int32) for x in zip(*pairs)) if pairs else np.zeros((3, 0), np.int32)
        least = np.full(max(ranks.values()) + 1, np.iinfo(np.int32).max)
        for side in (left, right):
            np.minimum.at(least, side, rank)
        self.fixed = {
            "merges": pa.table({"l": left, "r": right, "rank": rank, "safe": least[rank] > rank}),
            "vocabulary": pa.table({
                "id": pa.array(ranks.values(), pa.int32()), "letters": pa.array([t.decode("latin-1") for t in ranks]),
            }),
        }
        self._forget()

    @property
    def db(self):
        """The database with the vocabulary, opened when first asked for."""
        if self._db is None:
            import duckdb

            self._db = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": self.memory, "temp_directory": ""})
            for name, rows in self.fixed.items():
                self._table(name, **dict(zip(rows.column_names, rows.columns)))
        return self._db

    def rest(self) -> None:
        """Gives back what only a running task needs: the database, and pieces beyond the bound."""
        if self._db is not None:
            self._db.close()
            self._db = None
        self._bound()
        pa.default_memory_pool().release_unused()

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _forget(self, keep: int = 0) -> None:
        """Forgets all pieces but the `keep` that occurred in most calls; their uses count half from now on."""
        if not keep:
            self.codes = _Codes()
            self.lengths, self.uses, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        elif keep < len(self.codes):
            kept = np.zeros(len(self.codes), dtype=bool)
            kept[np.argpartition(self.uses, -keep)[-keep:]] = True
            self.codes = _Codes((piece, code) for code, piece in enumerate(compress(self.codes, kept)))
            self.ids = self.ids[np.repeat(kept, self.lengths)]
            self.lengths, self.uses = self.lengths[kept], self.uses[kept] // 2

    def _bound(self) -> None:
        if len(self.codes) > CACHED_PIECES:
            self._forget(min(KEPT_PIECES, CACHED_PIECES))

    def _merge(self, pieces: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """Per piece its number of tokens, and all tokens."""
        lengths = np.array([len(x) for x in pieces])
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        pos = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self._table("start", word=word, pos=pos.astype(np.int32), id=self.byte_id[data])
        found = self.db.execute(query).fetchnumpy()
        return np.bincount(np.asarray(found["word"]), minlength=len(pieces)), np.asarray(found["id"], dtype=np.int32)

    def _merged(self, pieces: list[bytes], query: str = _STEPS) -> tuple[np.ndarray, np.ndarray]:
        """_merge() in blocks of bounded memory: all steps of a piece have at most half its length squared in rows."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        rows = np.cumsum([len(x) ** 2 if query == _STEPS else 50 * len(x) for x in pieces])
        cuts = np.unique(np.searchsorted(rows, np.arange(0, rows[-1] + ROWS, ROWS)))
        cuts = [*cuts[cuts < len(pieces)], len(pieces)]
        found = [self._merge(pieces[a:b], query) for a, b in zip(cuts[:-1], cuts[1:])]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _joined(self, windows: list[np.ndarray], starts: list[int]) -> np.ndarray | None:
        """One sequence of the tokens of overlapping windows; None if two neighbours have no token in common."""
        out, low = [], 0
        ids, end = windows[0], np.cumsum(self.size[windows[0]])
        for other, start in zip(windows[1:], starts[1:]):
            other_end = start + np.cumsum(self.size[other])
            shared = np.intersect1d(end << 32 | ids, other_end << 32 | other)
            shared = shared[(shared >> 32) - self.size[shared & 0xFFFFFFFF] >= low]
            if not len(shared):
                return None
            cut = int(shared[0] >> 32)
            out.append(ids[(end > low) & (end <= cut)])
            ids, end, low = other, other_end, cut
        return np.concatenate([*out, ids[end > low]])

    def _merged_long(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        done: list = [None] * len(pieces)
        todo, width = list(range(len(pieces))), max(SHORT, 2)
        while todo:
            starts = {i: list(range(0, max(1, len(pieces[i]) - width // 2), width // 2)) for i in todo}
            cut = [pieces[i][a: a + width] for i in todo for a in starts[i]]
            counts, ids = self._merged(cut, _STEPS if width == SHORT else _STEPS_IN_PLACE)
            windows = iter(np.split(ids.astype(np.int64), np.cumsum(counts)[:-1]))
            for i in todo:
                done[i] = self._joined([next(windows) for _ in starts[i]], starts[i])
            todo, width = [i for i in todo if done[i] is None], 4 * width
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.array([len(x) for x in done]), np.concatenate(done).astype(np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Adds the ids of pieces, which get the next codes."""
        raw = [x.encode() for x in pieces]
        size = np.array([len(x) for x in raw])
        token = np.array([self.ranks.get(x, -1) for x in raw])
        whole = np.flatnonzero(token >= 0)
        parts = [(whole, np.ones(len(whole), np.int64), token[whole])]
        for chosen, encode in ((size <= SHORT, self._merged), (size > SHORT, self._merged_long)):
            rest = np.flatnonzero(chosen & (token < 0))
            parts.append((rest, *encode([raw[i] for i in rest])))
        lengths = np.zeros(len(raw), np.int32)
        for block, counts, _ in parts:
            lengths[block] = counts
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        ids = np.zeros(lengths.sum(dtype=np.int64), np.int32)
        for block, counts, own in parts:
            ids[np.repeat(starts[block] - np.cumsum(counts) + counts, counts) + np.arange(len(own))] = own
        self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(raw), np.int32)])

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        self._bound()
        codes, coded = self.codes, []
        codes.new = []
        for text in texts:
            pieces = self.split(text)
            coded.append(np.fromiter(map(codes.__getitem__, pieces), dtype=np.int64, count=len(pieces)))
        if codes.new:
            self.learn(codes.new)
            codes.new = []
        ends = np.cumsum(self.lengths, dtype=np.int64)
        used = np.zeros(len(self.uses), dtype=bool)
        out = []
        for code in coded:
            used[code] = True
            n = self.lengths[code].astype(np.int64)
            at = np.repeat(ends[code] - np.cumsum(n), n) + np.arange(n.sum())
            out.append(self.ids[at].astype("<u4"))
        self.uses += used
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes that each sequence of ids stands for."""
        n = [len(x) for x in ids]
        if not sum(n):
            return [b""] * len(ids)
        self._table(
            "tokens", text=np.repeat(np.arange(len(ids), dtype=np.int32), n),
            pos=np.arange(sum(n), dtype=np.int32), id=np.concatenate(ids).astype(np.int32),
        )
        found = dict(self.db.execute(_DECODE).fetchall())
        # Each letter of code point n stands for the byte n.
        return [found.get(i, "").encode("latin-1") for i in range(len(ids))]


_CODERS: dict[tuple[str, str], Coder] = {}


def _coder(vocabulary: str, ranks, pattern: str) -> Coder:
    """The worker process's coder: tasks that follow each other in it share the pieces they have learnt."""
    if (vocabulary, pattern) not in _CODERS:
        _CODERS[vocabulary, pattern] = Coder(ranks.value, pattern)
    return _CODERS[vocabulary, pattern]


def _slices(texts: list[str | None]):
    """(start, end) of runs of texts of about CHUNK_CHARS characters; a longer text is one of its own."""
    start = chars = 0
    for i, text in enumerate(texts):
        if chars and chars + len(text or "") > CHUNK_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def coded(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(row, tokens, decoded) per document: ids as little-endian unsigned 32-bit integers, and the bytes they decode to.

    row: the document's own columns but the text. A null text counts as empty and has no tokens. The vocabulary is read
    from its file by the driver and sent to the tasks. An empty table gives an empty result; repeated rows are coded alike.
    """
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    others = [f"`{c}`" for c in documents.columns if c != "text"]
    rows = documents.select(F.struct(*others).alias("row"), "text")

    def code(batches):
        coder = None
        for batch in batches:
            coder = _coder(vocabulary, ranks, pattern)
            texts = batch.column("text").to_pylist()
            for start, end in _slices(texts):
                ids = coder.encode(x or "" for x in texts[start:end])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(start, end - start),
                        pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(coder.decode(ids), pa.binary()),
                    ],
                    names=["row", "tokens", "decoded"],
                )
        if coder:
            coder.rest()

    return rows.mapInArrow(code, f"row {rows.schema['row'].dataType.simpleString()}, tokens binary, decoded binary")
