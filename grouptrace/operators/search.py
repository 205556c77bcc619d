"""Ranked text search: BM25 over a table of documents for a table of queries.

Score of a document for a query, over the distinct query tokens t found in it (Okapi BM25):

    sum of  idf(t) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length))
    idf(t) = ln(1 + (N - df(t) + 0.5) / (df(t) + 0.5))

Pairing every query token with every document that holds it would pair nearly all queries with nearly
all documents through words such as "the". The search gives the same result without that:

1. Documents with the same words are scored once, and so are queries with the same words.
2. The postings are laid out in blocks of documents with like words and lengths, in files of the shared folder: in a block, each
   token's postings stand together, with its idf and its largest weight in the block. These largest weights, summed over a
   query's tokens, bound what any document of the block can score.
3. The queries are dealt into chunks. A chunk's task reads the blocks one after the other from their files: neither blocks nor
   queries are copied for each other, and what lies on disk grows with the corpus and the queries, not with their product.
4. The few best texts for a query's rarest words, in the block of its largest bound, give a floor for its k-th best score, which
   rises with each block. Blocks whose bound lies below it are passed over.
5. In a block only a query's rarest tokens look for texts: those that, together with the lighter ones, can reach the
   floor. What they find is completed by the lighter tokens, and what can still be among the best k is kept.

Weights are whole billionths, so a sum does not depend on the order of its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grouptrace.functions.text import tokens
from grouptrace.operators.ranking import top_k
from grouptrace.session import Scratch, freed_shuffles, materialize

UNIT = 1e9
# Scores are reported in millionths; a text within this many billionths of the floor can still tie.
SLACK = 2_000
# Texts and postings of a block; a longer text has one of its own.
BLOCK_TEXTS = 16_384
BLOCK_POSTINGS = 524_288
# Queries that a task scores against the blocks; for each chunk of them all blocks are read. One of so many tokens is cut.
CHUNK_QUERIES = 32_768
CHUNK_TOKENS = 1 << 22
# Queries whose texts are sought together, the postings that may bring a first floor, and the texts that are completed together.
GROUP = 32
# Postings of a token that are added by themselves; those of shorter ones are added together.
LONG = 128
FIRST_POSTINGS = 1_024
COMPLETED = 1 << 20
# The share of its floor that a query's lighter tokens may still add to a text; the others seek texts.
LEFT = 0.6


@dataclass(frozen=True)
class TextIndex:
    """``texts``: text_no, words_id, first_keys, copies, doc_len, terms. ``members``: words_id, document keys; only for the first
    document of each text none are needed.

    ``analysis``: how tokens became the index's terms, as (column of tokens kept?, column of the term), where it isn't plain.
    """

    texts: DataFrame
    members: DataFrame | None
    keys: tuple[str, ...]
    analysis: tuple[Callable[[Column], Column], Callable[[Column], Column]] | None = None


def _line_of_terms() -> tuple[Column, Column]:
    """A text's terms as they take least room on their way between tasks: its tokens, which hold no space, and their counts."""
    return F.array_join("terms.token", " ").alias("_line"), F.col("terms.tf").alias("_tfs")


def build_index(
    corpus: DataFrame, keys: Sequence[str], text: str, members: bool = True, scratch: Scratch | None = None
) -> TextIndex:
    """Index of a corpus, written to the shared folder. It can serve any number of searches, without ``members`` only those
    for the best document. With ``scratch`` it goes with its tables.

    The (token, tf) pairs of a document are the runs of equal words among its sorted words, so a
    document is not taken apart to be counted.
    """
    words = corpus.select(
        *keys, F.sort_array(tokens(F.coalesce(F.col(text), F.lit("")))).alias("_words")
    )
    size = F.size("_words")
    run_starts = F.filter(
        F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get("_words", i) != F.get("_words", i - 1))
    )
    runs = words.select(
        *keys,
        F.unhex(F.sha2(F.concat_ws(" ", "_words"), 256)).alias("words_id"),
        "_words",
        F.when(size > 0, run_starts).otherwise(F.array().cast("array<int>")).alias("_starts"),
    )

    def term(start: Column, place: Column) -> Column:
        end = F.coalesce(F.get("_starts", place + 1), size)
        return F.struct(F.get("_words", start).alias("token"), (end - start).alias("tf"))

    counted = runs.select(
        *keys, "words_id", size.cast("long").alias("doc_len"), F.transform("_starts", term).alias("terms")
    )
    store = scratch.store if scratch else materialize
    # Names as long as their texts would lie on disk twice.
    rows = store(counted, "search-rows") if members else counted
    texts = rows.select("*", *_line_of_terms()).groupBy("words_id").agg(
        F.min(F.struct(*keys)).alias("first_keys"),
        F.count("*").alias("copies"),
        F.max("doc_len").alias("doc_len"),
        F.first(F.struct("_line", "_tfs")).alias("_terms"),
    )
    terms = F.arrays_zip(F.split("_terms._line", " ").alias("token"), F.col("_terms._tfs").alias("tf"))
    none = F.array().cast("array<struct<token:string,tf:int>>")
    texts = texts.withColumn("terms", F.when(F.size("_terms._tfs") > 0, terms).otherwise(none)).drop("_terms")
    numbered = texts.withColumn("text_no", F.monotonically_increasing_id())
    return TextIndex(store(numbered, "search-texts"), rows.select("words_id", *keys) if members else None, tuple(keys))


def light_stem(token: Column) -> Column:
    """A token without its commonest English endings, as long as three letters remain."""
    return F.regexp_replace(token, "^(.{3,}?)(ings?|edly|ed|ly|es|s)$", "$1")


def analysed(
    index: TextIndex, stop_words: Sequence[str] = (), stem: Callable[[Column], Column] | None = None,
    scratch: Scratch | None = None,
) -> TextIndex:
    """The index without stop words and, with ``stem``, of stems instead of words.

    Both are decided text by text, where its terms stand, so no term is moved. Searches of the new index treat their queries
    alike.
    """
    counts, term = (lambda token: ~token.isin(*stop_words)), (stem or (lambda token: token))
    kept = F.transform(
        F.filter("terms", lambda t: counts(t["token"])), lambda t: F.struct(term(t["token"]).alias("token"), t["tf"].alias("tf")))
    texts = index.texts.withColumn("_sorted", F.array_sort(kept))
    size = F.size("_sorted")
    run_starts = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: (i == 0) | (F.get("_sorted", i)["token"] != F.get("_sorted", i - 1)["token"]))
    texts = texts.withColumn("_starts", F.when(size > 0, run_starts).otherwise(F.array().cast("array<int>")))

    def merged(start: Column, place: Column) -> Column:
        run = F.slice("_sorted", start + 1, F.coalesce(F.get("_starts", place + 1), size) - start)
        tf = F.aggregate(run, F.lit(0), lambda total, t: total + t["tf"])
        return F.struct(F.get("_sorted", start)["token"].alias("token"), tf.alias("tf"))

    texts = texts.select(
        "text_no", "words_id", "first_keys", "copies",
        F.aggregate("_sorted", F.lit(0).cast("long"), lambda total, t: total + t["tf"]).alias("doc_len"),
        F.transform("_starts", merged).alias("terms"),
    )
    store = scratch.store if scratch else materialize
    return TextIndex(store(texts, "analysed-texts"), index.members, index.keys, (counts, term))


def vocabulary(index: TextIndex) -> DataFrame:
    """(token_id, token, df) of an index. Postings know a token by its id, a 64-bit hash."""
    terms = index.texts.select("copies", F.inline("terms"))
    return terms.groupBy("token").agg(F.sum("copies").alias("df")).withColumn("token_id", F.xxhash64("token"))


def _without_collision(known: DataFrame, asked: DataFrame) -> None:
    """Two tokens with one id, of texts or of queries, would be scored as one: an error."""
    found = known.select("token").unionByName(asked.select("token")).distinct()
    ids = found.groupBy(F.xxhash64("token").alias("token_id")).count()
    if not ids.filter("count > 1").isEmpty():
        raise ValueError("two tokens share an id")


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted values."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


_BLOCK = "block long, texts array<long>, token_ids binary, idfs binary, tops binary, offsets binary, docs binary, tfs binary, norms binary"
_HEADS = ["token_ids", "idfs", "tops"]


def _packed(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes each as the largest takes."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def _unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{len(data) // count}").astype(np.int64)


def _saturation(tf: np.ndarray, norm: np.ndarray, k1: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + norm)


def _points(idf: np.ndarray, saturation: np.ndarray) -> np.ndarray:
    return np.floor(idf * saturation * UNIT + 0.5)


def _stored(folder: str, columns: Sequence[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a table in the shared folder, so many at a time, in an order that stays. ``folder`` is a path or a URI that
    pyarrow knows."""
    store, root = fs.FileSystem.from_uri(folder)
    for path in sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")):
        with store.open_input_file(path) as file:
            yield from pq.ParquetFile(file).iter_batches(batch_size=rows, columns=list(columns))


def _idfs_of(ids: np.ndarray, vocabulary: str | None) -> np.ndarray:
    """The idf of each of a block's tokens, which stand in order. The vocabulary passes by; no task holds it."""
    idfs = np.ones(len(ids))
    for batch in _stored(vocabulary, ["token_id", "idf"], 1 << 18) if vocabulary else ():
        known, idf = (np.asarray(batch.column(i)) for i in range(2))
        at = np.minimum(np.searchsorted(ids, known), len(ids) - 1)
        hit = ids[at] == known
        idfs[at[hit]] = idf[hit]
    return idfs


def posting_blocks(
    index: TextIndex, mean_len: float, k1: float = 1.2, b: float = 0.75, vocabulary: str | None = None
) -> DataFrame:
    """The postings in blocks: per block its texts, its tokens in order with their idf, their largest weight and the
    bounds of their postings, and the postings as (place of the text in the block, count), with a norm for each text. A posting's
    weight is made of its count and its text's norm where it is read: the two take a quarter of its room.

    Texts with the same most frequent word are neighbours and among them texts of like length, so that blocks differ in what
    they hold and a block's largest weights are near to its others. A block is cut where it has BLOCK_TEXTS texts or
    BLOCK_POSTINGS postings: memory and tasks are bounded whatever the corpus. ``vocabulary``: the folder of (token_id, idf); without it
    every idf is 1.
    """
    commonest = F.array_max(F.transform("terms", lambda t: F.struct(t.tf, t.token)))["token"]
    texts = index.texts.filter(F.size("terms") > 0).select(
        commonest.alias("_near"), "text_no", F.col("doc_len").cast("double").alias("doc_len"), *_line_of_terms())
    order = ["_near", "doc_len", "text_no"]
    near = texts.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "text_no", "doc_len", F.transform(F.split("_line", " "), lambda t: F.xxhash64(t)).alias("token_ids"), "_tfs")

    def block(number: int, rows: list[tuple]) -> pa.RecordBatch:
        sizes = [len(ids) for _, _, ids, _ in rows]
        ids, tf = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        norms = k1 * ((1 - b) + b * np.array([r[1] for r in rows], dtype=np.float64) / mean_len)
        by = np.argsort(ids, kind="stable")
        ids, doc, tf = ids[by], doc[by], tf[by]
        at = _starts(ids)
        idfs = _idfs_of(ids[at], vocabulary)
        tops = _points(idfs, np.maximum.reduceat(_saturation(tf, norms[doc], k1), at))
        arrays = (ids[at], idfs, tops, np.append(at, len(ids)).astype(np.int64), _packed(doc), _packed(tf), norms)
        columns = [pa.array([x.tobytes()], pa.binary()) for x in arrays]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), *columns],
            names=["block", "texts", *_HEADS, "offsets", "docs", "tfs", "norms"])

    def cut(batches):
        number, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            bounds = np.concatenate([[0], np.cumsum(np.asarray(columns[2].value_lengths()))])
            ids, tfs = np.asarray(columns[2].flatten()), np.asarray(columns[3].flatten())
            for i, (text, length) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist())):
                own = slice(bounds[i], bounds[i + 1])
                if rows and (len(rows) == BLOCK_TEXTS or held + bounds[i + 1] - bounds[i] > BLOCK_POSTINGS):
                    yield block(number, rows)
                    number, rows, held = number + 1, [], 0
                rows.append((text, length, ids[own], tfs[own]))
                held += bounds[i + 1] - bounds[i]
        if rows:
            yield block(number, rows)

    return near.mapInArrow(cut, _BLOCK)


class _Heads:
    """A block's tokens, with what is needed to bound its texts."""

    def __init__(self, token_ids: bytes, idfs: bytes, tops: bytes):
        self.tokens = np.frombuffer(token_ids, dtype=np.int64)
        self.idfs, self.tops = np.frombuffer(idfs, dtype=np.float64), np.frombuffer(tops, dtype=np.float64)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where tokens stand in the block, -1 where they don't."""
        at = np.minimum(np.searchsorted(self.tokens, ids), len(self.tokens) - 1)
        return np.where(self.tokens[at] == ids, at, -1)


class _Block(_Heads):
    """A block with its postings. Within a token, they stand in the order of their texts."""

    def __init__(
        self, k1: float, texts: pa.Array, token_ids: bytes, idfs: bytes, tops: bytes, offsets: bytes, docs: bytes, tfs: bytes,
        norms: bytes,
    ):
        super().__init__(token_ids, idfs, tops)
        self.texts, self.offsets = np.asarray(texts), np.frombuffer(offsets, dtype=np.int64)
        self.docs, tf = _unpacked(docs, self.offsets[-1]), _unpacked(tfs, self.offsets[-1]).astype(np.float64)
        sizes = np.diff(self.offsets)
        self.points = _points(np.repeat(self.idfs, sizes), _saturation(tf, np.frombuffer(norms, dtype=np.float64)[self.docs], k1))
        self.keys = np.repeat(np.arange(len(sizes)) * len(self.texts), sizes) + self.docs

    def _completed(self, asked: _Asked, token, of, doc, total, floors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts of which a query's tokens up to ``token`` are summed: the lighter ones are added one by one, as long as
        a text can still reach the floor."""
        done = []
        while len(of):
            can = total + asked.left(token, of) >= floors[of]
            of, doc, total, token = of[can], doc[can], total[can], token[can]
            over = token == asked.bounds[of + 1]
            done.append((of[over], doc[over], total[over]))
            of, doc, total, token = of[~over], doc[~over], total[~over], token[~over]
            wanted = asked.at[token] * len(self.texts) + doc
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            total = total + np.where(self.keys[place] == wanted, self.points[place], 0)
            token = token + 1
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (of, doc, total)

    def best(
        self, asked: _Asked, floors: np.ndarray, k: int, room: np.ndarray, postings: int = 0
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, text, points) of the texts that reach their query's floor and can be among the block's best k.

        room: zeros for GROUP queries' texts. postings: a query's rarest tokens alone seek texts, as long as they have so few, and
        the texts are those that get most of them: good ones, though perhaps not the best.
        """
        texts, n = len(self.texts), len(floors)
        floors = np.maximum(floors, 1)
        sizes = self.offsets[asked.at + 1] - self.offsets[asked.at]
        if postings:
            upto = np.cumsum(sizes)
            own = upto - (upto - sizes)[asked.bounds[asked.query]]
            seeking = (own <= postings) | (np.arange(len(own)) == asked.bounds[asked.query])
        else:
            seeking = asked.rest[:-1] >= LEFT * floors[asked.query]
        seeks = asked.bounds[:-1] + np.bincount(asked.query, weights=seeking, minlength=n).astype(np.int64)
        held, count = [], 0
        for first in range(0, n, GROUP):
            last = min(n, first + GROUP)
            tokens = slice(asked.bounds[first], asked.bounds[last])
            here = seeking[tokens]
            at, query, size = asked.at[tokens][here], asked.query[tokens][here], sizes[tokens][here]
            if not len(at):
                continue
            row = query - first
            short = size < LONG
            ends = np.cumsum(size[short])
            if len(ends):
                place = np.repeat(self.offsets[at[short]] - ends + size[short], size[short]) + np.arange(ends[-1])
                np.add.at(room, np.repeat(row[short] * texts, size[short]) + self.docs[place], self.points[place])
            table = room[:(last - first) * texts].reshape(last - first, texts)
            for i, begin, end in zip(row[~short].tolist(), self.offsets[at[~short]].tolist(), self.offsets[at[~short] + 1].tolist()):
                table[i][self.docs[begin:end]] += self.points[begin:end]
            if k == 1:
                most = table.max(axis=1)
            if postings:
                least = np.maximum(most, 1) if k == 1 else np.ones(last - first)
            else:
                if k == 1:
                    # What has been summed so far is a floor as well.
                    floors[first:last] = np.maximum(floors[first:last], most - SLACK)
                least = np.maximum(floors[first:last] - asked.left(seeks[first:last], np.arange(first, last)), 1)
            found = np.flatnonzero(table >= least[:, None])
            of, doc, points = found // texts + first, found % texts, room[found]
            table[:] = 0
            if postings:
                of, doc, points = _first(of, doc, points, k)
            held.append((of, doc, points))
            count += len(of)
            if count > COMPLETED or last == n:
                yield self._ranked(asked, seeks, held, floors, k)
                held, count = [], 0
        if held:
            yield self._ranked(asked, seeks, held, floors, k)

    def _ranked(self, asked: _Asked, seeks, held, floors, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, doc, total = (np.concatenate(x) for x in zip(*held))
        of, doc, total = self._completed(asked, seeks[of], of, doc, total, floors)
        of, doc, total = _first(of, doc, total, k, SLACK)
        return of, self.texts[doc], total.astype(np.int64)


def _first(of: np.ndarray, doc: np.ndarray, total: np.ndarray, k: int, slack: float | None = None) -> tuple:
    """Each query's k best texts, in order; with ``slack`` also those so little below the k-th."""
    by = np.lexsort((doc, -total, of))
    of, doc, total = of[by], doc[by], total[by]
    begins = _starts(of)
    sizes = np.diff(np.append(begins, len(of)))
    rank = np.arange(len(of)) - np.repeat(begins, sizes)
    best = rank < k
    if slack is not None and len(of):
        kth = np.where(sizes >= k, total[np.minimum(begins + k - 1, len(of) - 1)] - slack, 0)
        best |= total >= np.repeat(kth, sizes)
    return of[best], doc[best], total[best]


class _Asked:
    """The tokens of queries that a block has, a query's in the order of their idf, the largest first.

    at: their places in the block, query: whose they are (numbers from 0, in order), bounds: where each query's begin.
    """

    def __init__(self, block: _Heads, at: np.ndarray, query: np.ndarray, n: int):
        self.at, self.query, self.bounds = at, query, np.searchsorted(query, np.arange(n + 1))
        # What a token and its query's lighter ones can add: a text without heavier ones reaches no more.
        upto = np.concatenate([[0.0], np.cumsum(block.tops[at])])
        self.rest = np.append(upto[self.bounds[query + 1]] - upto[:-1], 0.0)

    def left(self, token: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.where(token < self.bounds[of + 1], self.rest[token], 0.0)


class _Chunk:
    """Queries that a task scores against all blocks, or against every ``slices``-th one from ``own`` on."""

    def __init__(self, count: int, sizes: np.ndarray, ids: np.ndarray, k: int, k1: float, folder: str, own: int, slices: int):
        self.count, self.k, self.k1, self.folder, self.own, self.slices = count, k, k1, folder, own, slices
        self.ids, self.token = np.unique(ids, return_inverse=True)
        self.query = np.repeat(np.arange(count), sizes)
        self.floors, self.best = np.zeros(count), np.zeros((count, k))
        self.room = np.zeros(0)

    def _blocks(self, columns: Sequence[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for number, batch in enumerate(_stored(self.folder, columns, 1)):
            if number % self.slices == self.own:
                yield number, batch

    def _whole(self) -> Iterator[tuple[int, _Block]]:
        names = [c.split()[0] for c in _BLOCK.split(", ")][1:]
        for number, batch in self._blocks(names):
            texts, *rest = (batch.column(name)[0] for name in names)
            block = _Block(self.k1, texts.values, *(x.as_py() for x in rest))
            if len(self.room) < GROUP * len(block.texts):
                self.room = np.zeros(GROUP * len(block.texts))
            yield number, block

    def _bounds(self, block: _Heads, at: np.ndarray) -> np.ndarray:
        """What a text of the block can score for each query."""
        tops = np.append(block.tops, 0.0)[at]
        return np.bincount(self.query, weights=tops[self.token], minlength=self.count)

    def _asked(self, block: _Heads, at: np.ndarray, opened: np.ndarray) -> _Asked:
        """The block's share of some queries, given as a flag for each."""
        here = opened[self.query] & (at >= 0)[self.token]
        number = np.cumsum(opened) - 1
        return _Asked(block, at[self.token[here]], number[self.query[here]], int(opened.sum()))

    def _set_out(self) -> np.ndarray:
        """The block of each query's largest bound. Puts each query's tokens into the order of their idf."""
        idfs = np.zeros(len(self.ids))
        most, where = np.zeros(self.count), np.full(self.count, -1)
        for number, batch in self._blocks(_HEADS):
            block = _Heads(*(batch.column(name)[0].as_py() for name in _HEADS))
            at = block.places(self.ids)
            idfs[at >= 0] = block.idfs[at[at >= 0]]
            bounds = self._bounds(block, at)
            where[bounds > most] = number
            most = np.maximum(most, bounds)
        self.token = self.token[np.lexsort((-idfs[self.token], self.query))]
        return where

    def scored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, text, points) of the texts that can be among the best k of these blocks."""
        where = self._set_out()
        for number, block in self._whole():
            opened = where == number
            if opened.any():
                asked = self._asked(block, block.places(self.ids), opened)
                of_all = np.flatnonzero(opened)
                for of, _, points in block.best(asked, self.floors[opened], self.k, self.room, FIRST_POSTINGS):
                    self.floors[of_all] = np.maximum(self.floors[of_all], self._kth(of, points, len(of_all)))
        kept, count, limit = [], 0, COMPLETED
        for _, block in self._whole():
            at = block.places(self.ids)
            opened = self._bounds(block, at) >= np.maximum(self.floors, 1)
            if not opened.any():
                continue
            of_all = np.flatnonzero(opened)
            for of, texts, points in block.best(self._asked(block, at, opened), self.floors[opened], self.k, self.room):
                self._raise_floors(of_all[of], points)
                kept.append((of_all[of], texts, points))
                count += len(of)
                if count > limit:
                    kept = [self._reaching(kept)]
                    count = len(kept[0][0])
                    limit = max(COMPLETED, 2 * count)
        return self._reaching(kept) if kept else (np.zeros(0, np.int64),) * 3

    def _kth(self, of: np.ndarray, points: np.ndarray, n: int) -> np.ndarray:
        """The floor that texts set, each query's in the order of their points; 0 for queries with fewer than k."""
        begins = _starts(of)
        sizes = np.diff(np.append(begins, len(of)))
        floors, enough = np.zeros(n), sizes >= self.k
        floors[of[begins[enough]]] = points[begins[enough] + self.k - 1] - SLACK
        return floors

    def _raise_floors(self, of: np.ndarray, points: np.ndarray) -> None:
        begins = _starts(of)
        sizes = np.diff(np.append(begins, len(of)))
        new = np.zeros((len(begins), self.k))
        for rank in range(self.k):
            there = sizes > rank
            new[there, rank] = points[begins[there] + rank]
        queries = of[begins]
        self.best[queries] = np.sort(np.concatenate([self.best[queries], new], axis=1), axis=1)[:, self.k:]
        self.floors[queries] = np.maximum(self.floors[queries], self.best[queries, 0] - SLACK)

    def _reaching(self, kept: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, texts, points = (np.concatenate(x) for x in zip(*kept))
        can = points >= self.floors[of]
        return of[can], texts[can], points[can]


def _scored(sets: DataFrame, folder: str, blocks: int, chunks: int, k: int, k1: float) -> DataFrame:
    """(_q, text_no, points) of the texts that can be among the best k of the queries in sets (_q, asked).

    Each chunk is a task that reads the blocks from their files. Of few chunks each is given to several tasks, which share the blocks.
    """
    slots = sets.sparkSession.sparkContext.defaultParallelism
    slices = max(1, min(blocks, -(-slots // chunks)))
    first = F.pmod(F.xxhash64("_q"), F.lit(chunks)).cast("int") * slices
    dealt = sets.select("_q", "asked", F.explode(F.sequence(first, first + (slices - 1))).alias("_place"))
    rows = dealt.repartitionById(chunks * slices, "_place")

    def score(batches):
        def scored(place: int, held: list[tuple]) -> pa.RecordBatch:
            queries, asked = (pa.concat_arrays(x) for x in zip(*held))
            chunk = _Chunk(len(queries), np.asarray(asked.value_lengths()), np.asarray(asked.flatten()), k, k1, folder, place % slices, slices)
            of, texts, points = chunk.scored()
            return pa.RecordBatch.from_arrays(
                [queries.take(pa.array(of)), pa.array(texts), pa.array(points)], names=["_q", "text_no", "points"])

        place, held, count, size = None, [], 0, 0
        for batch in batches:
            if batch.num_rows:
                place, count, size = batch.column(2)[0].as_py(), count + batch.num_rows, size + len(batch.column(1).flatten())
                held.append((batch.column(0), batch.column(1)))
            if count >= 2 * CHUNK_QUERIES or size >= CHUNK_TOKENS:
                yield scored(place, held)
                held, count, size = [], 0, 0
        if held:
            yield scored(place, held)

    return rows.mapInArrow(score, "_q binary, text_no long, points long")


def search_index(
    index: TextIndex,
    queries: DataFrame,
    query_key: str,
    query_text: str,
    k: int = 1,
    k1: float = 1.2,
    b: float = 0.75,
    scratch: Scratch | None = None,
) -> DataFrame:
    """The best ``k`` documents per query: (query_key, *keys, score, rank). No row without a hit.

    Equal scores go to the smallest document keys. ``scratch``: that of an index which serves no other search.
    """
    keys = list(index.keys)
    if k > 1 and index.members is None:
        raise ValueError("an index without members serves searches for the best document only")
    with freed_shuffles(queries.sparkSession):
        size = index.texts.agg(
            F.sum("copies").alias("documents"), F.sum(F.col("copies") * F.col("doc_len")).alias("words")
        ).first()
        documents = size["documents"] or 0
        mean_len = (size["words"] or 0) / documents if documents else 1.0

        # Tables that only this search needs; each goes when nothing reads it any more.
        scratch = scratch or Scratch(queries.sparkSession)

        # Queries as sets of tokens, each set once.
        asked = queries.select(F.col(query_key), F.array_distinct(tokens(F.col(query_text))).alias("_set"))
        if index.analysis:
            kept = F.filter("_set", index.analysis[0])
            asked = asked.withColumn("_set", F.array_distinct(F.transform(kept, index.analysis[1])))
        # Stored before anything asks for the set again, else its text is taken apart each time.
        line = F.array_join(F.sort_array("_set"), " ")
        asked = scratch.store(asked.filter(F.size("_set") > 0).select(query_key, line.alias("_line")), "search-queries")
        asked = asked.withColumn("_q", F.unhex(F.sha2("_line", 256)))
        lines = scratch.store(asked.groupBy("_q").agg(F.first("_line").alias("_line")), "search-sets")
        named = scratch.store(asked.select(query_key, "_q"), "search-names")
        scratch.drop("search-queries")

        df = F.col("df")
        known = vocabulary(index).withColumn("idf", F.log(1 + (documents - df + 0.5) / (df + 0.5)))
        known = scratch.store(known.select("token", "token_id", "idf"), "search-vocabulary")
        words = F.split("_line", " ")
        _without_collision(known, lines.select(F.explode(words).alias("token")))
        blocks = scratch.store(
            posting_blocks(index, mean_len, k1, b, scratch.path("search-vocabulary")), "search-blocks")

        # How many tasks read a block: one for each chunk of queries, whatever they find in it.
        chunks = F.greatest(F.ceil(F.count("*") / CHUNK_QUERIES), F.lit(1)).cast("int")
        chunks = materialize(lines.agg(chunks.alias("_chunks")), "search-chunks").first()[0]
        sets = lines.select("_q", F.transform(words, lambda t: F.xxhash64(t)).alias("asked"))
        found = _scored(sets, scratch.path("search-blocks"), max(1, blocks.count()), chunks, k, k1)
        found = scratch.store(found, "search-candidates")
        for label in ("search-sets", "search-vocabulary", "search-blocks"):
            scratch.drop(label)

        of_query = Window.partitionBy("_q")
        scored = found.withColumn("score", F.floor((F.col("points") + 500) / 1000) / 1e6)
        # Among texts with equal scores, those of the smallest document keys win. The keys are only fetched
        # for texts that reach the k-th place, which rank() keeps together with all their ties.
        placed = scored.withColumn("_place", F.rank().over(of_query.orderBy(F.desc("score")))).filter(F.col("_place") <= k)
        placed = placed.join(index.texts.select("text_no", "words_id", "first_keys"), "text_no")
        best = top_k(placed, ["_q"], [F.desc("score"), F.asc("first_keys")], k)
        if k == 1:
            # A text's first document is the best one.
            ranked = scratch.store(best.select("_q", "first_keys.*", "score", "rank"), "search-best")
        else:
            best = scratch.store(best.select("_q", "words_id", "score"), "search-best")
            members = index.members.join(best.select("words_id").distinct(), "words_id", "left_semi")
            members = top_k(members, ["words_id"], [F.asc(c) for c in keys], k, "_copy").drop("_copy")
            ranked = top_k(best.join(members, "words_id"), ["_q"], [F.desc("score"), *[F.asc(c) for c in keys]], k)
        for label in ("search-candidates", "search-texts", "analysed-texts"):
            scratch.drop(label)
        answers = materialize(named.join(ranked, "_q").select(query_key, *keys, "score", "rank"), "search-answers")
        scratch.clear()
    return answers


def search_top_k(
    queries: DataFrame,
    corpus: DataFrame,
    query_key: str,
    query_text: str,
    keys: Sequence[str],
    text: str,
    k: int = 1,
    k1: float = 1.2,
    b: float = 0.75,
    stop_words: Sequence[str] = (),
    stem: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Index the corpus and search it. Neither stop words nor stems unless asked for."""
    scratch = Scratch(corpus.sparkSession)
    with freed_shuffles(corpus.sparkSession):
        index = build_index(corpus, keys, text, k > 1, scratch)
        if stop_words or stem:
            index = analysed(index, stop_words, stem, scratch)
    return search_index(index, queries, query_key, query_text, k, k1, b, scratch)
