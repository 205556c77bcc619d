"""N-gram Jaccard self-join of documents by vertical partitioning.

All five-word shingles have one global order, from rare to frequent. Sets that reach the threshold share a shingle among
the first few of this order, which yields candidate pairs. The order is then cut into fragments of equal weight;
each fragment counts the partial overlap of every candidate pair on its own, and the counts are summed per pair.

Equal sets are one vertex. Only the components of the links are asked for, so the join runs twice: first each vertex
with its most similar partner of every group, then, exactly, all pairs that lie in different components.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grouptrace.llm import bits, words
from grouptrace.llm.components import components, files_for
from grouptrace.session import materialize, work_path

SHINGLE = 5
PERCENT = 80
FRAGMENTS = 4
TILE = 1024
_CELL_BITS = 20
_SLICES = 64
_SIGNATURE_WORDS = 4


def shingles(w: words.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle) of texts; one with fewer words has its whole sequence, one without words none."""
    start, key = w.windows(size)
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = w.hashes(w.range[short], w.range[short + 1])
    return words.distinct_per_text(np.concatenate([w.text[start], short]), np.concatenate([key, whole]))


def _sets(batch: pa.RecordBatch):
    """(first row, texts, vertex, sizes, (text, shingle)) of slices of a batch. A vertex is the hash of a set."""
    for row, data, bounds in words.chunks(batch.column("text")):
        w = words.Words(data, bounds, fold_case=True)
        text, key = shingles(w)
        at = np.searchsorted(text, np.arange(w.n_texts + 1))
        size = np.diff(at)
        sums = np.zeros(len(key) + 1, dtype=np.uint64)
        np.cumsum(words.mix(key ^ words.U(0x5851F42D4C957F2D)), out=sums[1:])
        vertex = words.mix(sums[at[1:]] - sums[at[:-1]] + words.mix(size.astype(np.uint64))).view(np.int64)
        yield row, w.n_texts, vertex, size, text, key, at


def _array(values, kind=None) -> pa.Array:
    return pa.array(values, kind or pa.int64())


_SIGNATURE = tuple(f"s{k}" for k in range(_SIGNATURE_WORDS))
_DESCRIBED = f"doc_id long, row_key long, vertex long, n long, {', '.join(f'{s} long' for s in _SIGNATURE)}, slice int, counts binary"


def _row_key() -> Column:
    """By which a row's text is fetched again: the hash of its doc_id, or of the text where it has none."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit("doc_id"), "doc_id")).otherwise(F.xxhash64(F.lit("text"), "text")).alias("row_key")


def described(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One pass over the texts, with two kinds of rows.

    Per document (doc_id, row_key, vertex, n, s0..s3), where s is the parity of the set's members in each of 256 cells: two sets
    differ in at least as many members as their signatures in bits. Per task, and with a slice, a sketch of the shingles'
    frequencies: compressed counts of documents in 2**20 cells, a size that doesn't depend on the data.
    """
    names = ["doc_id", "row_key", "vertex", "n", *_SIGNATURE, "slice", "counts"]

    def describe(batches):
        total = np.zeros(1 << _CELL_BITS, dtype=np.int64)
        for batch in batches:
            for row, n_texts, vertex, size, text, key, _ in _sets(batch):
                total += np.bincount((key >> words.U(64 - _CELL_BITS)).astype(np.int64), minlength=len(total))
                bits = np.zeros((n_texts, 64 * _SIGNATURE_WORDS), dtype=np.uint8)
                cell = (words.mix(key ^ words.U(0x14057B7EF767814F)) % words.U(64 * _SIGNATURE_WORDS)).astype(np.int64)
                flips = np.bincount(text * (64 * _SIGNATURE_WORDS) + cell, minlength=bits.size)
                signature = np.packbits((flips & 1).astype(np.uint8).reshape(bits.shape), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).slice(row, n_texts) for x in ("doc_id", "row_key")), _array(vertex), _array(size)]
                    + [_array(signature[:, k].copy()) for k in range(_SIGNATURE_WORDS)]
                    + [pa.nulls(n_texts, pa.int32()), pa.nulls(n_texts, pa.binary())],
                    names=names,
                )
        if total.any():
            empty = [pa.nulls(_SLICES, pa.int64())] * (len(names) - 2)
            yield pa.RecordBatch.from_arrays([*empty, *_slices(dict(enumerate(total.reshape(_SLICES, -1))))], names=names)

    return documents.select("doc_id", _row_key(), "text").mapInArrow(describe, _DESCRIBED)


def _slices(parts: dict[int, np.ndarray]) -> list[pa.Array]:
    codec = pa.Codec("zstd")
    return [pa.array(list(parts), pa.int32()),
            pa.array([codec.compress(x.tobytes(), asbytes=True) for x in parts.values()], pa.binary())]


def _counts(blob: bytes) -> np.ndarray:
    n = (1 << _CELL_BITS) // _SLICES
    return np.frombuffer(pa.Codec("zstd").decompress(blob, 8 * n, asbytes=True), dtype=np.int64)


def frequency_levels(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                counts = _counts(blob)
                sums[number] = sums[number] + counts if number in sums else counts
        if sums:
            yield pa.RecordBatch.from_arrays(_slices(sums), names=["slice", "counts"])

    parts = rows.where("slice IS NOT NULL").select("slice", "counts").repartition(_SLICES, "slice")
    total = np.zeros((_SLICES, (1 << _CELL_BITS) // _SLICES), dtype=np.int64)
    for part in parts.mapInArrow(add, "slice int, counts binary").collect():
        total[part["slice"]] = _counts(part["counts"])
    return total.ravel()


class Order:
    """The global order of shingles: by frequency level, then by hash; and its cuts into fragments of equal weight."""

    def __init__(self, counts: np.ndarray, fragments: int = FRAGMENTS):
        self.levels = np.minimum(255, np.round(4 * np.log2(counts + 1.0))).astype(np.uint8)
        weight = np.bincount(self.levels, weights=counts, minlength=256)
        upto = np.concatenate([[0.0], np.cumsum(weight)])
        cuts = []
        for k in range(1, fragments):
            want = upto[-1] * k / fragments
            level = min(255, int(np.searchsorted(upto, want, side="right")) - 1)
            inside = (want - upto[level]) / weight[level] if weight[level] else 0.0
            cuts.append((level << 56) + min(int(inside * 2**56), 2**56 - 1))
        self.cuts = np.array(cuts, dtype=np.uint64)

    def rank(self, key: np.ndarray) -> np.ndarray:
        level = self.levels[(key >> words.U(64 - _CELL_BITS)).astype(np.int64)].astype(np.uint64)
        return (level << words.U(56)) | (words.mix(key) >> words.U(8))

    def fragment(self, key: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, self.rank(key), side="right")


def _needed(n, percent: int):
    """The least overlap of two sets of together n members that reach the threshold."""
    return -(-percent * n // (100 + percent))


def prefixes(documents: DataFrame, order: Order, percent: int = PERCENT) -> DataFrame:
    """(key, vertex, place): the rarest shingles of each set, of which two linked sets share one."""

    def rarest(batches):
        for batch in batches:
            done: set[int] = set()
            for _, n_texts, vertex, size, text, key, at in _sets(batch):
                new = np.array([size[i] > 0 and v not in done and not done.add(v) for i, v in enumerate(vertex)])
                by = np.lexsort((order.rank(key), text))
                place = np.arange(len(key)) - at[text]
                keep = new[text] & (place <= (size - (-(-percent * size // 100)))[text]) if len(text) else place > 0
                yield pa.RecordBatch.from_arrays(
                    [_array(key[by][keep].view(np.int64)), _array(vertex[text[keep]]), _array(place[keep], pa.int32())],
                    names=["key", "vertex", "place"],
                )

    return documents.select("text").mapInArrow(rarest, "key long, vertex long, place int")


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """Rows whose key also belongs to another vertex, each once. Rows are dealt by ranges of (key, vertex), so no
    key has to fit one task; the ends of a partition stay, as their neighbours lie in another one."""

    def compare(batches):
        held = None
        held_stays = True
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not len(table):
                continue
            key, vertex = np.asarray(table["key"]), np.asarray(table["vertex"])
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (vertex[1:] != vertex[:-1])
            at = np.flatnonzero(new)
            same = key[at][1:] == key[at][:-1]
            keep = np.zeros(len(at), dtype=bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= held_stays
            held_stays = bool(keep[-1])
            held = table.slice(int(at[-1]), 1).combine_chunks().to_batches()[0]
            yield from table.take(pa.array(at[:-1][keep[:-1]])).to_batches()
        if held is not None:
            yield held

    ordered = rows.repartitionByRange("key", "vertex").sortWithinPartitions("key", "vertex")
    return ordered.mapInArrow(compare, "key long, vertex long, place int")


def large_groups(shared: DataFrame) -> DataFrame:
    """(key, count) of the prefix shingles with more than TILE vertices."""
    return shared.groupBy("key").count().where(F.col("count") > TILE)


def candidates(shared: DataFrame, large: DataFrame, sets: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """(a, b, na, nb): pairs of vertices that share a prefix shingle and may reach the threshold, each once.

    A group of more than TILE vertices is cut into tiles, and pairs of tiles go to separate tasks. best_only: of a
    group's pairs only each vertex's with the least signature distance, so every vertex that may have a link is in a
    pair; else all pairs that lie in different components.
    """
    rows = shared.join(sets, "vertex")
    tiles = F.ceil(F.coalesce("count", F.lit(1)) / TILE).cast("int")
    rows = rows.join(large, "key", "left").withColumn("tiles", tiles)
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("vertex"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumn("t0", F.least("tile", "other")).withColumn("t1", F.greatest("tile", "other"))
    names = ["key", "t0", "t1", "tile", "vertex", "root", "place", "n", *(f"s{k}" for k in range(_SIGNATURE_WORDS))]
    rows = rows.select(*names).repartition("key", "t0", "t1").sortWithinPartitions("key", "t0", "t1", "n", "vertex")

    def pairs(group: pa.Table) -> pa.RecordBatch:
        c = {name: np.asarray(group[name].combine_chunks()) for name in names}
        new = np.ones(len(group), dtype=bool)
        new[1:] = np.any([c[x][1:] != c[x][:-1] for x in ("key", "t0", "t1")], axis=0)
        number = np.cumsum(new)
        signature = np.stack([c[f"s{k}"] for k in range(_SIGNATURE_WORDS)], axis=1)
        best = np.full(len(group), np.iinfo(np.int64).max)
        partner = np.full(len(group), -1)
        found_i, found_j = [], []
        i = np.arange(len(group) - 1)
        step = 1
        while len(i):
            i = i[i + step < len(group)]
            i = i[number[i] == number[i + step]]
            j = i + step
            na, nb = c["n"][i], c["n"][j]
            need = _needed(na + nb, percent)
            ok = (100 * na >= percent * nb) & (c["root"][i] != c["root"][j])
            ok &= (c["place"][i] <= na - need) & (c["place"][j] <= nb - need)
            ok &= (c["t0"][i] == c["t1"][i]) | (c["tile"][i] != c["tile"][j])
            x, y = i[ok], j[ok]
            apart = np.bitwise_count((signature[x] ^ signature[y]).view(np.uint64)).sum(axis=1).astype(np.int64)
            near = apart <= (na + nb - 2 * need)[ok]
            x, y, apart = x[near], y[near], apart[near]
            if best_only:
                for own, other in ((x, y), (y, x)):
                    less = apart < best[own]
                    best[own[less]], partner[own[less]] = apart[less], other[less]
            else:
                found_i.append(x)
                found_j.append(y)
            step += 1
        if best_only:
            y = np.flatnonzero(partner >= 0)
            x = partner[y]
        else:
            x, y = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (found_i, found_j))
        swap = c["vertex"][x] > c["vertex"][y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return pa.RecordBatch.from_arrays(
            [_array(c["vertex"][x]), _array(c["vertex"][y]), _array(c["n"][x]), _array(c["n"][y])],
            names=["a", "b", "na", "nb"],
        )

    def compare(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            last = [table[x][-1] for x in ("key", "t0", "t1")]
            tail = np.all([np.asarray(table[x]) == v.as_py() for x, v in zip(("key", "t0", "t1"), last)], axis=0)
            cut = int(np.argmax(tail))
            if cut:
                yield pairs(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield pairs(rest)

    return rows.mapInArrow(compare, "a long, b long, na long, nb long").distinct()


def fragments(documents: DataFrame, first: DataFrame, wanted: DataFrame, order: Order) -> DataFrame:
    """(vertex, keys0, keys1, ...): the wanted vertices' sets, each cut at the order's fragments.

    first: (vertex, row_key), a row of each vertex. wanted: (vertex). The table is stored in buckets of vertices, so no later
    join moves it.
    """
    chosen = materialize(first.join(wanted, "vertex").groupBy("row_key").agg(F.collect_set("vertex").alias("own")), "chosen")
    known = bits.filter_of(chosen.select(F.col("row_key").alias("key")))
    parts = len(order.cuts) + 1
    names = ["vertex", *(f"keys{i}" for i in range(parts))]

    def cut(batches):
        for batch in batches:
            own = batch.column("own").to_pylist()
            batch = pa.RecordBatch.from_arrays([words.unpacked(batch.column("packed"))], names=["text"])
            for row, n_texts, vertex, _, text, key, at in _sets(batch):
                part = order.fragment(key)
                by = np.lexsort((key, part, text))
                text, part, key = text[by], part[by], key[by]
                edges = np.searchsorted(text * parts + part, np.arange(n_texts * parts + 1))
                kept = [i for i in range(n_texts) if vertex[i] in own[row + i]]
                blobs = [[key[edges[i * parts + p]: edges[i * parts + p + 1]].tobytes() for i in kept] for p in range(parts)]
                yield pa.RecordBatch.from_arrays([_array(vertex[kept]), *(pa.array(x, pa.binary()) for x in blobs)], names=names)

    shared = documents.sparkSession.sparkContext.broadcast(known)

    def thinned(batches):
        nameless: set[int] = set()
        for batch in batches:
            key = np.asarray(batch.column("row_key"))
            keep = bits.may_be_in(key, shared.value)
            # Copies without doc_id have one key: one of a task's is enough.
            for i in np.flatnonzero(keep & np.asarray(batch.column("nameless"))).tolist():
                keep[i] = key[i] not in nameless
                nameless.add(int(key[i]))
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [kept.column("row_key"), words.pack(kept.column("text"))], names=["row_key", "packed"])

    near = documents.select(_row_key(), F.col("doc_id").isNull().alias("nameless"), "text").mapInArrow(thinned, "row_key long, packed binary")
    texts = words.met(near, chosen, "row_key").select("packed", "own")
    sets = texts.mapInArrow(cut, ", ".join(["vertex long", *(f"{x} binary" for x in names[1:])]))
    spark = documents.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _stored_by_vertex(sets.repartition(buckets, "vertex").dropDuplicates(["vertex"]), buckets)


def _stored_by_vertex(sets: DataFrame, buckets: int) -> DataFrame:
    """Written in the buckets that it is already dealt to."""
    spark, name = sets.sparkSession, f"fragments_{uuid.uuid4().hex}"
    writer = sets.write.bucketBy(buckets, "vertex").sortBy("vertex").format("parquet")
    writer.option("path", work_path(spark, "fragments")).saveAsTable(name)
    return spark.table(name)


def _partial(pairs: DataFrame, parts: DataFrame, numbers: list[int]) -> DataFrame:
    """(a, b, na, nb, sa, sb, partial) per pair: sizes of its sets in some fragments, and the overlaps, summed."""
    names = [f"keys{i}" for i in numbers]
    left, right = (parts.select(F.col("vertex").alias(x), *(F.col(n).alias(f"{x}_{n}") for n in names)) for x in "ab")
    sides = [f"{x}_{n}" for n in names for x in "ab"]
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", *sides)

    def count(batches):
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), dtype=np.int64)
            for n in names:
                values, row = [], []
                for k, side in enumerate("ab"):
                    blobs = batch.column(f"{side}_{n}").to_pylist()
                    size = np.array([len(x) // 8 for x in blobs], dtype=np.int64)
                    sums[k] += size
                    values.append(np.frombuffer(b"".join(blobs), dtype=np.uint64))
                    row.append(np.repeat(np.arange(len(blobs)), size))
                key, row = np.concatenate(values), np.concatenate(row)
                by = np.lexsort((key, row))
                key, row = key[by], row[by]
                common = (key[1:] == key[:-1]) & (row[1:] == row[:-1])
                sums[2] += np.bincount(row[1:][common], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("a", "b", "na", "nb")), *(_array(x) for x in sums)],
                names=["a", "b", "na", "nb", "sa", "sb", "partial"],
            )

    return both.mapInArrow(count, "a long, b long, na long, nb long, sa long, sb long, partial long")


def links(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: partial overlaps per fragment, summed per pair.

    The first fragment is counted for all pairs. A pair goes on to the others only if it would reach the threshold with
    all of its remaining members in common.
    """
    pair = ["a", "b", "na", "nb"]
    need = -F.floor(-percent * (F.col("na") + F.col("nb")) / (100 + percent))
    most = F.col("partial") + F.least(F.col("na") - F.col("sa"), F.col("nb") - F.col("sb"))
    first = _partial(pairs, parts, [0])
    open_pairs = materialize(first.where(most >= need).select(*pair, "partial"), "open-pairs")
    rest = _partial(open_pairs.select(*pair), parts, list(range(1, len(parts.columns) - 1))).select(*pair, "partial")
    overlap = open_pairs.unionByName(rest).groupBy(*pair).agg(F.sum("partial").alias("overlap"))
    linked = 100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))
    return overlap.where(linked).select("a", "b")


def same_document(rows: DataFrame) -> DataFrame:
    """(a, b): links between the sets of documents whose doc_id stands in several rows."""
    known = rows.where("n > 0 AND doc_id IS NOT NULL")
    several = known.groupBy("doc_id").agg(F.min("vertex").alias("b"), F.max("vertex").alias("last")).where("b <> last")
    return known.join(several, "doc_id").where("vertex <> b").select(F.col("vertex").alias("a"), "b").distinct()


def joined(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of documents.

    A null or empty text has no shingles and links with nothing: it is its own component. Rows with equal sets are
    linked whatever their number; rows with one doc_id are one document. A row without doc_id links like any other and
    gets its component's id too (null if all are without). A text of any length is one set. An empty table gives an empty
    result.
    """
    rows = materialize(described(documents), "vertices")
    order = Order(frequency_levels(rows))
    rows = rows.where("slice IS NULL").select("doc_id", "row_key", "vertex", "n", *_SIGNATURE)
    sets = rows.where("n > 0").groupBy("vertex").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key"))["row_key"].alias("row_key"),
        F.first("n").alias("n"), *(F.first(s).alias(s) for s in _SIGNATURE)
    )
    sets = materialize(sets, "sets")
    shared = materialize(shared_prefixes(prefixes(documents, order, percent)), "prefixes")
    large = materialize(large_groups(shared), "large-groups")

    alone = sets.drop("doc_id", "row_key").withColumn("root", F.col("vertex"))
    pairs = materialize(candidates(shared, large, alone, percent, True), "pairs")
    files = files_for(pairs.count())
    wanted = pairs.select(F.col("a").alias("vertex")).union(pairs.select("b")).distinct()
    wanted = materialize(wanted.coalesce(files), "wanted")
    parts = fragments(documents, sets.select("vertex", "row_key"), wanted, order)
    roots = materialize(components(links(pairs, parts, percent)).coalesce(files), "roots")

    grouped = alone.drop("root").join(wanted, "vertex").join(roots, "vertex", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "vertex"))
    across = materialize(candidates(shared, large, grouped, percent, False), "pairs")
    every = links(across, parts, percent).unionByName(roots.select(F.col("vertex").alias("a"), F.col("root").alias("b")))

    found = components(every.unionByName(same_document(rows)))
    placed = sets.select("vertex", "doc_id").join(found, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    placed = materialize(placed.coalesce(files), "placed")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("least"))
    placed = placed.join(least, "root").select("vertex", "least")
    return rows.select("doc_id", "vertex", "n").join(placed, "vertex", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )
