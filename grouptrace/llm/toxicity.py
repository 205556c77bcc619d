"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is lower-cased (A-Z) and cut into words at ASCII characters that are neither letters nor digits. Its subwords are the
character n-grams (3 to 6 bytes) of its words with a space at both ends, hashed into buckets. The mean of the buckets'
vectors goes through a linear layer and a softmax over the two classes. Words never seen before share n-grams with those
seen, so misspellings keep most of their vector.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grouptrace.llm import words
from grouptrace.session import materialize

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 18
DIMENSIONS = 8
#: Bound of the training sample, in texts of each label (toxic, other); taken in order of a hash of doc_id.
SAMPLE = {1: 1500, 0: 3000}
THRESHOLD = 0.7

#: The mean counts this many neutral subwords besides a text's own, so that a few words alone decide little.
NEUTRAL = 300
#: The mean enters the linear layer times this.
SCALE = 32

_SPACE = 0x20
_FOLD = np.full(256, _SPACE, dtype=np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _counted(padded: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which bytes begin a subword that counts: those of a word equal to the word before it don't."""
    word = padded != _SPACE
    start = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    end = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    key = words.range_hash(padded, start, end)
    again = np.zeros(len(start), dtype=bool)
    again[1:] = (key[1:] == key[:-1]) & (owner[start[1:]] == owner[start[:-1]])
    change = np.zeros(len(padded) + 1, dtype=np.int8)
    change[start[again] - 1] += 1
    change[end[again]] -= 1
    return np.cumsum(change[:-1], dtype=np.int8) == 0


def subwords(data: np.ndarray, bounds: np.ndarray):
    """(text, bucket) of all subwords of some texts, one pair of arrays for each size.

    A word that repeats the one before it counts once, so that a run of one word doesn't outweigh a text.
    """
    n_texts = len(bounds) - 1
    text = np.repeat(np.arange(n_texts), np.diff(bounds))
    padded = np.full(len(data) + n_texts + 1 + max(SIZES), _SPACE, dtype=np.uint8)
    padded[np.arange(len(data)) + text + 1] = _FOLD[data]
    owner = np.repeat(np.arange(n_texts), np.diff(bounds) + 1)
    spaces = np.concatenate([[0], np.cumsum(padded == _SPACE, dtype=np.int32)])
    wide = padded.astype(np.uint32)
    length = len(owner)
    counted = _counted(padded, owner)[:length]
    code = wide[:length].copy()
    for n in range(2, max(SIZES) + 1):
        code = code * np.uint32(16777619) + wide[n - 1: n - 1 + length] + np.uint32(1)
        if n in SIZES:
            at = np.flatnonzero((spaces[n - 1: n - 1 + length] == spaces[1: 1 + length]) & counted)
            mixed = (code[at] ^ (code[at] >> np.uint32(15))) * np.uint32(0x9E3779B1)
            yield owner[at], (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Model:
    """values: what a subword of a bucket adds to the toxic logit before the mean is taken; bias: the rest."""

    values: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n_texts = len(bounds) - 1
        total, count = np.zeros(n_texts), np.zeros(n_texts)
        for text, bucket in subwords(data, bounds):
            total += np.bincount(text, weights=self.values[bucket], minlength=n_texts)
            count += np.bincount(text, minlength=n_texts)
        return 1 / (1 + np.exp(-np.clip(total / (count + NEUTRAL) + self.bias, -500, 500)))


def train(texts: pa.ChunkedArray | list[str], toxic: list[int], epochs: int = 8, batch: int = 64, rate: float = 0.1, seed: int = 7) -> Model:
    """Embeddings, linear layer and bias, learnt together by Adagrad on the softmax loss. Deterministic."""
    random = np.random.default_rng(seed)
    embedding = random.normal(0, 0.02, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = random.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen = np.full(len(embedding), 1e-6, dtype=np.float32)
    seen_layer, seen_bias = np.full(layer.shape, 1e-3, np.float32), np.full(2, 1e-3, np.float32)
    # All texts' bags in three flat arrays: buckets, their weights in the mean, and where each bag begins.
    buckets, weights, lengths = [], [], []
    if isinstance(texts, list):
        texts = pa.chunked_array([pa.array(texts, pa.string())])
    for data, bounds in ((d, b) for part in texts.chunks for _, d, b in words.chunks(part, 100_000)):
        text, bucket = (np.concatenate(x) for x in zip(*subwords(data, bounds)))
        pair, count = np.unique((text << BUCKET_BITS) | bucket, return_counts=True)
        text = pair >> BUCKET_BITS
        size = NEUTRAL + np.bincount(text, weights=count, minlength=len(bounds) - 1)
        buckets.append((pair & ((1 << BUCKET_BITS) - 1)).astype(np.int32))
        weights.append((SCALE * count / size[text]).astype(np.float32))
        lengths.append(np.bincount(text, minlength=len(bounds) - 1))
    buckets = np.concatenate(buckets)
    weights = np.concatenate(weights)
    lengths = np.concatenate(lengths)
    ends = np.cumsum(lengths)
    labels = np.array(toxic)
    usable = np.flatnonzero(lengths)
    for _ in range(epochs):
        order = random.permutation(usable)
        for o in range(0, len(order), batch):
            chosen = order[o: o + batch]
            n = lengths[chosen]
            starts = np.cumsum(n) - n
            at = np.repeat(ends[chosen] - n - starts, n) + np.arange(n.sum())
            bucket, weight = buckets[at], weights[at][:, None]
            mean = np.add.reduceat(embedding[bucket] * weight, starts, axis=0)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            p /= len(chosen)
            back = p @ layer.T
            rows, inverse = np.unique(bucket, return_inverse=True)
            gradient = np.zeros((len(rows), DIMENSIONS), np.float32)
            np.add.at(gradient, inverse, np.repeat(back, n, axis=0) * weight)
            seen[rows] += (gradient**2).mean(axis=1)
            embedding[rows] -= rate * gradient / np.sqrt(seen[rows])[:, None]
            step_layer, step_bias = mean.T @ p, p.sum(axis=0)
            seen_layer += step_layer**2
            seen_bias += step_bias**2
            layer -= 0.05 * step_layer / np.sqrt(seen_layer)
            bias -= 0.05 * step_bias / np.sqrt(seen_bias)
    difference = layer[:, 1] - layer[:, 0]
    return Model((SCALE * embedding @ difference).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(documents: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model:
    """A model of labels.toxic, learnt from a bounded sample of whole labelled texts that are not held out.

    A label that is null or not 0 or 1, and a null or empty text, are left out; of several labels of one doc_id the
    largest counts. Without texts of both labels every score is one half.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = documents.where("text <> ''").select("doc_id", "text")
    usable = known.where(~held_out(F.col("doc_id"))).join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in sample.items()]
    chosen = materialize(reduce(DataFrame.unionByName, chosen), "labelled-sample")
    # As many rows as the sample's bound, so they may be sent to all tasks.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("toxic", "doc_id").agg(F.min("text").alias("text"))
    rows = materialize(rows, "labelled-texts")
    taken = {y: rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").select("text").toArrow()["text"]
             for y in sample}
    if not all(len(own) for own in taken.values()):
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
    texts = pa.chunked_array([c for own in taken.values() for c in own.chunks])
    return train(texts, [y for y, own in taken.items() for _ in range(len(own))])


def score(text: Column, model: Model, spark) -> Column:
    """The toxicity of a whole text, 0 to 1; a null or empty text has the score of no evidence."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        parts = [shared.value.scores(data, bounds) for _, data, bounds in words.chunks(column)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return scored(text)


def classified(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, held_out, score, predicted) per row of documents, whose own columns are in row.

    Repeated rows are scored alike; an empty table gives an empty result.
    """
    model = fitted(documents, labels)
    rows = documents.select(F.struct("*").alias("row"))
    scored = rows.withColumn("score", score(F.col("row.text"), model, documents.sparkSession))
    return scored.select(
        "row", held_out(F.col("row.doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
