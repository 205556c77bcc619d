"""Suffix-array deduplication with sparse suffix arrays.

Only the suffixes at content-selected (minimiser) positions are kept; they are sorted, neighbours that agree are
extended to both sides (see `sparse`), and a word run of at least `length` words that also stands in a document with a
smaller doc_id is cut out of the later one. The first document keeps its text unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grouptrace.llm import sparse, words

LENGTH = 50
SPREAD = 24


def without_repeats(documents: DataFrame, length: int = LENGTH, spread: int = SPREAD) -> DataFrame:
    """(row, kept_text, n_words, n_removed, spans) per document.

    row: the document's own columns but the text. kept_text: the text without its spans and the white space that follows each; a text
    without spans is unchanged, null included. spans: (first word, words). A null text has no words. A document
    without doc_id keeps its text and is nobody's predecessor; rows that repeat one doc_id don't cut each other. An
    empty table gives an empty result.
    """

    def cut(batches):
        for batch in batches:
            list_text, list_key = words.list_column(batch.column("keys"))
            column = words.unpacked(batch.column("packed"))
            for row, data, bounds in words.chunks(column):
                w = words.Words(data, bounds)
                own = (list_text >= row) & (list_text < row + w.n_texts)
                start = sparse.found_passages(w, length, list_text[own] - row, list_key[own])
                first, end = sparse.runs(w, start, length)
                at = np.searchsorted(w.text[first], np.arange(w.n_texts + 1))
                texts = []
                for i in range(w.n_texts):
                    pieces, done = [], bounds[i]
                    for f, e in zip(first[at[i]: at[i + 1]], end[at[i]: at[i + 1]]):
                        pieces.append(data[done: w.start[f]].tobytes())
                        done = w.start[e] if e < w.range[i + 1] else bounds[i + 1]
                    pieces.append(data[done: bounds[i + 1]].tobytes())
                    texts.append(b"".join(pieces) if column[row + i].is_valid else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(row, w.n_texts), pa.array(texts, pa.binary()), *sparse.spans(w, first, end)],
                    names=["row", "kept_text", "n_words", "n_removed", "spans"],
                )

    inputs = sparse.marked(documents, sparse.repeated_passages(documents, length, spread))
    schema = (
        f"row {inputs.schema['row'].dataType.simpleString()}, kept_text binary, n_words long, n_removed long, "
        "spans array<struct<first: bigint, words: bigint>>"
    )
    return inputs.mapInArrow(cut, schema).withColumn("kept_text", F.col("kept_text").cast("string"))
