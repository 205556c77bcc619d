"""Substring deduplication by window lookup among the passages of smaller doc_ids.

Every `length`-word passage that a smaller doc_id has too is found through minimiser suffixes (see `sparse`). All windows
of a document that are such passages are marked at once, and marked windows that overlap or touch are united to spans.
This is not a relative Lempel-Ziv parse: there are no factors that point at a source document, no literals and no reference
blocks. The words that go are those that lie in a passage of a smaller doc_id, wherever a parse would cut its factors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grouptrace.llm import sparse, words

LENGTH = 13
SPREAD = 9


def parsed(documents: DataFrame, length: int = LENGTH, spread: int = SPREAD) -> DataFrame:
    """(row, kept, n_words, n_removed, factors) per document.

    row: the document's own columns but the text. kept: the words outside all spans, joined by one space. factors: (first word,
    words) of these spans. A null text counts as empty. A document without doc_id, or whose texts repeat only
    under the same doc_id, keeps all its words. An empty table gives an empty result.
    """

    def parse(batches):
        for batch in batches:
            list_text, list_key = words.list_column(batch.column("keys"))
            for row, data, bounds in words.chunks(words.unpacked(batch.column("packed"))):
                w = words.Words(data, bounds)
                own = (list_text >= row) & (list_text < row + w.n_texts)
                has = np.zeros(w.n_texts, dtype=bool)
                has[list_text[own] - row] = True
                start = sparse.found_passages(w, length, list_text[own] - row, list_key[own])
                first, end = sparse.runs(w, start, length)
                covered = np.zeros(len(w.hash) + 1, dtype=np.int64)
                np.add.at(covered, first, 1)
                np.add.at(covered, end, -1)
                keep = np.cumsum(covered)[:-1] == 0
                kept = [w.joined(i, keep if has[i] else None) for i in range(w.n_texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(row, w.n_texts), pa.array(kept, pa.binary()), *sparse.spans(w, first, end)],
                    names=["row", "kept", "n_words", "n_removed", "factors"],
                )

    inputs = sparse.marked(documents, sparse.repeated_passages(documents, length, spread))
    schema = (
        f"row {inputs.schema['row'].dataType.simpleString()}, kept binary, n_words long, n_removed long, "
        "factors array<struct<first: bigint, words: bigint>>"
    )
    return inputs.mapInArrow(parse, schema)
