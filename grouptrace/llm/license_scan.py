r"""Licence scan by canonical digests.

Case, punctuation, white space, copyright lines and equivalent spellings are normalised away; the SHA-256 of what is left
is looked up among the digests of known licences. A whole text is compared, never a part of it; each line is also a text
of its own, as notices stand on one line. The steps are plain substitutions that Spark, Python and SQL share.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grouptrace.llm.license_texts import NOTICES, TEXTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# How licence texts and notices open.
_OPENINGS = (
    "permission is hereby granted", "permission to use", "redistribution and use", "this software is provided",
    "licensed under", "licenced under", "released under", "this work is licensed", "spdx-license-identifier",
)

#: (pattern, replacement, group to keep or 0), applied in this order to the lower-cased text. A copyright clause ends where a
#: licence opens, else with its line.
STEPS = (
    (rf"(^|\n)[ \t/#*;%-]*(copyright|\(c\)|©|all rights reserved)[^\n]*?({'|'.join(_OPENINGS)})", " ", 3),
    (r"(^|\n)[ \t/#*;%-]*(copyright|\(c\)|©|all rights reserved)[^\n]*", " ", 0),
    (r"[\x00-\x2F\x3A-\x60\x7B-\x7F‘’“”–—…]+", " ", 0),
    (r"\blicenc", "licens", 0),
    (r"\bsub licens", "sublicens", 0),
    (r"\bnon commercial", "noncommercial", 0),
    (r"\borganis", "organiz", 0),
    (r"\bfavour", "favor", 0),
    (r"\bper cent\b", "percent", 0),
    (r"\b(?:version|v) ?([0-9]+)(?: 0)?\b", "version ", 1),
)


def _spark(text: Column) -> Column:
    lowered = F.translate(text, _UPPER, _LOWER)
    return F.btrim(reduce(
        lambda x, step: F.regexp_replace(x, step[0], step[1] + (f"${step[2]}" if step[2] else "")), STEPS, lowered))


def canonical(text: str) -> str:
    """The normal form in plain Python, for the registry."""
    text = text.translate(str.maketrans(_UPPER, _LOWER))
    for pattern, to, group in STEPS:
        text = re.sub(pattern, to + (rf"\{group}" if group else ""), text, flags=re.ASCII)
    return text.strip(" ")


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def registry() -> dict[str, str]:
    """digest -> licence of all known texts and notices."""
    return {digest(text): name for name, text in (*TEXTS, *NOTICES)}


def scanned(documents: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, canonical_sha256, license, notices) per row.

    license: the known licence that the whole text is, else null. notices: the licences, sorted, of lines that are a known
    text as a whole (every known one-line notice contains "licen", other lines aren't digested). known: digest -> licence,
    so no digest has two. A null text counts as empty; an empty one has the digest of the empty text and no licence. Texts of
    any length are compared whole, one row at a time; repeated rows give equal rows; an empty table gives an empty result.
    Other columns are not read. The known digests are part of the plan: a list for licences, not for corpora.
    """
    known = registry() if known is None else known
    spark = documents.sparkSession
    table = spark.createDataFrame(list(known.items()), "canonical_sha256 string, license string")
    pairs = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(F.translate(x, _UPPER, _LOWER), F.lit("licen")))
    found = F.transform(lines, lambda x: F.try_element_at(pairs, F.sha2(_spark(x), 256)))
    digests = documents.select(
        "doc_id", F.sha2(_spark(text), 256).alias("canonical_sha256"),
        F.array_sort(F.array_distinct(F.array_compact(found))).alias("notices"),
    )
    joined = digests.join(table, "canonical_sha256", "left")
    return joined.select("doc_id", "canonical_sha256", "license", "notices")


def _sql(text: str) -> str:
    out = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    for pattern, to, group in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{to}{f'{chr(92)}{group}' if group else ''}', 'g')"
    return f"trim({out}, ' ')"


def oracle_sql() -> str:
    known = ", ".join(f"('{d}', '{n}')" for d, n in registry().items())
    return f"""
WITH known(canonical_sha256, license) AS (VALUES {known}),
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
digests AS (SELECT doc_id, sha256({_sql("text")}) AS canonical_sha256 FROM texts),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
notices AS (
  SELECT doc_id, list_sort(list_distinct(list(license))) AS notices
  FROM (SELECT doc_id, sha256({_sql("line")}) AS canonical_sha256 FROM lines
        WHERE contains(translate(line, '{_UPPER}', '{_LOWER}'), 'licen')) JOIN known USING (canonical_sha256)
  GROUP BY doc_id
)
SELECT d.doc_id, d.canonical_sha256, k.license, coalesce(n.notices, []) AS notices
FROM digests d LEFT JOIN known k USING (canonical_sha256) LEFT JOIN notices n USING (doc_id)
"""
