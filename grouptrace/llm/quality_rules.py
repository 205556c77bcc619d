"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A word is a maximal run of characters other than U+0020 and U+0009-U+000D. All ratios are compared in whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "as", "are", "this",
    "der", "die", "das", "und", "ist", "von", "mit", "den", "ein", "nicht", "zu", "auf",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "que", "qui", "pour",
    "el", "los", "las", "y", "en", "por", "con", "del", "se", "para",
)


@dataclass(frozen=True)
class Rule:
    """Passes where low * whole <= 100 * part <= high * whole; None leaves a side open."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def passes(self) -> Column:
        part, whole = 100 * F.col(self.part), F.col(self.whole)
        sides = ([part >= self.low * whole] if self.low is not None else []) + (
            [part <= self.high * whole] if self.high is not None else [])
        return reduce(Column.__and__, sides, F.lit(True))


RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=1),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=40),
)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_WINDOWS = f"sequence(1, size(_words) - {WINDOW - 1})"
# Starts of the windows that occur twice, in order; each adds the words the one before it doesn't cover.
_REPEAT_WORDS = f"""
CASE WHEN size(array_distinct(_hashes)) = size(_hashes) THEN 0L ELSE
  transform(
    array(array_sort(transform({_WINDOWS}, i -> struct(array_join(slice(_words, i, {WINDOW}), ' ') AS x, i AS p)))),
    s -> aggregate(
      array_sort(transform(
        filter(
          transform(s, (e, j) -> struct(e.p AS p,
            coalesce(get(s, j - 1).x = e.x, false) OR coalesce(get(s, j + 1).x = e.x, false) AS twice)),
          e -> e.twice),
        e -> e.p)),
      struct(0L AS n, {-WINDOW} AS last),
      (a, p) -> struct(a.n + least({WINDOW}, p - a.last) AS n, p AS last),
      a -> a.n))[0]
END
"""


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words) per row.

    A null or empty text measures 0 throughout. n_lines are the lines with a word, n_dup_lines those of them equal to an
    earlier one; n_repeat_words are the words in five-word windows that occur twice or more in the text, where equal
    hashes are settled by the words themselves. Rows are measured on their own, so repeated rows and other columns
    don't matter.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    split = documents.select("doc_id", text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    hashed = split.withColumn("_hashes", F.expr(
        f"CASE WHEN size(_words) > {WINDOW} THEN transform({_WINDOWS}, i -> xxhash64(slice(_words, i, {WINDOW}))) "
        "ELSE array() END"))
    stop_words = F.size(F.filter("_words", lambda word: word.isin(*STOP_WORDS)))
    return hashed.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEAT_WORDS).cast("long").alias("n_repeat_words"),
        stop_words.cast("long").alias("n_stop_words"),
    )


def judged(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures with base_failed, failed_rules and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.array_compact(F.array(*(F.when(~rule.passes(), F.lit(rule.name)) for rule in rules)))
    verdict = reduce(Column.__and__, [rule.passes() for rule in rules], ~base)
    return measured(documents).withColumns({"base_failed": base, "failed_rules": failed, "kept": verdict})


def _rule_sql(rule: Rule) -> str:
    sides = [f"100 * {rule.part} >= {rule.low} * {rule.whole}"] if rule.low is not None else []
    sides += [f"100 * {rule.part} <= {rule.high} * {rule.whole}"] if rule.high is not None else []
    return " AND ".join(sides)


ORACLE_SQL = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS x
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM split)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1
), repeats AS (
  SELECT doc_id, sum(least(5, i - coalesce(before, -5))) AS n
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY doc_id
), measures AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(words, lambda x: x IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop_words
  FROM split LEFT JOIN repeats USING (doc_id)
), base AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(_rule_sql(r) for r in RULES)} AS kept, n_lines, n_stop_words
FROM base
"""
