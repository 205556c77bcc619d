"""An inverted index of names for many searches at once.

A name is listed under the character grams and words that searches need: its distinct grams of one to three characters
(contains), its words (any word, all words), its beginnings of up to eight characters (begins with) and the whole name (exact).
The lists are stored in buckets by the hash of their term, so any number of searches reads them without moving them. A
search goes to the one list, among those that every hit must be in, that is shortest; what it finds there is verified with
the same predicates a scan would use. So results are those of a scan, and the work is that of the rarest term.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grouptrace.functions.text import normalize_name
from grouptrace.session import materialize
from grouptrace.sources.sinks import write_bucketed

GRAM = 3
BEGINNING = 8
MODES = ("begins_with", "exact", "any_word", "all_words", "contains")


@dataclass(frozen=True)
class NameIndex:
    """``names``: name_no, the record's columns, _lower, _name. ``lists``: term, name_no. ``sizes``: term, names."""

    names: DataFrame
    lists: DataFrame
    sizes: DataFrame
    columns: tuple[str, ...]


def _slices(text: Column, size: int) -> Column:
    """All pieces of a text that are ``size`` characters long."""
    last = F.length(text) - size + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substr(text, i, F.lit(size)))


def _marked(kind: str, terms: Column) -> Column:
    return F.transform(terms, lambda t: F.concat(F.lit(f"{kind}:"), t))


def _words(name: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(name, " +"), ""))


def _beginnings(name: Column) -> Column:
    sizes = F.sequence(F.lit(0), F.least(F.length(name), F.lit(BEGINNING)))
    return F.transform(sizes, lambda n: F.substr(name, F.lit(1), n))


def build_name_index(records: DataFrame, name: str, buckets: int) -> NameIndex:
    """Index a table by a column of names. Records without a name are never found and not listed.

    ``buckets``: so many that one holds some 100 MB of lists.
    """
    known = records.filter(F.col(name).isNotNull())
    known = known.withColumn("_lower", F.lower(name)).withColumn("_name", normalize_name(F.col(name)))
    names = materialize(known.withColumn("name_no", F.monotonically_increasing_id()), "indexed-names")
    low, plain = F.col("_lower"), F.col("_name")
    terms = F.concat(
        *[_marked("gram", F.array_distinct(_slices(low, n))) for n in range(1, GRAM + 1)],
        _marked("word", _words(plain)), _marked("start", _beginnings(plain)), F.array(F.concat(F.lit("name:"), plain)),
    )
    listed = names.select(F.explode(terms).alias("term"), "name_no")
    lists = write_bucketed(listed, ["term"], buckets, "name-lists")
    sizes = write_bucketed(lists.groupBy("term").agg(F.count("*").alias("names")), ["term"], buckets, "name-list-sizes")
    return NameIndex(names, lists, sizes, tuple(records.columns))


def _needed_terms(searches: DataFrame) -> DataFrame:
    """(searches' columns, _low, _plain, _terms, _all): the terms of a search, and whether a hit must have all or any of them."""
    low, plain = F.col("_low"), F.col("_plain")
    texts = searches.withColumn("_low", F.lower("text")).withColumn("_plain", normalize_name(F.col("text")))
    grams = F.when(F.length(low) == 0, F.array(F.lit("start:"))).when(
        F.length(low) <= GRAM, F.array(F.concat(F.lit("gram:"), low))).otherwise(_marked("gram", F.array_distinct(_slices(low, GRAM))))
    terms = (
        F.when(F.col("mode") == "contains", grams)
        .when(F.col("mode") == "begins_with", F.array(F.concat(F.lit("start:"), F.substr(plain, F.lit(1), F.lit(BEGINNING)))))
        .when(F.col("mode") == "exact", F.array(F.concat(F.lit("name:"), plain)))
        .when(F.col("mode").isin("any_word", "all_words"), _marked("word", _words(plain)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown search mode: "), F.col("mode"))))
    )
    return texts.withColumn("_terms", terms).withColumn("_all", F.col("mode") != "any_word")


def _matches() -> Column:
    """Does a name pass its search? The predicates of ``text.name_matches``, with the text in a column."""
    wanted = _words(F.col("_plain"))
    words = F.split("_name", " +")
    return (
        F.when(F.col("mode") == "contains", F.contains("_lower", "_low"))
        .when(F.col("mode") == "begins_with", F.startswith("_name", "_plain"))
        .when(F.col("mode") == "exact", F.col("_name") == F.col("_plain"))
        .when(F.col("mode") == "any_word", F.arrays_overlap(words, wanted))
        .otherwise((F.size(wanted) > 0) & (F.size(F.array_except(wanted, words)) == 0))
    )


def _first_found() -> Column:
    """Is a candidate's term the first one of its search that the name has? Only any_word asks for several."""
    has = F.transform(_words(F.col("_plain")), lambda w: F.array_contains(F.split("_name", " +"), w))
    return (F.col("mode") != "any_word") | (F.array_position(has, F.lit(True)) == F.col("_place") + 1)


def search_names(index: NameIndex, searches: DataFrame, keys: Sequence[str] = ("mode", "text")) -> DataFrame:
    """All hits of a table of searches (mode, text): ``keys`` of the search and the record's columns.

    Modes: begins_with, exact, any_word and all_words on normalised names, contains regardless of case; another one fails. A search
    without a text finds nothing. Equal searches are asked once.
    """
    asked = searches.filter(F.col("text").isNotNull()).select("mode", "text").distinct()
    asked = materialize(_needed_terms(asked).withColumn("_search", F.monotonically_increasing_id()), "name-searches")
    wanted = asked.select("_search", "_all", F.posexplode("_terms").alias("_place", "term"))
    sized = wanted.join(index.sizes, "term", "left").withColumn("names", F.coalesce("names", F.lit(0)))
    every = sized.filter("_all").groupBy("_search").agg(F.min(F.struct("names", "term")).alias("_rarest"))
    chosen = every.select("_search", F.lit(0).alias("_place"), F.col("_rarest.term").alias("term")).unionByName(
        sized.filter("NOT _all").select("_search", "_place", "term"))
    # Candidates travel to their names as numbers; the searches, which are far fewer, are sent to every task. A name that several
    # of a search's terms find counts at the first of them, so candidates need no comparison with each other.
    candidates = chosen.join(index.lists, "term").select("_search", "_place", "name_no")
    found = candidates.join(index.names, "name_no").join(F.broadcast(asked), "_search").filter(_matches() & _first_found())
    columns = [c for c in index.columns if c not in keys]
    answered = found.select("mode", "text", *columns)
    if list(keys) == ["mode", "text"]:
        return answered
    return searches.select("mode", "text", *[k for k in keys if k not in ("mode", "text")]).join(answered, ["mode", "text"]).select(*keys, *columns)
