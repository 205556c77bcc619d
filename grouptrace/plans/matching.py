"""Matching grantees to registered entities: exact names, ranked search, human review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grouptrace.functions.text import normalize_name, split_at
from grouptrace.operators.joins import anti_join, left_join_fanout
from grouptrace.operators.ranking import distinct_first_seen, distinct_on
from grouptrace.operators.search import search_top_k
from grouptrace.operators.tables import assert_unique, insert_if_absent, pending
from grouptrace.session import materialize

ENTITY = ["registration_index", "corp_name", "status_id", "status_es"]
REVIEW_KEY = ["grantee", "registration_index"]
REVIEW_COLUMNS = [*REVIEW_KEY, "corp_name", "status_id", "status_es", "score", "aprobado", "rechazado"]


def grantees(decrees: DataFrame) -> DataFrame:
    """Distinct grantees in the order of their first decree."""
    return distinct_first_seen(decrees.filter(F.col("grantee").isNotNull()), ["grantee"], "decree_id")


def exact_name_match(decrees: DataFrame, entities: DataFrame) -> DataFrame:
    """Every grantee with all entities of the same normalised name; ``match_type`` is NULL without one."""
    left = grantees(decrees).select("grantee", normalize_name(F.col("grantee")).alias("_name"))
    right = entities.select(*ENTITY, normalize_name(F.col("corp_name")).alias("_name"))
    # The join reads its left side three times.
    joined = left_join_fanout(materialize(left, "grantee-names"), right, ["_name"])
    return joined.select(
        "grantee", *ENTITY, F.when(F.col("corp_name").isNotNull(), F.lit("exact")).alias("match_type")
    )


def unmatched_grantees(
    decrees: DataFrame, entities: DataFrame, without: Callable[[DataFrame, DataFrame, list[str]], DataFrame] = anti_join
) -> DataFrame:
    """Grantees without an entity of their name. ``without``: ``joins.bitmap_anti_join`` pays where most stay unmatched."""
    left = grantees(decrees).select("grantee", normalize_name(F.col("grantee")).alias("_name"))
    right = entities.select(normalize_name(F.col("corp_name")).alias("_name"))
    return without(left, right, ["_name"]).select("grantee")


def grantees_to_search(unmatched: DataFrame, stored: DataFrame) -> DataFrame:
    """Unmatched grantees without a stored search result."""
    return pending(unmatched, stored, ["grantee"])


def search_grantees(to_search: DataFrame, entities: DataFrame, k: int = 1) -> DataFrame:
    """The best ``k`` entities per grantee by name; a grantee without any hit has no row."""
    hits = search_top_k(to_search, entities, "grantee", "grantee", ["registration_index", "corp_name"], "corp_name", k)
    details = distinct_on(entities.select(*ENTITY), ["registration_index", "corp_name"], ["status_id"])
    found = hits.join(details, ["registration_index", "corp_name"])
    return found.select("grantee", *ENTITY, "score")


def store_search_results(stored: DataFrame, results: DataFrame) -> DataFrame:
    return insert_if_absent(stored, results, REVIEW_KEY)


def with_evaluated(table: DataFrame) -> DataFrame:
    """The derived flag: somebody has approved or rejected the row."""
    return table.withColumn("evaluado", F.col("aprobado").isNotNull() | F.col("rechazado").isNotNull())


def review_merge(table: DataFrame, edits: DataFrame, search: DataFrame) -> DataFrame:
    """New version of the review table; all three inputs are unique by (grantee, registration_index).

    1. Edited decisions replace stored ones, also where they became NULL; edited rows not stored are added.
    2. Rows found by search with the same name take status and score from the search.
    3. Search rows are added unless their key is present or their (grantee, name) is already evaluated.

    The three tables are laid on top of each other by key in one shuffle.
    """
    update = ["aprobado", "rechazado"]
    found = ["status_id", "status_es", "score"]
    parts = [("old", table, [*found, *update]), ("edit", edits, update), ("search", search, found)]
    stacked = None
    for label, df, columns in parts:
        part = df.select(*REVIEW_KEY, F.lit(label).alias("_part"), "corp_name", *columns)
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)

    def side(label: str):
        here = F.col("_part") == label
        values = F.struct(F.lit(1).alias("_set"), "corp_name", *found, *update)
        return F.max(F.when(here, values)).alias(label), F.count_if(here).alias(f"_n_{label}")

    by_key = stacked.groupBy(*REVIEW_KEY).agg(*side("old"), *side("edit"), *side("search"))
    twice = F.greatest("_n_old", "_n_edit", "_n_search") > 1
    in_old, in_edit, in_search = (F.col(c).isNotNull() for c in ("old", "edit", "search"))
    kept = in_old | in_edit
    corp_name = F.when(in_old, F.col("old.corp_name")).when(in_edit, F.col("edit.corp_name"))
    corp_name = corp_name.otherwise(F.col("search.corp_name"))
    refreshed = in_search & (~kept | (F.col("search.corp_name") == corp_name))
    decision = {c: F.when(in_edit, F.col(f"edit.{c}")).otherwise(F.col(f"old.{c}")) for c in update}
    merged = by_key.select(
        F.when(twice, F.raise_error(F.lit("duplicate review key"))).otherwise(F.col("grantee")).alias("grantee"),
        "registration_index",
        corp_name.alias("corp_name"),
        *[F.when(refreshed, F.col(f"search.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in found],
        *[value.alias(c) for c, value in decision.items()],
        kept.alias("_kept"),
    )
    merged = with_evaluated(merged)
    evaluated = merged.filter("_kept AND evaluado").select("grantee", "corp_name")
    added = anti_join(merged.filter("NOT _kept"), evaluated, ["grantee", "corp_name"])
    return merged.filter("_kept").unionByName(added).drop("_kept").select(*REVIEW_COLUMNS, "evaluado")


def final_matches(exact: DataFrame, review: DataFrame) -> DataFrame:
    """Exact matches and approved search matches, tagged by origin."""
    columns = ["grantee", "registration_index", "corp_name", "status_es", "match_type"]
    approved = review.filter(F.col("aprobado").isNotNull()).withColumn("match_type", F.lit("search_aprobado"))
    return (
        exact.filter(F.col("match_type") == "exact").select(*columns).unionByName(approved.select(*columns))
    )


def review_sheet(review: DataFrame) -> DataFrame:
    """What the reviewers edit: open rows first, best score first."""
    return review.orderBy(F.asc("evaluado"), F.desc_nulls_last("score"), *REVIEW_KEY).select(
        "registration_index", "grantee", "corp_name", "aprobado", "rechazado"
    )


def match_profile(matches: DataFrame, column: str) -> DataFrame:
    """Row counts by one column, most frequent first; very frequent names are usually too generic."""
    counts = matches.groupBy(column).agg(F.count("*").alias("thecount"))
    return counts.orderBy(F.desc("thecount"), F.asc_nulls_last(column))


def searched_companies(companies: DataFrame) -> DataFrame:
    """Distinct searched companies with the state out of the jurisdiction code (``us_de`` -> ``DE``)."""
    keys = ["company_number_search", "jurisdiction_code_search", "company_name_search"]
    renamed = companies.select(
        F.col("search_company_company_number").alias(keys[0]),
        F.col("search_company_jurisdiction_code").alias(keys[1]),
        F.col("search_company_name").alias(keys[2]),
        F.col("search_company_country_code").alias("country_code_search"),
    )
    single = distinct_on(renamed, keys, ["country_code_search"])
    return single.withColumn("state_search", F.upper(split_at(F.col(keys[1]), "_", 2)))


def search_back_match(results: DataFrame, searched: DataFrame) -> DataFrame:
    """Results whose normalised name is none of the searched names."""
    named = results.withColumn("_name", normalize_name(F.col("company_name")))
    names = searched.select(normalize_name(F.col("company_name_search")).alias("_name"))
    return anti_join(named, names, ["_name"]).drop("_name")


def checked_review_input(df: DataFrame) -> DataFrame:
    """A review input whose key is checked on the way."""
    return assert_unique(df, REVIEW_KEY)
