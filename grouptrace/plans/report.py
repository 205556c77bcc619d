"""Whole runs: the chained jobs with their shared intermediate tables stored once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from grouptrace.plans import matching, network, panel, present
from grouptrace.session import materialize
from grouptrace.sources.sinks import write_csv, write_parquet


def revenue_report(revenue: DataFrame, values: list[str], threshold: float) -> dict[str, DataFrame]:
    """Qualified groups and the local companies that belong to them."""
    groups = materialize(
        panel.qualified_groups(panel.any_year_worksheet(revenue, values, threshold)), "qualified-groups"
    )
    return {
        "qualified_groups": groups,
        "qualified_local_companies": panel.qualified_local_companies(groups, revenue),
    }


def rule_report(
    local_ids: DataFrame,
    revenue: DataFrame,
    entities: DataFrame,
    members: DataFrame,
    group_revenue: DataFrame,
    countries: DataFrame,
    adoption: DataFrame,
    rule_starts: Mapping[int, bool],
) -> dict[str, DataFrame]:
    """All tables of the group and country analysis.

    ``rule_starts`` gives the years to display and whether the subsidiaries' rule already applies then.
    Three tables feed several others and are stored: local companies with their parent, answers per
    group and year, and the status table.
    """
    local = materialize(network.local_to_parent(local_ids, revenue, entities, members, group_revenue), "local")
    answers = materialize(
        network.subject_to_rule_by_year(network.foreign_subsidiary_countries(members), adoption), "answers"
    )
    status = materialize(network.group_rule_status(local, adoption, group_revenue, answers), "status")
    summary = materialize(network.country_rule_summary(status), "summary")
    tables = {
        "local_to_parent": local,
        "local_to_parent_display": present.local_to_parent_display(local),
        "subject_to_rule_by_year": answers.orderBy("parent_id", "year"),
        "group_rule_status": status,
        "country_rule_summary": summary,
        "ranked_group_table": present.ranked_group_table(local),
    }
    for year, applies in rule_starts.items():
        tables[f"country_rule_display_{year}"] = present.country_rule_display(summary, countries, year, applies)
        tables[f"country_revenue_display_{year}"] = present.country_revenue_display(summary, countries, year, applies)
        tables[f"group_rule_display_{year}"] = present.group_rule_display(status, year, applies)
    return tables


def matching_report(
    decrees: DataFrame,
    entities: DataFrame,
    stored: DataFrame,
    review: DataFrame,
    edits: DataFrame,
    k: int = 1,
) -> dict[str, DataFrame]:
    """One round of matching: exact names, search for grantees not searched before, review merge.

    ``stored`` holds earlier search results, ``review`` the last version of the review table and
    ``edits`` the sheet the reviewers returned. The returned ``search_results``, ``review`` and
    ``review_sheet`` are the inputs of the next round.
    """
    entities = materialize(entities, "entities")
    exact = materialize(matching.exact_name_match(decrees, entities), "exact")
    unmatched = matching.unmatched_grantees(decrees, entities)
    found = matching.search_grantees(matching.grantees_to_search(unmatched, stored), entities, k)
    results = materialize(matching.store_search_results(stored, found), "search-results")
    merged = materialize(matching.review_merge(review, edits, results), "review")
    final = matching.final_matches(exact, merged)
    return {
        "exact_matches": exact.filter("match_type = 'exact'"),
        "search_results": results,
        "review": merged,
        "review_sheet": matching.review_sheet(merged),
        "final_matches": final,
        "names": matching.match_profile(merged, "corp_name"),
        "review_status": matching.match_profile(merged, "status_es"),
        "final_status": matching.match_profile(final, "status_es"),
        "evaluated": matching.match_profile(merged, "evaluado"),
    }


def write_tables(tables: Mapping[str, DataFrame], folder: str, csv: bool = False) -> None:
    """Every table as Parquet and, where people read it, as CSV with a header."""
    for name, df in tables.items():
        write_parquet(df, f"{folder}/{name}.parquet")
        if csv:
            write_csv(df, f"{folder}/{name}.csv")
