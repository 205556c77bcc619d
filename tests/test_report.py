import os

import pytest

from benchset.catalog import ANY_YEAR_THRESHOLD, PANEL_VALUES, QUERIES, inputs, rule_adoption, country_dimension
from grouptrace.plans import report
from grouptrace.sources.sinks import write_csv

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_rule_report_equals_the_single_jobs(spark, rows):
    t = inputs(spark, SF_DIR)
    tables = report.rule_report(
        t["local_ids"], t["local_panel"], t["local_entities"], t["network"], t["group_revenue"],
        country_dimension(t), rule_adoption(t), {2024: False, 2025: True},
    )
    for name in ("group_rule_status", "country_revenue_display_2025", "group_rule_display_2024", "ranked_group_table"):
        assert rows(tables[name]) == rows(QUERIES[name](spark, SF_DIR)), name


def test_revenue_report(spark, rows, tmp_path):
    t = inputs(spark, SF_DIR)
    tables = report.revenue_report(t["revenue_wide"], PANEL_VALUES, ANY_YEAR_THRESHOLD)
    assert rows(tables["qualified_groups"]) == rows(QUERIES["qualified_groups"](spark, SF_DIR))
    report.write_tables(tables, str(tmp_path), csv=True)
    read = spark.read.parquet(str(tmp_path / "qualified_local_companies.parquet"))
    assert rows(read) == rows(QUERIES["qualified_local_companies"](spark, SF_DIR))


def test_matching_rounds(spark, rows, tmp_path):
    names = "registration_index string, corp_name string, status_id bigint, status_es string, record_id bigint"
    entities = spark.createDataFrame(
        [("1", "RED WINE INC", 1, "ACTIVA", 1), ("2", "BLUE WINE CORP", 1, "ACTIVA", 2), ("3", "GAS", 1, "X", 3)], names
    )
    decrees = spark.createDataFrame(
        [("Red Wine, Inc.", 1), ("The Blue Wine Co.", 2), ("No such thing", 3)], "grantee string, decree_id int"
    )
    search = "grantee string, registration_index string, corp_name string, status_id bigint, status_es string, score double"
    none_stored = spark.createDataFrame([], search)
    none_reviewed = spark.createDataFrame([], search + ", aprobado string, rechazado string")
    no_edits = spark.createDataFrame(
        [], "registration_index string, grantee string, corp_name string, aprobado string, rechazado string"
    )
    first = report.matching_report(decrees, entities, none_stored, none_reviewed, no_edits)
    assert rows(first["review_sheet"]) == [("2", "The Blue Wine Co.", "BLUE WINE CORP", None, None)]
    assert rows(first["final_matches"], "grantee", "match_type") == [("Red Wine, Inc.", "exact")]

    # A reviewer approves the row; the next round keeps it and asks for nothing again.
    sheet = first["review_sheet"].collect()[0].asDict() | {"aprobado": "x"}
    edits = spark.createDataFrame([tuple(sheet[c] for c in no_edits.columns)], no_edits.schema)
    second = report.matching_report(decrees, entities, first["search_results"], first["review"].drop("evaluado"), edits)
    assert rows(second["search_results"]) == rows(first["search_results"])
    assert rows(second["final_matches"], "grantee", "registration_index", "match_type") == [
        ("Red Wine, Inc.", "1", "exact"), ("The Blue Wine Co.", "2", "search_aprobado")]
    write_csv(second["review_sheet"], str(tmp_path / "sheet"))
    assert rows(second["evaluated"]) == [(True, 1)]
