import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from grouptrace.plans import matching, network, panel, present, registry
from grouptrace.sources import schemas

YEARLY = (
    "company_id string, operating_revenue_year_last_eur_th double, operating_revenue_year_1_eur_th double, "
    "operating_revenue_year_2_eur_th double, operating_revenue_year_3_eur_th double, operating_revenue_year_4_eur_th double"
)


def test_consistent_threshold(spark, rows):
    batch = spark.createDataFrame([
        ("two over", None, 800e3, 800e3, None, None),
        ("one over of two", 9e9, 800e3, 1e3, None, None),
        ("last decides", 900e3, 800e3, None, None, None),
        ("nothing known", None, None, None, None, None),
        ("inclusive", None, 750000.0, 750000.0, 1.0, 1.0),
        ("last too low", 749999.0, None, None, None, None),
    ], YEARLY)
    assert rows(panel.consistent_threshold(batch), "company_id") == [("inclusive",), ("last decides",), ("two over",)]


def test_any_year_threshold(spark, rows):
    df = spark.createDataFrame(
        [("strict", "p", 750000.0, None), ("over", "p", 1.0, 750000.01), ("none", "q", None, None)],
        "company_id string, parent_id string, a double, b double",
    )
    sheet = panel.any_year_worksheet(df, ["a", "b"])
    assert rows(sheet, "company_id", "num_years_available", "no_revenue_data", "operating_revenue_max", "qualified") == [
        ("none", 0, True, None, False), ("over", 2, False, 750000.01, True), ("strict", 1, False, 750000.0, False),
    ]


def test_qualified_groups_and_their_local_companies(spark, rows):
    df = spark.createDataFrame([
        ("a", "p", "pr/1-112", 9e5), ("b", "p", "rp/2-112", 1.0), ("c", "q", "pr/3-112", 1.0),
        ("d", None, "pr/4-112", 8e5), ("e", "p", None, None),
    ], "company_id string, parent_id string, own_id string, r double")
    groups = panel.qualified_groups(panel.any_year_worksheet(df, ["r"]))
    assert rows(groups) == [("p", 9e5), (None, 8e5)]
    # Members of a qualified group count although they do not qualify themselves.
    assert rows(panel.qualified_local_companies(groups, df)) == [("1-112",), ("2-112",), (None,)]


def test_revenue_in_thousands(spark, rows):
    nominal = spark.createDataFrame([("a", 5000.0)], "id string, rev_eur double")
    assert rows(panel.revenue_in_thousands(nominal, "_th$", "_eur$", "_th"), "rev_eur_th") == [(5.0,)]
    ready = spark.createDataFrame([("a", 5.0)], "id string, rev_eur_th double")
    assert panel.revenue_in_thousands(ready, "_th$", "_eur$", "_th").columns == ready.columns
    both = spark.createDataFrame([(5.0, 9.0)], "rev_eur_th double, rev_eur double")
    assert panel.revenue_in_thousands(both, "_th$", "_eur$", "_th").columns == ["rev_eur_th"]
    with pytest.raises(ValueError):
        panel.revenue_in_thousands(spark.createDataFrame([("a",)], "id string"), "_th$", "_eur$", "_th")


def test_merge_data_batches_keeps_fanout_and_column_order(spark, rows):
    data = spark.createDataFrame([("f1", "A", 1), ("f1", "B", 2)], "file_name string, company_id string, r int")
    search = spark.createDataFrame([("A", "pr/1"), ("A", "pr/2"), (None, "pr/3")], "matched_company_id string, own_id string")
    merged = panel.merge_data_batches(data, search)
    assert merged.columns == ["file_name", "own_id", "company_id", "r"]
    assert rows(merged) == [("f1", "pr/1", "A", 1), ("f1", "pr/2", "A", 1), ("f1", None, "B", 2)]


def test_year_columns_latest_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], "rev_year_2014_x int, rev_year_2024_x int, rev_year_last_x int")
    assert panel.year_columns(df) == ["rev_year_2024_x", "rev_year_2014_x"]


def test_minimum_tax_panel_reproduces_published_years(spark):
    # Published totals and results of two years.
    names = "time_period int, TOT_REV double, PROFIT double, TAX_ACCRUED double, ASSETS double, PAYROLL double"
    totals = spark.createDataFrame([
        (2016, 98924500352.504, 38872070880.503, 420237800.61, 17496562680.272, 2952932304.96),
        (2021, 115574457057.0, 32306693147.0, 824113852.0, 30940595598.0, 4166263804.5),
    ], names)
    expected = {
        2016: (37177052635.585236, 1695018244.9177601, 0.010810790140351849, 5174644581.257658),
        2021: (29414819118.710003, 2891874028.29, 0.0255090747991497, 3661878046.7038684),
    }
    for row in panel.minimum_tax_panel(totals).collect():
        got = (row.TAX_BASE, row.SBIE, row.ETR, row.QDMTT)
        assert got == pytest.approx(expected[row.time_period], rel=1e-9)


def test_minimum_tax_without_profit(spark):
    totals = spark.createDataFrame(
        [(1, 1.0, 0.0, 1.0, 1.0, 1.0)],
        "time_period int, TOT_REV double, PROFIT double, TAX_ACCRUED double, ASSETS double, PAYROLL double",
    )
    assert panel.minimum_tax_panel(totals).first().ETR is None


NET = "company_id string, parent_id string, country_iso_code string, state string, branch_indicator string"


@pytest.fixture
def groups(spark):
    return spark.createDataFrame([
        ("H", "H", "US", None, "No"), ("H1", "H", "US", None, "No"),            # home country only
        ("M1", "GONE", "DE", None, "No"),                                         # parent not in the network
        ("N", "N", "US", None, "No"), ("N1", "N", "BN", None, "No"),              # country without data
        ("B", "B", "US", None, "No"), ("B1", "B", "DE", None, "Yes"),             # only a branch abroad
        ("F", "F", "US", "PR", "No"), ("F1", "F", "US", None, "No"), ("F2", "F", "NA", None, "No"),
        ("X", None, "DE", None, "No"),
    ], NET)


@pytest.fixture
def adoption(spark):
    rows = [("US", y, "No") for y in (2024, 2025)] + [("NA", 2024, "Pending"), ("NA", 2025, "Yes"), ("DE", 2025, "Yes")]
    return spark.createDataFrame(rows, "country_code string, year int, utpr string")


def test_foreign_subsidiary_countries(rows, groups):
    got = rows(network.foreign_subsidiary_countries(groups))
    assert got == [
        ("B", "US", None), ("F", "PR", ["NA", "US"]), ("GONE", None, None), ("H", "US", None), ("N", "US", ["BN"]),
    ]


def test_subject_to_rule_by_year(rows, groups, adoption):
    subject = network.subject_to_rule_by_year(network.foreign_subsidiary_countries(groups), adoption)
    got = {(r.parent_id, r.year): r.parent_subject_to_rule for r in subject.collect()}
    assert len(got) == subject.count()
    never = {(p, y): False for p in ("B", "GONE", "H") for y in (2024, 2025, 2026)}
    assert got == {**never, ("F", 2024): False, ("F", 2025): True}  # N has no row at all


def test_network_profile_counts_each_id_once(spark, rows, groups):
    profile = network.network_profile(groups.union(groups.filter("company_id = 'F'")))
    assert rows(profile) == [(12, 11, 1, 5, 1)]
    assert rows(network.network_profile(groups.limit(0))) == [(0, 0, 0, 0, 0)]


def test_parent_tax_country_keeps_repeated_parents(spark, rows):
    net = spark.createDataFrame([("P", "P", "US", None, "No"), ("P", "P", "DE", None, "No"), ("C", "P", "FR", None, "No")], NET)
    got = rows(network.with_parent_tax_country(net).filter("company_id = 'C'"), "parent_tax_country")
    assert got == [("DE",), ("US",)]


def test_status_keeps_parents_without_adoption_data(spark, rows):
    local = spark.createDataFrame(
        [("1", "n1", "P", "Parent", "ZZ", None, 5.0), ("2", None, "P", "Parent", "ZZ", None, 5.0)],
        "company_number string, local_corp_name string, parent_id string, parent_company_name string, "
        "parent_country_iso_code string, parent_state string, filial_operating_revenue_max double",
    )
    flags = spark.createDataFrame(
        [("US", "United States", 2024, "No", "No", "No", "No")],
        "country_code string, country string, year int, pillar2 string, iir string, utpr string, qdmtt string",
    )
    revenue = spark.createDataFrame([("P", 5.0)], "parent_id string, filial_operating_revenue_max double")
    answers = spark.createDataFrame([("P", 2024, True)], "parent_id string, year int, parent_subject_to_rule boolean")
    status = network.group_rule_status(local, flags, revenue, answers)
    assert rows(status, "num_local_companies", "year", "utpr", "filial_operating_revenue_max") == [(2, None, None, 5.0)]
    summary = network.country_rule_summary(status)
    assert rows(summary, "num_parents", "num_parents_with_utpr", "total_revenue", "total_revenue_with_utpr") == [(1, 0, 5.0, None)]


def test_ranked_group_table_puts_missing_names_first(spark):
    local = spark.createDataFrame(
        [("1", "b", "P", "p", "US", None, 1.0), ("2", None, "P", "p", "US", None, 1.0), ("3", "a", "Q", "q", "US", None, 2.0)],
        "company_number string, local_corp_name string, parent_id string, parent_company_name string, "
        "parent_country_iso_code string, parent_state string, filial_operating_revenue_max double",
    )
    got = [tuple(r)[:3] + (r["ID de compañía de PR"],) for r in present.ranked_group_table(local).collect()]
    assert got == [(1, 1, "Q", "3"), (2, 1, "P", "2"), (2, 2, "P", "1")]


def test_foreign_entities(spark, rows):
    texts = [
        '{"response":{"corporation":{"corpRegisterIndex":"1-1","jurisdictionEs":"Foránea","corporationJurisdictionTypeId":2,'
        '"statusEs":"ACTIVA"},"mainLocation":{"foreignDomicileAddress":null,"streetAddress":{"city":"Ponce"}}}}',
        '{"response":{"corporation":{"corpRegisterIndex":"2-1","jurisdictionEs":"Foránea - No Estadounidense",'
        '"corporationJurisdictionTypeId":3,"statusEs":"ACTIVA"},"mainLocation":{"foreignDomicileAddress":'
        '{"city":"Lima","province":"Peru"}}}}',
        '{"response":{"corporation":{"corpRegisterIndex":"3-1","jurisdictionEs":"Doméstica","statusEs":"ACTIVA"}}}',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    documents = df.select(F.from_json("value", schemas.ENTITY_DOCUMENT).alias("d")).select("d.*")
    got = rows(registry.foreign_entities(documents, "ACTIVA", "u="), "register_index", "city", "country_name", "country_code", "link")
    assert got == [("1-1", "Ponce", "United States", "US", "u=1-1"), ("2-1", None, "Peru", None, "u=2-1")]


def test_searches_return_every_match(spark, rows):
    records = spark.range(1500).selectExpr("id as record_id", "id as registration_number", "'x y' as corp_name")
    assert registry.number_search(records, "at_least", 0).count() == registry.name_search(records, "any_word", "x").count() == 1500
    assert rows(registry.number_search(records, "greater", 9, 2), "record_id") == [(10,), (11,)]
    assert registry.name_search(records, "all_words", " ").count() == 0


def test_exact_match_keeps_all_entities_of_a_name(spark, rows):
    decrees = spark.createDataFrame([("Foo, Inc.", 2), ("Foo, Inc.", 1), ("Bar", 3), (None, 4)], "grantee string, decree_id int")
    entities = spark.createDataFrame(
        [("1", "FOO INC", 1, "ACTIVA"), ("2", "Foo Inc.", 2, "X")],
        "registration_index string, corp_name string, status_id int, status_es string",
    )
    got = rows(matching.exact_name_match(decrees, entities), "grantee", "registration_index", "match_type")
    assert got == [("Bar", None, None), ("Foo, Inc.", "1", "exact"), ("Foo, Inc.", "2", "exact")]
    assert rows(matching.unmatched_grantees(decrees, entities)) == [("Bar",)]


OLD = (
    "grantee string, registration_index string, corp_name string, status_id int, status_es string, score double, "
    "aprobado string, rechazado string"
)
EDIT = "grantee string, registration_index string, corp_name string, aprobado string, rechazado string"
SEARCH = "grantee string, registration_index string, corp_name string, status_id int, status_es string, score double"


@pytest.fixture
def review(spark):
    old = spark.createDataFrame([("g1", "1", "A", 1, "s", 0.1, "x", None), ("g2", "2", "B", 1, "s", 0.2, None, "x")], OLD)
    edits = spark.createDataFrame([("g1", "1", "A", None, None), ("g3", "3", "C", "x", None)], EDIT)
    search = spark.createDataFrame([
        ("g1", "1", "A", 7, "new", 9.0),      # refreshes
        ("g2", "9", "B", 7, "new", 8.0),      # its (grantee, name) is decided: not added
        ("g3", "3", "Other", 7, "new", 7.0),  # key present under another name: nothing changes
        ("g4", "4", "D", 7, "new", 6.0),      # added
    ], SEARCH)
    return old, edits, search


def test_review_merge(rows, review):
    merged = matching.review_merge(*review)
    assert rows(merged) == [
        ("g1", "1", "A", 7, "new", 9.0, None, None, False),
        ("g2", "2", "B", 1, "s", 0.2, None, "x", True),
        ("g3", "3", "C", None, None, None, "x", None, True),
        ("g4", "4", "D", 7, "new", 6.0, None, None, False),
    ]


def test_review_merge_twice_is_once(rows, review):
    old, edits, search = review
    merged = matching.review_merge(old, edits, search)
    assert rows(matching.review_merge(merged.drop("evaluado"), edits, search)) == rows(merged)


def test_review_merge_rejects_repeated_keys(review):
    old, edits, search = review
    with pytest.raises(PySparkException):
        matching.review_merge(old, edits.union(edits), search).collect()


def test_review_sheet_and_profile(review):
    merged = matching.review_merge(*review)
    assert [r.grantee for r in matching.review_sheet(merged).collect()] == ["g1", "g4", "g2", "g3"]
    assert [tuple(r) for r in matching.match_profile(merged, "evaluado").collect()] == [(False, 2), (True, 2)]


def test_search_memo_only_asks_for_new_grantees(spark, rows):
    unmatched = spark.createDataFrame([("a",), ("b",)], "grantee string")
    stored = spark.createDataFrame([("a", "1", "A", 1, "s", 0.5)], SEARCH)
    assert rows(matching.grantees_to_search(unmatched, stored)) == [("b",)]


def test_search_back_match(spark, rows):
    searched = matching.searched_companies(spark.createDataFrame(
        [("1", "us_de", "ACME, Inc.", "US"), ("1", "us_de", "ACME, Inc.", "AA"), ("2", "us", None, "US")],
        "search_company_company_number string, search_company_jurisdiction_code string, search_company_name string, "
        "search_company_country_code string",
    ))
    assert rows(searched, "country_code_search", "state_search") == [("AA", "DE"), ("US", None)]
    results = spark.createDataFrame([("x", "acme inc"), ("y", "Other")], "company_id string, company_name string")
    assert rows(matching.search_back_match(results, searched), "company_id") == [("y",)]


def test_pending_related(spark, rows):
    merged = spark.createDataFrame([("1", "a", "FUSIONADA"), ("2", "b", "FUSIONADA")], "register_index string, corp_name string, status string")
    done = registry.collected_ids(spark.createDataFrame([("1.json",), ("1.json",)], "file_name string"))
    assert rows(registry.pending_related(merged, done), "registration_index") == [("2",)]
