"""The shape of physical plans: what is shuffled, reused and pushed down."""

import re

import pytest
from pyspark.sql import functions as F

from grouptrace.operators import joins, ranking, sampling
from grouptrace.plans import network, panel


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan")[0]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t")
    df = spark.range(500).selectExpr(
        "cast(id % 7 as string) as parent_id", "cast(id as string) as company_id", "cast(id as double) as r_1_eur",
        "cast(id as double) as r_last", "if(id % 3 = 0, 'PR', 'NY') as state", "'US' as country_iso_code",
        "'No' as branch_indicator", "'unused' as note",
    )
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_threshold_is_one_narrow_stage(table):
    passed = panel.consistent_threshold(table, last="r_last", yearly_pattern=r"r_\d_eur")
    assert "Exchange" not in plan(passed)


def test_sampling_by_id_is_a_filter(table):
    assert "Exchange" not in plan(sampling.sample_ids(table, "company_id", 0.05))


def test_profile_reads_three_columns_and_shuffles_once_per_step(table):
    text = plan(network.network_profile(table))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["parent_id:string,company_id:string,state:string"]
    assert text.count("Exchange hashpartitioning") == 1


def test_groups_are_reduced_before_the_shuffle(table):
    text = plan(network.foreign_subsidiary_countries(table))
    below = text[text.index("Exchange hashpartitioning(parent_id"):]
    assert "bool_or" in below or "max" in below
    assert "note" not in text


def test_fanout_join_reuses_the_left_side(spark, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        right = table.select("parent_id", F.col("company_id").alias("other"))
        text = final_plan(joins.left_join_fanout(table.select("parent_id", "company_id"), right, ["parent_id"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in text and "LeftOuter" not in text and "CartesianProduct" not in text


def test_top_k_limits_before_the_shuffle(table):
    text = plan(ranking.top_k(table, ["parent_id"], [F.desc("r_last")], 2))
    assert text.count("WindowGroupLimit") == 2


def test_group_joins_read_each_table_once(table):
    assert plan(network.with_parent_tax_country(table)).count("FileScan") == 2
    names = table.select(F.col("company_id").alias("registration_index"), F.col("note").alias("corp_name"))
    network_rows = table.select("company_id", F.col("note").alias("company_name"), "country_iso_code", "state")
    panel_rows = table.select(F.col("company_id").alias("own_id"), "parent_id")
    revenue = table.select("parent_id", F.col("r_last").alias("filial_operating_revenue_max"))
    ids = table.select(F.col("company_id").alias("company_number"))
    text = plan(network.local_to_parent(ids, panel_rows, names, network_rows, revenue))
    assert text.count("FileScan") == 5


def test_filters_reach_the_scan(table):
    text = plan(network.with_parent_tax_country(table))
    assert "PushedFilters: [IsNotNull(parent_id)]" in text
