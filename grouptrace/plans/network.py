"""Corporate groups: profile, tax countries, rule adoption and rule status per group and country."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grouptrace.functions.text import strip_leading_chars
from grouptrace.functions.values import any_true, exact_sum, yes_no, yes_no_text
from grouptrace.operators.id_sets import add_to_sets, set_sizes
from grouptrace.operators.joins import semi_join
from grouptrace.operators.reshape import cross_with_list
from grouptrace.plans.panel import OWN_ID_CHARS
from grouptrace.sources.sinks import write_bucketed

LOCAL_STATE = "PR"
RULE_YEARS = (2024, 2025, 2026)


def network_profile(network: DataFrame, state: str = LOCAL_STATE) -> DataFrame:
    """Rows, distinct companies and parents, and how many of each have a row in the local state.

    Company and parent ids are stacked and reduced once per id, instead of one copy of the data for
    each of the four distinct counts.
    """
    local = F.coalesce(F.col("state") == state, F.lit(False))
    ids = network.select(
        F.explode(
            F.array(
                F.struct(F.lit("company").alias("kind"), F.col("company_id").alias("id")),
                F.struct(F.lit("parent").alias("kind"), F.col("parent_id").alias("id")),
            )
        ).alias("e"),
        local.alias("local"),
    )
    per_id = ids.groupBy("e.kind", "e.id").agg(F.count("*").alias("rows"), F.bool_or("local").alias("local"))
    company, parent = F.col("kind") == "company", F.col("kind") == "parent"
    known, is_local = F.col("id").isNotNull(), F.col("local")
    return per_id.agg(
        F.coalesce(F.sum(F.when(company, F.col("rows"))), F.lit(0)).alias("num_rows"),
        F.count_if(company & known).alias("num_unique_companies"),
        F.count_if(company & known & is_local).alias("num_unique_companies_with_local_state"),
        F.count_if(parent & known).alias("num_unique_parents"),
        F.count_if(parent & known & is_local).alias("num_unique_parents_with_local_state"),
    )


_PROFILE = {
    "num_unique_companies": "company", "num_unique_companies_with_local_state": "local company",
    "num_unique_parents": "parent", "num_unique_parents_with_local_state": "local parent",
}


def add_profile_batch(network: DataFrame, path: str, batch: int, state: str = LOCAL_STATE) -> None:
    """Add rows to a profile that is kept between runs: their number, and the ids as sets of bits."""
    local = F.col("state") == state
    kinds = F.array(
        *[F.struct(F.lit(kind).alias("measure"), F.col(f"{kind}_id").alias("id")) for kind in ("company", "parent")],
        *[F.struct(F.lit(f"local {kind}").alias("measure"), F.when(local, F.col(f"{kind}_id")).alias("id")) for kind in ("company", "parent")],
    )
    add_to_sets(network.select(F.inline(kinds)), f"{path}/sets", batch)
    network.agg(F.count("*").alias("num_rows")).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")


def stored_profile(spark: SparkSession, path: str) -> DataFrame:
    """``network_profile`` of all batches added so far, from their sets."""
    rows = spark.read.schema("num_rows bigint").parquet(f"{path}/rows").agg(F.sum("num_rows").alias("num_rows"))
    sizes = set_sizes(spark, f"{path}/sets").agg(
        *[F.coalesce(F.sum(F.when(F.col("measure") == kind, F.col("ids"))), F.lit(0)).alias(name) for name, kind in _PROFILE.items()])
    return rows.withColumn("_", F.lit(1)).join(sizes.withColumn("_", F.lit(1)), "_").drop("_")


def country_dimension(countries: DataFrame, spanish_names: DataFrame) -> DataFrame:
    """Countries with their Spanish name by two-letter code."""
    names = spanish_names.select(F.col("code").alias("alpha-2"), F.col("country").alias("country_es"))
    return countries.join(names, "alpha-2", "left").select(*countries.columns, "country_es")


def rule_adoption(adoption: DataFrame, countries: DataFrame) -> DataFrame:
    """Adoption flags per country and year with the country's code; unknown names keep a NULL code."""
    codes = countries.select("country", F.col("alpha-2").alias("country_code"))
    return (
        adoption.filter(F.col("country").isNotNull())
        .join(codes, "country", "left")
        .select("country_code", "country", F.col("year").cast("int").alias("year"), "pillar2", "iir", "utpr", "qdmtt")
    )


def with_tax_country(network: DataFrame, state: str = LOCAL_STATE) -> DataFrame:
    """The local state counts as a country of its own."""
    code = F.when(F.col("state") == state, F.lit(state)).otherwise(F.col("country_iso_code"))
    return network.withColumn("tax_country", code)


def with_parent_tax_country(network: DataFrame) -> DataFrame:
    """Every member row with the tax country of its parent's row; NULL when the parent has no row.

    A large parent's members are the left side, which Spark splits.
    """
    rows = with_tax_country(network)
    parents = rows.select(
        F.col("company_id").alias("parent_id"), F.col("tax_country").alias("parent_tax_country")
    ).filter(F.col("parent_id").isNotNull())
    return rows.filter(F.col("parent_id").isNotNull()).join(parents, "parent_id", "left").select(
        *rows.columns, "parent_tax_country"
    )


def foreign_subsidiary_countries(network: DataFrame) -> DataFrame:
    """Per parent: the countries, other than its own, of its subsidiaries; NULL when there are none.

    Members are reduced to one row per (parent, country) before any join, so a group holding a large
    share of all rows shrinks to the number of countries.
    """
    rows = with_tax_country(network)
    subsidiary = (F.col("company_id") != F.col("parent_id")) & (F.col("branch_indicator") == "No")
    per_country = (
        rows.filter(F.col("parent_id").isNotNull())
        .groupBy("parent_id", "tax_country")
        .agg(any_true(subsidiary).alias("_subsidiary"))
    )
    # Only companies that are somebody's parent take part in the join.
    places = rows.select(F.col("company_id").alias("parent_id"), F.col("tax_country").alias("parent_tax_country"))
    parents = semi_join(places, rows, ["parent_id"]).distinct()
    abroad = F.col("_subsidiary") & (F.col("tax_country") != F.col("parent_tax_country"))
    countries = F.array_sort(F.collect_set(F.when(abroad, F.col("tax_country"))))
    return (
        per_country.join(parents, "parent_id", "left")
        .groupBy("parent_id", "parent_tax_country")
        .agg(countries.alias("_countries"))
        .select(
            "parent_id",
            "parent_tax_country",
            F.when(F.size("_countries") > 0, F.col("_countries")).alias("foreign_tax_countries"),
        )
    )


def subject_to_rule_by_year(
    parents: DataFrame, adoption: DataFrame, rule: str = "utpr", years: Sequence[int] = RULE_YEARS
) -> DataFrame:
    """Per (parent, year): does any country of its subsidiaries apply the rule?

    Without foreign subsidiaries the answer is false in all ``years``. With subsidiaries only in
    countries without adoption data there is no row, which is not the same as false.
    """
    countries = F.col("foreign_tax_countries")
    applied = adoption.filter(F.col("year").isNotNull() & F.col("country_code").isNotNull()).select(
        "country_code", "year", yes_no(F.col(rule)).alias("_applies")
    )
    having = (
        parents.filter(countries.isNotNull())
        .select("parent_id", "parent_tax_country", F.explode(countries).alias("country_code"))
        .join(applied, "country_code")
        .groupBy("parent_id", "parent_tax_country", "year")
        .agg(any_true(F.col("_applies")).alias("parent_subject_to_rule"))
    )
    lacking = cross_with_list(
        parents.filter(countries.isNull()).select("parent_id", "parent_tax_country"), years, "year"
    ).withColumn("parent_subject_to_rule", F.lit(False))
    return having.unionByName(lacking)


def local_to_parent(
    local_ids: DataFrame, panel: DataFrame, entities: DataFrame, network: DataFrame, group_revenue: DataFrame
) -> DataFrame:
    """Local companies with name, parent, parent's place and group revenue; only parents in the network.

    Rows without a parent in the network are dropped in the end, so panel and network join as inner.
    """
    parents = panel.select(strip_leading_chars(F.col("own_id"), OWN_ID_CHARS).alias("company_number"), "parent_id")
    with_parent = local_ids.select("company_number").join(parents, "company_number")
    places = network.select(
        F.col("company_id").alias("parent_id"),
        F.col("company_name").alias("parent_company_name"),
        F.col("country_iso_code").alias("parent_country_iso_code"),
        F.col("state").alias("parent_state"),
    )
    placed = with_parent.join(places, "parent_id")
    names = entities.select(
        F.col("registration_index").alias("company_number"), F.col("corp_name").alias("local_corp_name")
    )
    named = placed.join(names, "company_number", "left")
    return named.join(group_revenue, "parent_id", "left").select(
        "company_number",
        "local_corp_name",
        "parent_id",
        "parent_company_name",
        "parent_country_iso_code",
        "parent_state",
        "filial_operating_revenue_max",
    )


def group_rule_status(
    local_companies: DataFrame, adoption: DataFrame, group_revenue: DataFrame, rule_by_year: DataFrame,
    state: str = LOCAL_STATE,
) -> DataFrame:
    """Per parent and year: local companies, adoption flags of the parent's country, revenue, UTPR.

    A parent whose country has no adoption data keeps one row with a NULL year.
    """
    tax_country = F.when(F.col("parent_state") == state, F.lit(state)).otherwise(F.col("parent_country_iso_code"))
    parents = (
        local_companies.withColumn("parent_tax_country", tax_country)
        .groupBy("parent_id", "parent_company_name", "parent_tax_country")
        .agg(F.count_distinct("company_number").alias("num_local_companies"))
    )
    flags = adoption.filter(F.col("country_code").isNotNull()).select(
        F.col("country_code").alias("parent_tax_country"),
        F.col("country").alias("parent_country"),
        "year", "pillar2", "iir", "qdmtt",
    )
    answers = rule_by_year.select(
        "parent_id", "year", yes_no_text(F.col("parent_subject_to_rule")).alias("utpr")
    )
    return (
        parents.join(flags, "parent_tax_country", "left")
        .join(group_revenue, "parent_id", "left")
        .join(answers, ["parent_id", "year"], "left")
        .select(
            "parent_id", "parent_company_name", "num_local_companies", "parent_tax_country", "parent_country",
            "year", "pillar2", "iir", "qdmtt", "utpr", "filial_operating_revenue_max",
        )
    )


def stored_by_parent(
    local_companies: DataFrame, group_revenue: DataFrame, rule_by_year: DataFrame, buckets: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three large inputs of ``group_rule_status`` bucketed by parent, once for all reports that join them.

    ``group_rule_status`` of them shuffles none of the three. Some 100 MB per bucket is a good size.
    """
    return tuple(
        write_bucketed(df, ["parent_id"], buckets, label)
        for df, label in ((local_companies, "local-companies"), (group_revenue, "group-revenue"), (rule_by_year, "rule-by-year"))
    )


def group_rule_status_by_parent(
    local_companies: DataFrame, adoption: DataFrame, group_revenue: DataFrame, rule_by_year: DataFrame,
    state: str = LOCAL_STATE,
) -> DataFrame:
    """``group_rule_status`` with all joins on the parent first, so that inputs bucketed by parent stay where they are.

    A parent's answers are gathered to one row by year before the join (as many as there are years). The adoption table, one
    row per country and year, comes last; Spark sends it to all tasks where its size allows.
    """
    tax_country = F.when(F.col("parent_state") == state, F.lit(state)).otherwise(F.col("parent_country_iso_code"))
    parents = (
        local_companies.withColumn("parent_tax_country", tax_country)
        .groupBy("parent_id", "parent_company_name", "parent_tax_country")
        .agg(F.count_distinct("company_number").alias("num_local_companies"))
    )
    answers = rule_by_year.filter(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(
        F.collect_list(F.struct("year", yes_no_text(F.col("parent_subject_to_rule")).alias("utpr"))).alias("_answers"))
    flags = adoption.filter(F.col("country_code").isNotNull()).select(
        F.col("country_code").alias("parent_tax_country"),
        F.col("country").alias("parent_country"),
        "year", "pillar2", "iir", "qdmtt",
    )
    placed = parents.join(group_revenue, "parent_id", "left").join(answers, "parent_id", "left").join(flags, "parent_tax_country", "left")
    # A parent may have several rows with different tax countries, and with them several answers a year.
    of_year = F.filter("_answers", lambda a: a.year == F.col("year"))
    answered = placed.withColumn("_utpr", F.explode_outer(F.transform(of_year, lambda a: F.struct(a.utpr.alias("utpr")))))
    return answered.select(
        "parent_id", "parent_company_name", "num_local_companies", "parent_tax_country", "parent_country",
        "year", "pillar2", "iir", "qdmtt", F.col("_utpr.utpr").alias("utpr"), "filial_operating_revenue_max",
    )


def country_rule_summary(status: DataFrame) -> DataFrame:
    """Per country and year: parents, local companies, flags, parents per flag, and revenue."""
    revenue, utpr = F.col("filial_operating_revenue_max"), F.col("utpr") == "Yes"
    return status.groupBy("parent_tax_country", "parent_country", "year").agg(
        F.count("*").alias("num_parents"),
        F.sum("num_local_companies").cast("int").alias("num_local_companies"),
        F.max("qdmtt").alias("qdmtt"),  # constant per country and year
        F.max("iir").alias("iir"),
        F.count_if(F.col("qdmtt") == "Yes").alias("num_parents_with_qdmtt"),
        F.count_if(F.col("iir") == "Yes").alias("num_parents_with_iir"),
        F.count_if(utpr).alias("num_parents_with_utpr"),
        exact_sum(revenue).alias("total_revenue"),
        exact_sum(F.when(utpr, revenue)).alias("total_revenue_with_utpr"),
    )
