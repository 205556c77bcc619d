"""Tables for publication, with their display headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grouptrace.functions.values import yes_no_spanish
from grouptrace.operators.ranking import spread_row_number
from grouptrace.session import materialize

# Display headings.
COUNTRY, PAIS = "Country", "País"
PARENTS, LOCALS = "Matrices", "Filiales puertorriqueñas"
WITH_UTPR = "Matrices con filiales en países con UTPR"
REVENUE = "Ingreso total de matrices (millones de euros)"
REVENUE_WITH_UTPR = "Ingreso total de matrices con filiales en países con UTPR (millones de euros)"


def _with_spanish_name(summary: DataFrame, countries: DataFrame) -> DataFrame:
    names = countries.select(F.col("alpha-2").alias("parent_tax_country"), "country_es")
    names = names.filter(F.col("parent_tax_country").isNotNull())
    return summary.join(names, "parent_tax_country", "left")


def _by_local_companies(df: DataFrame, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("num_local_companies"), *ties)


def _base() -> list[Column]:
    return [
        F.col("parent_country").alias(COUNTRY),
        F.col("country_es").alias(PAIS),
        F.col("num_parents").alias(PARENTS),
        F.col("num_local_companies").alias(LOCALS),
    ]


def country_rule_display(summary: DataFrame, countries: DataFrame, year: int, with_utpr: bool) -> DataFrame:
    """Countries of one year with adoption flags in two languages; UTPR is left out before it applies."""
    rows = _with_spanish_name(summary.filter(F.col("year") == year), countries)
    utpr = [F.col("num_parents_with_utpr").alias(WITH_UTPR)] if with_utpr else []
    return _by_local_companies(rows, "parent_tax_country").select(
        *_base(),
        F.col("qdmtt").alias("QDMTT (Yes/No)"),
        F.col("iir").alias("IIR (Yes/No)"),
        yes_no_spanish(F.col("qdmtt")).alias("QDMTT (Sí/No)"),
        yes_no_spanish(F.col("iir")).alias("IIR (Sí/No)"),
        *utpr,
    )


def country_revenue_display(summary: DataFrame, countries: DataFrame, year: int, with_utpr: bool) -> DataFrame:
    """Countries of one year with group revenue in millions."""
    rows = _with_spanish_name(summary.filter(F.col("year") == year), countries)
    count = [F.col("num_parents_with_utpr").alias(WITH_UTPR)] if with_utpr else []
    share = [(F.col("total_revenue_with_utpr") / 1e3).alias(REVENUE_WITH_UTPR)] if with_utpr else []
    return _by_local_companies(rows, "parent_tax_country").select(
        *_base(), *count, (F.col("total_revenue") / 1e3).alias(REVENUE), *share
    )


def group_rule_display(status: DataFrame, year: int, with_utpr: bool) -> DataFrame:
    """Groups of one year by number of local companies."""
    rows = _by_local_companies(status.filter(F.col("year") == year), "parent_id", "parent_company_name")
    columns = ["parent_company_name", "num_local_companies", "parent_tax_country", "iir", "qdmtt"]
    return rows.select(*columns, *(["utpr"] if with_utpr else []))


def local_to_parent_display(local_companies: DataFrame) -> DataFrame:
    """Local company, parent and the parent's country with its state in brackets."""
    state = F.coalesce(F.concat(F.lit(" ("), F.col("parent_state"), F.lit(")")), F.lit(""))
    return local_companies.orderBy("parent_company_name", "local_corp_name", "company_number").select(
        "local_corp_name",
        "parent_company_name",
        F.concat(F.col("parent_country_iso_code"), state).alias("parent_country_state"),
    )


def ranked_group_table(local_companies: DataFrame) -> DataFrame:
    """Groups ranked by revenue, their local companies numbered by name; missing values first."""
    revenue = "filial_operating_revenue_max"
    # Range partitioning samples its input first: store it instead of computing it several times.
    local_companies = materialize(local_companies, "local-companies")
    groups = local_companies.select("parent_id", revenue).distinct()
    ranks = spread_row_number(groups, [F.desc_nulls_first(revenue), F.asc("parent_id")], "parent_rank")
    numbered = spread_row_number(
        local_companies,
        [F.asc_nulls_first("local_corp_name"), F.asc("company_number"), F.asc("parent_company_name")],
        "local_row_number",
        partition_by=["parent_id"],
    )
    return (
        numbered.join(ranks.select("parent_id", "parent_rank"), "parent_id", "left")
        .orderBy("parent_rank", "local_row_number")
        .select(
            F.col("parent_rank").alias("Número de matriz"),
            F.col("local_row_number").alias("Número de filial puertorriqueña"),
            F.col("parent_id").alias("ID de matriz"),
            F.col("parent_company_name").alias("Nombre de matriz"),
            F.col("parent_country_iso_code").alias("País de matriz"),
            F.col("parent_state").alias("Estado de matriz"),
            F.col(revenue).alias("Ingresos máximos de matriz (EUR miles)"),
            F.col("company_number").alias("ID de compañía de PR"),
            F.col("local_corp_name").alias("Nombre de filial puertorriqueña"),
        )
    )
