"""Revenue panels: merging batches, thresholds, qualified groups, minimum-tax arithmetic."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grouptrace.functions.text import strip_leading_chars, trim_spaces
from grouptrace.functions.values import (
    REVENUE_THRESHOLD_TH,
    exact_sum,
    known_count,
    money_millions,
    over_count,
    percent,
    whole_number,
)
from grouptrace.operators.joins import left_join_fanout, semi_join
from grouptrace.operators.ranking import dense_row_id
from grouptrace.operators.reshape import matching_columns, move_first, transpose_panel
from grouptrace.session import materialize

OWN_ID_CHARS = "pr/"


def merge_search_batches(search: DataFrame, ordinal: str) -> DataFrame:
    """Search batches as one table with a 1-based row number in file order."""
    return dense_row_id(search, "file_name", ordinal, "row_number").drop(ordinal)


def merge_data_batches(data: DataFrame, search: DataFrame) -> DataFrame:
    """Data batches with the caller's own id attached by matched id; several own ids keep several rows."""
    pairs = search.select(F.col("matched_company_id").alias("company_id"), "own_id").dropna(subset=["company_id"])
    # The join reads its left side three times.
    joined = left_join_fanout(materialize(data, "data-batches"), pairs, ["company_id"])
    return move_first(joined, "file_name", "own_id")


def revenue_in_thousands(batch: DataFrame, thousands_pattern: str, nominal_pattern: str, suffix: str) -> DataFrame:
    """The batch with revenue in thousands alone, so that one unit goes on from here.

    Nominal columns ``x`` become ``x + suffix`` where the batch has no thousands columns, and go otherwise. A batch with
    neither kind is an error.
    """
    thousands = matching_columns(batch, thousands_pattern)
    nominal = [c for c in matching_columns(batch, nominal_pattern) if c not in thousands]
    if thousands:
        return batch.drop(*nominal)
    if not nominal:
        raise ValueError("the batch has no revenue columns in EUR")
    return batch.select(*[
        (F.col(c) / 1e3).cast("double").alias(c + suffix) if c in nominal else F.col(c) for c in batch.columns
    ])


def consistent_threshold(
    batch: DataFrame,
    last: str = "operating_revenue_year_last_eur_th",
    yearly_pattern: str = r"^operating_revenue_year_\d_eur_th$",
    threshold: float = REVENUE_THRESHOLD_TH,
    min_years: int = 2,
) -> DataFrame:
    """Companies at or over the threshold in at least two of the prior years; with fewer than two known
    years the last available value decides. Revenue is in thousands, as revenue_in_thousands() leaves it."""
    yearly = F.array(*matching_columns(batch, yearly_pattern))
    available, over = known_count(yearly), over_count(yearly, threshold, inclusive=True)
    by_last = F.coalesce(F.col(last) >= threshold, F.lit(False))
    return (
        batch.withColumn("operating_revenue_yearly_values", yearly)
        .withColumn("operating_revenue_num_years_available", available)
        .withColumn("operating_revenue_num_years_over_threshold", over)
        .withColumn(
            "operating_revenue_over_threshold",
            F.when(available >= min_years, over >= min_years).otherwise(by_last),
        )
        .filter("operating_revenue_over_threshold")
    )


def any_year_worksheet(
    panel: DataFrame, values: Sequence[str], threshold: float = REVENUE_THRESHOLD_TH
) -> DataFrame:
    """Per row: known values, their maximum, and whether any value exceeds the threshold."""
    revenue = F.array(*[F.col(c).cast("double") for c in values])
    known = known_count(revenue)
    return panel.select(
        "company_id",
        "parent_id",
        known.alias("num_years_available"),
        (known == 0).alias("no_revenue_data"),
        F.array_max(revenue).alias("operating_revenue_max"),
        (over_count(revenue, threshold, inclusive=False) > 0).alias("qualified"),
    )


def qualified_groups(worksheet: DataFrame) -> DataFrame:
    """Highest revenue per global parent over its qualifying members."""
    return (
        worksheet.filter("qualified")
        .groupBy("parent_id")
        .agg(F.max("operating_revenue_max").alias("filial_operating_revenue_max"))
    )


def qualified_local_companies(groups: DataFrame, panel: DataFrame, chars: str = OWN_ID_CHARS) -> DataFrame:
    """Local ids of every member of a qualified group, leading prefix characters stripped.

    A group without a parent id matches no panel row and leaves one NULL id, as a left join does.
    """
    members = semi_join(panel.select("parent_id", "own_id"), groups, ["parent_id"]).select("own_id")
    unknown = groups.filter(F.col("parent_id").isNull()).select(F.lit(None).cast("string").alias("own_id"))
    ids = members.unionByName(unknown)
    return ids.select(strip_leading_chars(F.col("own_id"), chars).alias("company_number")).distinct()


def company_details(documents: DataFrame) -> DataFrame:
    """Third-party company documents as flat rows; absent structs give false, an absent list gives NULL."""
    company = "results.company"
    present = {
        "has_home_company": "home_company",
        "has_controlling_entity": "controlling_entity",
        "has_ultimate_controlling_company": "ultimate_controlling_company",
    }
    owners = F.col(f"{company}.ultimate_beneficial_owners")
    return documents.select(
        *[
            F.col(f"{company}.{c}").alias(c)
            for c in ("company_number", "name", "jurisdiction_code", "branch")
        ],
        F.col(f"{company}.registered_address.locality").alias("locality"),
        F.col(f"{company}.number_of_employees").alias("number_of_employees"),
        *[
            F.col(f"{company}.home_company.{c}").alias(f"home_company_{c}")
            for c in ("name", "jurisdiction_code", "company_number")
        ],
        *[F.col(f"{company}.{c}").isNotNull().alias(flag) for flag, c in present.items()],
        F.when(owners.isNotNull(), F.size(owners) > 0).alias("has_ultimate_beneficial_owners"),
    )


def local_search_sheet(
    local_ids: DataFrame, details: DataFrame, panel: DataFrame, country_code: str = "US"
) -> DataFrame:
    """What to look up for the qualified local companies: name, place, country, and the parent's id."""
    wanted = details.select(
        "company_number",
        "name",
        "jurisdiction_code",
        F.replace(trim_spaces(F.col("locality")), F.lit(","), F.lit("")).alias("locality"),
    )
    # Documents are stored one per company.
    known = local_ids.join(wanted.withColumn("_known", F.col("company_number")), "company_number", "left")
    # The number shown is the document's, so it is NULL where no document was found.
    sheet = known.select(
        F.col("_known").alias("company_number"),
        "name",
        "jurisdiction_code",
        "locality",
        F.lit(country_code).alias("country_code"),
        F.upper("locality").alias("locality_upper_case"),
    )
    parents = panel.select(strip_leading_chars(F.col("own_id"), OWN_ID_CHARS).alias("company_number"), "parent_id")
    return sheet.join(parents, "company_number", "left").select(*sheet.columns, "parent_id")


MINIMUM_TAX_RATE, ASSET_SHARE, PAYROLL_SHARE = 0.15, 0.08, 0.10


def minimum_tax_panel(
    totals: DataFrame,
    rate: float = MINIMUM_TAX_RATE,
    asset_share: float = ASSET_SHARE,
    payroll_share: float = PAYROLL_SHARE,
) -> DataFrame:
    """Income exclusion, tax base, excess profit, effective rate, top-up rate and minimum tax per period."""
    return (
        totals.withColumn("SBIE", F.col("ASSETS") * asset_share + F.col("PAYROLL") * payroll_share)
        .withColumn("TAX_BASE", F.col("PROFIT") - F.col("SBIE"))
        .withColumn("EXCESS_PROFIT", F.col("TOT_REV") - F.col("SBIE"))
        .withColumn("ETR", F.try_divide("TAX_ACCRUED", "PROFIT"))
        .withColumn("TTR", F.lit(rate) - F.col("ETR"))
        .withColumn("QDMTT", F.col("TTR") * F.col("TAX_BASE"))
        .select(*totals.columns, "TAX_BASE", "SBIE", "EXCESS_PROFIT", "ETR", "TTR", "QDMTT")
    )


COUNTS = ("EMPLOYEES", "ENTITIES_COUNT")
RATES = ("ETR", "TTR")


def minimum_tax_display(panel: DataFrame, periods: Sequence[int], period: str = "time_period") -> DataFrame:
    """The panel turned round and written as text: one row per indicator, one column per period."""
    indicators = [c for c in panel.columns if c != period]
    texts = []
    for c in indicators:
        shown = whole_number if c in COUNTS else percent if c in RATES else money_millions
        texts.append(shown(F.col(c)).alias(c))
    shown_panel = panel.select(F.col(period).cast("string").alias(period), *texts)
    return transpose_panel(shown_panel, period, [str(p) for p in periods], indicators)


def totals_by(facts: DataFrame, dimensions: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Sums of chosen variables by year, region or country."""
    return facts.groupBy(*dimensions).agg(*[exact_sum(F.col(v)).alias(v) for v in variables])


def add_partial_totals(
    facts: DataFrame, path: str, batch: int, dimensions: Sequence[str], variables: Sequence[str]
) -> None:
    """Store a batch's exact sums by all dimensions together. A repeated batch replaces itself."""
    sums = [F.sum(F.col(v).cast("decimal(38,9)")).alias(v) for v in variables]
    facts.groupBy(*dimensions).agg(*sums).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def totals_all(partials: DataFrame, dimensions: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Sums by every choice of the dimensions, none and all included, in one pass over facts or stored partial sums.

    ``level`` tells which dimensions are summed over, as Spark's grouping id: bit 0 for the last one. There a dimension is
    NULL; elsewhere NULL is a value of its own.
    """
    sums = [F.sum(F.col(v).cast("decimal(38,9)")).cast("double").alias(v) for v in variables]
    return partials.cube(*dimensions).agg(F.grouping_id().cast("int").alias("level"), *sums)


def year_columns(df: DataFrame, pattern: str = r"_year_(\d{4})_") -> list[str]:
    """Columns of single years, latest first."""
    found = [(int(m[1]), c) for c in df.columns if (m := re.search(pattern, c))]
    return [c for _, c in sorted(found, reverse=True)]
