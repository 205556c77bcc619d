"""The registered queries: each Spark job next to the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchset.derived import REVENUE_COLUMNS, YEARS, Inputs, with_views
from grouptrace.functions.text import normalize_name
from grouptrace.functions.values import ISO_SECONDS_PATTERN
from grouptrace.operators import joins, name_index, ranking, reshape, sampling, search, tables
from grouptrace.plans import matching, network, panel, present, registry
from grouptrace.session import apply_runtime_conf, freed_shuffles, materialize, work_path
from grouptrace.sources import readers, schemas, sinks
from grouptrace.streaming import documents, ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ANY_YEAR_THRESHOLD, CONSISTENT_THRESHOLD = 1_200_000.0, 600_000.0
LINK = "https://registry.example/entity?c="
PANEL_VALUES = [*REVENUE_COLUMNS, "rev_last", "parent_rev"]

Job = Callable[[Inputs], DataFrame]


_INPUTS: dict[tuple, Inputs] = {}


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """The views over one folder, defined once per session."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _INPUTS:
        _INPUTS[key] = Inputs(apply_runtime_conf(spark), sf_dir)
    return _INPUTS[key]


def register(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def add(job: Job) -> Job:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return job(inputs(spark, sf_dir))

        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return job

    return add


def text_time(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


def joined_list(col: str) -> Column:
    return F.array_join(col, ",").alias(col)


# Text fragments shared by several SQL texts -----------------------------------------------------

NAME_KEY = "strip_accents(replace(replace(rtrim(ltrim(lower(nfc_normalize({0})))), '.', ''), ',', ''))"
_LIST = "[" + ", ".join(PANEL_VALUES) + "]"
WORKSHEET = f"""
    select company_id, parent_id, cast(len(list_filter({_LIST}, lambda d: d is not null)) as int)
            as num_years_available,
        len(list_filter({_LIST}, lambda d: d is not null)) = 0 as no_revenue_data,
        list_max({_LIST}) as operating_revenue_max,
        len(list_filter({_LIST}, lambda d: d > {ANY_YEAR_THRESHOLD})) > 0 as qualified
    from {{revenue_wide}}"""
GROUPS = f"""
    select parent_id, max(operating_revenue_max) as filial_operating_revenue_max
    from ({WORKSHEET}) where qualified group by parent_id"""
ENTITIES = """
    select registration_index, corp_name, status_id, status_es, min(record_id) as record_id
    from {registry} group by all"""
DETAILED = """
    select registration_index, corp_name, status_id, status_es, class_es, class_en, profit_type_es,
        min(record_id) as record_id
    from {registry} group by all"""


# Thresholds and panels --------------------------------------------------------------------------

def worksheet(t: Inputs) -> DataFrame:
    return panel.any_year_worksheet(t["revenue_wide"], PANEL_VALUES, ANY_YEAR_THRESHOLD)


@register("qualified_groups", GROUPS)
def qualified_groups(t: Inputs) -> DataFrame:
    return panel.qualified_groups(worksheet(t))


register("any_year_worksheet", WORKSHEET)(worksheet)

CONSISTENT = f"""
    select *, from_yearly >= 2 as unused from (
        select b.*,
            cast(len(list_filter([operating_revenue_year_1_eur_th, operating_revenue_year_2_eur_th,
                operating_revenue_year_3_eur_th, operating_revenue_year_4_eur_th], lambda v: v is not null)) as int)
                as operating_revenue_num_years_available,
            cast(len(list_filter([operating_revenue_year_1_eur_th, operating_revenue_year_2_eur_th,
                operating_revenue_year_3_eur_th, operating_revenue_year_4_eur_th],
                lambda v: v >= {CONSISTENT_THRESHOLD})) as int)
                as operating_revenue_num_years_over_threshold,
            operating_revenue_num_years_over_threshold as from_yearly
        from {{yearly_batch}} b)
    where case when operating_revenue_num_years_available >= 2
        then operating_revenue_num_years_over_threshold >= 2
        else coalesce(operating_revenue_year_last_eur_th >= {CONSISTENT_THRESHOLD}, false) end"""


@register("consistent_threshold", f"""
    select * exclude (unused, from_yearly), true as operating_revenue_over_threshold from ({CONSISTENT})""")
def consistent_threshold(t: Inputs) -> DataFrame:
    passed = panel.consistent_threshold(t["yearly_batch"], threshold=CONSISTENT_THRESHOLD)
    return passed.drop("operating_revenue_yearly_values")


@register("qualified_local_companies", f"""
    select distinct ltrim(own_id, 'pr/') as company_number
    from ({GROUPS}) g left join {{revenue_wide}} p using (parent_id)""")
def qualified_local_companies(t: Inputs) -> DataFrame:
    revenue = materialize(t["revenue_wide"], "revenue")
    groups = panel.qualified_groups(panel.any_year_worksheet(revenue, PANEL_VALUES, ANY_YEAR_THRESHOLD))
    return panel.qualified_local_companies(groups, revenue)


_UNITS = ", ".join(f"operating_revenue_year_{y}_eur / 1e3 as operating_revenue_year_{y}_eur_th" for y in ("last", 1, 2, 3, 4))
THOUSANDS = f"select file_name, company_id, {_UNITS} from {{nominal_batch}}"


@register("unit_branch", THOUSANDS)
def unit_branch(t: Inputs) -> DataFrame:
    return panel.revenue_in_thousands(t["nominal_batch"], "_eur_th$", "_eur$", "_th")


@register("consistent_threshold_nominal", f"""
    select *, cast(len(list_filter(ys, lambda v: v is not null)) as int) as operating_revenue_num_years_available,
        cast(len(list_filter(ys, lambda v: v >= {CONSISTENT_THRESHOLD})) as int)
            as operating_revenue_num_years_over_threshold, true as operating_revenue_over_threshold
    from (select *, [operating_revenue_year_1_eur_th, operating_revenue_year_2_eur_th,
        operating_revenue_year_3_eur_th, operating_revenue_year_4_eur_th] as ys from ({THOUSANDS}))
    where case when len(list_filter(ys, lambda v: v is not null)) >= 2
        then len(list_filter(ys, lambda v: v >= {CONSISTENT_THRESHOLD})) >= 2
        else coalesce(operating_revenue_year_last_eur_th >= {CONSISTENT_THRESHOLD}, false) end""".replace("select *, cast", "select * exclude (ys), cast", 1))
def consistent_threshold_nominal(t: Inputs) -> DataFrame:
    passed = panel.consistent_threshold(unit_branch(t), threshold=CONSISTENT_THRESHOLD)
    return passed.drop("operating_revenue_yearly_values")


@register("merge_batches", """
    select d.file_name, s.own_id, d.* exclude (file_name)
    from {data_batches} d left join (
        select matched_company_id, own_id from {search_batches} where matched_company_id is not null) s
    on d.company_id = s.matched_company_id""")
def merge_batches(t: Inputs) -> DataFrame:
    return panel.merge_data_batches(t["data_batches"], t["search_batches"])


@register("merge_search_batches", """
    select row_number() over (order by file_name, row_in_file) as row_number, * exclude (row_in_file)
    from {search_batches}""")
def merge_search_batches(t: Inputs) -> DataFrame:
    return panel.merge_search_batches(t["search_batches"], "row_in_file")


CATALOG = r"""
    select *, cast(query_num_start as string) || '-' || cast(query_num_end as string) as query_range from (
        select file_path, parse_filename(file_path) as file_name,
            regexp_extract(file_name, '\((\w+) with [^)]*\) (\d+)-(\d+)', 1) as dataset_type,
            cast(regexp_extract(file_name, '\((\w+) with [^)]*\) (\d+)-(\d+)', 2) as int) as query_num_start,
            cast(regexp_extract(file_name, '\((\w+) with [^)]*\) (\d+)-(\d+)', 3) as int) as query_num_end
        from {batch_files})
    where not starts_with(file_name, '~$')"""


@register("batch_catalog", CATALOG)
def batch_catalog(t: Inputs) -> DataFrame:
    return readers.batch_catalog(t["batch_files"])


@register("batch_query_ranges", f"""
    select query_range, query_num_start, row_number() over (order by query_num_start) as position
    from (select distinct query_range, query_num_start from ({CATALOG}))""")
def batch_query_ranges(t: Inputs) -> DataFrame:
    return readers.query_ranges(batch_catalog(t))


@register("batch_query_range_list", f"""
    select string_agg(query_range, ',' order by query_num_start) as query_ranges, count(*) as ranges
    from (select distinct query_range, query_num_start from ({CATALOG}))""")
def batch_query_range_list(t: Inputs) -> DataFrame:
    listed = readers.query_range_list(batch_catalog(t))
    return listed.select(joined_list("query_ranges"), F.size("query_ranges").cast("long").alias("ranges"))


@register("null_tokens", """
    select company_id, try_cast(nullif(nullif(rev_2001, 'n.a.'), '#N/A') as double) as rev_2001,
        try_cast(nullif(nullif(rev_2000, 'n.a.'), '#N/A') as double) as rev_2000,
        nullif(country_code, 'n.a.') as country_code
    from {revenue_text}""")
def null_tokens(t: Inputs) -> DataFrame:
    return readers.clean_tokens(t["revenue_text"], {"rev_2001": "double", "rev_2000": "double"})


@register("positional_ids", """
    select company_id, cast(first_number as string) as batch, row_in_file, company_name from {batch_numbers}""")
def positional_ids(t: Inputs) -> DataFrame:
    rows = t["batch_numbers"].select(F.col("first_number").cast("string").alias("batch"), "row_in_file", "company_name", "company_id")
    # One id list per batch; a gap in the keys keeps its place as an empty id.
    placed = rows.groupBy("batch").agg(F.collect_list(F.struct("row_in_file", "company_id")).alias("_ids"))
    by_place = F.map_from_entries("_ids")
    ids = F.array_join(
        F.transform(F.sequence(F.lit(1).cast("bigint"), F.array_max(F.map_keys(by_place))), lambda i: F.coalesce(F.try_element_at(by_place, i), F.lit(""))), ", "
    )
    lists = placed.select("batch", ids.alias("ids"))
    return readers.attach_positional_ids(rows.drop("company_id"), lists, "batch", "row_in_file", "ids", "company_id")


def company_document_text(t: Inputs) -> DataFrame:
    name_if = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("name")))
    owner = F.struct(F.lit("Owner").alias("name"))
    company = F.struct(
        "company_number", "name", "jurisdiction_code", "branch",
        F.struct("locality").alias("registered_address"), "number_of_employees",
        F.when(
            F.col("home_company_name").isNotNull(),
            F.struct(
                F.col("home_company_name").alias("name"), F.lit("us_de").alias("jurisdiction_code"),
                F.col("company_number").alias("company_number"),
            ),
        ).alias("home_company"),
        name_if("ultimate_controlling_company").alias("ultimate_controlling_company"),
        name_if("controlling_entity").alias("controlling_entity"),
        F.when(F.col("owners") == 0, F.array().cast("array<struct<name:string>>"))
        .when(F.col("owners") == 1, F.array(owner))
        .alias("ultimate_beneficial_owners"),
    )
    return t["company_flat"].select(F.to_json(F.struct(F.struct(company.alias("company")).alias("results"))).alias("value"))


def company_documents(t: Inputs) -> DataFrame:
    path = t.landed("company-documents", lambda: company_document_text(t))
    return readers.read_json_documents(t.spark, path, schemas.COMPANY_DOCUMENT)


@register("company_details", """
    select company_number, name, jurisdiction_code, branch, locality, number_of_employees, home_company_name,
        case when home_company_name is not null then 'us_de' end as home_company_jurisdiction_code,
        case when home_company_name is not null then company_number end as home_company_company_number,
        home_company_name is not null as has_home_company, controlling_entity is not null as has_controlling_entity,
        ultimate_controlling_company is not null as has_ultimate_controlling_company,
        case owners when 0 then false when 1 then true end as has_ultimate_beneficial_owners
    from {company_flat}""")
def company_details(t: Inputs) -> DataFrame:
    return panel.company_details(company_documents(t))


@register("local_search_sheet", """
    select q.*, 'US' as country_code, upper(q.locality) as locality_upper_case, p.parent_id
    from (select c.company_number, name, jurisdiction_code, replace(trim(locality), ',', '') as locality
          from {sheet_ids} i left join {company_flat} c on i.company_number = c.company_number) q
    left join {revenue_wide} p on q.company_number = ltrim(p.own_id, 'pr/')""")
def local_search_sheet(t: Inputs) -> DataFrame:
    return panel.local_search_sheet(t["sheet_ids"], company_details(t), t["revenue_wide"])


MINIMUM_TAX = """
    select *, ttr * tax_base as QDMTT from (
        select *, cast(0.15 as double) - etr as TTR from (
            select *, profit - sbie as TAX_BASE, tot_rev - sbie as EXCESS_PROFIT, tax_accrued / profit as ETR from (
                select *, assets * cast(0.08 as double) + payroll * cast(0.1 as double) as SBIE
                from {yearly_totals})))"""


@register("minimum_tax_panel", MINIMUM_TAX)
def minimum_tax_panel(t: Inputs) -> DataFrame:
    return panel.minimum_tax_panel(t["yearly_totals"])


_INDICATORS = [
    "TOT_REV", "PROFIT", "TAX_ACCRUED", "EMPLOYEES", "ENTITIES_COUNT", "ASSETS", "EARNINGS", "PAYROLL",
    "TAX_BASE", "SBIE", "EXCESS_PROFIT", "ETR", "TTR", "QDMTT",
]


def _shown(c: str) -> str:
    if c in panel.COUNTS:
        return f"format('{{{{:,}}}}', cast({c} as bigint))"
    if c in panel.RATES:
        return f"format('{{{{:,.2f}}}}', round({c} * 100, 2)) || '%'"
    return f"'$' || regexp_replace(format('{{{{:,.1f}}}}', round({c} / 1e6, 1)), '\\.0$', '.') || 'M'"


@register("minimum_tax_display", "\nunion all\n".join(
    f"select '{c}' as indicator, "
    + ", ".join(f"max(case when time_period = {y} then {_shown(c)} end) as \"{y}\"" for y in YEARS)
    + f" from ({MINIMUM_TAX})"
    for c in _INDICATORS
))
def minimum_tax_display(t: Inputs) -> DataFrame:
    return panel.minimum_tax_display(minimum_tax_panel(t), list(YEARS))


def _totals_sql(dimensions: str) -> str:
    return f"""
    select {dimensions}, cast(sum(cents) as double) / 100 as TOT_REV, cast(sum(profit) as double) / 10000 as PROFIT,
        cast(sum(tax) as double) / 10000 as TAX_ACCRUED
    from {{country_year_money}} group by {dimensions}"""


def _totals(*dimensions: str) -> Job:
    return lambda t: panel.totals_by(t["country_year_totals"], dimensions, ["TOT_REV", "PROFIT", "TAX_ACCRUED"])


register("totals_by_year", _totals_sql("yr"))(_totals("yr"))
register("totals_by_region", _totals_sql("region"))(_totals("region"))
register("totals_by_country", _totals_sql("country"))(_totals("country"))
register("totals_by_country_year", _totals_sql("country, yr"))(_totals("country", "yr"))


_DIMENSIONS, _VARIABLES = ["yr", "region", "country"], ["TOT_REV", "PROFIT", "TAX_ACCRUED"]


@register("totals_all", """
    select yr, region, country, cast(grouping(yr, region, country) as int) as level,
        cast(sum(cents) as double) / 100 as TOT_REV, cast(sum(profit) as double) / 10000 as PROFIT,
        cast(sum(tax) as double) / 10000 as TAX_ACCRUED
    from {country_year_money} group by cube (yr, region, country)""")
def totals_all(t: Inputs) -> DataFrame:
    """All choices of dimensions at once, from partial sums to which the years are added in two batches."""
    path = work_path(t.spark, "partial-totals")
    facts = materialize(t["country_year_totals"], "totals")
    for batch in (0, 1):
        panel.add_partial_totals(facts.filter(F.col("yr") % 2 == batch), path, batch, _DIMENSIONS, _VARIABLES)
    return panel.totals_all(t.spark.read.parquet(path).drop("batch"), _DIMENSIONS, _VARIABLES)


# Networks and rule status -----------------------------------------------------------------------

@register("network_profile", """
    select count(*) as num_rows, count(distinct company_id) as num_unique_companies,
        count(distinct company_id) filter (state = 'PR') as num_unique_companies_with_local_state,
        count(distinct parent_id) as num_unique_parents,
        count(distinct parent_id) filter (state = 'PR') as num_unique_parents_with_local_state
    from {network}""")
def network_profile(t: Inputs) -> DataFrame:
    return network.network_profile(t["network"])


@register("network_profile_incremental", ORACLE["network_profile"])
def network_profile_incremental(t: Inputs) -> DataFrame:
    """Rows that come in two batches, of which the second one comes twice."""
    path = work_path(t.spark, "profile")
    odd = F.col("row_number") % 2 == 1
    for batch, part in ((0, odd), (1, ~odd), (1, ~odd)):
        network.add_profile_batch(t["network"].filter(part), path, batch)
    return network.stored_profile(t.spark, path)


COUNTRIES = """
    select c.*, s.country as country_es from {countries} c left join {spanish_names} s on c."alpha-2" = s.code"""
ADOPTION = """
    select c."alpha-2" as country_code, a.country, cast(a.year as int) as year, pillar2, iir, utpr, qdmtt
    from {adoption} a left join {countries} c on a.country = c.country where a.country is not null"""
TAX = "select *, case when state = 'PR' then 'PR' else country_iso_code end as tax_country from {network}"
PARENT_TAX = f"""
    select c.*, p.tax_country as parent_tax_country
    from ({TAX}) c left join ({TAX}) p on c.parent_id = p.company_id where c.parent_id is not null"""
SUBSIDIARIES = f"""
    select parent_id, parent_tax_country, list_sort(list(distinct tax_country) filter (
        company_id <> parent_id and branch_indicator = 'No' and tax_country <> parent_tax_country))
        as foreign_tax_countries
    from ({PARENT_TAX}) group by all"""
RULE_YEARS = f"""
    select parent_id, parent_tax_country, year,
        len(list_filter(list(case utpr when 'Yes' then true when 'No' then false end), lambda x: x)) > 0
            as parent_subject_to_rule
    from (select parent_id, parent_tax_country, unnest(foreign_tax_countries) as code
          from ({SUBSIDIARIES}) where foreign_tax_countries is not null) s
    join ({ADOPTION}) a on s.code = a.country_code
    where year is not null group by all
    union all
    select parent_id, parent_tax_country, unnest([2024, 2025, 2026]) as year, false
    from ({SUBSIDIARIES}) where foreign_tax_countries is null"""
LOCAL_PARENTS = """
    select i.company_number, e.corp_name as local_corp_name, p.parent_id, n.company_name as parent_company_name,
        n.country_iso_code as parent_country_iso_code, n.state as parent_state, g.filial_operating_revenue_max
    from {local_ids} i left join {local_panel} p on i.company_number = ltrim(p.own_id, 'pr/')
    left join {local_entities} e on i.company_number = e.registration_index
    left join {network} n on p.parent_id = n.company_id
    left join {group_revenue} g on p.parent_id = g.parent_id
    where n.company_id is not null"""
STATUS = f"""
    select c.parent_id, c.parent_company_name, c.num_local_companies, c.parent_tax_country,
        a.country as parent_country, a.year, a.pillar2, a.iir, a.qdmtt,
        case when r.parent_subject_to_rule then 'Yes' when not r.parent_subject_to_rule then 'No' end as utpr,
        g.filial_operating_revenue_max
    from (select parent_id, parent_company_name,
            case when parent_state = 'PR' then 'PR' else parent_country_iso_code end as parent_tax_country,
            count(distinct company_number) as num_local_companies
          from ({LOCAL_PARENTS}) group by all) c
    left join ({ADOPTION}) a on c.parent_tax_country = a.country_code
    left join {{group_revenue}} g on c.parent_id = g.parent_id
    left join ({RULE_YEARS}) r on c.parent_id = r.parent_id and a.year = r.year"""
SUMMARY = f"""
    select parent_tax_country, parent_country, year, count(*) as num_parents,
        cast(sum(num_local_companies) as int) as num_local_companies, max(qdmtt) as qdmtt, max(iir) as iir,
        count(*) filter (qdmtt = 'Yes') as num_parents_with_qdmtt,
        count(*) filter (iir = 'Yes') as num_parents_with_iir, count(*) filter (utpr = 'Yes') as num_parents_with_utpr,
        cast(sum(cast(filial_operating_revenue_max as decimal(18,2))) as double) as total_revenue,
        cast(sum(cast(filial_operating_revenue_max as decimal(18,2))) filter (utpr = 'Yes') as double)
            as total_revenue_with_utpr
    from ({STATUS}) group by all"""


@register("country_dimension", COUNTRIES)
def country_dimension(t: Inputs) -> DataFrame:
    return network.country_dimension(t["countries"], t["spanish_names"])


@register("rule_adoption", ADOPTION)
def rule_adoption(t: Inputs) -> DataFrame:
    return network.rule_adoption(t["adoption"], t["countries"])


@register("tax_country", PARENT_TAX)
def tax_country(t: Inputs) -> DataFrame:
    return network.with_parent_tax_country(t["network"])


def _subsidiaries(t: Inputs) -> DataFrame:
    return network.foreign_subsidiary_countries(t["network"])


@register("foreign_subsidiary_countries", f"""
    select parent_id, parent_tax_country, array_to_string(foreign_tax_countries, ',') as foreign_tax_countries
    from ({SUBSIDIARIES})""")
def foreign_subsidiary_countries(t: Inputs) -> DataFrame:
    return _subsidiaries(t).withColumn("foreign_tax_countries", joined_list("foreign_tax_countries"))


def _rule_years(t: Inputs) -> DataFrame:
    return network.subject_to_rule_by_year(_subsidiaries(t), rule_adoption(t))


@register("subject_to_rule_by_year", RULE_YEARS)
def subject_to_rule_by_year(t: Inputs) -> DataFrame:
    return _rule_years(t).orderBy("parent_id", "year")


@register("local_to_parent", LOCAL_PARENTS)
def local_to_parent(t: Inputs) -> DataFrame:
    return network.local_to_parent(
        t["local_ids"], t["local_panel"], t["local_entities"], t["network"], t["group_revenue"]
    )


@register("local_to_parent_display", f"""
    select local_corp_name, parent_company_name,
        parent_country_iso_code || coalesce(' (' || parent_state || ')', '') as parent_country_state
    from ({LOCAL_PARENTS})""")
def local_to_parent_display(t: Inputs) -> DataFrame:
    return present.local_to_parent_display(local_to_parent(t))


@register("group_rule_status", STATUS)
def group_rule_status(t: Inputs) -> DataFrame:
    local, answers = materialize(local_to_parent(t), "local"), materialize(_rule_years(t), "answers")
    return network.group_rule_status(local, rule_adoption(t), t["group_revenue"], answers)


@register("group_rule_status_bucketed", STATUS)
def group_rule_status_bucketed(t: Inputs) -> DataFrame:
    """The same from inputs that are stored once in buckets of parents, for this and all further reports."""
    local, revenue, answers = network.stored_by_parent(local_to_parent(t), t["group_revenue"], _rule_years(t), 8)
    return network.group_rule_status_by_parent(local, rule_adoption(t), revenue, answers)


@register("country_rule_summary", SUMMARY)
def country_rule_summary(t: Inputs) -> DataFrame:
    return network.country_rule_summary(group_rule_status(t))


def _flag(c: str) -> str:
    return f"case when {c} = 'Yes' then 'Sí' when {c} = 'No' then 'No' end"


_BASE_SQL = f"""parent_country as "{present.COUNTRY}", country_es as "{present.PAIS}", num_parents as "{present.PARENTS}",
        num_local_companies as "{present.LOCALS}\""""


def _register_displays(year: int, utpr: bool) -> None:
    count = f', num_parents_with_utpr as "{present.WITH_UTPR}"' if utpr else ""
    share = f', total_revenue_with_utpr / 1e3 as "{present.REVENUE_WITH_UTPR}"' if utpr else ""
    source = f'from ({SUMMARY}) s left join ({COUNTRIES}) c on s.parent_tax_country = c."alpha-2" where year = {year}'
    register(f"country_rule_display_{year}", f"""
    select {_BASE_SQL}, qdmtt as "QDMTT (Yes/No)", iir as "IIR (Yes/No)", {_flag("qdmtt")} as "QDMTT (Sí/No)",
        {_flag("iir")} as "IIR (Sí/No)"{count}
    {source}""")(lambda t: present.country_rule_display(country_rule_summary(t), country_dimension(t), year, utpr))
    register(f"country_revenue_display_{year}", f"""
    select {_BASE_SQL}{count}, total_revenue / 1e3 as "{present.REVENUE}"{share}
    {source}""")(lambda t: present.country_revenue_display(country_rule_summary(t), country_dimension(t), year, utpr))
    register(f"group_rule_display_{year}", f"""
    select parent_company_name, num_local_companies, parent_tax_country, iir, qdmtt{", utpr" if utpr else ""}
    from ({STATUS}) where year = {year}""")(lambda t: present.group_rule_display(group_rule_status(t), year, utpr))


_register_displays(2024, False)
_register_displays(2025, True)


@register("ranked_group_table", f"""
    select parent_rank as "Número de matriz",
        row_number() over (partition by l.parent_id order by local_corp_name nulls first, company_number,
            parent_company_name) as "Número de filial puertorriqueña",
        l.parent_id as "ID de matriz", parent_company_name as "Nombre de matriz",
        parent_country_iso_code as "País de matriz", parent_state as "Estado de matriz",
        l.filial_operating_revenue_max as "Ingresos máximos de matriz (EUR miles)",
        company_number as "ID de compañía de PR", local_corp_name as "Nombre de filial puertorriqueña"
    from ({LOCAL_PARENTS}) l left join (
        select parent_id, row_number() over (order by filial_operating_revenue_max desc nulls first, parent_id)
            as parent_rank
        from (select distinct parent_id, filial_operating_revenue_max from ({LOCAL_PARENTS}))) r
    on l.parent_id = r.parent_id""")
def ranked_group_table(t: Inputs) -> DataFrame:
    return present.ranked_group_table(local_to_parent(t))


# Registry ---------------------------------------------------------------------------------------

@register("registry_entities", ENTITIES)
def registry_entities(t: Inputs) -> DataFrame:
    return registry.registry_entities(t["registry"]).orderBy("record_id")


def _detailed(t: Inputs) -> DataFrame:
    return registry.registry_entities(t["registry"], registry.ENTITY_DETAILED)


register("non_profits", f"select * from ({DETAILED}) where profit_type_es = 'Sin Fines' and status_es = 'ACTIVA'")(
    lambda t: registry.non_profits(_detailed(t)))
register("for_profits", f"select * from ({DETAILED}) where profit_type_es = 'Con Fines'")(
    lambda t: registry.for_profits(_detailed(t)))
register("coops", f"select * from ({ENTITIES}) where corp_name ilike '%coop%'")(
    lambda t: registry.cooperatives(registry.registry_entities(t["registry"])))


def entity_document_text(t: Inputs) -> DataFrame:
    """The detail documents as JSON text, one per row."""
    corporation = F.struct(
        F.col("corp_register_index").alias("corpRegisterIndex"), F.col("corp_name").alias("corpName"),
        F.col("jurisdiction").alias("jurisdictionEs"),
        F.col("jurisdiction_type").alias("corporationJurisdictionTypeId"), F.col("home_state").alias("homeState"),
        F.col("status").alias("statusEs"), F.lit("Corporation").alias("classEn"),
        F.col("date_effective").alias("effectiveDate"), F.col("date_formed").alias("dateFormed"),
        F.col("date_expiration").alias("expirationDate"), F.col("date_termination").alias("terminationDate"),
    )
    abroad = F.struct(F.col("foreign_city").alias("city"), "province")
    location = F.struct(
        F.when(F.col("foreign_city").isNotNull() | F.col("province").isNotNull(), abroad).alias("foreignDomicileAddress"),
        F.struct(F.col("local_city").alias("city")).alias("streetAddress"),
    )
    response = F.struct(corporation.alias("corporation"), location.alias("mainLocation"))
    return t["entity_flat"].select(F.to_json(F.struct(response.alias("response"))).alias("value"))


def entity_documents(t: Inputs) -> DataFrame:
    path = t.landed("entity-documents", lambda: entity_document_text(t))
    return readers.read_json_documents(t.spark, path, schemas.ENTITY_DOCUMENT)


def _foreign_sql(status: str) -> str:
    return f"""
    select corp_register_index as register_index, corp_name, jurisdiction, jurisdiction_type as jurisdiction_id,
        foreign_city, local_city, case when jurisdiction_type = 2 then coalesce(foreign_city, local_city) end as city,
        case when jurisdiction_type = 2 then 'United States' else coalesce(home_state, province) end as country_name,
        case when jurisdiction_type = 2 then 'US' end as country_code, status,
        '{LINK}' || corp_register_index as link
    from {{entity_flat}} where jurisdiction in ('Foránea', 'Foránea - No Estadounidense') and status = '{status}'"""


register("foreign_active", _foreign_sql("ACTIVA"))(
    lambda t: registry.foreign_entities(entity_documents(t), registry.ACTIVE, LINK))
register("foreign_merged", _foreign_sql("FUSIONADA"))(
    lambda t: registry.foreign_entities(entity_documents(t), registry.MERGED, LINK))

_PATTERN = ISO_SECONDS_PATTERN.replace("{4}", "{{4}}")


def _date_sql(c: str) -> str:
    return f"try_strptime(regexp_extract(replace({c}, '\"', ''), '{_PATTERN}'), '%Y-%m-%dT%H:%M:%S')"


_DATES = ["date_effective", "date_formed", "date_expiration", "date_termination"]
DATES = f"""
    select corp_register_index as registration_index, corp_name as corporation_name,
        {", ".join(f"{_date_sql(c)} as {c}" for c in _DATES)}
    from {{entity_flat}}"""


@register("detail_dates", f"""
    select registration_index, corporation_name,
        {", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {c}" for c in _DATES)}
    from ({DATES})""")
def detail_dates(t: Inputs) -> DataFrame:
    dates = registry.detail_dates(entity_documents(t))
    return dates.select("registration_index", "corporation_name", *[text_time(c) for c in _DATES])


@register("events_by_year", f"""
    select event_year, {", ".join(f"sum(n) filter (event_name = '{e}')::bigint as {e}" for e in registry.EVENTS)}
    from (select cast(year(event_date) as int) as event_year, event_name, count(*) as n
          from ({" union all ".join(
              f"select {c} as event_date, '{c[5:]}' as event_name, corporation_name from ({DATES})" for c in _DATES)})
          where event_date is not null and corporation_name ilike '%coop%' group by all)
    group by event_year""")
def events_by_year(t: Inputs) -> DataFrame:
    return registry.events_by_year(registry.detail_dates(entity_documents(t)))


_SAMPLED = "substr(md5('1:' || {0}), 1, 8) < '19999999'"
SAMPLE = f"""
    select i.registration_index, d.corp_register_index as register_index, d.corp_name, d.status,
        d.date_formed, d.date_expiration, d.date_termination, '{LINK}' || d.corp_register_index as link
    from {{entity_targets}} i left join {{entity_flat}} d on i.registration_index = d.corp_register_index
    where {_SAMPLED.format("i.registration_index")}"""


@register("detailed_sample", SAMPLE)
def detailed_sample(t: Inputs) -> DataFrame:
    return registry.detailed_sample(t["entity_targets"], entity_documents(t), LINK, fraction=0.1)


@register("system_sample", f"""
    select corp_register_index as registration_index, corp_name from {{entity_flat}}
    where {_SAMPLED.format("corp_register_index || '.json'")}""")
def system_sample(t: Inputs) -> DataFrame:
    """A sample of files: the documents of about a tenth of them; the others are not opened."""
    folder = t.document_folder(lambda: entity_document_text(t))
    documents = sampling.sample_files(readers.read_json_documents(t.spark, folder, schemas.ENTITY_DOCUMENT), 0.1)
    return documents.select(
        F.col("response.corporation.corpRegisterIndex").alias("registration_index"), F.col("response.corporation.corpName").alias("corp_name"))


register("sample_without_detail", f"select registration_index from ({SAMPLE}) where register_index is null")(
    lambda t: registry.sample_without_detail(detailed_sample(t)))
register("sample_fixed_n", """
    select * from {entity_targets} order by md5('1:' || registration_index), registration_index limit 20""")(
    lambda t: sampling.sample_rows(t["entity_targets"], "registration_index", 20))


@register("decree_list", """
    select row_number() over (order by law, decree_id) as decree_id, decree, grantee, approval_date from (
        select case when decree_id % 4 = 0 then 0 else 1 end as law,
            case when decree_id % 4 = 0 then 'Law A' else 'Law B' end as decree, decree_id, grantee,
            '2020-01-' || cast(10 + decree_id % 20 as string) as approval_date
        from {decree_texts})""")
def decree_list(t: Inputs) -> DataFrame:
    dated = t["decree_texts"].withColumn(
        "approval_date", F.concat(F.lit("2020-01-"), (10 + F.col("decree_id") % 20).cast("string"))
    )
    rows = dated.withColumnRenamed("decree_id", "position")
    laws = {"Law A": rows.filter("position % 4 = 0"), "Law B": rows.filter("position % 4 <> 0")}
    return registry.decree_list(laws, "position")


_EXCLUDE, _EXTRA = ["3-112", "6-112"], ["2-112", "2-112", "9-112", "1000000000-112"]


@register("pending_collection", f"""
    select registration_index, corp_name, status_es from (
        select registration_index, corp_name, status_es from {{entity_targets}}
        where corp_name ilike '%coop%' and registration_index not in ('3-112', '6-112')
        union all
        select x, null, null from (select distinct unnest({_EXTRA}) as x)
        where x not in (select registration_index from {{entity_targets}}
            where corp_name ilike '%coop%' and registration_index not in ('3-112', '6-112')))
    where registration_index not in (select corp_register_index from {{entity_flat}})""")
def pending_collection(t: Inputs) -> DataFrame:
    collected = t["entity_flat"].select(F.col("corp_register_index").alias("registration_index"))
    return registry.pending_collection(t["entity_targets"], collected, _EXCLUDE, _EXTRA)


@register("pending_related", f"""
    select register_index as registration_index, corp_name, status from ({_foreign_sql("FUSIONADA")})
    where register_index not in (select company_number from {{company_flat}})""")
def pending_related(t: Inputs) -> DataFrame:
    merged = registry.foreign_entities(entity_documents(t), registry.MERGED, LINK)
    return registry.pending_related(merged, t["company_flat"].select(F.col("company_number").alias("registration_index")))


_SEARCH_COLUMNS = "record_id, registration_number, registration_index, corp_name"
_KEY = NAME_KEY.format("corp_name")
_NAME_SEARCHES = {
    "begins_with": ("Red W", f"starts_with({_KEY}, 'red w')"),
    "exact": ("Cold Gear brand#21 inc", f"{_KEY} = 'cold gear brand#21 inc'"),
    "any_word": ("ring, coop.", f"list_has_any(string_split({_KEY}, ' '), ['ring', 'coop'])"),
    "all_words": ("inc. small", f"list_has_all(string_split({_KEY}, ' '), ['inc', 'small'])"),
}
for _name, (_text, _where) in _NAME_SEARCHES.items():
    register(f"name_search_{_name}", f"""
    select {_SEARCH_COLUMNS} from {{registry}} where {_where}""")(
        lambda t, m=_name, x=_text: registry.name_search(t["registry"], m, x).select(*_SEARCH_COLUMNS.split(", ")))

_NUMBER_SEARCHES = {"equal": "= 120", "greater": "> 120", "less": "< 120", "at_least": ">= 120", "at_most": "<= 120"}
for _name, _where in _NUMBER_SEARCHES.items():
    register(f"number_search_{_name}", f"""
    select {_SEARCH_COLUMNS} from {{registry}} where registration_number {_where}""")(
        lambda t, m=_name: registry.number_search(t["registry"], m, 120).select(*_SEARCH_COLUMNS.split(", ")))

register("number_search_first_page", f"""
    select {_SEARCH_COLUMNS} from {{registry}} where registration_number > 120
    order by registration_number, record_id limit 250""")(
        lambda t: registry.number_search(t["registry"], "greater", 120, 250).select(*_SEARCH_COLUMNS.split(", ")))


_WANTED = NAME_KEY.format("text")
_WANTED_WORDS = f"list_filter(string_split({_WANTED}, ' '), lambda w: w <> '')"


@register("name_search_many", f"""
    select mode, text, record_id, corp_name from {{name_searches}} s join {{registry}} r on case mode
        when 'contains' then contains(lower(corp_name), lower(text))
        when 'begins_with' then starts_with({_KEY}, {_WANTED})
        when 'exact' then {_KEY} = {_WANTED}
        when 'any_word' then list_has_any(string_split({_KEY}, ' '), {_WANTED_WORDS})
        else len({_WANTED_WORDS}) > 0 and list_has_all(string_split({_KEY}, ' '), {_WANTED_WORDS}) end""")
def name_search_many(t: Inputs) -> DataFrame:
    """A table of searches of all modes at once, through the inverted index of names."""
    index = name_index.build_name_index(t["registry"].select("record_id", "corp_name"), "corp_name", 8)
    return name_index.search_names(index, t["name_searches"])


# Matching ---------------------------------------------------------------------------------------

def _exact_sql(decrees: str) -> str:
    return f"""
    select g.grantee, e.registration_index, e.corp_name, e.status_id, e.status_es,
        case when e.corp_name is not null then 'exact' end as match_type
    from (select distinct grantee from {{{decrees}}} where grantee is not null) g
    left join {{name_records}} e on {NAME_KEY.format("g.grantee")} = {NAME_KEY.format("e.corp_name")}"""


EXACT = _exact_sql("decrees")


@register("normalized_names", f"""
    select doc_id, {NAME_KEY.format("spaced")} as name from {{spaced_texts}}""")
def normalized_names(t: Inputs) -> DataFrame:
    return t["spaced_texts"].select("doc_id", normalize_name(F.col("spaced")).alias("name"))


def name_entities(t: Inputs) -> DataFrame:
    return registry.registry_entities(t["name_records"])


@register("grantees", "select grantee, min(decree_id) as decree_id from {decrees} where grantee is not null group by all")
def grantees(t: Inputs) -> DataFrame:
    return matching.grantees(t["decrees"]).orderBy("decree_id")


@register("exact_name_match", EXACT)
def exact_name_match(t: Inputs) -> DataFrame:
    return matching.exact_name_match(t["decrees"], name_entities(t))


@register("unmatched_grantees", f"select grantee from ({EXACT}) where match_type is null")
def unmatched_grantees(t: Inputs) -> DataFrame:
    return matching.unmatched_grantees(t["decrees"], name_entities(t))


@register("unmatched_grantees_bitmap", f"select grantee from ({EXACT}) where match_type is null")
def unmatched_grantees_bitmap(t: Inputs) -> DataFrame:
    """Most grantees have no entity of their name: a bitmap of all entities' names spares these the shuffle."""
    return matching.unmatched_grantees(materialize(t["decrees"], "decrees"), name_entities(t), joins.bitmap_anti_join)


def _bm25_sql(queries: str, corpus: str, keys: str, k: int, analysis: str = "{0}") -> str:
    """Plain BM25 over all pairs; ``queries`` gives (query, text), ``corpus`` gives the keys and text."""
    words = "list_filter(string_split_regex({0}, '[^a-z]+'), lambda w: w <> '')".format(NAME_KEY.format("text"))
    words = analysis.format(words)
    return f"""
    with query_rows as ({queries}), corpus as ({corpus}),
    words as (select {keys}, {words} as ws from corpus),
    stats as (select count(*) as n, avg(len(ws)) as mean_len from words),
    tf as (select {keys}, doc_len, token, count(*) as tf from (
        select {keys}, len(ws) as doc_len, unnest(ws) as token from words) group by all),
    df as (select token, count(*) as df from tf group by token),
    asked as (select distinct query, unnest({words}) as token from query_rows),
    weights as (
        select query, {keys}, cast(floor(ln(1 + (n - df + cast(0.5 as double)) / (df + cast(0.5 as double)))
            * (tf * cast(2.2 as double) / (tf + cast(1.2 as double)
                * (cast(0.25 as double) + cast(0.75 as double) * doc_len / mean_len))) * cast(1e9 as double)
            + cast(0.5 as double)) as bigint) as w
        from asked join tf using (token) join df using (token), stats),
    scores as (
        select query, {keys}, cast((cast(sum(w) as bigint) + 500) // 1000 as double) / 1e6 as score
        from weights group by all)
    select * from (
        select *, cast(row_number() over (partition by query order by score desc, {keys}) as int) as rank from scores)
    where rank <= {k}"""


_BENCHMARK = "select item_id as query, text from {benchmark}"
_DOCUMENTS = "select doc_id, coalesce(text, '') as text from {documents}"
for _k in (1, 5):
    register(f"text_search_top{_k}", f"""
    select query as item_id, doc_id, score, rank from ({_bm25_sql(_BENCHMARK, _DOCUMENTS, "doc_id", _k)})""")(
        lambda t, k=_k: search.search_top_k(t["benchmark"], t["documents"], "item_id", "text", ["doc_id"], "text", k))

_STOP_WORDS = ("the", "of", "and", "to", "in", "it", "is", "de", "la", "der", "die", "en", "le")
_ANALYSIS = (
    f"list_transform(list_filter({{0}}, lambda w: not list_contains([{', '.join(repr(w) for w in _STOP_WORDS)}], w)), "
    "lambda w: regexp_replace(w, '^(.{{3,}}?)(ings?|edly|ed|ly|es|s)$', '\\1'))"
)
register("text_search_stemmed_top3", f"""
    select query as item_id, doc_id, score, rank from ({_bm25_sql(_BENCHMARK, _DOCUMENTS, "doc_id", 3, _ANALYSIS).replace("{3,}", "{{3,}}")})""")(
        lambda t: search.search_top_k(t["benchmark"], t["documents"], "item_id", "text", ["doc_id"], "text", 3,
                                      stop_words=_STOP_WORDS, stem=search.light_stem))

def _grantee_search_sql(exact: str) -> str:
    return f"""
    select query as grantee, registration_index, corp_name, status_id, status_es, score
    from ({_bm25_sql(
        f"select grantee as query, grantee as text from ({exact}) where match_type is null",
        "select registration_index, corp_name, corp_name as text from {name_records}",
        "registration_index, corp_name", 1)}) h
    join {{name_records}} r using (registration_index, corp_name)"""


@register("unmatched_grantee_search_top1", _grantee_search_sql(EXACT))
def unmatched_grantee_search_top1(t: Inputs) -> DataFrame:
    """The whole C05: everything that C04 leaves over is searched."""
    with freed_shuffles(t.spark):
        # Asked for by the match, the index and the result.
        entities = materialize(name_entities(t), "name-entities")
        return matching.search_grantees(matching.unmatched_grantees(t["decrees"], entities), entities, 1)


_STORED = f"select distinct grantee from ({EXACT}) where match_type is null and length(grantee) % 2 = 0"


@register("grantees_to_search", f"""
    select grantee from ({EXACT}) where match_type is null and grantee not in ({_STORED})""")
def grantees_to_search(t: Inputs) -> DataFrame:
    unmatched = unmatched_grantees(t)
    return matching.grantees_to_search(unmatched, unmatched.filter(F.length("grantee") % 2 == 0))


REVIEW = """
    with existing as (
        select coalesce(o.grantee, e.grantee) as grantee,
            coalesce(o.registration_index, e.registration_index) as registration_index,
            coalesce(o.corp_name, e.corp_name) as corp_name, o.status_id, o.status_es, o.score,
            case when e.grantee is not null then e.aprobado else o.aprobado end as aprobado,
            case when e.grantee is not null then e.rechazado else o.rechazado end as rechazado
        from {review_old} o full join {review_edits} e
        on o.grantee = e.grantee and o.registration_index = e.registration_index),
    refreshed as (
        select x.grantee, x.registration_index, x.corp_name,
            case when s.grantee is not null then s.status_id else x.status_id end as status_id,
            case when s.grantee is not null then s.status_es else x.status_es end as status_es,
            case when s.grantee is not null then s.score else x.score end as score, x.aprobado, x.rechazado
        from existing x left join {review_search} s on x.grantee = s.grantee
            and x.registration_index = s.registration_index and x.corp_name = s.corp_name)
    select *, aprobado is not null or rechazado is not null as evaluado from (
        select * from refreshed
        union all
        select s.grantee, s.registration_index, s.corp_name, s.status_id, s.status_es, s.score, null, null
        from {review_search} s
        where not exists (select 1 from refreshed r where r.grantee = s.grantee and r.corp_name = s.corp_name
                and (r.aprobado is not null or r.rechazado is not null))
            and not exists (select 1 from refreshed r
                where r.grantee = s.grantee and r.registration_index = s.registration_index))"""


@register("review_merge", f"select * from ({REVIEW})")
def review_merge(t: Inputs) -> DataFrame:
    return matching.review_merge(t["review_old"], t["review_edits"], t["review_search"])


@register("review_upsert", """
    select coalesce(o.grantee, e.grantee) as grantee,
        coalesce(o.registration_index, e.registration_index) as registration_index,
        coalesce(o.corp_name, e.corp_name) as corp_name, o.status_id, o.status_es, o.score,
        case when e.grantee is not null then e.aprobado else o.aprobado end as aprobado,
        case when e.grantee is not null then e.rechazado else o.rechazado end as rechazado
    from {review_old} o full join {review_edits} e
    on o.grantee = e.grantee and o.registration_index = e.registration_index""")
def review_upsert(t: Inputs) -> DataFrame:
    return tables.upsert(t["review_old"], t["review_edits"], matching.REVIEW_KEY, ["aprobado", "rechazado"])


@register("review_refresh", """
    select o.grantee, o.registration_index, o.corp_name, case when s.grantee is not null then s.status_id
            else o.status_id end as status_id, case when s.grantee is not null then s.status_es else o.status_es end
            as status_es, case when s.grantee is not null then s.score else o.score end as score,
        o.aprobado, o.rechazado
    from {review_old} o left join {review_search} s on o.grantee = s.grantee
        and o.registration_index = s.registration_index and o.corp_name = s.corp_name""")
def review_refresh(t: Inputs) -> DataFrame:
    keys = ["grantee", "registration_index", "corp_name"]
    return tables.refresh_from(t["review_old"], t["review_search"], keys, ["status_id", "status_es", "score"])


@register("store_search_results", """
    select grantee, registration_index, corp_name, status_id, status_es, score, aprobado, rechazado from {review_old}
    union all
    select s.*, null, null from {review_search} s where not exists (select 1 from {review_old} o
        where o.grantee = s.grantee and o.registration_index = s.registration_index)""")
def store_search_results(t: Inputs) -> DataFrame:
    return matching.store_search_results(t["review_old"], t["review_search"])


FINAL = f"""
    select grantee, registration_index, corp_name, status_es, match_type from ({EXACT}) where match_type = 'exact'
    union all
    select grantee, registration_index, corp_name, status_es, 'search_aprobado' from ({REVIEW})
    where aprobado is not null"""


@register("final_matches", FINAL)
def final_matches(t: Inputs) -> DataFrame:
    return matching.final_matches(exact_name_match(t), review_merge(t))


@register("review_sheet", f"select registration_index, grantee, corp_name, aprobado, rechazado from ({REVIEW})")
def review_sheet(t: Inputs) -> DataFrame:
    return matching.review_sheet(review_merge(t))


for _suffix, _column in (("names", "corp_name"), ("status", "status_es"), ("evaluated", "evaluado")):
    register(f"match_profile_{_suffix}", f"select {_column}, count(*) as thecount from ({REVIEW}) group by all")(
        lambda t, c=_column: matching.match_profile(review_merge(t), c))
register("match_profile_final", f"select status_es, count(*) as thecount from ({FINAL}) group by all")(
    lambda t: matching.match_profile(final_matches(t), "status_es"))

SEARCHED = """
    select search_company_company_number as company_number_search,
        search_company_jurisdiction_code as jurisdiction_code_search, search_company_name as company_name_search,
        min(search_company_country_code) as country_code_search,
        upper(string_split(search_company_jurisdiction_code, '_')[2]) as state_search
    from {searched} group by all"""


@register("searched_companies", SEARCHED)
def searched_companies(t: Inputs) -> DataFrame:
    return matching.searched_companies(t["searched"])


@register("search_back_match", f"""
    select r.* from {{results}} r left join ({SEARCHED}) s
    on {NAME_KEY.format("r.company_name")} = {NAME_KEY.format("s.company_name_search")}
    where s.company_name_search is null""")
def search_back_match(t: Inputs) -> DataFrame:
    return matching.search_back_match(t["results"], searched_companies(t))


# Sources, sinks and incremental ingest ----------------------------------------------------------

@register("csv_round_trip", "select company_id, company_name, rev_2001, rev_last from {revenue_wide}")
def csv_round_trip(t: Inputs) -> DataFrame:
    path = work_path(t.spark, "csv")
    sinks.write_csv(t["revenue_wide"].select("company_id", "company_name", "rev_2001", "rev_last"), path)
    return readers.read_csv(t.spark, path, "company_id string, company_name string, rev_2001 double, rev_last double")


@register("json_documents_parse", """
    select corp_register_index as registration_index, corp_name, foreign_city, local_city, status from {entity_flat}""")
def json_documents_parse(t: Inputs) -> DataFrame:
    documents = readers.parse_json_documents(entity_document_text(t), "value", schemas.ENTITY_DOCUMENT)
    return documents.select(
        F.col("response.corporation.corpRegisterIndex").alias("registration_index"),
        F.col("response.corporation.corpName").alias("corp_name"),
        F.col("response.mainLocation.foreignDomicileAddress.city").alias("foreign_city"),
        F.col("response.mainLocation.streetAddress.city").alias("local_city"),
        F.col("response.corporation.statusEs").alias("status"),
    )


_DATA_COLUMNS = ["company_id", "company_name", "parent_id", *(f"operating_revenue_year_{y}_eur_th" for y in (2001, 2000, "last"))]
_DATA_FILES = """
    select file_name, row_in_file, company_id, company_name, parent_id, rev_2001 as operating_revenue_year_2001_eur_th,
        rev_2000 as operating_revenue_year_2000_eur_th, rev_last as operating_revenue_year_last_eur_th
    from {data_batches} join {data_positions} using (company_id)"""


def data_batches_read(t: Inputs) -> DataFrame:
    rows = readers.read_batches(t.spark, f"{t.batch_folder()}/*DATA*.csv", _DATA_COLUMNS)
    return readers.clean_tokens(rows, {c: "double" for c in _DATA_COLUMNS[3:]})


@register("batch_files_scan", _DATA_FILES)
def batch_files_scan(t: Inputs) -> DataFrame:
    return data_batches_read(t)


@register("merge_batches_from_files", f"""
    select d.file_name, s.own_id, d.* exclude (file_name)
    from ({_DATA_FILES}) d left join (
        select matched_company_id, own_id from {{search_batches}} where matched_company_id is not null) s
    on d.company_id = s.matched_company_id""")
def merge_batches_from_files(t: Inputs) -> DataFrame:
    found = readers.read_batches(t.spark, f"{t.batch_folder()}/*SEARCH*.csv", ["own_id", "matched_company_id", "score"])
    return panel.merge_data_batches(data_batches_read(t), found)


@register("batch_catalog_from_files", CATALOG.replace("file_path, parse", "parse").replace("{batch_files}", "{batch_files}"))
def batch_catalog_from_files(t: Inputs) -> DataFrame:
    """The folder's own listing; its path differs from run to run and is left out."""
    return readers.batch_catalog(readers.list_files(t.spark, t.batch_folder(), "*.csv")).drop("file_path")


@register("dates_unpivot", f"""
    select * from ({" union all ".join(
        f"select corp_register_index as registration_index, '{c}' as event_name, {c} as event_date "
        "from {entity_flat}" for c in _DATES)}) where event_date is not null""")
def dates_unpivot(t: Inputs) -> DataFrame:
    flat = t["entity_flat"].withColumnRenamed("corp_register_index", "registration_index")
    dates = reshape.matching_columns(flat, "^date_")
    return reshape.unpivot_known(flat, ["registration_index"], dates, "event_name", "event_date")


# The odd requests arrive first: of equal records the first one of them is stored, else the first of the others.
_ARRIVAL = "case when request_id % 2 = 1 then 0 else 1000000000000 end + record_id"
INGESTED = f"""
    select min_by(record_id, {_ARRIVAL}) as record_id, min_by(request_id, {_ARRIVAL}) as request_id,
        registration_number, registration_index, corp_name, profit_type_es, status_id, status_es
    from {{registry}} group by registration_number, registration_index, corp_name, profit_type_es, status_id, status_es"""
_STORE = ["record_id", "request_id", *ingest.CONTENT]


def _arrivals(t: Inputs) -> list[DataFrame]:
    pages = t["registry"].select(*_STORE)
    odd = F.col("request_id") % 2 == 1
    return [pages.filter(odd), pages.filter(~odd)]


@register("ingest_pages_batch", INGESTED)
def ingest_pages_batch(t: Inputs) -> DataFrame:
    first, second = _arrivals(t)
    return ingest.ingest_batch(ingest.ingest_batch(first.filter(F.lit(False)), first), second)


def _streamed(t: Inputs) -> tuple[str, DataFrame]:
    landing, store, progress = (work_path(t.spark, x) for x in ("landing", "store", "progress"))
    for part in _arrivals(t):
        part.repartitionByRange(4, "request_id").write.mode("append").parquet(landing)
        rows = ingest.ingest_stream(t.spark, landing, store, progress, part.schema)
    return store, rows


@register("ingest_pages_stream", INGESTED)
def ingest_pages_stream(t: Inputs) -> DataFrame:
    """Two runs of the stream, the second one from the first one's checkpoint."""
    return _streamed(t)[1]


@register("ingest_pages_stateful", INGESTED)
def ingest_pages_stateful(t: Inputs) -> DataFrame:
    """As above with Spark's own state, kept in the first run's checkpoint; no batch reads the store."""
    landing, store, progress = (work_path(t.spark, x) for x in ("landing", "store", "progress"))
    for part in _arrivals(t):
        part.repartitionByRange(4, "request_id").write.mode("append").parquet(landing)
        rows = ingest.ingest_stateful(t.spark, landing, store, progress, part.schema)
    return rows


@register("ingest_store_compacted", INGESTED)
def ingest_store_compacted(t: Inputs) -> DataFrame:
    store, rows = _streamed(t)
    return ingest.compacted(t.spark, store, rows.schema, work_path(t.spark, "compact"))


@register("append_page_records", """
    select business_entity_id, registration_number, registration_index, corp_name, request_id from {registry}""")
def append_page_records(t: Inputs) -> DataFrame:
    """Pages under the names the form gives them, stored by request. Every third request arrives twice."""
    path = work_path(t.spark, "records")
    names = {"business_entity_id": "businessEntityId", "registration_number": "registrationNumber",
             "registration_index": "registrationIndex", "corp_name": "corpName"}
    pages = t["registry"].select("request_id", *[F.col(c).alias(n) for c, n in names.items()])
    for arrived in (pages, pages.filter("request_id % 3 = 0")):
        sinks.append_records(ingest.parse_page_records(arrived, F.col("request_id")), path)
    return t.spark.read.schema("business_entity_id bigint, registration_number bigint, registration_index string, "
                               "corp_name string, request_id bigint").parquet(path)


@register("json_array_read", """
    select code, country from {spanish_names}""")
def json_array_read(t: Inputs) -> DataFrame:
    """A small dimension as one JSON array over several lines, with a field that isn't asked for."""
    path = work_path(t.spark, "names")
    rows = F.array_sort(F.collect_list(F.struct("code", "country", F.lit(True).alias("extended"))))
    t["spanish_names"].agg(F.regexp_replace(F.to_json(rows), r"\},\{", "},\n{").alias("value")).write.text(path)
    return readers.read_json_array(t.spark, path, schemas.COUNTRY_NAMES)


@register("json_documents_landed", """
    select company_number, name, locality, owners from {company_flat}""")
def json_documents_landed(t: Inputs) -> DataFrame:
    path = work_path(t.spark, "documents")
    flat = t["company_flat"].select("company_number", "name", "locality", "owners")
    sinks.write_json_documents(flat, path, "company_number")
    return readers.read_json_documents(t.spark, path, flat.schema.toDDL())


@register("compact_documents", """
    select corp_register_index || '.json' as file_name, corp_register_index as registration_index from {entity_flat}""")
def compact_documents(t: Inputs) -> DataFrame:
    """One file per document, read once and kept as Parquet under the file's name."""
    folder = t.document_folder(lambda: entity_document_text(t))
    compact = readers.compact_json_documents(t.spark, folder, schemas.ENTITY_DOCUMENT, work_path(t.spark, "compact"))
    named = compact.select("file_name", F.col("response.corporation.corpRegisterIndex").alias("registration_index"))
    return named.join(registry.collected_ids(named), "registration_index", "left_semi").select("file_name", "registration_index")


@register("compact_documents_incremental", """
    select corp_register_index as registration_index, corp_name from {entity_flat}""")
def compact_documents_incremental(t: Inputs) -> DataFrame:
    """Small files that come in two parts; the second run reads only the files it hasn't seen."""
    folder, target, progress = (work_path(t.spark, x) for x in ("collected", "compact", "progress"))
    text = entity_document_text(t)
    odd = F.crc32("value") % 2 == 1
    for part in (text.filter(odd), text.filter(~odd)):
        part.write.mode("append").option("maxRecordsPerFile", 20).text(folder)
        compact = documents.compact_new_documents(t.spark, folder, schemas.ENTITY_DOCUMENT, target, progress)
    corporation = F.col("response.corporation")
    return compact.select(corporation["corpRegisterIndex"].alias("registration_index"), corporation["corpName"].alias("corp_name"))


@register("review_versions", f"""
    select * from ({ORACLE["review_upsert"]})""")
def review_versions(t: Inputs) -> DataFrame:
    """The review table kept between runs: a first version, then one with the reviewers' edits."""
    path, stored = work_path(t.spark, "review"), t["review_old"]
    tables.write_version(stored, path, matching.REVIEW_KEY)
    last = tables.read_version(t.spark, path, stored.schema)
    edited = tables.upsert(last, matching.checked_review_input(t["review_edits"]), matching.REVIEW_KEY, ["aprobado", "rechazado"])
    tables.write_version(edited, path, matching.REVIEW_KEY)
    return tables.read_version(t.spark, path, stored.schema)


@register("review_versions_incremental", f"""
    select * from ({ORACLE["review_upsert"]})""")
def review_versions_incremental(t: Inputs) -> DataFrame:
    """The review table in buckets; two runs of edits, each of which rewrites only the buckets it changes."""
    path, stored, buckets = work_path(t.spark, "review"), t["review_old"], 16
    tables.create_buckets(stored, path, matching.REVIEW_KEY, buckets)
    edits = matching.checked_review_input(t["review_edits"])
    first = F.crc32("grantee") % 2 == 0
    for run, part in enumerate((edits.filter(first), edits.filter(~first))):
        tables.upsert_buckets(t.spark, path, stored.schema, part, matching.REVIEW_KEY, ["aprobado", "rechazado"], buckets, run)
    return tables.read_buckets(t.spark, path, stored.schema)


@register("ingest_page_report", """
    select request_id, count(*) as records, min(registration_number) as first_number,
        max(registration_number) as last_number, min(registration_number) = max(registration_number)
            as did_not_advance, count(*) < 250 as short_page
    from {registry} group by request_id""")
def ingest_page_report(t: Inputs) -> DataFrame:
    return ingest.page_report(t["registry"], 250)


register("high_water_mark", "select max(registration_number) as registration_number from {registry}")(
    lambda t: ingest.high_water_mark(t["registry"]))


@register("request_log", """
    select distinct request_id, '2024-07-01T08:30:00-04:00' as request_sent_timestamp from {registry}""")
def request_log(t: Inputs) -> DataFrame:
    return ingest.request_log(t["registry"], "2024-07-01 12:30:00", "America/Puerto_Rico", "-04:00")
