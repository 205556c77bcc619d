"""Inputs of the jobs, derived from the given tables.

Each view is one SQL text that both engines run: ``{name}`` stands for a given table or another view.
Money is summed as decimals and only then becomes a double, so both engines get the same value.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grouptrace.session import materialize, work_path
from grouptrace.sources.sinks import write_named_files

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
YEARS = range(1995, 2002)
REVENUE_COLUMNS = [f"rev_{y}" for y in reversed(YEARS)]


def _rev(year: int) -> str:
    return (
        f"cast(sum(case when year(o_orderdate) = {year} then cast(o_totalprice as decimal(18,2)) end) as double)"
        f" as rev_{year}"
    )


def _first_order(status: str, name: str, how: str = "min") -> str:
    return f"{how}(case when o_orderstatus = '{status}' then o_orderdate end) as date_{name}"


_PARENT = "'C' || cast(c_custkey % 150 as string)"

VIEWS: dict[str, str] = {
    # One row per customer: yearly revenue, the latest known value, parent and own id.
    "revenue_wide": f"""
        select r.*,
            coalesce(rev_2001, rev_2000, rev_1999, rev_1998, rev_1997, rev_1996, rev_1995) as rev_last,
            case when o_custkey % 5 = 0 then rev_2000 end as parent_rev,
            'C' || cast(o_custkey as string) as company_id,
            'Company ' || cast(o_custkey as string) as company_name,
            case when o_custkey % 101 <> 100 then 'C' || cast(o_custkey % 397 as string) end as parent_id,
            case when o_custkey % 53 <> 52 then 'pr/' || cast(o_custkey as string) || '-112' end as own_id
        from (select o_custkey, {", ".join(_rev(y) for y in YEARS)} from {{orders}} group by o_custkey) r""",
    "yearly_batch": """
        select 'Batch ' || cast(cast(floor(o_custkey / 100.0) as bigint) as string) || '.csv' as file_name,
            company_id, company_name, 'US' as country_code,
            case when o_custkey % 41 = 0 then 'PR' end as state,
            rev_last as operating_revenue_year_last_eur_th,
            rev_2001 as operating_revenue_year_1_eur_th, rev_2000 as operating_revenue_year_2_eur_th,
            rev_1999 as operating_revenue_year_3_eur_th, rev_1998 as operating_revenue_year_4_eur_th
        from {revenue_wide}""",
    # The same batch in plain EUR, without the thousands columns, and a company that misses the threshold by its unit.
    "nominal_batch": """
        select file_name, company_id, operating_revenue_year_last_eur_th * 1000 as operating_revenue_year_last_eur,
            operating_revenue_year_1_eur_th * 1000 as operating_revenue_year_1_eur,
            operating_revenue_year_2_eur_th * 1000 as operating_revenue_year_2_eur,
            operating_revenue_year_3_eur_th * 1000 as operating_revenue_year_3_eur,
            operating_revenue_year_4_eur_th * 1000 as operating_revenue_year_4_eur
        from {yearly_batch}
        union all
        select distinct 'Batch 0.csv', 'small', cast(800000 as double), cast(800000 as double), cast(800000 as double),
            cast(null as double), cast(null as double) from {region}""",
    "revenue_text": """
        select company_id,
            coalesce(cast(cast(rev_2001 as decimal(18,2)) as string),
                case when o_custkey % 2 = 0 then 'n.a.' else '#N/A' end) as rev_2001,
            coalesce(cast(cast(rev_2000 as decimal(18,2)) as string),
                case when o_custkey % 2 = 0 then '#N/A' else 'n.a.' end) as rev_2000,
            case when o_custkey % 19 = 0 then 'NA' when o_custkey % 19 = 1 then 'n.a.' else 'US' end as country_code
        from {revenue_wide}""",
    # Exported batches of 200 companies each, split by key.
    "batch_numbers": """
        select r.*, cast(floor(o_custkey / 200.0) as bigint) * 200 + 1 as first_number,
            o_custkey % 200 + 1 as row_in_file
        from {revenue_wide} r""",
    "data_batches": """
        select 'Export (DATA with ids) ' || cast(first_number as string) || '-' || cast(first_number + 199 as string)
                || '.csv' as file_name,
            company_id, company_name, parent_id, rev_2001, rev_2000, rev_last
        from {batch_numbers}""",
    "data_positions": """
        select company_id, row_in_file from {batch_numbers}""",
    # A second own id for every 20th company (fan-out), no match for every 13th.
    "search_batches": """
        select 'Export (SEARCH with ids) ' || cast(first_number as string) || '-' || cast(first_number + 199 as string)
                || '.csv' as file_name,
            (row_in_file - 1) * 2 + 1 as row_in_file, 'pr/' || cast(o_custkey as string) || '-112' as own_id,
            case when o_custkey % 13 <> 0 then company_id end as matched_company_id,
            cast(o_custkey % 100 as double) / 100 as score
        from {batch_numbers}
        union all
        select 'Export (SEARCH with ids) ' || cast(first_number as string) || '-' || cast(first_number + 199 as string)
                || '.csv' as file_name,
            row_in_file * 2 as row_in_file, 'pr/' || cast(o_custkey as string) || '-111' as own_id,
            case when o_custkey % 13 <> 0 then company_id end as matched_company_id,
            cast(o_custkey % 100 as double) / 100 as score
        from {batch_numbers} where o_custkey % 20 = 0""",
    "batch_files": """
        select distinct 'inputs/' || file_name as file_path from {data_batches}
        union all
        select distinct 'inputs/' || file_name as file_path from {search_batches}
        union all
        select distinct 'inputs/~$' || file_name as file_path from {data_batches}""",
    # Network: groups of customers, some purely domestic, some abroad only in a country without data.
    "network_rows": f"""
        select c_custkey, c_name, c_custkey % 150 as g, {_PARENT} as parent_id,
            case when (c_custkey % 150) % 7 = 0 then (c_custkey % 150) % 25
                 when c_custkey >= 150 and (c_custkey % 150) % 11 = 0 then 24
                 else c_nationkey end as nation_key
        from {{customer}} where not (c_custkey < 150 and c_custkey % 29 = 28)""",
    "network": """
        select c_custkey as row_number, c_name as company_name, 'C' || cast(c_custkey as string) as company_id,
            parent_id, case when c_custkey % 10 = 9 then 'Yes' else 'No' end as branch_indicator,
            'NATION_' || cast(nation_key as string) as country, 'N' || cast(nation_key as string) as country_iso_code,
            cast(null as string) as region_in_country,
            case when c_custkey % 41 = 0 and g % 7 <> 0 then 'PR' end as state
        from {network_rows}""",
    "countries": """
        select n_name as country, 'N' || cast(n_nationkey as string) as "alpha-2", r_name as region
        from {nation} join {region} on n_regionkey = r_regionkey
        union all
        select distinct 'Puerto Rico' as country, 'PR' as "alpha-2", 'AMERICA' as region from {region}""",
    "spanish_names": """
        select 'N' || cast(n_nationkey as string) as code, lower(n_name) as country
        from {nation} where n_nationkey % 10 <> 9""",
    # Adoption flags; includes a name without a code and a row without a name.
    "adoption_years": """
        select n_nationkey, n_name, 2024 as y from {nation}
        union all select n_nationkey, n_name, 2025 as y from {nation}
        union all select n_nationkey, n_name, 2026 as y from {nation}""",
    "adoption": """
        select n_name as country, cast(y as string) as year,
            case when n_nationkey % 2 = 0 then 'Yes' else 'No' end as pillar2,
            case when n_nationkey % 4 <> 0 then 'Yes' else 'No' end as iir,
            case when y = 2024 then 'No' when n_nationkey % 5 = 0 then 'Yes'
                 when n_nationkey % 6 = 5 then 'Pending' else 'No' end as utpr,
            case when n_nationkey % 3 = 0 then 'Yes' else 'No' end as qdmtt
        from {adoption_years} where n_nationkey <> 24 and n_nationkey % 8 <> 7
        union all
        select 'Puerto Rico', cast(y as string), 'No', 'No', case when y >= 2025 then 'Yes' else 'No' end, 'No'
        from {adoption_years} where n_nationkey = 0
        union all
        select case when n_nationkey = 1 then 'Atlantis' end, cast(y as string), 'No', 'No', 'No', 'No'
        from {adoption_years} where n_nationkey in (1, 2)""",
    # Local companies: their ids, the panel that knows their parent, and the registry that knows their name.
    "local_ids": """
        select cast(p_partkey as string) || '-112' as company_number from {part} where p_partkey % 31 <> 30""",
    "local_panel": """
        select case when p_partkey % 37 <> 36 then 'pr/' || cast(p_partkey as string) || '-112' end as own_id,
            case when p_partkey % 43 <> 42 then 'C' || cast(p_partkey % 150 as string) end as parent_id
        from {part}""",
    "local_entities": """
        select cast(p_partkey as string) || '-112' as registration_index,
            p_name || ' ' || cast(p_partkey as string) as corp_name
        from {part} where p_partkey % 23 <> 22""",
    "group_revenue": f"""
        select 'C' || cast(o_custkey % 150 as string) as parent_id,
            max(greatest({", ".join(REVENUE_COLUMNS)})) as filial_operating_revenue_max
        from {{revenue_wide}} group by 'C' || cast(o_custkey % 150 as string)""",
    # Registry hits: pages of 250 records, the last three of a page arrive again on the next one.
    "registry_first": """
        select p_partkey, p_partkey * 2 + 1 as record_id, cast(floor(p_partkey / 250.0) as bigint) + 1 as request_id,
            p_partkey + 700000 as business_entity_id, cast(floor(p_partkey / 3.0) as bigint) as registration_number,
            cast(cast(floor(p_partkey / 3.0) as bigint) as string) || '-' || cast(111 + p_partkey % 3 as string)
                as registration_index,
            upper(p_name) || ' ' || upper(p_brand)
                || case p_size % 4 when 0 then ' COOP' when 1 then ' INC.' when 2 then ', LLC' else ' CORP' end
                as corp_name,
            case p_size % 2 when 0 then 'Corporación' else 'Sociedad' end as class_es,
            case p_size % 2 when 0 then 'Corporation' else 'Partnership' end as class_en,
            case p_size % 2 when 0 then 'Sin Fines' else 'Con Fines' end as profit_type_es,
            case p_size % 2 when 0 then 'Non Profit' else 'For Profit' end as profit_type_en,
            cast(p_partkey % 5 as bigint) as status_id,
            case p_partkey % 5 when 0 then 'EXPIRADA' when 1 then 'ACTIVA' when 2 then 'FUSIONADA'
                when 3 then 'CANCELADA' else 'ACTIVA' end as status_es,
            case p_partkey % 5 when 0 then 'EXPIRED' when 1 then 'ACTIVE' when 2 then 'MERGED'
                when 3 then 'CANCELED' else 'ACTIVE' end as status_en
        from {part}""",
    # A table of name searches: those of every part whose key is divisible by 20.
    "name_searches": """
        select distinct mode, text from (
            select 'contains' as mode, substr(p_name, 2, 5) || case p_size % 3 when 0 then '' else substr(p_name, 7, 4) end as text
            from {part} where p_partkey % 20 = 0
            union all
            select 'contains', substr(p_name, 1 + p_size % 9, 1 + p_size % 3) from {part} where p_partkey % 20 = 0
            union all
            select 'begins_with', substr(upper(p_name), 1, 1 + p_size % 12) from {part} where p_partkey % 20 = 0
            union all
            select 'exact', upper(p_name) || ' ' || lower(p_brand) || ' inc' from {part} where p_partkey % 20 = 0
            union all
            select 'any_word', p_brand || ',  none' || p_type from {part} where p_partkey % 20 = 0
            union all
            select 'all_words', 'corp ' || p_name || case p_size % 5 when 0 then ' ' || p_brand else '' end from {part}
            where p_partkey % 20 = 0
            union all
            select 'all_words', case p_size % 2 when 0 then ' ' end from {part} where p_partkey % 20 = 0)
        t""",
    "registry": """
        select record_id, request_id, business_entity_id, registration_number, registration_index, corp_name,
            class_es, class_en, profit_type_es, profit_type_en, status_id, status_es, status_en
        from {registry_first}
        union all
        select record_id + 1, request_id + 1, business_entity_id, registration_number, registration_index, corp_name,
            class_es, class_en, profit_type_es, profit_type_en, status_id, status_es, status_en
        from {registry_first} where p_partkey % 250 >= 247""",
    # Detail documents as flat rows; the Spark side nests them into JSON text.
    "entity_orders": f"""
        select o_custkey, {_first_order("F", "effective")}, {_first_order("O", "formed")},
            {_first_order("P", "expiration", "max")}, {_first_order("F", "termination", "max")}
        from {{orders}} group by o_custkey""",
    "entity_flat": """
        select cast(c_custkey as string) || '-112' as corp_register_index,
            case c_custkey % 3 when 0 then 'Cooperativa ' when 1 then 'Servicios Coop ' else 'Empresas ' end
                || c_name as corp_name,
            c_nationkey % 3 + 1 as jurisdiction_type,
            case c_nationkey % 3 when 0 then 'Doméstica' when 1 then 'Foránea' else 'Foránea - No Estadounidense' end
                as jurisdiction,
            case when c_custkey % 4 = 0 then 'State ' || cast(c_nationkey as string) end as home_state,
            case c_custkey % 3 when 0 then 'ACTIVA' when 1 then 'FUSIONADA' else 'CANCELADA' end as status,
            case when c_custkey % 7 <> 0 then 'City ' || cast(c_nationkey as string) end as foreign_city,
            case when c_custkey % 11 <> 0 then 'Province ' || cast(c_nationkey as string) end as province,
            case when c_custkey % 5 <> 0 then 'Town ' || cast(c_nationkey as string) end as local_city,
            case when c_custkey % 17 = 0 then '' when c_custkey % 2 = 0
                then '"' || replace(cast(date_effective as string), ' ', 'T') || '"'
                else replace(cast(date_effective as string), ' ', 'T') end as date_effective,
            case when c_custkey % 13 = 0 then 'n/a' else replace(cast(date_formed as string), ' ', 'T') end
                as date_formed,
            replace(cast(date_expiration as string), ' ', 'T') || '.000' as date_expiration,
            case when c_custkey % 2 = 0 then replace(cast(date_termination as string), ' ', 'T') end
                as date_termination
        from {customer} left join {entity_orders} on c_custkey = o_custkey
        where c_custkey % 9 <> 0""",
    "entity_targets": """
        select c_custkey as record_id, cast(c_custkey as string) || '-112' as registration_index,
            case c_custkey % 3 when 0 then 'Cooperativa ' when 1 then 'Servicios Coop ' else 'Empresas ' end
                || c_name as corp_name,
            case c_custkey % 3 when 0 then 'ACTIVA' when 1 then 'FUSIONADA' else 'CANCELADA' end as status_es
        from {customer}""",
    # Third-party company documents as flat rows.
    "company_flat": """
        select cast(c_custkey as string) || '-112' as company_number, c_name as name, 'us_pr' as jurisdiction_code,
            case when c_custkey % 6 = 0 then 'F' end as branch,
            ' City, ' || cast(c_nationkey as string) || ' ' as locality, c_custkey % 500 as number_of_employees,
            case when c_custkey % 4 = 0 then 'Home ' || c_name end as home_company_name,
            case when c_custkey % 8 = 0 then 'Controller' end as controlling_entity,
            case when c_custkey % 9 = 0 then 'Ultimate' end as ultimate_controlling_company,
            c_custkey % 3 as owners
        from {customer} where c_custkey % 7 <> 0""",
    "sheet_ids": """
        select cast(c_custkey as string) || '-112' as company_number from {customer}""",
    # Whole texts between spaces of several kinds, also in their midst.
    "spaced_texts": """
        select doc_id, case doc_id % 4 when 0 then text when 1 then ' ' || ' ' || text || ' '
            when 2 then '  ' || replace(text, ' ', ' ') || ' ' else ' ' || text || chr(9) end as spaced
        from {documents}""",
    # Names out of documents: every line of every text. Some stand between no-break and em spaces.
    "text_lines": """
        select distinct doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from {documents})
        where line <> ''""",
    "decrees": """
        select doc_id as decree_id, case when doc_id % 6 = 0 then ' ' || line || ' ' else line end as grantee
        from {text_lines} where doc_id % 2 = 0""",
    "decree_texts": """
        select doc_id as decree_id, text as grantee from {documents}""",
    "name_records": """
        select doc_id as record_id, cast(doc_id as string) || '-111' as registration_index,
            case when doc_id % 5 = 0 then ' ' || ' ' || line || ' ' else line end as corp_name,
            cast(doc_id % 5 as bigint) as status_id,
            case doc_id % 5 when 0 then 'EXPIRADA' when 1 then 'ACTIVA' else 'CANCELADA' end as status_es
        from {text_lines} where doc_id % 2 = 1""",
    # Review tables: stored candidates, the reviewers' edits, search results.
    "review_search": """
        select 'G' || cast(doc_id as string) as grantee, cast(doc_id % 97 as string) || '-111' as registration_index,
            'CORP ' || cast(doc_id % 41 as string) as corp_name, cast(doc_id % 5 as bigint) as status_id,
            case when doc_id % 5 = 1 then 'ACTIVA' else 'CANCELADA' end as status_es,
            cast(doc_id % 1000 as double) / 8 as score
        from {documents} where doc_id % 5 <> 0
        union all
        select 'G' || cast(doc_id as string), cast(doc_id % 89 as string) || '-112',
            'CORP ' || cast(doc_id % 41 as string), cast(1 as bigint), 'ACTIVA', cast(doc_id % 500 as double) / 8
        from {documents} where doc_id % 10 < 4""",
    "review_old": """
        select 'G' || cast(doc_id as string) as grantee, cast(doc_id % 97 as string) || '-111' as registration_index,
            case when doc_id % 15 = 0 then 'OLD NAME' else 'CORP ' || cast(doc_id % 41 as string) end as corp_name,
            cast(9 as bigint) as status_id, 'EXPIRADA' as status_es, cast(0.5 as double) as score,
            case when doc_id % 6 = 0 then 'x' end as aprobado, case when doc_id % 9 = 0 then 'x' end as rechazado
        from {documents} where doc_id % 3 = 0""",
    "review_edits": """
        select 'G' || cast(doc_id as string) as grantee, cast(doc_id % 97 as string) || '-111' as registration_index,
            'CORP ' || cast(doc_id % 41 as string) as corp_name,
            case when doc_id % 8 = 0 then 'x' end as aprobado, case when doc_id % 20 = 4 then 'x' end as rechazado
        from {documents} where doc_id % 4 = 0""",
    "searched": """
        select cast(c_custkey as string) || '-112' as search_company_company_number,
            case when c_custkey % 6 = 0 then 'us'
                 else 'us_' || substr('denyprcatxfl', cast(c_custkey % 6 * 2 + 1 as int), 2) end
                as search_company_jurisdiction_code,
            upper(c_name) || '.' as search_company_name,
            case when c_custkey % 2 = 0 then 'US' else 'PR' end as search_company_country_code
        from {customer} where c_custkey % 7 <> 0
        union all
        select cast(c_custkey as string) || '-112', 'us', upper(c_name) || '.', 'ZZ'
        from {customer} where c_custkey % 12 = 0 and c_custkey % 7 <> 0""",
    "results": """
        select 'C' || cast(c_custkey as string) as company_id, lower(c_name) || ',' as company_name,
            'US' as country_code, case when c_custkey % 41 = 0 then 'PR' end as state
        from {customer}""",
    # Yearly totals: each step reduces the rows before the next shuffle. Per order in whole cents and
    # hundredths of cents, above that as decimals.
    "line_cents": """
        select l_orderkey, cast(year(l_shipdate) as int) as yr, cast(round(l_extendedprice * 100) as bigint) as cents,
            100 - cast(round(l_discount * 100) as bigint) as kept, cast(round(l_tax * 100) as bigint) as taxed
        from {lineitem}""",
    "order_year_totals": """
        select l_orderkey, yr, cast(sum(cents) as bigint) as cents, cast(sum(cents * kept) as bigint) as profit,
            cast(sum(cents * taxed) as bigint) as tax
        from {line_cents} group by l_orderkey, yr""",
    "customer_year_totals": """
        select o_custkey, yr, sum(cast(cents as decimal(38,0))) as cents, sum(cast(profit as decimal(38,0))) as profit,
            sum(cast(tax as decimal(38,0))) as tax
        from {order_year_totals} join {orders} on l_orderkey = o_orderkey group by o_custkey, yr""",
    "country_year_money": """
        select yr, r_name as region, n_name as country, sum(cents) as cents, sum(profit) as profit, sum(tax) as tax,
            count(*) as customers
        from {customer_year_totals} join {customer} on o_custkey = c_custkey
            join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
        group by yr, r_name, n_name""",
    "country_year_totals": """
        select yr, region, country, cast(cents as double) / 100 as TOT_REV, cast(profit as double) / 10000 as PROFIT,
            cast(tax as double) / 10000 as TAX_ACCRUED
        from {country_year_money}""",
    "yearly_totals": """
        select yr as time_period, cast(sum(cents) as double) / 100 as TOT_REV,
            cast(sum(profit) as double) / 10000 as PROFIT, cast(sum(tax) as double) / 10000 as TAX_ACCRUED,
            cast(sum(customers) as bigint) as EMPLOYEES, count(*) as ENTITIES_COUNT,
            cast(sum(cents) as double) / 500 as ASSETS, cast(sum(profit) as double) / 20000 as EARNINGS,
            cast(sum(cents) as double) / 3000 as PAYROLL
        from {country_year_money} group by yr""",
}


def csv_lines(df: DataFrame, name: str, order: str) -> DataFrame:
    """(name, order, line, header): rows as the lines of CSV files."""
    csv, columns = {"escape": '"'}, [c for c in df.columns if c not in (name, order)]
    header = F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(columns)]), csv)
    cells = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    return df.select(name, order, F.to_csv(cells, csv).alias("line"), header.alias("header"))


def names_in(sql: str) -> list[str]:
    """The tables and views a text refers to."""
    return list(dict.fromkeys(field for _, field, _, _ in string.Formatter().parse(sql) if field))


class Inputs:
    """The given tables and the derived views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._views, self._landed = spark, sf_dir, {}, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._views:
            if name in TABLES:
                self._views[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                # Spark quotes names with backticks and has names of its own for lists.
                sql = VIEWS[name].replace('"alpha-2"', "`alpha-2`").replace("unnest(string_split(", "explode(split(")
                self._views[name] = self.spark.sql(sql, **{n: self[n] for n in names_in(sql)})
        return self._views[name]

    def batch_folder(self) -> str:
        """A folder of exported batches, one CSV file each, named and headed as the exports are.

        Headers hold line breaks, and the columns of every other file stand in another order. Lock files lie beside them.
        """
        if "batches" not in self._landed:
            folder = work_path(self.spark, "batches")
            data = materialize(self["data_batches"].join(self["data_positions"], "company_id"), "batch-rows")
            text = lambda c, token: F.coalesce(F.col(c).cast("string"), F.lit(token))
            cells = data.select(
                "file_name", "row_in_file", F.col("company_name").alias("Company name Latin alphabet"),
                F.col("company_id").alias("BvD ID number"), F.col("parent_id").alias("Model data - Global parent bvdid"),
                text("rev_2001", "n.a.").alias("Operating revenue (Turnover)\nth EUR 2001"),
                text("rev_2000", "#N/A").alias("Operating revenue (Turnover)\nth EUR 2000"),
                text("rev_last", "n.a.").alias("Operating revenue (Turnover)\nth EUR Last avail. value"),
            )
            other = cells.select("file_name", "row_in_file", *[f"`{c}`" for c in reversed(cells.columns[2:])])
            turned = F.length("file_name") % 2 == 0
            found = self["search_batches"].select(
                "file_name", "row_in_file", F.col("own_id").alias("Own ID"),
                F.col("matched_company_id").alias("Matched BvD ID"), F.col("score").alias("Score"))
            locks = cells.filter("row_in_file = 1").withColumn("file_name", F.concat(F.lit("~$"), "file_name"))
            parts = (cells.filter(turned), other.filter(~turned), found, locks)
            lines = reduce(DataFrame.unionByName, [csv_lines(part, "file_name", "row_in_file") for part in parts])
            write_named_files(lines, folder, "file_name", "line", ["row_in_file"], "header")
            self._landed["batches"] = folder
        return self._landed["batches"]

    def document_folder(self, documents: Callable[[], DataFrame]) -> str:
        """A folder with one file per entity document, named by its id."""
        if "document-files" not in self._landed:
            folder = work_path(self.spark, "document-files")
            key = F.get_json_object("value", "$.response.corporation.corpRegisterIndex")
            named = documents().select(F.concat(key, F.lit(".json")).alias("file_name"), "value")
            write_named_files(named, folder, "file_name", "value")
            self._landed["document-files"] = folder
        return self._landed["document-files"]

    def landed(self, name: str, documents: Callable[[], DataFrame]) -> str:
        """Path of a set of JSON documents, written to the shared folder when it is first asked for."""
        if name not in self._landed:
            path = work_path(self.spark, name)
            documents().write.text(path)
            self._landed[name] = path
        return self._landed[name]


def with_views(sql: str) -> str:
    """An oracle text with the views it needs in front, as common table expressions."""
    needed: dict[str, str] = {}

    def add(text: str) -> None:
        for name in names_in(text):
            if name not in TABLES and name not in needed:
                add(VIEWS[name])
                needed[name] = VIEWS[name].format(**{n: n for n in names_in(VIEWS[name])})

    add(sql)
    body = sql.format(**{n: n for n in names_in(sql)})
    if not needed:
        return body.strip()
    head = ",\n".join(f"{name} as ({text})" for name, text in needed.items())
    return f"with {head}\n{body.strip()}"
