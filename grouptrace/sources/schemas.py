"""Explicit schemas of the inputs, as DDL text."""

from __future__ import annotations

import re

from grouptrace.functions.text import snake_case

REGISTRY = (
    "record_id bigint, request_id bigint, business_entity_id bigint, registration_number bigint, "
    "registration_index string, corp_name string, class_es string, class_en string, "
    "profit_type_es string, profit_type_en string, status_id bigint, status_es string, status_en string"
)
REQUEST_LOG = "request_id bigint, request_sent_timestamp string"

# The fields of what a search page delivers, before the request id and the record id are attached.
PAGE_RECORD = (
    "businessEntityId bigint, registrationNumber bigint, registrationIndex string, corpName string, "
    "classEs string, classEn string, profitTypeEs string, profitTypeEn string, "
    "statusId bigint, statusEs string, statusEn string"
)

# The fields of an entity document.
ENTITY_DOCUMENT = (
    "response struct<"
    "corporation: struct<corpRegisterIndex: string, corpName: string, jurisdictionEs: string, "
    "corporationJurisdictionTypeId: int, homeState: string, statusEs: string, classEn: string, "
    "effectiveDate: string, dateFormed: string, expirationDate: string, terminationDate: string>, "
    "mainLocation: struct<foreignDomicileAddress: struct<city: string, province: string>, "
    "streetAddress: struct<city: string>>>"
)

# The fields of a company document.
COMPANY_DOCUMENT = (
    "results struct<company: struct<company_number: string, name: string, jurisdiction_code: string, "
    "branch: string, registered_address: struct<locality: string>, number_of_employees: bigint, "
    "home_company: struct<name: string, jurisdiction_code: string, company_number: string>, "
    "ultimate_controlling_company: struct<name: string>, controlling_entity: struct<name: string>, "
    "ultimate_beneficial_owners: array<struct<name: string>>>>"
)

NETWORK = (
    "row_number bigint, company_name string, company_id string, parent_id string, branch_indicator string, "
    "country string, country_iso_code string, region_in_country string, state string"
)

COUNTRIES = (
    "country string, `alpha-2` string, `alpha-3` string, `country-code` int, `iso_3166-2` string, "
    "region string, `sub-region` string, `intermediate-region` string, `region-code` int, "
    "`sub-region-code` int, `intermediate-region-code` int, pillar2 string"
)
COUNTRY_NAMES = "code string, country string"
ADOPTION = (
    "country string, year string, pillar2 string, iir string, utpr string, qdmtt string"
)

# Headers of the exported batches. Revenue columns, one for each year, follow the pattern below.
BATCH_HEADERS = {
    "Own ID": "own_id",
    "Company name": "company_name",
    "Company name Latin alphabet": "company_name",
    "City": "city",
    "City\nLatin Alphabet": "city",
    "Country": "country",
    "Country ISO code": "country_code",
    "State or province (in US or Canada)": "state",
    "Postcode\nLatin Alphabet": "postcode",
    "Region in country": "region_in_country",
    "Branch indicator": "branch_indicator",
    "Identifier": "identifier",
    "Score": "score",
    "Matched BvD ID": "matched_company_id",
    "Matched company name": "matched_company_name",
    "BvD ID number": "company_id",
    "Model data - Global parent bvdid": "parent_id",
    "Model data - Global parent operating revenue\nth EUR": "parent_operating_revenue_eur_th",
    "NAICS 2022, core code (4 digits)": "naics_2022_core_code",
    "NAICS 2022, core code - description": "naics_2022_core_code_description",
    "Closing date\nDate of the last available value for Operating revenue (Turnover)":
        "closing_date_operating_revenue",
}
_REVENUE = re.compile(r"^Operating revenue \(Turnover\)\s(th )?EUR (Last avail\. (?:value|yr)|Year - (\d)|(\d{4}))$")


def batch_header(header: str) -> str:
    """Canonical column name of a batch header; unknown headers become snake case."""
    if header in BATCH_HEADERS:
        return BATCH_HEADERS[header]
    if found := _REVENUE.match(header):
        year = found[3] or found[4] or "last"
        return f"operating_revenue_year_{year}_eur" + ("_th" if found[1] else "")
    return re.sub(r"\W+", "_", snake_case(header)).strip("_")
