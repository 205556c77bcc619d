"""Registry of entities: distinct entities, classes, foreign entities, dates, samples, pending work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grouptrace.functions.text import name_matches, number_matches
from grouptrace.functions.values import iso_timestamp
from grouptrace.operators.ranking import dense_row_id, distinct_first_seen
from grouptrace.operators.reshape import map_columns, matching_columns, pivot_sum, unpivot_known
from grouptrace.operators.sampling import sample_ids
from grouptrace.operators.tables import append_keys, pending
from grouptrace.sources.readers import tagged_union

ENTITY = ("registration_index", "corp_name", "status_id", "status_es")
ENTITY_DETAILED = (*ENTITY, "class_es", "class_en", "profit_type_es")

# Codes and labels in the registry's data.
FOR_PROFIT, NON_PROFIT, ACTIVE, MERGED = "Con Fines", "Sin Fines", "ACTIVA", "FUSIONADA"
FOREIGN_JURISDICTIONS = ("Foránea", "Foránea - No Estadounidense")
FOREIGN_US_TYPE = 2
EVENTS = ("effective", "expiration", "formed", "termination")


def registry_entities(records: DataFrame, columns: Sequence[str] = ENTITY) -> DataFrame:
    """Distinct entities out of raw hits; ``record_id`` is the first hit and gives first-seen order."""
    return distinct_first_seen(records, columns, "record_id")


def non_profits(entities: DataFrame, profit_type: str = NON_PROFIT, status: str = ACTIVE) -> DataFrame:
    return entities.filter((F.col("profit_type_es") == profit_type) & (F.col("status_es") == status))


def for_profits(entities: DataFrame, profit_type: str = FOR_PROFIT) -> DataFrame:
    """Any status."""
    return entities.filter(F.col("profit_type_es") == profit_type)


def cooperatives(entities: DataFrame, name: str = "corp_name") -> DataFrame:
    return entities.filter(F.col(name).ilike("%coop%"))


def foreign_entities(
    documents: DataFrame,
    status: str,
    link_prefix: str,
    jurisdictions: Sequence[str] = FOREIGN_JURISDICTIONS,
    us_type: int = FOREIGN_US_TYPE,
) -> DataFrame:
    """Foreign entities of one status with city, country and link, from nested documents."""
    corporation, location = "response.corporation", "response.mainLocation"
    flat = documents.select(
        F.col(f"{corporation}.corpRegisterIndex").alias("register_index"),
        F.col(f"{corporation}.corpName").alias("corp_name"),
        F.col(f"{corporation}.jurisdictionEs").alias("jurisdiction"),
        F.col(f"{corporation}.corporationJurisdictionTypeId").alias("jurisdiction_id"),
        F.col(f"{location}.foreignDomicileAddress.city").alias("foreign_city"),
        F.col(f"{location}.streetAddress.city").alias("local_city"),
        F.col(f"{corporation}.homeState").alias("home_state"),
        F.col(f"{location}.foreignDomicileAddress.province").alias("province"),
        F.col(f"{corporation}.statusEs").alias("status"),
    ).filter(F.col("jurisdiction").isin(*jurisdictions) & (F.col("status") == status))
    is_us = F.col("jurisdiction_id") == us_type
    return flat.select(
        "register_index",
        "corp_name",
        "jurisdiction",
        "jurisdiction_id",
        "foreign_city",
        "local_city",
        F.when(is_us, F.coalesce("foreign_city", "local_city")).alias("city"),
        F.when(is_us, F.lit("United States"))
        .otherwise(F.coalesce("home_state", "province"))
        .alias("country_name"),
        F.when(is_us, F.lit("US")).alias("country_code"),
        "status",
        F.concat(F.lit(link_prefix), "register_index").alias("link"),
    )


def detail_dates(documents: DataFrame) -> DataFrame:
    """Id, name and the four dates of every document; unusable date text becomes NULL."""
    corporation = "response.corporation"
    texts = documents.select(
        F.col(f"{corporation}.corpRegisterIndex").alias("registration_index"),
        F.col(f"{corporation}.corpName").alias("corporation_name"),
        F.col(f"{corporation}.effectiveDate").alias("date_effective"),
        F.col(f"{corporation}.dateFormed").alias("date_formed"),
        F.col(f"{corporation}.expirationDate").alias("date_expiration"),
        F.col(f"{corporation}.terminationDate").alias("date_termination"),
    )
    return map_columns(texts, matching_columns(texts, "^date_"), iso_timestamp)


def events_by_year(dates: DataFrame, events: Sequence[str] = EVENTS) -> DataFrame:
    """Events per year of the entities whose name says cooperative: one column per event, ordered by year."""
    chosen = cooperatives(dates, "corporation_name")
    columns = [c for c in matching_columns(chosen, "date_") if c != "registration_index"]
    long = unpivot_known(chosen, ["registration_index"], columns, "event_name", "event_date")
    counted = (
        long.select(
            F.regexp_replace("event_name", "^date_", "").alias("event_name"),
            F.year("event_date").alias("event_year"),
        )
        .groupBy("event_year", "event_name")
        .agg(F.count("*").alias("entities"))
    )
    return pivot_sum(counted, ["event_year"], "event_name", events, "entities").orderBy("event_year")


def document_summary(documents: DataFrame, link_prefix: str) -> DataFrame:
    corporation = "response.corporation"
    return documents.select(
        F.col(f"{corporation}.corpRegisterIndex").alias("register_index"),
        F.col(f"{corporation}.corpName").alias("corp_name"),
        F.col(f"{corporation}.statusEs").alias("status"),
        F.col(f"{corporation}.dateFormed").alias("date_formed"),
        F.col(f"{corporation}.expirationDate").alias("date_expiration"),
        F.col(f"{corporation}.terminationDate").alias("date_termination"),
        F.concat(F.lit(link_prefix), f"{corporation}.corpRegisterIndex").alias("link"),
    )


def detailed_sample(
    entities: DataFrame, documents: DataFrame, link_prefix: str, fraction: float = 0.05, seed: int = 1
) -> DataFrame:
    """A sample of ids with all their rows, joined to the detail documents; ids without one stay."""
    sampled = sample_ids(entities, "registration_index", fraction, seed).select("registration_index")
    details = sample_ids(document_summary(documents, link_prefix), "register_index", fraction, seed)
    # Documents are stored one per id, so the right side has no large keys.
    keyed = details.withColumn("registration_index", F.col("register_index"))
    return sampled.join(keyed, "registration_index", "left")


def sample_without_detail(sample: DataFrame) -> DataFrame:
    return sample.filter(F.col("register_index").isNull()).select("registration_index")


def decree_list(sources: dict[str, DataFrame], ordinal: str) -> DataFrame:
    """Decrees of several laws in the order of the sources and of the rows in them, with a 1-based id."""
    numbered = {law: df.withColumn("_law", F.lit(i)) for i, (law, df) in enumerate(sources.items())}
    decrees = tagged_union(numbered, "decree")
    return dense_row_id(decrees, "_law", ordinal, "decree_id").select(
        "decree_id", "decree", "grantee", "approval_date"
    )


def pending_collection(
    entities: DataFrame, collected: DataFrame, exclude: Sequence[str] = (), extra: Sequence[str] = ()
) -> DataFrame:
    """Cooperatives minus exclusions plus extra ids, without those already collected."""
    targets = cooperatives(entities).select("registration_index", "corp_name", "status_es")
    if exclude:
        targets = targets.filter(~F.col("registration_index").isin(*exclude))
    if extra:
        targets = append_keys(targets, extra, "registration_index")
    return pending(targets, collected, ["registration_index"])


def pending_related(merged: DataFrame, collected: DataFrame) -> DataFrame:
    """Merged foreign entities whose related entities are not collected yet."""
    targets = merged.select(F.col("register_index").alias("registration_index"), "corp_name", "status")
    return pending(targets, collected, ["registration_index"])


def collected_ids(documents: DataFrame) -> DataFrame:
    """Ids of landed documents out of their file names (``<id>.json``)."""
    return documents.select(F.regexp_replace("file_name", r"\.json$", "").alias("registration_index")).distinct()


def _found(records: DataFrame, condition: Column, first: int | None) -> DataFrame:
    """All matching records; with ``first`` only so many, in order of their number."""
    found = records.filter(condition)
    return found if first is None else found.orderBy("registration_number", "record_id").limit(first)


def name_search(records: DataFrame, mode: str, text: str, first: int | None = None) -> DataFrame:
    return _found(records, name_matches(F.col("corp_name"), mode, text), first)


def number_search(records: DataFrame, mode: str, number: int, first: int | None = None) -> DataFrame:
    return _found(records, number_matches(F.col("registration_number"), mode, number), first)
