"""Numbers, flags, dates and display formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Revenue threshold in thousands of EUR; tokens that stand for a missing value in exports.
REVENUE_THRESHOLD_TH = 750e3
NULL_TOKENS = ("n.a.", "#N/A")

# Shape of a date-time in the registry's documents.
ISO_SECONDS_PATTERN = (
    "([0-9]{4})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9])"
)
ISO_SECONDS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def null_if_token(col: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """NULL where the text is one of the missing-value tokens."""
    return F.when(~col.isin(*tokens), col)


def exact_sum(col: Column) -> Column:
    """Sum of doubles that does not depend on the order of the rows."""
    return F.sum(col.cast("decimal(38,9)")).cast("double")


def known_count(values: Column) -> Column:
    return F.size(F.array_compact(values))


def over_count(values: Column, threshold: float, inclusive: bool) -> Column:
    """How many known values reach (``inclusive``) or exceed the threshold."""
    if inclusive:
        return F.size(F.filter(values, lambda v: v >= threshold))
    return F.size(F.filter(values, lambda v: v > threshold))


def yes_no(col: Column) -> Column:
    """Yes -> true, No -> false, anything else -> NULL."""
    return F.when(col == "Yes", F.lit(True)).when(col == "No", F.lit(False))


def yes_no_text(flag: Column) -> Column:
    return F.when(flag, F.lit("Yes")).when(~flag, F.lit("No"))


def yes_no_spanish(col: Column) -> Column:
    return F.when(col == "Yes", F.lit("Sí")).when(col == "No", F.lit("No"))


def any_true(col: Column) -> Column:
    """Aggregate: true when any row is true; false when none is, also when all are NULL."""
    return F.coalesce(F.bool_or(col), F.lit(False))


def iso_timestamp(text: Column) -> Column:
    """The first ISO date-time inside the text; NULL when there is none or it is no real date."""
    found = F.regexp_extract(F.replace(text, F.lit('"'), F.lit("")), ISO_SECONDS_PATTERN, 0)
    return F.try_to_timestamp(found, F.lit(ISO_SECONDS_FORMAT))


def zone_iso_text(utc_instant: Column, zone: str, offset: str) -> Column:
    """An instant as ISO text with second precision in a zone of constant offset."""
    local = F.from_utc_timestamp(utc_instant, zone)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def money_millions(col: Column) -> Column:
    """``$96,666.3M``; a whole number of millions keeps the point: ``$39,192.M``."""
    text = F.format_number(F.round(col / 1e6, 1), 1)
    return F.concat(F.lit("$"), F.regexp_replace(text, r"\.0$", "."), F.lit("M"))


def percent(col: Column) -> Column:
    return F.concat(F.format_number(F.round(col * 100, 2), 2), F.lit("%"))


def whole_number(col: Column) -> Column:
    return F.format_number(F.round(col, 0), 0)
