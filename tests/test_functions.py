import datetime

import pytest
from pyspark.sql import functions as F

from grouptrace.functions import text, values
from grouptrace.sources.schemas import batch_header


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, expected", [
    (" Ñandú, Inc. ", "nandu inc"),
    ("nandu inc", "nandu inc"),
    ("foo .", "foo "),  # trimmed before the full stop goes
    ("Straße", "straße"),
    ("é", "e"),
    ("É", "e"),
    ("Ørsted łódź", "ørsted łodz"),
    ("A.B.C., Corp", "abc corp"),
    (None, None),
])
def test_normalize_name(spark, given, expected):
    assert one(spark, text.normalize_name(F.lit(given).cast("string"))) == expected


def test_normalizing_twice_changes_only_outer_spaces(spark):
    once = text.normalize_name(F.lit(" Çedilla & Co . "))
    assert one(spark, text.normalize_name(once)) == one(spark, F.trim(once))


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("Über-Gas 24/7 s.a., Öl"))) == ["uber", "gas", "sa", "ol"]
    assert one(spark, text.tokens(F.lit(" 12 "))) == []


@pytest.mark.parametrize("given, expected", [
    ("pr/15-112", "15-112"), ("rp/pr15-112", "15-112"), ("15-112", "15-112"), (None, None),
])
def test_strip_leading_chars_is_a_set(spark, given, expected):
    assert one(spark, text.strip_leading_chars(F.lit(given).cast("string"), "pr/")) == expected


def test_split_at_is_null_beyond_the_end(spark):
    assert one(spark, text.split_at(F.lit("us"), "_", 2)) is None
    assert one(spark, F.upper(text.split_at(F.lit("us_de"), "_", 2))) == "DE"


@pytest.mark.parametrize("mode, wanted, names", [
    ("begins_with", "red w", ["RED WINE, INC."]),
    ("Comenzando con", "red", ["RED WINE, INC.", "RED. INC"]),
    ("exact", "Red Inc", ["RED. INC"]),
    ("any_word", "wine corp", ["BLUE CORP", "RED WINE, INC."]),
    ("all_words", "inc. red", ["RED WINE, INC.", "RED. INC"]),
])
def test_name_matches(spark, mode, wanted, names):
    df = spark.createDataFrame([("RED WINE, INC.",), ("BLUE CORP",), ("RED. INC",)], "n string")
    assert sorted(r.n for r in df.filter(text.name_matches(F.col("n"), mode, wanted)).collect()) == names


@pytest.mark.parametrize("mode, expected", [
    ("equal", [5]), ("greater", [6]), ("less", [4]), ("at_least", [5, 6]), ("Menor o igual que", [4, 5]),
])
def test_number_matches(spark, mode, expected):
    df = spark.range(4, 7)
    assert [r.id for r in df.filter(text.number_matches(F.col("id"), mode, 5)).orderBy("id").collect()] == expected


def test_unknown_modes_are_errors():
    with pytest.raises(ValueError):
        text._mode("sounds_like", text.NAME_MODES)
    with pytest.raises(ValueError):
        text._mode("between", text.NUMBER_MODES)


def test_null_tokens_keep_the_country_code_na(spark):
    df = spark.createDataFrame([("NA",), ("n.a.",), ("#N/A",), (None,), ("1",)], "c string")
    got = [r.c for r in df.select(values.null_if_token(F.col("c")).alias("c")).collect()]
    assert got == ["NA", None, None, None, "1"]


@pytest.mark.parametrize("given, expected", [
    ('"1999-01-02T03:04:05"', datetime.datetime(1999, 1, 2, 3, 4, 5)),
    ("1999-01-02T03:04:05.123Z", datetime.datetime(1999, 1, 2, 3, 4, 5)),
    ("", None), ("n/a", None), ("1999-02-31T00:00:00", None),
])
def test_iso_timestamp(spark, given, expected):
    assert one(spark, values.iso_timestamp(F.lit(given))) == expected


@pytest.mark.parametrize("given, shown", [
    (39192.0e6, "$39,192.M"), (96666.3e6, "$96,666.3M"), (393.44e6, "$393.4M"), (100.0, "$0.M"),
])
def test_money_millions(spark, given, shown):
    assert one(spark, values.money_millions(F.lit(given))) == shown


def test_percent_and_counts(spark):
    assert one(spark, values.percent(F.lit(0.0100379))) == "1.00%"
    assert one(spark, values.whole_number(F.lit(58777.0))) == "58,777"


def test_zone_time(spark):
    stamp = values.zone_iso_text(F.to_timestamp(F.lit("2024-07-01 12:30:15.9")), "America/Puerto_Rico", "-04:00")
    assert one(spark, stamp) == "2024-07-01T08:30:15-04:00"


def test_snake_case_and_batch_headers():
    assert text.snake_case("registrationIndex") == "registration_index"
    assert text.snake_case("profitTypeEs") == "profit_type_es"
    assert batch_header("Operating revenue (Turnover)\nth EUR 2019") == "operating_revenue_year_2019_eur_th"
    assert batch_header("Operating revenue (Turnover)\nth EUR Year - 3") == "operating_revenue_year_3_eur_th"
    assert batch_header("Operating revenue (Turnover)\nEUR Last avail. yr") == "operating_revenue_year_last_eur"
    assert batch_header("Own ID") == "own_id"
    assert batch_header("Matched BvD ID") == "matched_company_id"
    assert batch_header("Other ID number") == "other_id_number"
    assert batch_header("Anything else (x)") == "anything_else_x"


def test_unicode_spaces_are_trimmed_tabs_stay(spark):
    from grouptrace.functions.text import normalize_name

    names = ["\u00a0Acme Inc.\u2003", " Acme Inc. ", "Acme\u00a0Inc.", "\tAcme Inc."]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(normalize_name("n")).collect()]
    assert got == ["acme inc", "acme inc", "acme\u00a0inc", "\tacme inc"]
