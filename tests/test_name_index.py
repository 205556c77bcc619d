import random

import pytest

from grouptrace.functions.text import name_matches
from grouptrace.operators import name_index
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 4))) for _ in range(300)]
    texts += ["", None, "Á.B, c", "  ab  ba ", "A%B_c", "abcabcabcabc x", "ÑANDÚ", "ab ab"]
    return spark.createDataFrame(list(enumerate(texts)), "id int, name string")


def searches(rng):
    found = []
    for mode in name_index.MODES:
        found += [(mode, "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 12)))) for _ in range(25)]
        found += [(mode, t) for t in ("", " ", "ab", "%", "_", "b_c", "Á.B, c", "ab ab", "ñandu", "ÑAND", None, "abcabcabc")]
    return found + found[:5]


def test_equal_to_a_scan(spark, names):
    asked = searches(random.Random(4))
    index = name_index.build_name_index(names, "name", 4)
    table = spark.createDataFrame(asked, "mode string, text string")
    got = sorted((r.mode, r.text, r.id) for r in name_index.search_names(index, table).collect())
    want = []
    for mode, text in sorted({a for a in asked if a[1] is not None}):
        where = F.contains(F.lower("name"), F.lit(text.lower())) if mode == "contains" else name_matches(F.col("name"), mode, text)
        want += [(mode, text, r.id) for r in names.filter(where).select("id").collect()]
    assert got == sorted(want) and len(got) > 500


def test_search_columns_are_kept_and_unknown_modes_fail(spark, names):
    index = name_index.build_name_index(names, "name", 4)
    table = spark.createDataFrame([(7, "contains", "ÑAN"), (8, "contains", "ÑAN")], "q int, mode string, text string")
    got = name_index.search_names(index, table, ["q"])
    assert got.columns == ["q", "id", "name"]
    assert sorted((r.q, r.name) for r in got.collect()) == [(7, "ÑANDÚ"), (8, "ÑANDÚ")]
    with pytest.raises(Exception, match="unknown search mode"):
        name_index.search_names(index, spark.createDataFrame([("sounds_like", "x")], "mode string, text string")).collect()


def test_only_the_rarest_list_is_joined(spark):
    """"the" is in every name, "quux" in three: the search's candidates are those of a rare gram."""
    names = spark.range(5000).selectExpr("id", "concat('the ', if(id < 3, 'quux', 'word'), ' ', id) as name")
    index = name_index.build_name_index(names, "name", 4)
    table = spark.createDataFrame([("contains", "the quux"), ("all_words", "quux the")], "mode string, text string")
    found = name_index.search_names(index, table)
    assert found.count() == 6
    asked = name_index._needed_terms(table)
    terms = asked.select("mode", F.explode("_terms").alias("term")).join(index.sizes, "term").groupBy("mode").agg(F.min("names").alias("n"))
    assert {r["n"] for r in terms.collect()} == {3}


def test_lists_are_read_without_a_shuffle(spark, names):
    index = name_index.build_name_index(names, "name", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sizes = index.lists.join(index.sizes, "term")
        assert "Exchange" not in sizes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_candidates_are_not_compared_with_each_other(spark):
    """No distinct over candidates, and yet no hit comes twice."""
    names = spark.range(300).selectExpr("id", "concat('red blue ', id % 7, ' red') as name")
    index = name_index.build_name_index(names, "name", 4)
    table = spark.createDataFrame([("any_word", "none 3 blue red"), ("any_word", "6 5 5"), ("contains", "ue 2")], "mode string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = name_index.search_names(index, table)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r.mode, r.text, r.id) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = [("any_word", "none 3 blue red", i) for i in range(300)] + [("any_word", "6 5 5", i) for i in range(300) if i % 7 in (5, 6)]
    assert got == sorted(want + [("contains", "ue 2", i) for i in range(300) if i % 7 == 2])
    keys = [line.split("Aggregate [")[1].split("]")[0] for line in plan.split("\n") if "Aggregate [" in line]
    assert keys and not any("name_no" in k for k in keys)
