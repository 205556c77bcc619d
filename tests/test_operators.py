import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from grouptrace.operators import joins, ranking, reshape, sampling, tables


def test_left_join_fanout_equals_left_join(spark, rows):
    rng = random.Random(3)
    # A third of both sides shares one key; some keys are NULL or have no partner.
    key = lambda: rng.choice([0, 0, None, *range(1, 8)])
    left = spark.createDataFrame([(key(), i) for i in range(60)], "k int, a int")
    right = spark.createDataFrame([(rng.choice([0, 0, None, 2, 3, 11]), i) for i in range(30)], "k int, b int")
    assert rows(joins.left_join_fanout(left, right, ["k"])) == rows(left.join(right, "k", "left"))


def test_anti_and_semi_join_split_the_rows(spark, rows):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k int, v string")
    right = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert rows(joins.anti_join(left, right, ["k"]), "v") == [("c",), ("d",)]
    assert rows(joins.semi_join(left, right, ["k"]), "v") == [("a",), ("b",)]


def test_distinct_on_takes_the_smallest_row(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z")], "k string, o int, v string")
    assert rows(ranking.distinct_on(df, ["k"], ["o"])) == [("a", 1, "y"), ("b", None, "z")]


def test_first_seen_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "name string, record_id int")
    got = ranking.distinct_first_seen(df, ["name"], "record_id").orderBy("record_id").collect()
    assert [tuple(r) for r in got] == [("b", 1), ("a", 2)]


def test_top_k_breaks_ties_by_order(spark, rows):
    df = spark.createDataFrame([("q", 1.0, 2), ("q", 1.0, 1), ("q", 0.5, 3)], "q string, s double, id int")
    best = ranking.top_k(df, ["q"], [F.desc("s"), F.asc("id")], 2)
    assert rows(best, "id", "rank") == [(1, 1), (2, 2)]


def test_dense_row_id(spark):
    pairs = [("b", i) for i in (0, 1, 2, 7, 8)] + [("a", i) for i in range(10)]
    df = spark.createDataFrame(pairs, "src string, pos int").repartition(4)
    got = ranking.dense_row_id(df, "src", "pos", "id").orderBy("id").collect()
    assert [(r.id, r.src, r.pos) for r in got] == [(i, *p) for i, p in enumerate(sorted(pairs), start=1)]
    plan = ranking.dense_row_id(df, "src", "pos", "id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_spread_row_number_with_a_large_group(spark, groups):
    # Group 0 holds two thirds of the rows and is cut over several slices; one group is NULL.
    data = [(None if i % 30 == 29 else 0 if i % 3 else i % 7, (i * 37) % 500) for i in range(500)]
    df = spark.createDataFrame(data, "g int, v int")
    got = ranking.spread_row_number(df, [F.desc("v")], "n", groups, slices=7).collect()
    expected, counts = {}, {}
    for g, v in sorted(data, key=lambda r: -r[1]):
        group = g if groups else "all"
        counts[group] = counts.get(group, 0) + 1
        expected[(g, v)] = counts[group]
    assert len(got) == 500
    assert {(r.g, r.v): r.n for r in got} == expected


def test_reshape_round_trip_keeps_sums(spark, rows):
    df = spark.createDataFrame([(1, 5, None), (2, 7, 9)], "id int, date_a int, date_b int")
    assert reshape.matching_columns(df, "date_*") == ["date_a", "date_b"]
    long = reshape.unpivot_known(df, ["id"], ["date_a", "date_b"], "name", "value")
    assert rows(long) == [(1, "date_a", 5), (2, "date_a", 7), (2, "date_b", 9)]
    wide = reshape.pivot_sum(long, ["id"], "name", ["date_a", "date_b"], "value")
    assert rows(wide) == [(1, 5, None), (2, 7, 9)]


def test_transpose_and_columns(spark, rows):
    df = spark.createDataFrame([(2020, "1", "2"), (2021, "3", "4")], "y int, a string, b string")
    df = df.withColumn("y", F.col("y").cast("string"))
    assert rows(reshape.transpose_panel(df, "y", ["2020", "2021"], ["a", "b"])) == [("a", "1", "3"), ("b", "2", "4")]
    assert reshape.move_first(df, "b").columns == ["b", "y", "a"]
    with pytest.raises(ValueError):
        reshape.rename(df, {"missing": "x"})
    assert reshape.rename(df, {"a": "c"}).columns == ["y", "c", "b"]


def test_cross_with_list(spark, rows):
    df = spark.createDataFrame([("x",)], "p string")
    assert rows(reshape.cross_with_list(df, [2024, 2025], "year")) == [("x", 2024), ("x", 2025)]


def test_insert_if_absent(spark, rows):
    table = spark.createDataFrame([("g", "1", "old")], "grantee string, idx string, name string")
    new = spark.createDataFrame([("g", "1", "x"), ("g", "2", "b"), ("g", "2", "a")], "grantee string, idx string, name string")
    once = tables.insert_if_absent(table, new, ["grantee", "idx"])
    assert rows(once) == [("g", "1", "old"), ("g", "2", "a")]
    assert rows(tables.insert_if_absent(once, new, ["grantee", "idx"])) == rows(once)


def test_upsert_overwrites_with_null(spark, rows):
    table = spark.createDataFrame([("k", "n", 1, "x")], "k string, name string, s int, ok string")
    new = spark.createDataFrame([("k", "other", None), ("l", "new", "y")], "k string, name string, ok string")
    assert rows(tables.upsert(table, new, ["k"], ["ok"])) == [("k", "n", 1, None), ("l", "new", None, "y")]


def test_upsert_rejects_repeated_keys(spark):
    table = spark.createDataFrame([("k", "x")], "k string, ok string")
    new = spark.createDataFrame([("a", "1"), ("a", "2")], "k string, ok string")
    with pytest.raises(PySparkException):
        tables.upsert(table, new, ["k"], ["ok"]).collect()


def test_refresh_keeps_unmatched_rows(spark, rows):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, s int")
    source = spark.createDataFrame([("a", None)], "k string, s int")
    assert rows(tables.refresh_from(table, source, ["k"], ["s"])) == [("a", None), ("b", 2)]


def test_append_keys_adds_each_once(spark, rows):
    work = spark.createDataFrame([("1", "n")], "id string, name string")
    assert rows(tables.append_keys(work, ["1", "2", "2"], "id")) == [("1", "n"), ("2", None)]


def test_samples_repeat(spark, rows):
    df = spark.range(2000).selectExpr("cast(id as string) as id")
    first = rows(sampling.sample_ids(df, "id", 0.05))
    assert first == rows(sampling.sample_ids(df.repartition(7), "id", 0.05))
    assert 60 < len(first) < 140
    assert len(sampling.sample_rows(df, "id", 20).collect()) == 20


def test_refresh_never_adds_rows(spark, rows):
    table = spark.createDataFrame([("k", 1), ("m", 2)], "id string, v int")
    source = spark.createDataFrame([("k", None), ("k", 9), ("k", 7)], "id string, v int")
    assert rows(tables.refresh_from(table, source, ["id"], ["v"])) == [("k", 7), ("m", 2)]


def test_distinct_on_prefers_known_values(spark, rows):
    df = spark.createDataFrame([("k", None, 1), ("k", "b", 2), ("m", None, 3)], "id string, a string, b int")
    assert rows(ranking.distinct_on(df, ["id"], ["a"])) == [("k", "b", 2), ("m", None, 3)]


def test_versions_of_a_keyed_table(spark, rows, tmp_path):
    path, schema = str(tmp_path / "versions"), "id string, v int"
    assert tables.versions(spark, path) == []
    for v in (1, 2):
        tables.write_version(spark.createDataFrame([("k", v)], schema), path, ["id"])
    assert rows(tables.read_version(spark, path, schema)) == [("k", 2)]
    assert rows(tables.read_version(spark, path, schema, 0)) == [("k", 1)]
    with pytest.raises(Exception, match="duplicate key"):
        tables.write_version(spark.createDataFrame([("k", 1), ("k", 2)], schema), path, ["id"])
    assert tables.versions(spark, path) == [0, 1]
