"""Tables kept between runs: buckets, states, sets, sums, compacted documents."""

import random

import pytest
from pyspark.sql import functions as F

from grouptrace.operators import id_sets, joins, sampling, tables
from grouptrace.plans import network, panel
from grouptrace.sources import readers
from grouptrace.streaming import documents, ingest
from tests.test_plans import final_plan, plan


def files_in(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def bucketed(spark, path, rows, schema):
    df = spark.createDataFrame(rows, schema)
    tables.create_buckets(df, str(path), ["k"], 8)
    return df.schema


def test_untouched_buckets_keep_their_files(spark, rows, tmp_path):
    schema = bucketed(spark, tmp_path, [(f"k{i}", i, "a") for i in range(200)], "k string, n long, s string")
    before = files_in(tmp_path / "rows")
    edits = spark.createDataFrame([("k1", "x"), ("k2", "a"), ("new", "y")], "k string, s string")
    changed = tables.upsert_buckets(spark, str(tmp_path), schema, edits, ["k"], ["s"], 8, 0)
    after = files_in(tmp_path / "rows")
    assert 1 <= len(changed) <= 2
    kept = {f: t for f, t in before.items() if int(f.split("/")[0].removeprefix("bucket=")) not in changed}
    assert len(kept) >= 6 and all(after.get(f) == t for f, t in kept.items())
    expected = [(f"k{i}", i, "x" if i == 1 else "a") for i in range(200)] + [("new", None, "y")]
    assert rows(tables.read_buckets(spark, str(tmp_path), schema)) == sorted(expected, key=repr)
    log = tables.bucket_changes(spark, str(tmp_path), schema)
    assert rows(log, "k", "n", "s", "added", "run") == [("k1", 1, "x", False, 0), ("new", None, "y", True, 0)]


def test_upserts_equal_the_plain_one_and_can_be_repeated(spark, rows, tmp_path):
    rng = random.Random(1)
    stored = [(None if i == 7 else f"k{i}", i % 5, rng.choice("ab")) for i in range(60)]
    schema = bucketed(spark, tmp_path, stored, "k string, n long, s string")
    whole = spark.createDataFrame(stored, schema)
    for run in range(3):
        new = [(f"k{rng.randrange(90)}", rng.choice(["a", "b", None])) for _ in range(15)]
        edits = spark.createDataFrame(sorted(dict(new).items()), "k string, s string")
        whole = tables.upsert(whole, edits, ["k"], ["s"])
        first = tables.upsert_buckets(spark, str(tmp_path), schema, edits, ["k"], ["s"], 8, run)
        log = rows(tables.bucket_changes(spark, str(tmp_path), schema))
        assert tables.upsert_buckets(spark, str(tmp_path), schema, edits, ["k"], ["s"], 8, run) == first
        assert rows(tables.read_buckets(spark, str(tmp_path), schema)) == rows(whole)
        assert rows(tables.bucket_changes(spark, str(tmp_path), schema)) == log
    assert rows(tables.bucket_changes(spark, str(tmp_path), schema, 2)) == []


def test_a_run_that_failed_between_log_and_buckets_is_finished(spark, rows, tmp_path, monkeypatch):
    schema = bucketed(spark, tmp_path, [("a", 1, "x"), ("b", 2, "x")], "k string, n long, s string")
    edits = spark.createDataFrame([("a", "y"), ("c", "z")], "k string, s string")
    changes = tables.bucket_changes
    monkeypatch.setattr(tables, "bucket_changes", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        tables.upsert_buckets(spark, str(tmp_path), schema, edits, ["k"], ["s"], 8, 5)
    monkeypatch.setattr(tables, "bucket_changes", changes)
    assert rows(tables.read_buckets(spark, str(tmp_path), schema)) == [("a", 1, "x"), ("b", 2, "x")]
    tables.upsert_buckets(spark, str(tmp_path), schema, edits, ["k"], ["s"], 8, 5)
    assert rows(tables.read_buckets(spark, str(tmp_path), schema)) == [("a", 1, "y"), ("b", 2, "x"), ("c", None, "z")]
    assert rows(tables.bucket_changes(spark, str(tmp_path), schema), "k", "added") == [("a", False), ("c", True)]


def test_new_keys_of_another_type_find_their_bucket(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    tables.create_buckets(df, str(tmp_path), ["k"], 4)
    tables.upsert_buckets(spark, str(tmp_path), df.schema, spark.createDataFrame([(2, "c")], "k int, s string"), ["k"], ["s"], 4, 0)
    assert rows(tables.read_buckets(spark, str(tmp_path), df.schema)) == [(1, "a"), (2, "c")]


PAGE = "record_id long, request_id long, registration_number long, corp_name string"
CONTENT = ["registration_number", "corp_name"]


def land(spark, path, records):
    spark.createDataFrame(records, PAGE).coalesce(1).write.mode("append").parquet(path)


def test_state_lasts_over_restarts(spark, rows, tmp_path):
    landing, store, progress = (str(tmp_path / x) for x in ("landing", "store", "progress"))
    schema = spark.createDataFrame([], PAGE).schema
    run = lambda: ingest.ingest_stateful(spark, landing, store, progress, schema, CONTENT, 1)
    land(spark, landing, [(5, 1, 10, "a"), (3, 1, 10, "a"), (4, 1, 11, None), (9, 1, 11, None)])
    assert rows(run()) == [(3, 1, 10, "a"), (4, 1, 11, None)]
    land(spark, landing, [(1, 2, 10, "a"), (6, 2, 10, "b"), (2, 2, 11, None), (7, 2, 12, "c")])
    land(spark, landing, [(8, 3, 12, "c"), (9, 3, 13, "d")])
    expected = [(3, 1, 10, "a"), (4, 1, 11, None), (6, 2, 10, "b"), (9, 3, 13, "d")]
    got = rows(run())
    # Of the two files of the second run either may be the first.
    assert sorted(r[2:] for r in got) == sorted([*(r[2:] for r in expected), (12, "c")], key=lambda r: (r[0], r[1] or ""))
    assert set(expected) < set(got)
    assert rows(run()) == got


def test_a_batch_never_reads_the_store(spark, tmp_path):
    landing, store, progress = (str(tmp_path / x) for x in ("landing", "store-of-records", "progress"))
    schema = spark.createDataFrame([], PAGE).schema
    for number in (1, 2):
        land(spark, landing, [(number, 1, number, "a")])
        query = ingest.start_stateful_ingest(spark, landing, store, progress, schema, CONTENT)
        query.awaitTermination()
        text = query._jsq.explainInternal(False)
        assert "landing" in text or "FileScan" in text or "Scan" in text
        assert "store-of-records" not in text and "Join" not in text
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2


def test_state_of_many_contents_needs_no_python_call_for_each(spark, rows, tmp_path, monkeypatch):
    """Copies of a content come in several files and pages of one batch; the smallest of them is stored, nulls are equal."""
    monkeypatch.setattr(ingest, "REDUCE_ROWS", 5)
    rng = random.Random(9)
    landing, store, progress = (str(tmp_path / x) for x in ("landing", "store", "progress"))
    schema = spark.createDataFrame([], PAGE).schema
    first: dict = {}
    for batch in range(2):
        ids = rng.sample(range(1000 * batch, 1000 * batch + 400), 300)
        now = [(i, batch, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b", "ö", *"cdefgh"[:3 + 3 * batch]])) for i in ids]
        now += [(None, batch, 9, "null id"), (None, batch, 1, "a")]
        spark.createDataFrame(now, PAGE).repartition(3).write.mode("append").parquet(landing)
        query = ingest.start_stateful_ingest(spark, landing, store, progress, schema, CONTENT)
        query.awaitTermination()
        found: dict = {}
        for r in now:
            found[r[2:]] = min(found.get(r[2:], r), r, key=lambda r: (r[0] is None, r[0]))
        first = found | first
    assert rows(spark.read.schema(schema).parquet(store)) == sorted(first.values(), key=repr)
    plan = query._jsq.explainInternal(False)
    assert "StreamingDeduplicate" in plan and "FlatMapGroups" not in plan
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == len(first)


def test_new_documents_only(spark, rows, tmp_path):
    folder, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()
    runs = []
    for part in (range(3), range(3, 5), range(0)):
        for i in part:
            (tmp_path / "in" / f"{i}.json").write_text(f'{{"id": {i}}}')
        query = documents.start_compacting(spark, folder, "id long", target, progress)
        query.awaitTermination()
        runs.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert runs == [3, 2, 0]
    compact = documents.compact_new_documents(spark, folder, "id long", target, progress)
    assert rows(compact) == [(i, f"{i}.json") for i in range(5)]


def test_sets_count_distinct_ids(spark, rows, tmp_path):
    rng = random.Random(2)
    seen = {"a": set(), "b": set()}
    for batch in (0, 1, 1, 2):
        rng.seed(batch)
        members = [(rng.choice("ab"), rng.choice([None, *(f"id{i}" for i in range(batch * 20, batch * 20 + 60))])) for _ in range(150)]
        id_sets.add_to_sets(spark.createDataFrame(members, "measure string, id string"), str(tmp_path), batch)
        for measure, i in members:
            seen[measure] |= {i} - {None}
    assert rows(id_sets.set_sizes(spark, str(tmp_path))) == [(m, len(x)) for m, x in sorted(seen.items())]
    numbers = [r.number for r in spark.read.parquet(f"{tmp_path}/ids").collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))


def test_stored_profile(spark, rows, tmp_path):
    table = [(None if i % 13 == 0 else f"C{i % 40}", f"C{i % 7}", "PR" if i % 5 == 0 else None) for i in range(120)]
    df = spark.createDataFrame(table, "company_id string, parent_id string, state string")
    for batch in range(3):
        network.add_profile_batch(df.filter((F.hash("company_id", "parent_id") % 3 + 3) % 3 == batch), str(tmp_path), batch)
    assert rows(network.stored_profile(spark, str(tmp_path))) == rows(network.network_profile(df))
    empty = str(tmp_path / "empty")
    network.add_profile_batch(df.limit(0), empty, 0)
    assert rows(network.stored_profile(spark, empty)) == [(0, 0, 0, 0, 0)]


def test_totals_of_all_choices(spark, rows, tmp_path):
    facts = spark.createDataFrame([(2001, "x", 0.1), (2001, "y", 0.2), (2002, "x", 0.3), (2002, None, 1e12)], "yr int, c string, v double")
    for batch, where in enumerate(("yr = 2001", "yr = 2002", "yr = 2002")):
        panel.add_partial_totals(facts.filter(where), str(tmp_path), min(batch, 1), ["yr", "c"], ["v"])
    totals = panel.totals_all(spark.read.parquet(str(tmp_path)).drop("batch"), ["yr", "c"], ["v"])
    assert rows(totals.filter("level = 3"), "v") == [(1e12 + 0.6,)]
    for level, by in ((0, ["yr", "c"]), (1, ["yr"]), (2, ["c"])):
        assert rows(totals.filter(f"level = {level}"), *by, "v") == rows(panel.totals_by(facts, by, ["v"]))
    assert plan(totals).count("FileScan") == 1


def shuffled_bytes(df):
    """Bytes that the exchanges of an executed plan wrote."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        size = node.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
        children = node.children()
        return size + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_bitmap_anti_join(spark, rows, tmp_path):
    spark.range(20_000).selectExpr("id % 9000 as k", "if(id % 100 = 0, null, concat('t', id % 7)) as t", "repeat('x', 50) as body").write.parquet(str(tmp_path / "l"))
    left = spark.read.parquet(str(tmp_path / "l"))
    right = spark.range(300).selectExpr("id * 29 as k", "concat('t', id % 7) as t", "1 as extra")
    right = right.unionByName(right.selectExpr("k", "cast(null as string) as t", "extra"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plain, thinned = joins.anti_join(left, right, ["k", "t"]), joins.bitmap_anti_join(left, right, ["k", "t"], 1 << 18)
        assert rows(thinned) == rows(plain)
        assert shuffled_bytes(thinned) < shuffled_bytes(plain) / 4
        # A bitmap that is full spares nothing, and changes nothing.
        assert rows(joins.bitmap_anti_join(left, right, ["k", "t"], 64)) == rows(plain)
        assert rows(joins.bitmap_anti_join(left, right.limit(0), ["k", "t"])) == rows(left)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joins.key_bitmap(right, ["k", "t"]).count() <= joins.BITMAP_BITS / joins.BITMAP_ROW_BITS


def test_bucketed_joins_do_not_shuffle(spark, rows):
    local = spark.range(400).selectExpr(
        "concat('c', id) as company_number", "concat('p', id % 50) as parent_id", "concat('P', id % 50) as parent_company_name",
        "if(id % 50 % 4 = 0, null, concat('N', id % 50 % 3)) as parent_country_iso_code", "if(id % 50 = 1, 'PR', null) as parent_state")
    revenue = spark.range(45).selectExpr("concat('p', id) as parent_id", "cast(id as double) as filial_operating_revenue_max")
    answers = spark.range(90).selectExpr(
        "concat('p', id % 30) as parent_id", "concat('N', id % 3) as parent_tax_country", "cast(2024 + id div 30 as int) as year",
        "id % 4 = 0 as parent_subject_to_rule")
    adoption = spark.range(6).selectExpr(
        "concat('N', id % 3) as country_code", "concat('Country ', id % 3) as country", "cast(2024 + id div 3 as int) as year",
        "'Yes' as pillar2", "'No' as iir", "'Yes' as qdmtt")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 1)
    try:
        stored = network.stored_by_parent(local, revenue, answers, 4)
        small = F.broadcast(adoption)
        status = network.group_rule_status_by_parent(stored[0], small, stored[1], stored[2])
        text = final_plan(status)
        assert "Exchange hashpartitioning" not in text and text.count("SortMergeJoin") == 2
        assert rows(status) == rows(network.group_rule_status(local, adoption, revenue, answers))
        assert "Exchange" not in plan(stored[0].join(stored[1], "parent_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_sample_of_files_opens_no_others(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.json").write_text(f'{{"id": {i}}}')
    sample = sampling.sample_files(readers.read_json_documents(spark, str(tmp_path), "id long"), 0.25)
    ids = sorted(r.id for r in sample.collect())
    names = spark.createDataFrame([(f"{i}.json",) for i in range(40)], "n string")
    chosen = sampling.sample_ids(names, "n", 0.25)
    assert [f"{i}.json" for i in ids] == [n for n in (f"{i}.json" for i in range(40)) if n in {r.n for r in chosen.collect()}]
    assert 0 < len(ids) < 40

    def scans(node):
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            yield node.metrics().apply("numFiles").value()
        for i in range(node.children().size()):
            yield from scans(node.children().apply(i))

    assert list(scans(sample._jdf.queryExecution().executedPlan())) == [len(ids)]


def test_batches_of_any_width(spark, rows, tmp_path):
    wide = [f"c{i}" for i in range(700)]
    (tmp_path / "w[1] {a}.csv").write_text(",".join(wide) + "\n" + ",".join(map(str, range(700))) + "\n")
    (tmp_path / "quoted.csv").write_text('﻿"c699","a ""b"",\n c",c0\r\n"x\ny",2,3\r\n\r\nz\r\n', newline="")
    (tmp_path / "header only.csv").write_text("c0,c699")
    (tmp_path / "empty.csv").write_text("")
    batch = readers.read_batches(spark, str(tmp_path), ["c0", "c699", "none"], lambda name: name)
    assert rows(batch) == [("quoted.csv", 1, "3", "x\ny", None), ("quoted.csv", 2, None, "z", None), ("w[1] {a}.csv", 1, "0", "699", None)]
    assert {(len(names), end) for names, end in readers.batch_headers(spark, str(tmp_path))} == {(700, "\n"), (3, "\r\n"), (2, "")}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "~$x.csv").write_text("a\n1\n")
    assert readers.read_batches(spark, str(tmp_path / "none"), ["a"]).count() == 0
