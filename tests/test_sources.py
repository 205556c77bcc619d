import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from grouptrace.sources import readers, schemas, sinks
from grouptrace.streaming import ingest


def test_csv_keeps_quoted_commas_and_the_code_na(spark, rows, tmp_path):
    df = spark.createDataFrame([("ACME, Inc.", "NA", 1.5), ('say "x"', None, None)], "name string, code string, v double")
    path = str(tmp_path / "t")
    sinks.write_csv(df.withColumn("many", F.array(F.lit(1))), path)
    assert rows(readers.read_csv(spark, path, "name string, code string, v double")) == rows(df)
    assert readers.infer_csv_schema(spark, path).simpleString() == "struct<name:string,code:string,v:double>"


def test_json_array_leaves_other_fields_out(spark, rows, tmp_path):
    path = tmp_path / "names.json"
    path.write_text('[\n {"code": "NA", "country": "Namibia"},\n {"code": "XX", "country": "X", "extended": true}\n]')
    got = rows(readers.read_json_array(spark, str(path), schemas.COUNTRY_NAMES))
    assert got == [("NA", "Namibia"), ("XX", "X")]


def test_small_documents_are_compacted_with_their_id(spark, rows, tmp_path):
    folder = tmp_path / "documents"
    folder.mkdir()
    for i in range(5):
        document = {"response": {"corporation": {"corpRegisterIndex": f"{i}-112", "corpName": f"C{i}"}, "mainLocation": None}}
        (folder / f"{i}-112.json").write_text(json.dumps(document))
    target = str(tmp_path / "compact")
    compact = readers.compact_json_documents(spark, str(folder), schemas.ENTITY_DOCUMENT, target)
    assert rows(compact, "file_name", "response.corporation.corpName")[0] == ("0-112.json", "C0")
    assert compact.count() == 5


def test_the_driver_lists_no_small_documents(spark, rows, tmp_path):
    folder = tmp_path / "documents"
    folder.mkdir()
    for i in range(300):
        (folder / f"{i}-112.json").write_text(json.dumps({"response": {"corporation": {"corpRegisterIndex": f"{i}-112"}}}))
    listed = spark._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics.METRIC_FILES_DISCOVERED()
    before = listed.getCount()
    compact = readers.compact_json_documents(spark, str(folder), schemas.ENTITY_DOCUMENT, str(tmp_path / "compact"))
    assert rows(compact, "file_name", "response.corporation.corpRegisterIndex") == sorted(
        (f"{i}-112.json", f"{i}-112") for i in range(300))
    assert listed.getCount() - before < 20


def test_compact_documents_hold_what_the_json_reader_finds(spark, rows, tmp_path):
    folder, schema = tmp_path / "documents", "id bigint, name string, parts array<struct<n: int>>, `at.x` timestamp"
    folder.mkdir()
    files = {
        "plain.json": b'{"id": 1, "name": "a", "parts": [{"n": 1}, {"n": 2}], "at.x": "2024-05-06T07:08:09"}',
        "two lines.json": b'{"id": 2}\n\n  \t\n{"id": 3, "other": {"x": 1}}\r\n{"id": 4}\r{"name": "last"}',
        "b 1+2%41.json": b'\xef\xbb\xbf{"id": 5, "name": "\xc3\xa9"}\n',
        "wrong.json": b'{"id": "x", "name": "kept"}\n{"id": 6, \nnone\n"text"\n7\nnull\n{"id": 8, "name": "\xff"}\n{"id": 9} {"id": 10}',
        "list.json": b' [{"id": 11}, {"id": 12, "name": "b"}]\n[]\n[1]\n[{"id": 13',
        "é € #?[x]{y}|^'~;.json": b'{"id": 18}', "packed.json.gz": gzip.compress(b'{"id": 19}'), "empty.json": b"", ".hidden.json": b'{"id": 14}', "_hidden.json": b'{"id": 15}', "_k=v.json": b'{"id": 16}',
    }
    for name, text in files.items():
        (folder / name).write_bytes(text)
    (folder / "below").mkdir()
    (folder / "below" / "deep.json").write_text('{"id": 17}')
    for path in (str(folder), f"file://{folder}", f"{folder}/plain.json", f"{folder}/[pl]*.json"):
        want = readers.read_json_documents(spark, path, schema).select("*", "_metadata.file_name")
        got = readers.compact_json_documents(spark, path, schema, str(tmp_path / "compact"))
        assert rows(got) == rows(want) and got.dtypes == want.dtypes
    (folder / "packed.json.deflate").write_bytes(zlib.compress(b'{"id": 20}'))
    with pytest.raises(Exception, match="compressed in a way"):
        readers.compact_json_documents(spark, str(folder), schema, str(tmp_path / "compact"))


def test_batch_catalog_leaves_lock_files_out(spark, rows):
    names = ["a/Export (SEARCH with ids) 1-100.xlsx", "a/Export (DATA with ids) 101-200.xlsx",
             "a/Export (DATA with ids) 1-100.xlsx", "a/~$Export (DATA with ids) 1-100.xlsx"]
    catalog = readers.batch_catalog(spark.createDataFrame([(n,) for n in names], "file_path string"))
    assert [(r.dataset_type, r.query_range) for r in catalog.collect()] == [
        ("DATA", "1-100"), ("DATA", "101-200"), ("SEARCH", "1-100")]
    assert rows(readers.query_ranges(catalog)) == [("1-100", 1, 1), ("101-200", 101, 2)]


def test_batches_are_read_by_their_headers(spark, rows, tmp_path):
    (tmp_path / "b 1+2.csv").write_text('"BvD ID number","City\nLatin Alphabet",more\nA,"two\nlines",n.a.\nB,x,5.5\n')
    (tmp_path / "c.csv").write_text('"City\nLatin Alphabet",BvD ID number\ny,C\n')
    (tmp_path / "~$c.csv").write_text("BvD ID number\nZ\n")
    batch = readers.read_batches(spark, str(tmp_path), ["company_id", "city", "more"])
    clean = readers.clean_tokens(batch, {"more": "double"})
    assert rows(clean) == [("b 1+2.csv", 1, "A", "two\nlines", None), ("b 1+2.csv", 2, "B", "x", 5.5), ("c.csv", 1, "C", "y", None)]
    listed = readers.list_files(spark, str(tmp_path), "*.csv").collect()
    assert sorted(r.file_path.rsplit("/", 1)[1] for r in listed) == ["b 1+2.csv", "c.csv", "~$c.csv"]


def test_csv_columns_in_another_order_are_an_error(spark, tmp_path):
    (tmp_path / "t.csv").write_text("city,id\nx,1\n")
    with pytest.raises(Exception, match="header"):
        readers.read_csv(spark, str(tmp_path), "id string, city string").collect()


def test_csv_line_breaks(spark, rows, tmp_path):
    df = spark.createDataFrame([("1", "two\nlines", "x")], "id string, body string, z string")
    sinks.write_csv(df, str(tmp_path / "t"))
    assert rows(readers.read_csv(spark, str(tmp_path / "t"), df.schema)) == rows(df)


def test_positional_ids(spark, rows):
    table = spark.createDataFrame([("f", 1, "x"), ("f", 2, "y"), ("g", 1, "z")], "file string, pos int, name string")
    lists = spark.createDataFrame([("f", "I1, I2"), ("g", "I3")], "file string, ids string")
    got = readers.attach_positional_ids(table, lists, "file", "pos", "ids", "company_id")
    assert rows(got, "company_id", "name") == [("I1", "x"), ("I2", "y"), ("I3", "z")]


def test_tagged_union(spark, rows):
    a, b = (spark.createDataFrame([(v,)], "g string") for v in "ab")
    assert rows(readers.tagged_union({"Law 1": a, "Law 2": b}, "decree")) == [("a", "Law 1"), ("b", "Law 2")]


def test_json_landing_keeps_the_id(spark, tmp_path):
    df = spark.createDataFrame([("1", "x")], "id string, body string")
    sinks.write_json_documents(df, str(tmp_path / "landing"), "id")
    assert spark.read.schema("id string, body string").json(str(tmp_path / "landing")).first() == df.first()


STORE = (
    "record_id bigint, request_id bigint, registration_number bigint, registration_index string, corp_name string, "
    "profit_type_es string, status_id bigint, status_es string"
)


def _record(record_id, request_id, number):
    return (record_id, request_id, number, f"{number}-111", f"N{number}", "Con Fines", 1, "ACTIVA")


def test_page_records(spark, rows, tmp_path):
    page = spark.createDataFrame([(1, 5, "5-111", "N")], "businessEntityId bigint, registrationNumber bigint, registrationIndex string, corpName string")
    parsed = ingest.parse_page_records(page, 7)
    assert parsed.columns == ["business_entity_id", "registration_number", "registration_index", "corp_name", "request_id"]
    for _ in range(2):
        sinks.append_records(parsed, str(tmp_path / "records"))
    assert [r["request_id"] for r in spark.read.parquet(str(tmp_path / "records")).collect()] == [7]


def test_ingest_stores_border_records_once(spark, rows):
    store = spark.createDataFrame([_record(1, 1, 1), _record(2, 1, 2)], STORE)
    page = spark.createDataFrame([_record(3, 2, 2), _record(4, 2, 3)], STORE)
    after = ingest.ingest_batch(store, page)
    assert rows(after, "record_id") == [(1,), (2,), (4,)]
    assert rows(ingest.ingest_batch(after, page)) == rows(after)
    assert ingest.high_water_mark(after).first()[0] == 3


def test_page_report_warns(spark, rows):
    pages = spark.createDataFrame([_record(1, 1, 1), _record(2, 1, 2), _record(3, 2, 5), _record(4, 2, 5)], STORE)
    assert rows(ingest.page_report(pages, 2), "request_id", "did_not_advance", "short_page") == [(1, False, False), (2, True, False)]


def test_stream_takes_in_new_files_only(spark, rows, tmp_path):
    landing, store, progress = (str(tmp_path / n) for n in ("landing", "store", "progress"))
    schema = spark.createDataFrame([], STORE).schema

    def land(*records):
        spark.createDataFrame(list(records), STORE).coalesce(1).write.mode("append").parquet(landing)

    run = lambda: ingest.ingest_stream(spark, landing, store, progress, schema, files_per_batch=1)
    land(_record(1, 1, 1), _record(2, 1, 2))
    assert rows(run(), "registration_number") == [(1,), (2,)]
    land(_record(3, 2, 2), _record(4, 2, 3))
    assert rows(run(), "record_id") == [(1,), (2,), (4,)]
    assert rows(run(), "record_id") == [(1,), (2,), (4,)]
