import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grouptrace.llm import arc, warc

BODY = st.binary(max_size=60)


@settings(max_examples=80, deadline=None)
@given(st.sampled_from([1, 2]), st.lists(BODY, max_size=6))
def test_arc_round_trip_by_declared_length(version, bodies):
    records = [arc.Record(f"http://x/{i} a\n", "1.2.3.4", "20200102030405", "text/html", b) for i, b in enumerate(bodies)]
    found = list(arc.parse(arc.write(version, "n.arc", "20200102030405", records)))
    assert [r.body for r in found] == bodies
    assert [r.url for r in found] == [f"http://x/{i}%20a%0A" for i in range(len(bodies))]


def test_version_lines():
    for version, n in ((1, 5), (2, 10)):
        first = arc.write(version, "n.arc", "20200102030405", [arc.Record("u", "i", "20200102030405", "t", b"")]).split(b"\n")
        assert first[1] == f"{version} 0 origin".encode() and len(first[2].split()) == n and len(first[4].split()) == n


@pytest.mark.parametrize("data", [
    b"http://x 1.1.1.1 20200101000000 text/html 3\nabc\n", b"filedesc://a 0 0 text/plain 5\n3 0 o",
    arc.version_block(1, "a", "0") + b"http://x 0 0 text/html 10\nabc\n", arc.version_block(2, "a", "0") + b"http://x 0 0 t 0\n\n",
])
def test_broken_archives_are_errors(data):
    with pytest.raises(ValueError):
        list(arc.parse(data))


@settings(max_examples=60, deadline=None)
@given(st.lists(BODY, max_size=5))
def test_warc_round_trip(payloads):
    records = [arc.Record("http://x/", "0.0.0.0", "20200102030405", "text/html", warc._response(i, p)) for i, p in enumerate(payloads)]
    data = b"".join(warc.warc_record(r, "place", None) for r in records)
    found = list(warc.parse(data))
    assert [warc._headers(block)[1] for _, block in found] == payloads
    assert all(f["warc-date"] == "2020-01-02T03:04:05Z" and f["warc-type"] == "response" for f, _ in found)
    assert len({f["warc-record-id"] for f, _ in found}) == len(payloads)


def test_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    big, tricky = "é" * 700, "WARC/1.1\r\n\r\n" + "x" * 1200 + "\r\n\r\nfiledesc://\n"
    pages = [(1, "http://a/1", big), (2, None, big), (9, "http://a/ 9\n", big), (3, "u", "x" * 999), (4, "u", "x" * 999),
             (5, "u", None), (6, "u", ""), (7, "u", tricky), (8, "u", tricky), (10, "u", "z" * 20000), (11, "u", "y" * 1000),
             (11, "u", "y" * 1000), (None, "u", big), (None, "u", "only" * 300)]
    df = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, url string, html string, path string, again long")
    rows = warc.archived(df.repartition(3)).collect()
    assert len(rows) == len(pages)
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        body = (h or "").encode()
        again = len(body) >= 1000 and last[h or ""] not in (i, -1)
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response",
                     last[h or ""] if again else None, None if again else body))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
            None if r.payload is None else bytes(r.payload)) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    by_page = {r.page_id: r.record_id for r in rows}
    assert by_page[1] != by_page[2]


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
