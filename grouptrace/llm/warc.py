r"""WARC archives from legacy ARC archives.

Pages are written as ARC records (an HTTP response each), the ARC archives are parsed by their version's header lines and
declared lengths, and equivalent WARC records are synthesised: identifier, ISO timestamp, type and digests. A payload
that a later page repeats becomes a revisit record without payload. Archives are gzip files in a folder that all
executors reach, written and read by Spark's own text and binary file sources.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grouptrace.llm import arc
from grouptrace.session import materialize, work_path

#: An archive is closed once it holds this many bytes before compression; a longer record makes it longer.
ARCHIVE_BYTES = 16_000_000
#: Shorter payloads are always stored.
LEAST_SHARED = 1000
DATE = "20240101000000"
_NAMESPACE = uuid.UUID("8f0c6a3e-5f5d-4f0b-9f5c-0a4f3b1c2d7e")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _packed(records: Iterator[tuple], finish) -> Iterator[pa.RecordBatch]:
    """Rows of one archive each. records: (size, record); finish: from records to an archive that ends in a line feed,
    which the text writer adds."""
    held, size = [], 0
    for length, record in records:
        held.append(record)
        size += length
        if size >= ARCHIVE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([finish(held)[:-1]], pa.binary())], names=["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([finish(held)[:-1]], pa.binary())], names=["value"])


def _write(archives: DataFrame, path: str) -> None:
    """A gzip file for each row. The fastest level: archives are read again at once."""
    options = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "lineSep": "\n", "maxRecordsPerFile": 1}
    archives.select(F.col("value").cast("string")).write.options(**options).text(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content")


def _response(page_id: int | None, html: bytes) -> bytes:
    key = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n{key}\r\n"
            ).encode() + html


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a header block and what follows its empty line."""
    head, _, rest = block.partition(b"\r\n\r\n")
    fields = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {name.lower(): value.strip() for name, _, value in fields}, rest


def write_arc(pages: DataFrame, path: str) -> None:
    """ARC archives of pages (page_id, url, html). Both versions are written, each archive in the one its first page's
    number picks. A null html is an empty payload; a page without url gets a name of its own."""

    def pack(batches):
        def records():
            for batch in batches:
                for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    body = _response(page_id, html or b"")
                    yield len(body), (page_id, arc.Record(url or f"urn:page:{page_id}", "0.0.0.0", DATE, "text/html", body))

        def finish(held):
            version = 1 + (held[0][0] or 0) % 2
            return arc.write(version, f"pages-{held[0][0]}.arc", DATE, [r for _, r in held])

        yield from _packed(records(), finish)

    rows = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"))
    _write(rows.mapInArrow(pack, "value binary"), path)


def described_arc(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, page_id, payload_bytes, payload_digest) of every ARC record."""

    def describe(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for position, record in enumerate(arc.parse(gzip.decompress(content.as_buffer()))):
                    fields, payload = _headers(record.body)
                    page_id = fields.get("x-page-id")
                    rows.append((name, position, None if page_id is None else int(page_id), len(payload),
                                 hashlib.sha1(payload).hexdigest()))
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["path", "position", "page_id", "payload_bytes", "payload_digest"],
                )

    return _read(spark, path).mapInArrow(
        describe, "path string, position long, page_id long, payload_bytes long, payload_digest string"
    )


def revisits(described: DataFrame) -> DataFrame:
    """(path, again): per archive the records whose payload another page stores, as (position, refers_to).

    Of equal payloads of at least LEAST_SHARED bytes the one with the largest page_id is stored; rows that repeat this
    page_id are all stored. Groups are reduced before the join, and an archive's list has at most its own records.
    """
    shared = described.where(F.col("payload_bytes") >= LEAST_SHARED)
    kept = shared.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    found = shared.join(kept.where("n > 1 AND refers_to IS NOT NULL"), ["payload_digest", "payload_bytes"])
    found = found.where("NOT page_id <=> refers_to")
    return found.groupBy("path").agg(F.collect_list(F.struct("position", "refers_to")).alias("again"))


def _iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _identifier(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(record: arc.Record, place: str, refers_to: int | None) -> bytes:
    """The WARC record equivalent to an ARC record; with refers_to, a revisit of that page's record."""
    fields, payload = _headers(record.body)
    page_id = fields.get("x-page-id")
    block = record.body if refers_to is None else record.body[: len(record.body) - len(payload)]
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_identifier(place if page_id is None else page_id)}", f"WARC-Date: {_iso(record.date)}",
        f"WARC-Target-URI: {record.url}", f"WARC-IP-Address: {record.ip}", f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_identifier(refers_to)}",
                 f"X-Refers-To-Page-Id: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def convert(spark: SparkSession, arc_path: str, again: DataFrame, path: str) -> None:
    """WARC archives of ARC archives. again: as revisits() gives it."""

    def pack(batches):
        def records():
            for batch in batches:
                for name, content, revisited in zip(
                    batch.column("path").to_pylist(), batch.column("content"), batch.column("again").to_pylist()
                ):
                    refers = {x["position"]: x["refers_to"] for x in revisited or []}
                    for position, record in enumerate(arc.parse(gzip.decompress(content.as_buffer()))):
                        out = warc_record(record, f"{name}#{position}", refers.get(position))
                        yield len(out), out

        yield from _packed(records(), b"".join)

    rows = _read(spark, arc_path).join(again, "path", "left").select("path", "content", "again")
    _write(rows.mapInArrow(pack, "value binary"), path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records of a WARC archive, by their declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("a WARC record has no header")
        fields, _ = _headers(data[at: end + 4])
        start, length = end + 4, int(fields["content-length"])
        if data[start + length: start + length + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end at its declared length")
        yield fields, data[start: start + length]
        at = start + length + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_id, date, record_type, payload_bytes, payload_digest, refers_to, payload) per WARC record.

    payload_bytes and the digest (lower-case hex) are those of the full payload, also for a revisit, whose payload is null.
    A stored payload that doesn't have its digest is an error.
    """
    kinds = {
        "page_id": pa.int64(), "url": pa.string(), "record_id": pa.string(), "date": pa.string(),
        "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(),
        "payload": pa.binary(),
    }

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in parse(gzip.decompress(content.as_buffer())):
                    http, payload = _headers(block)
                    stored = fields["warc-type"] == "response"
                    if stored and _sha1(payload) != fields["warc-payload-digest"]:
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
                    page_id, refers_to = http.get("x-page-id"), fields.get("x-refers-to-page-id")
                    rows.append((
                        None if page_id is None else int(page_id), fields["warc-target-uri"], fields["warc-record-id"],
                        fields["warc-date"], fields["warc-type"], int(http["content-length"]),
                        base64.b32decode(fields["warc-payload-digest"][5:]).hex(),
                        None if refers_to is None else int(refers_to), payload if stored else None,
                    ))
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=[*kinds])

    return _read(spark, path).mapInArrow(
        read,
        "page_id long, url string, record_id string, date string, record_type string, payload_bytes long, "
        "payload_digest string, refers_to long, payload binary",
    )


def archived(pages: DataFrame) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back; see read_warc for the columns.

    One record per row: repeated rows make a record each. Other columns of pages don't matter. An empty table makes
    no archive and gives an empty result.
    """
    spark = pages.sparkSession
    arcs, warcs = work_path(spark, "arc"), work_path(spark, "warc")
    write_arc(pages, arcs)
    described = materialize(described_arc(spark, arcs), "records")
    convert(spark, arcs, revisits(described), warcs)
    return read_warc(spark, warcs)


ORACLE_SQL = f"""
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), stored AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id <> last THEN last END AS refers_to
FROM stored
"""
