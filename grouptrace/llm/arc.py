r"""The legacy ARC format, versions 1 and 2: writing and parsing of single archives.

An archive begins with a version block, whose header line names the file and whose body states the version and the names
of the fields. Each record is a header line, a body of the length that the line declares, and a line feed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

# The fields of a header line in each version.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"),
}
_UNSAFE = re.compile(rb"[\x00-\x20\x7F]")


@dataclass
class Record:
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes


def _safe(text: str) -> bytes:
    """White space and control characters would cut the header line."""
    return _UNSAFE.sub(lambda c: b"%%%02X" % c[0][0], text.encode()) or b"-"


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 origin\n{' '.join(FIELDS[version])}\n".encode()
    return header_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), 0) + body + b"\n"


def header_line(version: int, url: str, ip: str, date: str, content_type: str, length: int, offset: int) -> bytes:
    values = {
        "URL": _safe(url), "IP-address": _safe(ip), "Archive-date": _safe(date), "Content-type": _safe(content_type),
        "Result-code": b"200", "Checksum": b"-", "Location": b"-", "Offset": b"%d" % offset, "Filename": b"-",
        "Archive-length": b"%d" % length,
    }
    return b" ".join(values[f] for f in FIELDS[version]) + b"\n"


def write(version: int, name: str, date: str, records: list[Record]) -> bytes:
    out = [version_block(version, name, date)]
    offset = len(out[0])
    for r in records:
        out.append(header_line(version, r.url, r.ip, r.date, r.content_type, len(r.body), offset) + r.body + b"\n")
        offset += len(out[-1])
    return b"".join(out)


def parse(data: bytes) -> Iterator[Record]:
    """The records of an archive. What follows a header line is taken by its declared length, whatever it holds."""
    at, fields = 0, None
    while at < len(data):
        if data[at] == 0x0A:  # line feeds between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        values = data[at:end].decode().split(" ")
        if fields is None:
            if not values[0].startswith("filedesc://"):
                raise ValueError("an ARC archive begins with a version block")
            names = FIELDS[1]
        else:
            names = fields
        if len(values) != len(names) and not (fields is None and len(values) == len(FIELDS[2])):
            raise ValueError(f"{len(values)} fields in an ARC header line; its version has {len(names)}")
        length = int(values[-1])
        body = data[end + 1: end + 1 + length]
        if len(body) < length:
            raise ValueError("an ARC record is shorter than its declared length")
        at = end + 1 + length
        if fields is None:
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} isn't known")
            fields = FIELDS[version]
            continue
        by = dict(zip(fields, values))
        yield Record(by["URL"], by["IP-address"], by["Archive-date"], by["Content-type"], body)
