"""WARC records in ZIP packages: a writer, and a reader that finds records by the directory and reads their ranges.

A package holds stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdxj``, one line per record with its offset and length.  The reader parses the end record, the
ZIP64 locator and end record where there are such, and the central directory; it then reads the index and the
ranges of records, and never unpacks a member.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import files
from gleaner.llm.common import as_bytes, checkpoint, in_pieces, tidy

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A payload of fewer bytes is never replaced by a revisit.
LEAST_REVISIT = 1000
PACKAGE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
_SALTS = 32
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, name space of URLs
_DATE = "2024-01-01T00:00:00Z"


# ZIP directories


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def _wide(extra: bytes, size: int, packed: int, header: int) -> tuple[int, int, int]:
    """Sizes and offset with what the ZIP64 field has of those that are all ones."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            size, packed, header = (next(values) if v == 0xFFFFFFFF else v for v in (size, packed, header))
        at += 4 + n
    return size, packed, header


def directory(file: files.Ranges) -> dict[str, Member]:
    """The members that the central directory of a package lists."""
    tail_at = max(0, file.size - 65_557 - 20)
    tail = file.read(tail_at, file.size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (wide_at,) = struct.unpack_from("<Q", tail, end - 12)
        wide = file.read(wide_at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where its locator points")
        count, size, start = struct.unpack_from("<QQQ", wide, 32)
    listed, at, found = file.read(start, size), 0, {}
    for _ in range(count):
        if listed[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory is cut short")
        method, = struct.unpack_from("<H", listed, at + 10)
        packed, plain, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", listed, at + 20)
        header, = struct.unpack_from("<I", listed, at + 42)
        name = listed[at + 46 : at + 46 + name_n].decode()
        extra = listed[at + 46 + name_n : at + 46 + name_n + extra_n]
        plain, packed, header = _wide(extra, plain, packed, header)
        found[name] = Member(name, method, plain, packed, header)
        at += 46 + name_n + extra_n + note_n
    return found


def data_start(file: files.Ranges, member: Member) -> int:
    """Where the bytes of a stored member begin; its local header may have other extra fields than the directory."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is not stored")
    head = file.read(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member.name}")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + name_n + extra_n


# Records


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit, which has the HTTP head but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_IDS, f'page:{page_id}')}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", _line(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Page-Id", "" if page_id is None else str(page_id)),
        *([] if refers_to is None else [("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(_IDS, f'page:{refers_to}')}>"), ("Refers-To-Page-Id", str(refers_to))]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record; field names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, payload


def package(records: list[tuple[int | None, str | None, bytes]]) -> bytes:
    """A ZIP package of (page_id, url, record)."""
    body, index, at = [], [], 0
    for page_id, url, data in records:
        packed = gzip.compress(data, compresslevel=1, mtime=0)
        index.append(json.dumps({"page_id": page_id, "url": url, "offset": at, "length": len(packed)}))
        body.append(packed)
        at += len(packed)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, data in ((DATA, b"".join(body)), (INDEX, "\n".join(index).encode())):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def records(file: files.Ranges) -> Iterator[bytes]:
    """All records of a package by its index; neighbours are read in one range of bounded size."""
    members = directory(file)
    index_at = data_start(file, members[INDEX])
    lines = file.read(index_at, members[INDEX].size).split(b"\n")
    wanted = [(x["offset"], x["length"]) for x in map(json.loads, filter(None, lines))]
    base, k = data_start(file, members[DATA]), 0
    while k < len(wanted):
        first, last = k, k
        while last + 1 < len(wanted) and wanted[last + 1][0] == sum(wanted[last]) and sum(wanted[last + 1]) - wanted[first][0] <= RANGE_BYTES:
            last += 1
        start = wanted[first][0]
        data = file.read(base + start, sum(wanted[last]) - start)
        for offset, n in wanted[first : last + 1]:
            yield zlib.decompress(data[offset - start : offset - start + n], wbits=31)
        k = last + 1


# On DataFrames


def _write(folder: str, package_bytes: int):
    def run(batches):
        part, piece, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            path = f"{folder}/pages-{part:06d}-{piece:04d}.wacz"
            files.put(path, package(held))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64())], names=["path", "n"])

        for batch in in_pieces(batches, 500):
            html = as_bytes(batch.column(2))
            for page_id, url, payload, digest, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), html, *(batch.column(k).to_pylist() for k in (3, 4)), strict=True):
                held.append((page_id, url, record(page_id, url, payload, digest, refers)))
                size += len(held[-1][2])
                if size >= package_bytes:
                    yield flush()
                    held, size, piece = [], 0, piece + 1
        if held:
            yield flush()

    return run


def write_packages(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per row of (page_id, url, html) below ``folder``; returns (path, n) of the packages.

    Of rows with equal payloads of at least ``least`` bytes, those with the largest page_id are responses and the
    others revisit it.  A null html is an empty payload, a null url an empty target; a null page_id is a revisit
    where its payload has a page with an id.  Other columns are not read.  Rows of one payload are spread over
    several tasks by a salt, so a payload of many pages is no hot spot.  An empty table writes no package.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    long = rows.where(F.octet_length("html") >= least)
    groups = long.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1 and newest is not null")
    groups = groups.select("digest", "newest", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(_SALTS)))
    refers = F.when(F.col("page_id").eqNullSafe(F.col("newest")), None).otherwise(F.col("newest"))
    marked = salted.join(groups, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return checkpoint(marked.mapInArrow(tidy(_write(folder, package_bytes)), "path string, n bigint"))


def _read(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            file, rows = files.Ranges(path), []
            for data in records(file):
                fields, http, payload = parse(data)
                revisit = fields["warc-type"] == "revisit"
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of page {fields['page-id']} in {path} is damaged")
                rows.append((int(fields["page-id"]) if fields["page-id"] else None, int(http["content-length"]) if revisit else len(payload), digest, fields["warc-type"], int(fields["refers-to-page-id"]) if revisit else None))
            file.close()
            for at in range(0, len(rows), 5000):
                a, b, c, d, e = zip(*rows[at : at + 5000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.string()), pa.array(e, pa.int64())], names=_OUT)


_OUT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def read_packages(packages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the listed packages."""
    n = max(1, packages.count())
    return packages.select("path").repartition(n).mapInArrow(tidy(_read), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def find(paths: Iterable[str], page_id: int) -> bytes | None:
    """The record of one page, read alone by its range."""
    for path in paths:
        file = files.Ranges(path)
        members = directory(file)
        lines = file.read(data_start(file, members[INDEX]), members[INDEX].size).split(b"\n")
        for x in map(json.loads, filter(None, lines)):
            if x["page_id"] == page_id:
                return zlib.decompress(file.read(data_start(file, members[DATA]) + x["offset"], x["length"]), wbits=31)
    return None
