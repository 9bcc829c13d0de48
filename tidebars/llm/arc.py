"""Legacy ARC archives to WARC.

`write_arc` makes ARC files of versions 1 and 2, `read_arc` reads any, gzipped
or plain: the first record names the version, which says how a header line is
read, and the last field of a header line is the length of what follows.
`convert` synthesises what WARC asks for and ARC lacks: identifiers (from
archive, offset, address and date, so a repeated run makes the same ones), W3C
timestamps, record types and SHA-1 digests; payloads that occurred before become
revisits.  `write_warc` and `read_warc` go to files and back.

An archive is built and read inside one task and bounded by `ARCHIVE_BYTES` (or
one larger record); every record is a gzip member of its own, so a reader may
start at any.  Files are written by Spark's own writer and read by its
``binaryFile`` source, so they may lie in any store.  What decides between
response and revisit is a table of digests, made without payloads; what it says
of an archive's records meets the archive, compressed as it is, in one join.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.staging import staged

ARCHIVE_BYTES = 8 << 20
LEVEL = 1  # of compression
REVISIT_BYTES = 1000
NO_ADDRESS, NO_DATE = "0.0.0.0", "19700101000000"

#: The fields of a URL record's header line in each ARC version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
RECORD = "archive string, offset bigint, version int, url string, address string, date string, content_type string, status int, headers binary, payload binary, truncated boolean"
RECORD_SCHEMA = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("address", pa.string()), ("date", pa.string()),
    ("content_type", pa.string()), ("status", pa.int32()), ("headers", pa.binary()), ("payload", pa.binary()), ("truncated", pa.bool_()),
])
WARC_RECORD = "record_id string, type string, url string, date string, content_type string, digest string, refers_to string, headers binary, payload binary, sha1 binary"
WARC_SCHEMA = pa.schema([
    *((n, pa.string()) for n in ("record_id", "type", "url", "date", "content_type", "digest", "refers_to")), ("headers", pa.binary()), ("payload", pa.binary()), ("sha1", pa.binary()),
])


def _field(value: str | None, none: str = "-") -> str:
    """A header field: without white space, which is written in percent form."""
    return re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", value) if value else none


def arc_header(version: int, url: str, address: str, date: str, content_type: str, length: int, status: int = 200, offset: int = 0, filename: str = "-") -> str:
    """A header line without its line end."""
    values = (url, address, date, content_type)
    extra = (status, "-", "-", offset, filename) if version == 2 else ()
    return " ".join(map(str, (*values, *extra, length)))


def arc_opening(version: int, name: str, date: str) -> bytes:
    """The version block that every ARC file begins with."""
    body = f"{version} 0 tidebars\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    return arc_header(version, f"filedesc://{name}", NO_ADDRESS, date, "text/plain", len(body), filename=name).encode() + b"\n" + body + b"\n"


def _packed(parts: Iterator[bytes], opening: Callable[[int], bytes], at: list[int], limit: int) -> Iterator[bytes]:
    """Archives of records, each opened by ``opening(number)``; ``at[0]`` is the number of the one being filled.

    ``limit`` counts bytes before compression, by which every record becomes a gzip member.
    """
    made, size = [], 0

    def whole() -> bytes:
        return b"".join([zlib.compress(opening(at[0]), LEVEL, 31), *made])

    for part in parts:
        made.append(zlib.compress(part, LEVEL, 31))
        size += len(part)
        if size >= limit:
            yield whole()
            at[0], made, size = at[0] + 1, [], 0
    if made:
        yield whole()


def _write(archives: DataFrame, path: str) -> None:
    """One file per row; the bytes go as they are, with the zero at the end that a gzip file may have."""
    writer = archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    writer.option("lineSep", "\0").text(path)


def http_head(length: int, extra: dict[str, str]) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {length}", *(f"{k}: {v}" for k, v in extra.items())]
    return "\r\n".join([*lines, "", ""]).encode()


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", date: str = NO_DATE, limit: int = ARCHIVE_BYTES) -> None:
    """Write a URL record per row, its content an HTTP response with the row's body, into gzipped ARC files.

    A task's archives take versions 1 and 2 in turn.  The key goes along as the
    HTTP header ``X-Key`` (none for a null key).  A null body is empty; white
    space in an address is written in percent form, a null address as ``-``.
    An empty table gives a folder without archives.
    """
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url"), F.col(body).cast("binary").alias("body"))
    schema = pa.schema([("archive", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [0]

        def parts() -> Iterator[bytes]:
            for batch in batches:
                for k, u, b in zip(*(batch.column(i) for i in range(3)), strict=True):
                    payload = b.as_py() or b""
                    content = http_head(len(payload), {} if k.as_py() is None else {"X-Key": k.as_py()}) + payload
                    head = arc_header(1 + at[0] % 2, _field(u.as_py()), NO_ADDRESS, date, "text/html", len(content))
                    yield head.encode() + b"\n" + content + b"\n"

        def opening(number: int) -> bytes:
            return arc_opening(1 + number % 2, f"part-{number}.arc", date)

        for archive in _packed(parts(), opening, at, limit):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], schema=schema)

    _write(rows.mapInArrow(run, "archive binary"), path)


def _opened(content: bytes) -> io.BufferedIOBase:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 16) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def split_http(content: bytes) -> tuple[int | None, bytes, bytes]:
    """Status, head with its blank line, and body of an HTTP response; anything else is all body."""
    if not content.startswith(b"HTTP/"):
        return None, b"", content
    end = re.search(rb"\r?\n\r?\n", content)
    cut = end.end() if end else len(content)
    status = re.match(rb"HTTP/\S+ +(\d{3})", content)
    return int(status[1]) if status else None, content[:cut], content[cut:]


def parse_arc(stream) -> Iterator[tuple[int, int, dict[str, str], bytes, bool]]:
    """``(offset, version, fields, content, truncated)`` of each URL record of an ARC stream.

    The version block, at the beginning only, says which fields a header line
    has; without one, the number of fields does.  Addresses may hold spaces: fields are counted from
    the end.  Lines that are no header line are passed over; a record whose
    content ends early is marked truncated.
    """
    version, offset = 0, 0
    while line := stream.readline():
        begin, offset = offset, offset + len(line)
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if not parts[-1].isdigit() or len(parts) < len(ARC_FIELDS[1]):
            continue
        kind = version or (2 if len(parts) >= len(ARC_FIELDS[2]) else 1)
        if begin == 0 and parts[0].startswith("filedesc:"):
            content = stream.read(int(parts[-1]))
            offset += len(content)
            stated = content.split(b" ", 1)[0]
            version = int(stated) if stated in (b"1", b"2") else kind
            continue
        names = ARC_FIELDS[kind]
        if len(parts) < len(names):
            continue
        extra = len(parts) - len(names)
        fields = dict(zip(names, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]], strict=True))
        if not re.fullmatch(r"\d{12}|\d{14}", fields["Archive-date"]):
            continue
        length = int(fields["Archive-length"])
        content = stream.read(length)
        offset += len(content)
        yield begin, kind, fields, content, len(content) < length


def _batched(rows: Iterator[tuple], schema: pa.Schema, size_of, limit: int = ARCHIVE_BYTES) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= limit or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per URL record: archive, offset, version, address, 14-digit date, HTTP head and payload apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, content in zip(batch.column(0), batch.column(1), strict=True):
                    archive = name.as_py().rsplit("/", 1)[-1]
                    for offset, version, fields, body, short in parse_arc(_opened(content.as_py())):
                        status, head, payload = split_http(body)
                        stated = fields.get("Result-code", "")
                        status = status or (int(stated) if stated.isdigit() else None)
                        yield (archive, offset, version, fields["URL"], fields["IP-address"], fields["Archive-date"].ljust(14, "0"), fields["Content-type"], status, head, payload, short)

        yield from _batched(rows(), RECORD_SCHEMA, lambda r: len(r[9]))

    return _files(spark, path).mapInArrow(run, RECORD)


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


#: The key that `write_arc` puts into the HTTP head.
RANK = r"cast(nullif(regexp_extract(cast(headers AS string), '(?im)^X-Key: *(-?[0-9]+)', 1), '') AS bigint)"


def warc_rows(archive: str, content: bytes) -> Iterator[tuple]:
    """`WARC_RECORD` fields of an ARC file's records, all responses or resources so far."""
    for offset, _, fields, body, _ in parse_arc(_opened(content)):
        _, head, payload = split_http(body)
        date, url = fields["Archive-date"].ljust(14, "0"), fields["URL"]
        name = hashlib.sha1(f"{archive} {offset} {date} {url}".encode()).digest()[:16]
        sha1 = hashlib.sha1(payload).digest()
        digest = "sha1:" + base64.b32encode(sha1).decode()
        yield (f"<urn:uuid:{uuid.UUID(bytes=name, version=5)}>", "response" if head else "resource", url, warc_date(date), fields["Content-type"], digest, None, head, payload, sha1)


def revisits(spark: SparkSession, path: str, rank: str = RANK, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``(path, again)``: per archive the records whose payload another one holds, ``(record_id, refers_to)``.

    Of records with equal payloads of at least ``revisit_bytes``, the one with
    the largest ``rank``, an expression over ``headers`` (then the largest
    identifier; a null rank is the smallest) is the response and the others
    revisit it.  Equal means equal length and SHA-1.
    """
    schema = pa.schema([("path", pa.string()), ("record_id", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("headers", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, content in zip(batch.column(0), batch.column(1), strict=True):
                    for r in warc_rows(name.as_py().rsplit("/", 1)[-1], content.as_py()):
                        if len(r[8]) >= revisit_bytes:
                            yield (name.as_py(), r[0], r[5], len(r[8]), r[7])

        yield from _batched(rows(), schema, lambda r: len(r[4]))

    made = _files(spark, path).mapInArrow(run, "path string, record_id string, digest string, bytes bigint, headers binary")
    large = staged(made.select("path", "record_id", "digest", "bytes", F.expr(rank).alias("rank")), "digests")
    firsts = large.groupBy("digest", "bytes").agg(F.max(F.struct("rank", "record_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = staged(firsts.where("n > 1").select("digest", "bytes", F.col("first.record_id").alias("refers_to")), "first-digests")
    again = large.join(firsts, ["digest", "bytes"]).where("record_id <> refers_to")
    return again.groupBy("path").agg(F.collect_list(F.struct("record_id", "refers_to")).alias("again"))


def warc_record(record_id: str, kind: str, url: str, date: str, content_type: str, digest: str, refers_to: str | None, head: bytes, payload: bytes) -> bytes:
    http = kind in ("response", "revisit") and head
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: {digest}", f"Content-Type: {'application/http; msgtype=response' if http else content_type}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    lines += [f"Content-Length: {len(head) + len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + head + payload + b"\r\n\r\n"


def warc_opening(number: int) -> bytes:
    """The ``warcinfo`` record that every WARC file begins with."""
    body = b"software: tidebars\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {number}")
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {warc_date(NO_DATE)}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def _archives(parts: Iterator[bytes], limit: int) -> Iterator[pa.RecordBatch]:
    for archive in _packed(parts, warc_opening, [0], limit):
        yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])


def write_warc(records: DataFrame, path: str, limit: int = ARCHIVE_BYTES) -> None:
    """Write WARC records into gzipped WARC files, each opened by a ``warcinfo`` record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = [batch.column(j)[i].as_py() for j in range(batch.num_columns)]
                    yield warc_record(*row[:7], row[7] or b"", row[8] or b"")

        yield from _archives(parts(), limit)

    _write(records.select(*WARC_SCHEMA.names).mapInArrow(run, "archive binary"), path)


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()) and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length") or 0))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record but for ``warcinfo``; the payload's digest is computed again and has to agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column(1):
                    for fields, block in parse_warc(_opened(content.as_py())):
                        kind = fields.get("warc-type")
                        if kind == "warcinfo":
                            continue
                        http = fields.get("content-type", "").startswith("application/http")
                        _, head, payload = split_http(block) if http else (None, b"", block)
                        digest = fields.get("warc-payload-digest")
                        if kind != "revisit":
                            found = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if digest not in (None, found):
                                raise ValueError(f"{fields.get('warc-record-id')}: payload digest {found}, stated {digest}")
                            digest = found
                        yield (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("content-type"), digest, fields.get("warc-refers-to"), head, payload, base64.b32decode(digest.removeprefix("sha1:")) if digest else None)

        yield from _batched(rows(), WARC_SCHEMA, lambda r: len(r[8]))

    return _files(spark, path).mapInArrow(run, WARC_RECORD)


def convert(spark: SparkSession, arc_path: str, warc_path: str, rank: str = RANK, revisit_bytes: int = REVISIT_BYTES, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Convert a folder of ARC files to WARC files, and give back the records read from these.

    A payload that another record holds (`revisits`) is left out; content that
    is no HTTP response becomes a ``resource``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[bytes]:
            for batch in batches:
                for name, content, again in zip(*batch.columns, strict=True):
                    refers = {a["record_id"]: a["refers_to"] for a in again.as_py() or ()}
                    for r in warc_rows(name.as_py().rsplit("/", 1)[-1], content.as_py()):
                        first = refers.get(r[0])
                        yield warc_record(r[0], "revisit" if first else r[1], *r[2:6], first, r[7], b"" if first else r[8])

        yield from _archives(parts(), limit)

    known = _files(spark, arc_path).join(staged(revisits(spark, arc_path, rank, revisit_bytes), "revisits"), "path", "left")
    _write(known.select("path", "content", "again").mapInArrow(run, "archive binary"), warc_path)
    return read_warc(spark, warc_path)


def index(records: DataFrame) -> DataFrame:
    """``(record_id, type, key, payload_bytes, payload_digest, refers_to)``: sizes by the HTTP head, digests in hex."""
    head = F.col("headers").cast("string")
    number = lambda name: F.nullif(F.regexp_extract(head, rf"(?im)^{name}: *(-?[0-9]+)", 1), F.lit("")).cast("bigint")
    size = F.when(F.col("type") == "revisit", number("Content-Length")).otherwise(F.length("payload").cast("bigint"))
    return records.select("record_id", "type", number("X-Key").alias("key"), size.alias("payload_bytes"), F.lower(F.hex("sha1")).alias("payload_digest"), "refers_to")
