"""Legacy web archives converted to WARC.

ARC files of version 1 and 2 are parsed by their header lines and declared lengths;
each record becomes a WARC record with an identifier, a timestamp, a type and digests
made from it. Records with a payload that a later page has too become revisits.

An archive is a row: its name and its bytes, one gzip member a record. Only Spark
reads and writes them, so they can be in any store.
"""

from __future__ import annotations

import base64
import datetime
import functools
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ARCHIVE = "archive string, body binary"
#: Fixed field lists of the two versions of the format.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HOT_ROWS, MOST_HOT = 1_000, 10_000
#: Bytes that are handed to a decompressor at once; what lies behind the end of a member is copied.
WINDOW = 1 << 14


class ArchiveError(ValueError):
    """An archive that doesn't keep to its format."""


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    content: bytes
    version: int


def arc_version_block(name: str, version: int, date: str, agent: str = "coalign") -> bytes:
    body = f"{version} 0 {agent}\n{' '.join(FIELDS[version])}\n".encode()
    extra = f"200 - - 0 {name} " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body)}\n".encode() + body + b"\n"


def arc_record(record: ArcRecord, name: str, offset: int) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", record.url)
    head = [url, record.ip, record.date, record.kind]
    if record.version == 2:
        head += ["200", hashlib.md5(record.content).hexdigest(), "-", str(offset), name]
    return " ".join([*head, str(len(record.content))]).encode() + b"\n" + record.content + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block. The length that a header line declares says where its record ends."""
    version, at = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        line_end = data.find(b"\n", at)
        if line_end < 0:
            raise ArchiveError("a header line without an end")
        line = data[at:line_end].rstrip(b"\r").decode("utf-8", "surrogateescape")
        n = len(FIELDS[version]) if version else (len(FIELDS[2]) if len(line.split(" ")) >= len(FIELDS[2]) else len(FIELDS[1]))
        fields = line.rsplit(" ", n - 1)  # a URL of old crawlers may hold blanks
        if len(fields) != n or not fields[-1].isdigit():
            raise ArchiveError(f"not a header line of version {version or '1 or 2'}: {line[:200]!r}")
        content = data[line_end + 1 : line_end + 1 + int(fields[-1])]
        if len(content) != int(fields[-1]):
            raise ArchiveError(f"{fields[-1]} bytes declared, {len(content)} found")
        at = line_end + 1 + len(content)
        if not version:
            if not fields[0].startswith("filedesc:") or content[:1] not in (b"1", b"2"):
                raise ArchiveError("no version block")
            version = int(content[:1])
            continue
        yield ArcRecord(fields[0], fields[1], fields[2], fields[3], content, version)


@functools.lru_cache(4096)
def warc_date(date: str) -> str:
    """The time of a 14-digit date; a shorter one is completed, one that isn't a date becomes the epoch."""
    digits = re.sub(r"\D", "", date)[:14]
    digits += "00000101000000"[len(digits) :]
    try:
        return datetime.datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(content: bytes) -> tuple[bytes, bytes] | None:
    """Header with its blank line, and payload, of an HTTP response; None for anything else."""
    if not content.startswith(b"HTTP/"):
        return None
    m = re.search(rb"\r?\n\r?\n", content)
    return (content[: m.end()], content[m.end() :]) if m else (content, b"")


def record_id(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, of)))}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def warc_id(record: ArcRecord, archive: str, place: int) -> str:
    """Of a converted record: by all of its content, and where it was."""
    return record_id(record.url, warc_date(record.date), hashlib.sha1(record.content).hexdigest(), archive, place)


def to_warc(record: ArcRecord, archive: str, place: int, refers_to: tuple[int, str, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; ``refers_to`` is the page, URL, date and record id of the response that a revisit repeats."""
    http = split_http(record.content)
    date = warc_date(record.date)
    kind = "resource" if http is None else "revisit" if refers_to else "response"
    payload = record.content if http is None else http[1]
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", warc_id(record, archive, place)),
        ("WARC-Date", date),
        ("WARC-Target-URI", record.url),
        ("WARC-Payload-Digest", digest(payload)),
        ("Content-Type", "application/http; msgtype=response" if http else record.kind),
    ]
    if record.ip not in ("-", "0.0.0.0", ""):
        fields.append(("WARC-IP-Address", record.ip))
    block = record.content
    if kind == "revisit":
        page, url, at, response = refers_to
        block = http[0]
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", response), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", at), ("WARC-Refers-To-Page-Id", str(page))]
    return warc_record([*fields, ("WARC-Block-Digest", digest(block))], block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ArchiveError(f"no record at {at}")
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ArchiveError(f"the record at {at} doesn't end where it says")
        if "warc-block-digest" in fields and digest(block) != fields["warc-block-digest"]:
            raise ArchiveError(f"the record at {at} doesn't have its digest")
        yield fields, block
        at = end + 8 + n


def gunzip(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file, one after another, in time that grows with the file and not with its square."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof and at < len(view):
            window = view[at : at + WINDOW]
            parts.append(d.decompress(window))
            at += len(window)
        at -= len(d.unused_data)
        yield b"".join([*parts, d.flush()])


def _member(data: bytes) -> bytes:
    return gzip.compress(data, compresslevel=1, mtime=0)


def _page_id(header: bytes) -> int | None:
    m = re.search(rb"\r\nX-Page-Id: (-?\d+)", header)
    return int(m[1]) if m else None


def _rows(names: str, kinds: tuple, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in names.split(", ")])


def write_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000", archive_bytes: int = 8 << 20) -> DataFrame:
    """Pages as ARC archives of about ``archive_bytes``, in turn of version 1 and 2. A null page has an empty payload, a null URL is named after the id."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, body, size, plain = TaskContext.get().partitionId(), 0, [], 0, 0
        for batch in batches:
            for key, url, html in zip(*batch.columns, strict=True):
                key, url, payload = key.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass")
                name, version = f"pages-{part:06d}-{n:06d}.arc.gz", 1 + (part + n) % 2
                if not body:
                    first = arc_version_block(name, version, date)
                    body, size, plain = [_member(first)], 0, len(first)
                mark = "" if key is None else f"X-Page-Id: {key}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode()
                record = arc_record(ArcRecord(url or f"urn:page:{key}", "0.0.0.0", date, "text/html", head + payload, version), name, plain)
                body.append(_member(record))
                plain += len(record)
                size += len(payload)
                if size >= archive_bytes:
                    yield _rows(ARCHIVE, (pa.string(), pa.binary()), [(name, b"".join(body))])
                    n, body = n + 1, []
        if body:
            yield _rows(ARCHIVE, (pa.string(), pa.binary()), [(f"pages-{part:06d}-{n:06d}.arc.gz", b"".join(body))])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(write, ARCHIVE)


INDEX = "archive string, place int, page_id long, url string, date string, payload_bytes long, payload_sha1 string, record_id string"
_INDEX_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())


def index_arc(archives: DataFrame) -> DataFrame:
    """A row for each HTTP record of ARC archives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("archive").to_pylist(), batch.column("body"), strict=True):
                out = []
                for place, record in enumerate(read_arc(b"".join(gunzip(body.as_py())))):
                    if http := split_http(record.content):
                        out.append((name, place, _page_id(http[0]), record.url, warc_date(record.date), len(http[1]), hashlib.sha1(http[1]).hexdigest(), warc_id(record, name, place)))
                yield _rows(INDEX, _INDEX_TYPES, out)

    return archives.mapInArrow(read, INDEX)


def revisits(index: DataFrame, least_bytes: int) -> DataFrame:
    """archive, place and what they refer to, of records whose payload a later page has too.

    Payloads are grouped before the rows are joined; of the groups only the few that
    are hot (at most ``MOST_HOT`` can be) are broadcast.
    """
    long = index.where(F.col("payload_bytes") >= least_bytes)
    same = cut(
        long.groupBy("payload_sha1", "payload_bytes")
        .agg(F.max(F.struct("page_id", "url", "date", "record_id")).alias("last"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and last.page_id is not null")
        .select("payload_sha1", "n", F.col("last.page_id").alias("to_page"), F.col("last.url").alias("to_url"), F.col("last.date").alias("to_date"), F.col("last.record_id").alias("to_record"))
    )
    hot = F.col("n") > F.lit(max(HOT_ROWS, index.count() // MOST_HOT))
    rows = long.select("archive", "place", "page_id", "payload_sha1")
    named = rows.join(F.broadcast(same.where(hot)), "payload_sha1", "left")
    cold = named.where("to_page is null").select(*rows.columns).join(same.where(~hot), "payload_sha1")
    both = named.where("to_page is not null").unionByName(cold)
    return both.where(~F.col("page_id").eqNullSafe(F.col("to_page"))).select("archive", "place", "to_page", "to_url", "to_date", "to_record")


def convert(archives: DataFrame, repeats: DataFrame) -> DataFrame:
    """WARC archives of ARC archives, each behind a warcinfo record."""

    def write(arc: pa.Table, own: pa.Table) -> pa.Table:
        if not arc.num_rows:
            return _rows_table([])
        name, body = arc["archive"][0].as_py(), arc["body"][0].as_py()
        refers = {r["place"]: (r["to_page"], r["to_url"], r["to_date"], r["to_record"]) for r in own.to_pylist()}
        new = name.replace(".arc", ".warc")
        info = b"software: coalign\r\nformat: WARC File Format 1.1\r\n"
        out: list[bytes] = []
        for place, record in enumerate(read_arc(b"".join(gunzip(body)))):
            if not out:
                out.append(_member(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(new)), ("WARC-Date", warc_date(record.date)), ("WARC-Filename", new), ("Content-Type", "application/warc-fields")], info)))
            out.append(_member(to_warc(record, name, place, refers.get(place))))
        return _rows_table([(new, b"".join(out))])

    def _rows_table(rows: list[tuple]) -> pa.Table:
        return pa.Table.from_batches([_rows(ARCHIVE, (pa.string(), pa.binary()), rows)])

    return archives.groupBy("archive").cogroup(repeats.groupBy("archive")).applyInArrow(write, ARCHIVE)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, date string"
_READ_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())


def read_pages(archives: DataFrame) -> DataFrame:
    """A row for each response or revisit of WARC archives; what the headers say of a payload is checked against it where it is there."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                out = []
                for member in gunzip(body.as_py()):
                    for fields, block in read_warc(member):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        header, payload = split_http(block) or (b"", block)
                        said = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        m = re.search(rb"\r\nContent-Length: (\d+)", header)
                        size = int(m[1]) if m else len(payload)
                        if kind == "response" and (hashlib.sha1(payload).hexdigest() != said or len(payload) != size):
                            raise ArchiveError(f"{fields['warc-record-id']} doesn't have its payload")
                        to = fields.get("warc-refers-to-page-id")
                        out.append((_page_id(header), size, said, kind, int(to) if to else None, fields["warc-record-id"], fields["warc-target-uri"], fields["warc-date"]))
                yield _rows(READ, _READ_TYPES, out)

    return archives.mapInArrow(read, READ)


def pages_to_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Pages written to legacy archives, converted, and the WARC archives: archive, body.

    Of records with equal payloads of at least ``least_bytes`` that of the largest page
    is a response and the others revisit it; rows that share the largest id are all
    responses. A null page is an empty payload, a null id is less than any other and
    stays null. An empty table gives no archive.
    """
    legacy = cut(write_arc(pages, id_col, url_col, html_col))
    archives = cut(convert(legacy, revisits(cut(index_arc(legacy)), least_bytes)))
    return archives
