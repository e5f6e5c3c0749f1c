"""Converter of legacy ARC archives to WARC.

An ARC file begins with a version block whose second line names the version: 1 gives
every record a header line of five fields, 2 one of ten. The last field is the length
of what follows; payloads are never searched for borders. The converter parses both,
and synthesises what WARC wants beyond that: record identifiers (name-based UUIDs of
archive and offset, so a repeated task makes the same ones), ISO 8601 timestamps of
14-digit dates, record types, block and payload digests.

Of records with the same payload one stays a response and the others become
revisits of it. Only (archive, offset, id, digest) rows are grouped for that; the
records themselves are shuffled once, by archive and offset, which no two share.

WARC files are written by Spark's text writer, whose line separator is the two empty
lines that end a record: a row is a run of whole records, and a lost task leaves
no half file. They are read back by declared lengths.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, keep, shared_dir

#: A payload of at least so many bytes that another record has too is written once.
LEAST_SHARED = 1000
#: Bytes of records that one row of an archive holds, unless one record has more.
RUN_BYTES = 1 << 20
#: Rows of a WARC file, hence its size before compression in megabytes.
RUNS_PER_FILE = 64
#: Parts that a payload's occurrences are dealt into where they meet the one that stays.
SALTS = 32
#: Capture date of pages that have none.
DATE = "20010101000000"

# fixed values of the formats
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
WARC_VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
#: Names of the fields that carry a page's id through an archive.
PAGE_ID, REFERS_TO_PAGE = "X-Page-Id", "WARC-Refers-To-Page-Id"

PARSED = "archive string, offset long, page_id long, url string, ip string, date string, mime string, kind string, block binary, payload_bytes long, payload_digest string"


class ArchiveError(ValueError):
    """Bytes that are no archive; says where and why."""


def _opened(content: bytes) -> io.BufferedIOBase:
    """The archive as a stream; members of gzip, one or one for each record, are joined."""
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


# --- writing ARC


def _token(value: str | None) -> str:
    """A field of a header line: what would end it is percent-encoded, nothing is a hyphen."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "") or "-"


def version_block(name: str, version: int, date: str = DATE) -> bytes:
    """The first record of an ARC file, which names itself and says how header lines read."""
    body = f"{version} 0 pages\n{' '.join(FIELDS[version])}\n".encode()
    more = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str | None, block: bytes, version: int, name: str, offset: int, date: str = DATE, ip: str = "0.0.0.0", mime: str = "text/html") -> bytes:
    """One record: header line, block, line end."""
    more = f" 200 {hashlib.md5(block, usedforsecurity=False).hexdigest()} - {offset} {name}" if version == 2 else ""
    return f"{_token(url)} {ip} {date} {mime}{more} {len(block)}\n".encode("utf-8", "surrogatepass") + block + b"\n"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    """A page as the server's answer that crawlers store."""
    named = f"{PAGE_ID}: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{named}\r\n".encode() + payload


def arc_archives(pages: DataFrame, version: int | None = None) -> DataFrame:
    """(path, content): ARC archives of ``pages`` (page_id, url, html), some megabytes each.

    Without a ``version`` archives of both alternate. Null html is empty; a null url
    is a hyphen; a null page_id goes unnamed. Other columns play no part.
    """
    if version not in (None, *FIELDS):
        raise ValueError(f"unknown version {version!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, out = TaskContext.get().partitionId(), 0, bytearray()
        name, kind = "", 1

        def archive() -> pa.RecordBatch:
            return pa.record_batch([pa.array([name]), pa.array([bytes(out)], pa.binary())], ["path", "content"])

        for batch in batches:
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block = http_block(page_id, (html.as_py() or "").encode("utf-8", "surrogatepass"))
                if out and len(out) + len(block) > RUN_BYTES:
                    yield archive()
                    out.clear()
                if not out:
                    kind, number = version or 1 + (part + number) % 2, number + 1
                    name = f"pages-{part:06d}-{number:06d}.arc"
                    out += version_block(name, kind)
                out += arc_record(url, block, kind, name, len(out))
        if out:
            yield archive()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "path string, content binary")


# --- reading ARC


@dataclass
class ArcRecord:
    offset: int
    url: str
    ip: str
    date: str
    mime: str
    code: str | None
    block: bytes


def _header(line: bytes, version: int, where: str) -> dict[str, str]:
    names, values = FIELDS[version], line.decode("utf-8", "surrogateescape").split(" ")
    # content types of some writers hold spaces: what is too much belongs to that field
    extra, at = len(values) - len(names), names.index("Content-type")
    if extra < 0 or not values[-1].isdigit():
        raise ArchiveError(f"{where}: not a header line of version {version}")
    values[at : at + extra + 1] = [" ".join(values[at : at + extra + 1])]
    return dict(zip(names, values, strict=True))


def read_arc(content: bytes, name: str = "") -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block, whichever of the two versions it is."""
    stream, at, version, where = _opened(content), 0, None, name
    while line := stream.readline():
        start, at, where = at, at + len(line), f"{name} at {at}"
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        if version is None:
            # the version block's own line has as many fields as its version's records
            if not line.startswith(b"filedesc://"):
                raise ArchiveError(f"{where}: no version block")
            size = line.rsplit(b" ", 1)[-1]
            block = stream.read(int(size)) if size.isdigit() else b""
            said = block.split(b"\n", 1)[0].split(b" ")[0]
            if said not in (b"1", b"2"):
                raise ArchiveError(f"{where}: unknown version")
            version, at = int(said), at + len(block)
            continue
        head = _header(line, version, where)
        block = stream.read(int(head["Archive-length"]))
        at += len(block)
        if len(block) < int(head["Archive-length"]):
            raise ArchiveError(f"{where}: shorter than declared")
        yield ArcRecord(start, head["URL"], head["IP-address"], head["Archive-date"], head["Content-type"], head.get("Result-code"), block)


def split_http(block: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (in lower case) and payload of an HTTP answer; None if the block is none."""
    if not block.startswith(b"HTTP/"):
        return None
    found = re.search(rb"\r?\n\r?\n", block)
    if found is None:
        return None
    lines = block[: found.start()].decode("latin-1").splitlines()[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, block[found.end() :]


def timestamp(date: str) -> str:
    """ISO 8601 of a date of 4 to 14 digits; what is missing is the beginning of the period."""
    digits = re.match(r"\d{0,14}", date)[0]
    if len(digits) < 4:
        return timestamp(DATE)
    full = digits + "00000101000000"[len(digits) :] if len(digits) % 2 == 0 else digits[:-1] + "00000101000000"[len(digits) - 1 :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def _parsed(name: str, r: ArcRecord, blocks: bool) -> tuple:
    """A row of PARSED."""
    http = split_http(r.block)
    fields, payload = http if http else ({}, r.block)
    kind = "response" if http or r.url.startswith("dns:") else "resource"
    said = fields.get(PAGE_ID.lower(), "")
    page_id = int(said) if re.fullmatch(r"-?\d+", said) else None
    return name, r.offset, page_id, r.url, r.ip, timestamp(r.date), r.mime, kind if not http else "http", r.block if blocks else None, len(payload), hashlib.sha1(payload, usedforsecurity=False).hexdigest()


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in PARSED.split(", ")])


def _batched(rows: Iterable[tuple[tuple, int]]) -> Iterator[list[tuple]]:
    """Lists of rows of some megabytes by the rows' given sizes."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 256
        if size > 4 * RUN_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def parse_arc(archives: DataFrame, blocks: bool = True) -> DataFrame:
    """The records of ARC files (path, content), as ``spark.read.format("binaryFile")``
    gives them: archive, offset, page_id (of the field X-Page-Id), url, ip, date in ISO 8601, mime, kind
    (http, response or resource), block, and size and SHA-1 of the payload. Without
    ``blocks`` the block is null. Broken files raise an error that names file and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = path.rsplit("/", 1)[-1]
                records = read_arc(content.as_py(), name)
                for rows in _batched((_parsed(name, r, blocks), len(r.block) if blocks else 0) for r in records):
                    yield _columns(rows)

    return archives.select("path", "content").mapInArrow(run, PARSED)


# --- converting to WARC


def record_id(archive: str, offset: int) -> str:
    """A record's identifier: a UUID of its place."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def _sha1(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """Header and block, without the two empty lines that follow."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return WARC_VERSION + b"\r\n" + lines.encode("utf-8", "surrogateescape") + b"\r\n" + block


def _converted(archive: str, offset: int, url: str, ip: str, date: str, mime: str, kind: str, block: bytes, digest: str, of: dict | None) -> bytes:
    """The WARC record of an ARC record; ``of`` has archive, offset, url, date and page_id of the record that it revisits."""
    http = kind == "http"
    shared = [("WARC-Record-ID", record_id(archive, offset)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-IP-Address", ip if re.fullmatch(r"[0-9A-Fa-f.:]+", ip) and ip != "0.0.0.0" else None)]
    kept = block
    if of:
        # the answer's header stays, the payload is that of the other record
        kept = block[: re.search(rb"\r?\n\r?\n", block).end()] if http else b""
        shared += [("WARC-Refers-To", record_id(of["archive"], of["offset"])), ("WARC-Refers-To-Target-URI", of["url"]), ("WARC-Refers-To-Date", of["date"]), ("WARC-Profile", IDENTICAL), (REFERS_TO_PAGE, of["page_id"])]
    told = hashlib.sha1(kept, usedforsecurity=False).hexdigest()
    types = [("WARC-Type", "revisit" if of else "resource" if kind == "resource" else "response"), ("Content-Type", "application/http; msgtype=response" if http else mime)]
    return warc_record([*types, *shared, ("WARC-Block-Digest", _sha1(told)), ("WARC-Payload-Digest", _sha1(digest))], kept)


def revisits(facts: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(archive, offset, of) of the records whose payload another one keeps.

    Of records with the same payload of ``least`` bytes or more, the one with the
    largest page_id (null is smallest; then the last place) is kept.
    """
    of = F.struct("page_id", "archive", "offset", "url", "date")
    large = facts.where(F.col("payload_bytes") >= least)
    one = large.groupBy("payload_digest", "payload_bytes").agg(F.max(of).alias("of"), F.count("*").alias("n")).where("n > 1")
    one = one.select("payload_digest", "payload_bytes", "of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = large.select("payload_digest", "payload_bytes", "archive", "offset", F.pmod(F.xxhash64("archive", "offset"), F.lit(SALTS)).cast("int").alias("salt"))
    met = salted.join(one, ["payload_digest", "payload_bytes", "salt"])
    return met.where((F.col("archive") != F.col("of.archive")) | (F.col("offset") != F.col("of.offset"))).select("archive", "offset", "of")


def write_warc(archives: DataFrame, path: str, least: int = LEAST_SHARED) -> None:
    """Convert ARC files (path, content) to gzipped WARC files under ``path``. The archives are
    read twice, so they must be the same each time, as files are."""
    facts = parse_arc(archives, blocks=False).where(F.col("payload_bytes") >= least)
    facts = keep(facts.select("page_id", "archive", "offset", "url", "date", "payload_digest", "payload_bytes"), "facts")
    again = revisits(facts, least)
    records = parse_arc(archives).drop("page_id", "payload_bytes").join(again, ["archive", "offset"], "left")
    order = ("archive", "offset", "url", "ip", "date", "mime", "kind", "block", "payload_digest", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, out = TaskContext.get().partitionId(), 0, []
        size = 0

        def row() -> pa.RecordBatch:
            """A run of records; the first one of a file tells about the file."""
            nonlocal number, size
            if number % RUNS_PER_FILE == 0:
                about = b"software: humsearch\r\nformat: WARC File Format 1.1\r\n"
                out.insert(0, warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f"warcinfo-{part}", number)), ("WARC-Date", timestamp(DATE)), ("Content-Type", "application/warc-fields")], about))
            made = pa.record_batch([pa.array([RECORD_END.encode().join(out)], pa.binary())], ["run"])
            number, size = number + 1, 0
            out.clear()
            return made

        for batch in batches:
            texts = [batch.column(c).to_pylist() for c in order if c not in ("block", "of")]
            for k, (archive, offset, url, ip, date, mime, kind, digest) in enumerate(zip(*texts, strict=True)):
                record = _converted(archive, offset, url, ip, date, mime, kind, batch.column("block")[k].as_py(), digest, batch.column("of")[k].as_py())
                if out and size + len(record) > RUN_BYTES:
                    yield row()
                out.append(record)
                size += len(record)
        if out:
            yield row()

    runs = records.select(*order).mapInArrow(run, "run binary").select(F.col("run").cast("string").alias("value"))
    runs.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RUNS_PER_FILE).text(path)
    discard(facts)


# --- reading WARC


def read_warc(content: bytes, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record; names in lower case."""
    stream, at = _opened(content), 0
    while line := stream.readline():
        where, at = f"{name} at {at}", at + len(line)
        if not line.rstrip(b"\r\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"{where}: no record")
        fields: dict[str, str] = {}
        while (line := stream.readline()).rstrip(b"\r\n"):
            at += len(line)
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            fields[k.strip().lower()] = v.strip()
        at += len(line)
        size = fields.get("content-length", "")
        if not size.isdigit():
            raise ArchiveError(f"{where}: no length")
        block = stream.read(int(size))
        at += len(block)
        if len(block) < int(size):
            raise ArchiveError(f"{where}: shorter than declared")
        yield fields, block


def _told(name: str, fields: dict[str, str], block: bytes) -> tuple | None:
    """What a record says of its page; payloads are checked against their digests."""
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit", "resource"):
        return None
    http = split_http(block)
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "revisit":
        size = int(http[0].get("content-length", 0)) if http else None
    else:
        payload = http[1] if http else block
        size = len(payload)
        if hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest:
            raise ArchiveError(f"{name}: {fields.get('warc-record-id')} has another payload than its digest says")
    number = lambda v: None if v is None else int(v)
    return number(http[0].get(PAGE_ID.lower()) if http else None), size, digest, kind, number(fields.get(REFERS_TO_PAGE.lower())), fields.get("warc-record-id"), fields.get("warc-refers-to")


TOLD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string"


def warc_pages(spark: SparkSession, path: str) -> DataFrame:
    """What the records of the WARC files under ``path`` say of their pages, as TOLD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = file.rsplit("/", 1)[-1]
                rows = (t for fields, block in read_warc(content.as_py(), name) if (t := _told(name, fields, block)))
                for held in _batched((r, 0) for r in rows):
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], [c.split()[0] for c in TOLD.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, TOLD)


def archived(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``pages``
    (page_id, url, html), read back from WARC files that the converter made of ARC archives.

    One row for each row of ``pages``. Null html is an empty payload. Of rows with the
    same page_id and payload, the largest of its payload's, one is the response and
    the others revisit it; a response without page_id is referred to as null. An empty
    table gives no rows.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(arc_archives(pages), path, least)
    return warc_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
