"""Legacy web archives (ARC) to WARC.

An ARC file is a version block and then, for each capture, one header line whose fields depend on the
version (1: url, address, date, type, length; 2: url, address, date, type, result code, checksum,
location, offset, file name, length) and as many bytes as the line declares. Each archive becomes a WARC file: a warcinfo record
from the version block, and for each capture a response, a resource (where its block is no HTTP response), or a revisit of the capture with the
same payload that has the largest id. Record identifiers follow from archive and offset, dates, types and addresses from the header line.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored, table

#: Fields of a capture's header line, by the version that the version block declares (fixed by the format).
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
#: An archive is closed once it holds so many bytes; one larger capture still goes in whole.
ARCHIVE_BYTES = 4 << 20
#: Copies of a payload's newest capture, so that the captures of a payload that very many pages share are looked up in as many tasks.
SALTS = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "20240101000000"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_header(version: int, name: str) -> bytes:
    body = f"{version} 0 millrace\n{'URL IP-address Archive-date Content-type Archive-length' if version == 1 else 'URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length'}\n\n".encode()
    extra = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_capture(version: int, name: str, offset: int, url: str | None, payload: bytes, capture_id: int | None = None) -> bytes:
    """One capture. White space in the url would split the header line, so it is percent-encoded. The id goes into the HTTP header."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"
    own = b"" if capture_id is None else b"X-Page-Id: %d\r\n" % capture_id
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    line = f"{url} 0.0.0.0 {DATE} text/html" + ("" if version == 1 else f" 200 - - {offset} {name}") + f" {len(block)}\n"
    return line.encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """The captures of an ARC file, each with its header fields, ``at`` (its offset), ``http`` (the HTTP header; empty where there is none) and ``payload``.

    The version is read from the file's own version block. A header line of the wrong shape or a block
    shorter than declared raises ValueError: a broken archive isn't converted in part."""
    at, version = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line without end")
        fields = data[at:end].rstrip(b"\r").split(b" ")
        length, body = int(fields[-1]), end + 1
        block = data[body : body + length]
        if len(block) < length:
            raise ValueError("an ARC block is shorter than declared")
        here, at = at, body + length
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if version is None:
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        names = ARC_FIELDS[version]
        if len(fields) != len(names):
            raise ValueError(f"an ARC version {version} header line with {len(fields)} fields")
        http, gap, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        yield {n: f.decode("utf-8", "replace") for n, f in zip(names, fields, strict=True)} | {"at": here, "http": http + gap, "payload": payload}


def http_field(http: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", http)
    return found[1].decode("latin-1").strip() if found else None


def record_id(archive: str, offset: int) -> str:
    """The same id for the same capture, in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def warc_date(date: str) -> str:
    """ARC dates have 14 digits, early ones 12."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_file_start(archive: str, date: str) -> bytes:
    """The warcinfo record of a converted archive."""
    block = b"software: millrace\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(archive, 0)}", f"WARC-Date: {warc_date(date)}", f"WARC-Filename: {archive}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_record(archive: str, capture: dict, refers_to: tuple | None) -> bytes:
    """The WARC 1.1 record of a capture: a response or resource, or where ``refers_to`` (id, archive, offset) is given a revisit, whose block is the HTTP header alone."""
    kind = "revisit" if refers_to else "response" if capture["http"] else "resource"
    block = capture["http"] + (b"" if refers_to else capture["payload"])
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(archive, capture['at'])}", f"WARC-Warcinfo-ID: {record_id(archive, 0)}",
        f"WARC-Date: {warc_date(capture['date'])}", f"WARC-Target-URI: {capture['url']}",
        f"WARC-Payload-Digest: sha1:{payload_digest(capture['payload'])}", f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        f"Content-Type: {capture['type'] if kind == 'resource' else 'application/http; msgtype=response'}", f"Content-Length: {len(block)}",
    ]
    if capture["ip"] not in ("0.0.0.0", "-"):
        lines.append(f"WARC-IP-Address: {capture['ip']}")
    if refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*refers_to[1:])}", f"X-Refers-To-Page-Id: {refers_to[0]}", f"X-Payload-Length: {len(capture['payload'])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names in lower case) and block of every record; a truncated record raises ValueError."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError("a WARC record is shorter than declared")
        yield headers, block
        at = end + 8 + length


def _archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, url, html) as ARC files of bounded size, versions in turn."""
    task, number, out, held = TaskContext.get().partitionId(), 0, [], 0

    def closed():
        return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([b"".join(out)], pa.binary())], ["name", "content"])

    for batch in batches:
        for i, url, html in zip(*(batch.column(c).to_pylist() for c in range(2)), batch.column(2), strict=True):
            if not out:
                version, name = 1 + number % 2, f"legacy-{task:05d}-{number:05d}.arc"
                out, held, number = [arc_header(version, name)], 0, number + 1
                held = len(out[0])
            out.append(arc_capture(version, name, held, url, (html.as_py() or "").encode(), i))
            held += len(out[-1])
            if held >= ARCHIVE_BYTES:
                yield closed()
                out = []
    if out:
        yield closed()


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each HTTP capture stands, its id, payload length and SHA-256."""
    for batch in batches:
        for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = ((c, http_field(c["http"], b"X-Page-Id")) for c in parse_arc(content.as_buffer().to_pybytes()) if c["http"])
            rows = [(archive, c["at"], int(i) if i else None, len(c["payload"]), hashlib.sha256(c["payload"]).digest()) for c, i in found]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["archive", "at", "id", "n", "digest"])


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (archive, content, revisits) as WARC files."""
    for batch in batches:
        for archive, content, revisits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            refers = {r["at"]: (r["id"], r["archive"], r["offset"]) for r in revisits or ()}
            captures = list(parse_arc(content.as_buffer().to_pybytes()))
            out = [warc_file_start(archive, min((c["date"] for c in captures), default=DATE)), *(warc_record(archive, c, refers.get(c["at"])) for c in captures)]
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.string()), pa.array([len(captures)], pa.int64()), pa.array([b"".join(out)], pa.binary())], ["archive", "records", "content"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "url", "date", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for h, block in parse_warc(content.as_buffer().to_pybytes()):
                kind = h["warc-type"]
                if kind == "warcinfo":
                    continue
                http, payload = (b"", block) if kind == "resource" else (lambda x: (x[0], x[2]))(block.partition(b"\r\n\r\n"))
                revisit, page = kind == "revisit", http_field(http, b"X-Page-Id")
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and payload_digest(payload) != digest:
                    raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
                rows.append((int(page) if page else None, h["warc-target-uri"], h["warc-date"], h["warc-record-id"], kind, int(h["x-payload-length"]) if revisit else len(payload), digest, int(h["x-refers-to-page-id"]) if revisit else None, None if revisit else payload))
                held += len(payload)
                if held >= ARCHIVE_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` as legacy ARC files of many captures, (name, content), versions 1 and 2 in turn.

    A null html is an empty payload, a null url is ``-``, a null id is left out. Repeated rows are captures each. Other columns are ignored, whatever
    their names. An empty table gives no archive. The files' names and cuts follow the table's partitions: store them before they are read twice.
    """
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_archived, "name string, content binary")


def convert_archives(archives: DataFrame, name_col: str = "name", content_col: str = "content", least_bytes: int = 0) -> DataFrame:
    """ARC files (as from ``archive_pages``, or Spark's ``binaryFile`` with ``path``) as WARC files, one row for each: (archive, records, content).

    Of the captures with equal payloads of ``least_bytes`` or more, the one with the largest id is the response and
    the others are revisits that refer to it; shorter payloads are all responses. The id is the HTTP header's ``X-Page-Id``; a capture
    without one is never the largest, and where no capture of a payload has one, all are responses. Captures without an HTTP response are resources.

    Captures that repeat the largest id with the same payload are all
    responses. A null content is skipped, a null name is one name. Other columns are ignored. An empty table gives no file. A broken archive raises ValueError.
    """
    arcs = archives.where(F.col(content_col).isNotNull()).select(F.coalesce(F.col(name_col), F.lit("-")).alias("archive"), F.col(content_col).alias("content"))
    slim = stored(arcs.mapInArrow(_captures, "archive string, at long, id long, n long, digest binary").where(F.col("n") >= least_bytes), "warc-captures")
    # SHA-256, not the SHA-1 that is written, decides what is equal. The newest capture of a payload is looked up in SALTS copies.
    newest = slim.groupBy("digest").agg(F.max(F.struct("id", "archive", "at")).alias("new"), F.count("*").alias("copies")).where("copies > 1 and new.id is not null")
    newest = newest.select("digest", "new", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    older = slim.withColumn("salt", F.pmod(F.xxhash64("archive", "at"), F.lit(SALTS)).cast("int")).join(newest, ["digest", "salt"]).where(F.col("id").isNull() | (F.col("id") < F.col("new.id")))
    # An archive's size bounds its list.
    revisits = older.groupBy(F.col("archive").alias("of")).agg(F.collect_list(F.struct("at", F.col("new.id").alias("id"), F.col("new.archive").alias("archive"), F.col("new.at").alias("offset"))).alias("revisits"))
    # Partitions follow the number of archives, so that a task has a few of them whatever the input's size.
    n = arcs.count() // 4 + 1
    return arcs.repartition(n, "archive").join(revisits.repartition(n, "of"), F.col("archive") == F.col("of"), "left").select("archive", "content", "revisits").mapInArrow(_converted, "archive string, records long, content binary")


def read_archives(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """The captures of WARC archives (as from ``convert_archives``, or Spark's ``binaryFile``), payload digests verified.

    ``payload_bytes`` and ``payload_digest`` are of the full payload, for revisits too; ``payload`` is null for these. A null content is skipped; an empty table gives an empty one."""
    schema = "page_id long, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return archives.select(content_col).where(F.col(content_col).isNotNull()).mapInArrow(_read, schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page from a legacy archive to a WARC file, and read back."""
    archives = stored(archive_pages(table(spark, sf_dir, "pages")), "arc")
    return read_archives(stored(convert_archives(archives), "warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS newest FROM p),
d AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::BIGINT) AS parts FROM g)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  array_to_string(list_transform(parts, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32768) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 1024) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to FROM d
"""
