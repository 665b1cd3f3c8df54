"""Operator 3, legacy web archives to WARC.

`pages_to_arc` makes ARC archives (versions 1 and 2 in turn), `convert_arc` parses ARC archives of any origin by their version's header line
and the declared lengths and gives equivalent WARC records, `write_warc` writes them as .warc.gz files of the shared folder
and `read_warc` reads such files back, again by declared lengths.

The version block is the record at the start of an archive whose URL begins with `filedesc://`; its own header line has the fields of its version, and its
body names the fields of the others. A page whose URL begins so is a record like any other. URLs and media types may hold spaces: the fields around them do not.
Where an archive breaks the format, its records up to there are converted, the rest of it is set aside, and a row tells why (`malformed`); write_warc leaves
such rows out.

Among records with equal payloads of at least MIN_REVISIT bytes those with the smallest page id are responses and the others are
revisits that refer to the first of them. Types come from a count a digest (pre-aggregated before its shuffle), joined back to the records; Spark
broadcasts the digests with two or more records if they are few, and splits hot digests otherwise.

WARC-Record-ID derives from the archive's name and the record's place in it, so no two records share one. A record's page id is that of its X-Page-Id header; records
without one, as in foreign archives, have a null page id and are always responses. Null html is an empty payload; a null url
becomes `urn:none`; white space and control characters of a url are percent-encoded. Dates derive from the page id, or from the payload if it is null. Repeated page ids give a
record each. An archive is closed after ARC_BYTES of payload; a longer page is an archive of its own, and memory grows with the longest page. An empty table gives no
archives and an empty result. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import materialize, new_path, release

MIN_REVISIT = 100
#: Bytes of payload after which an ARC archive is closed.
ARC_BYTES = 8 << 20
#: Bytes of payload in a WARC file, about, and records at most.
WARC_BYTES, RECORDS_PER_FILE = 64 << 20, 20_000
#: Fixed values of the ARC format: the fields of a record's header line by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
EPOCH = datetime(2001, 1, 1, tzinfo=timezone.utc)
#: A header line by version: only the URL and the media type may hold spaces.
ARC_LINE = {
    1: re.compile(r"(.*) (\S+) (\d{8,17}|-) (.*) (\d+)"),
    2: re.compile(r"(.*) (\S+) (\d{8,17}|-) (.*) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+)"),
}
CONVERTED = "archive string, offset bigint, page_id bigint, target_uri string, warc_date string, media_type string, http_head string, payload binary, payload_bytes bigint, payload_digest string, malformed string"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def safe_uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f\s]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url) if url else "urn:none"


def arc_line(version: int, values: dict[str, str]) -> bytes:
    return (" ".join(values.get(f, "-") for f in ARC_FIELDS[version]) + "\n").encode()


def arc_bytes(version: int, name: str, records: list[tuple[int | None, str | None, bytes]]) -> bytes:
    """An ARC archive: the version block, then each record's header line and as many bytes as it declares."""
    about = f"{version} 0 polislake\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    own = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20010101000000", "Content-type": "text/plain", "Result-code": "200", "Offset": "0", "Filename": name, "Archive-length": str(len(about))}
    out = [arc_line(version, own), about]
    at = sum(map(len, out))
    for page_id, url, payload in records:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        number = int(hashlib.sha256(payload).hexdigest()[:15], 16) if page_id is None else abs(page_id)
        when = EPOCH + timedelta(seconds=number % 10**9)
        values = {"URL": safe_uri(url), "IP-address": "0.0.0.0", "Archive-date": when.strftime("%Y%m%d%H%M%S"), "Content-type": "text/html", "Archive-length": str(len(head) + len(payload))}
        if version == 2:
            values |= {"Result-code": "200", "Checksum": hashlib.md5(payload).hexdigest(), "Offset": str(at), "Filename": name}
        made = [arc_line(version, values), head, payload, b"\n"]
        at += sum(map(len, made))
        out += made
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC archive: fields of the header line by the version and names that its version block declares, offset and body. Raises ValueError where it breaks the format."""
    at, version, names = 0, 1, ARC_FIELDS[1]
    while at < len(data):
        end = data.find(b"\n", at)
        if end == at:  # the line feed between records
            at += 1
            continue
        if end < 0:
            raise ValueError(f"the header line at {at} has no end")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        about = at == 0 and line.startswith("filedesc://")
        found = next((m for v in ((2, 1) if about else (version,)) if (m := ARC_LINE[v].fullmatch(line))), None)
        if not found:
            raise ValueError(f"the header line at {at} does not have the fields of version {version}")
        size = int(found[found.re.groups])
        body = data[end + 1 : end + 1 + size]
        if len(body) != size:
            raise ValueError(f"the record at {at} is shorter than it declares")
        if about:
            told = body.decode("utf-8", "replace").split("\n")
            number = told[0].split(" ")[0]
            if number not in ("1", "2"):
                raise ValueError(f"version {number!r} is not known")
            version = int(number)
            names = tuple(told[1].split()) if len(told) > 1 and len(told[1].split()) == len(ARC_FIELDS[version]) else ARC_FIELDS[version]
        else:
            yield dict(zip(names, found.groups(), strict=True)) | {"offset": at, "body": body}
        at = end + 1 + size


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """archive string, content binary: ARC archives that hold all pages."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, made, part = [], 0, 0, TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            nonlocal held, size, made
            made += 1
            name = f"legacy-{part}-{made}.arc"
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_bytes(1 + made % 2, name, held)], pa.binary())], ["archive", "content"])
            held, size = [], 0
            return row

        for b in batches:
            for page_id, url, html in zip(b.column(0), b.column(1), b.column(2).cast(pa.binary()), strict=True):
                payload = html.as_py() or b""
                held.append((page_id.as_py(), url.as_py(), payload))
                size += len(payload)
                if size >= ARC_BYTES:
                    yield close()
        if held:
            yield close()

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(make, "archive string, content binary")


def arc_date(value: str) -> str | None:
    """The WARC date of an ARC date of 8 to 17 digits; null if it is none."""
    d = (value[:14] + "0" * 14)[:14] if value.isdigit() else ""
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z" if d else None


def convert_arc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row a record of ARC archives (archive string, content binary), with what its WARC record needs; a row with `malformed` for the rest of an archive that breaks the format."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("media_type", pa.string()), ("http_head", pa.string()), ("payload", pa.binary()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("malformed", pa.string()),
        ])
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size = [], 0
                try:
                    for r in parse_arc(content.as_py() or b""):
                        head, split, payload = r["body"].partition(b"\r\n\r\n")
                        if not split or not head.startswith(b"HTTP/"):  # not a web page's answer: all of it is payload
                            head, payload = b"", r["body"]
                        text = head.decode("latin-1")
                        found = re.search(r"(?im)^X-Page-Id: (-?\d+)\r?$", text)
                        rows.append({
                            "archive": archive, "offset": r["offset"], "page_id": int(found[1]) if found else None, "target_uri": safe_uri(r["URL"]), "warc_date": arc_date(r["Archive-date"]), "media_type": r["Content-type"],
                            "http_head": text + "\r\n\r\n" if text else "", "payload": payload if with_payload else None, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(),
                        })
                        size += len(payload)
                        if size >= ARC_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                except ValueError as e:
                    rows.append({"archive": archive, "malformed": str(e)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("archive", "content").mapInArrow(convert, CONVERTED)


def record_id(archive: Column, offset: Column) -> Column:
    """A version 8 style UUID from where the record was."""
    h = F.sha2(F.concat_ws(" ", archive, offset.cast("string")), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12)))


def with_types(records: DataFrame, digests: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Adds record_type, refers_to and first_record (archive and offset of the response). digests: payload_digest, payload_bytes, page_id, archive and offset of all records."""
    shared = (
        digests.where((F.col("payload_bytes") >= min_revisit) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min(F.struct("page_id", "archive", "offset")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("payload_digest", "first")
    )
    again = F.col("first").isNotNull() & (F.col("page_id") != F.col("first.page_id"))
    return records.join(shared, "payload_digest", "left").withColumns(
        {"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first.page_id")), "first_record": F.when(again, F.col("first"))}
    ).drop("first")


def write_warc(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Files of WARC/1.1 records. A revisit has its HTTP header only; its payload's digest and length stay in its header."""
    revisit = F.col("record_type") == "revisit"
    head_bytes = F.encode("http_head", "ISO-8859-1")
    block = F.when(revisit, head_bytes).otherwise(F.concat(head_bytes, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    named = lambda archive, offset: F.concat(F.lit("<"), record_id(archive, offset), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", named(F.col("archive"), F.col("offset"))), line("WARC-Date", F.coalesce("warc_date", F.lit("1970-01-01T00:00:00Z"))),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), line("WARC-Identified-Payload-Type", F.col("media_type")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", named(F.col("first_record.archive"), F.col("first_record.offset"))), line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.when(F.col("http_head") == "", F.col("media_type")).otherwise(F.lit("application/http; msgtype=response"))),
        line("Content-Length", F.octet_length(F.col("block")).cast("string")), F.lit("\r\n"),
    )
    record = records.where(F.col("malformed").isNull()).withColumn("block", block).select(F.concat(F.encode(head, "UTF-8"), F.col("block")).cast("string").alias("value"))
    record.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while True:
        line = stream.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record was expected")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is shorter than it declares")
        yield head, block


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row a record of the archives below `path`. The digest of a response is taken from the payload read, and must be the declared one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                data = content.as_buffer()
                if not len(data):
                    continue
                for head, block in parse_warc(io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(data)))):
                    kind, told = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                    payload = block.partition(b"\r\n\r\n")[2] if head["content-type"].startswith("application/http") else block
                    length = len(payload)
                    if kind == "revisit":
                        length = int(head["x-payload-length"])
                    elif hashlib.sha256(payload).hexdigest() != told:
                        raise ValueError(f"the payload of page {head['x-page-id']} does not have the digest it declares")
                    to = head.get("x-refers-to-page-id")
                    rows.append({"page_id": int(head["x-page-id"]) if head["x-page-id"] else None, "payload_bytes": length, "payload_digest": told, "record_type": kind, "refers_to": to and int(to), "payload": payload if with_payload else None})
                    size += len(payload)
                    if size >= ARC_BYTES or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, READ)


def archive_pages(pages: DataFrame, path: str | None = None) -> str:
    """Pages through ARC archives to WARC files; the folder they are in."""
    path = path or new_path(pages.sparkSession, "warc")
    archives = materialize(pages_to_arc(pages), "arc", compression="zstd")
    convert_archives(archives, path)
    release(archives)
    return path


def convert_archives(archives: DataFrame, path: str) -> None:
    """ARC archives (archive string, content binary) to WARC files below `path`."""
    digests = convert_arc(archives, with_payload=False).where(F.col("malformed").isNull()).select("page_id", "payload_bytes", "payload_digest", "archive", "offset")
    digests = materialize(digests, "digests")
    # As many records a file as take WARC_BYTES at their mean size.
    size, n = digests.agg(F.sum("payload_bytes"), F.count(F.lit(1))).first()
    per_file = min(RECORDS_PER_FILE, max(1, WARC_BYTES * n // max(1, size or 0)))
    write_warc(with_types(convert_arc(archives), digests), path, per_file)
    release(digests)


ORACLE_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM f
"""
