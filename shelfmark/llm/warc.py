"""WARC archives: writing records with Spark's own writer, and a reader that salvages damaged files.

Writing. Pages with equal payloads get one ``response`` record, the others are ``revisit`` records that
refer to it. A record is one gzip member; Spark's text writer puts the members one after the other, with an
empty member (a valid one that adds nothing) as the separator that the writer asks for. So archives go to
any store that Spark writes to, and commits survive lost executors.

Reading. A file is read member by member. Where a check fails (the compressed data and its checksum, the
version line, the header, the length or a digest), the bytes are set aside, and the search goes on for the
next valid member or, in files that aren't compressed, for the next version line. What comes after a damage is
recovered, and every gap is logged with its place.

A null payload counts as an empty one. A row without a key never is what others refer to, unless none of
its equals has a key: then all of them are responses. Rows that repeat with their key are written and read
like any others, each as a response if the key is the smallest of its payload. Columns other than those
named are not read. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import scratch_path

#: Payloads smaller than this are always written in full.
MIN_REVISIT_BYTES = 0
#: Records of an archive at most. Files are read whole, so this bounds a reader's memory.
ARCHIVE_RECORDS = 2_000

VERSION = b"WARC/1.1\r\n"
_MEMBER = b"\x1f\x8b\x08"
_EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

READ_SCHEMA = (
    "path string, kind string, start long, length long, reason string, record_type string, record_id string, "
    "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, "
    "fields map<string,string>"
)
_READ_TYPES = pa.schema(
    [
        *((n, pa.string()) for n in ("path", "kind")), *((n, pa.int64()) for n in ("start", "length")),
        *(
            (n, pa.string())
            for n in "reason record_type record_id target_uri refers_to payload_digest".split()
        ),
        ("payload_bytes", pa.int64()), ("payload", pa.binary()),
        ("fields", pa.map_(pa.string(), pa.string())),
    ]
)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_id(key: str) -> str:
    """A stable id, so a row written again gets the same record."""
    return f"urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{key}')}"


def _record(
    key: str | None, uri: str | None, payload: bytes, of: str | None, name: str, date: str
) -> bytes:
    """A response with its payload, or a revisit with the response's header alone; the length in it
    is that of the payload referred to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode("ascii") + (payload if of is None else b"")
    clean = re.sub(r"[\r\n]", " ", uri or "")
    fields = [
        ("WARC-Type", "response" if of is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id(key or f'{clean} {name}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha1:{name}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if key is not None:
        fields.append(("WARC-Page-Key", key))
    if of is not None:
        fields += [
            ("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<{record_id(of)}>"),
            ("WARC-Refers-To-Page-Key", of),
        ]
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8") + b"\r\n"
    return head + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _with_originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``key, uri, payload, digest, original``: the smallest key with the same payload, null for that
    row itself. Keys are grouped by digest and combined before the shuffle; only digests that repeat
    are joined back, as plain rows whose hot keys Spark can split."""
    keyed = pages.withColumn("size", F.octet_length("payload")).withColumn("sha", F.sha1("payload"))
    rows = keyed.withColumn("name", F.concat_ws("-", "sha", F.col("size").cast("string")))
    first = (
        rows.filter(F.col("size") >= min_bytes)
        .groupBy("name")
        .agg(F.min("key").alias("original"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("name", "original")
    )
    joined = rows.join(first, "name", "left")
    again = F.col("original").isNotNull() & ~F.col("key").eqNullSafe(F.col("original"))
    return joined.select("key", "uri", "payload", F.when(again, F.col("original")).alias("original"))


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", body: str = "html",
    min_bytes: int = MIN_REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write a record for each row to gzip archives below ``path``."""
    chosen = pages.select(
        F.col(key).cast("long").alias("key"),
        F.col(uri).cast("string").alias("uri"),
        F.coalesce(F.col(body).cast("binary"), F.lit(b"")).alias("payload"),
    )

    @F.pandas_udf("binary")
    def record(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for keys, uris, payloads, originals in batches:
            yield pd.Series(
                [
                    _gzip(_record(k, u, p, o, digest(p), date))
                    for k, u, p, o in zip(keys, uris, payloads, originals)
                ],
                dtype=object,
            )

    rows = _with_originals(chosen, min_bytes)
    member = record(F.col("key").cast("string"), "uri", "payload", F.col("original").cast("string"))
    members = rows.select(member.cast("string").alias("value"))
    (
        members.write.option("encoding", "ISO-8859-1")
        .option("lineSep", _EMPTY_MEMBER.decode("latin-1"))
        .option("compression", "none")
        .option("maxRecordsPerFile", ARCHIVE_RECORDS)
        .text(path)
    )


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line without a colon")
        out[name.strip().lower()] = value.strip()
    return out


def _parse(data: bytes) -> tuple[dict, int]:
    """The record at the start of ``data`` and its length; ValueError names the check that fails."""
    line = _VERSION_LINE.match(data)
    if not line:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("header without end")
    fields = _fields(data[:end])
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        raise ValueError("no content length") from None
    if length < 0:
        raise ValueError("no content length")
    start = end + 4
    block = data[start : start + length]
    if len(block) < length or data[start + length : start + length + 4] != b"\r\n\r\n":
        raise ValueError("wrong content length")
    told = fields.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != digest(block):
        raise ValueError("wrong block digest")
    kind = fields.get("warc-type", "")
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if kind == "revisit":
            found = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
            size = int(found[1]) if found else None
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and told and told != digest(payload):
        raise ValueError("wrong payload digest")
    found = {
        "record_type": kind,
        "record_id": fields.get("warc-record-id", "").strip("<>"),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_digest": told or digest(payload),
        "payload_bytes": size,
        "payload": None if kind == "revisit" else payload,
        "fields": fields,
    }
    return found, start + length + 4


def _inflate(data: memoryview) -> tuple[bytes, int] | None:
    """The content and compressed length of the gzip member at the start of ``data``, if it is whole
    and its checksum right."""
    unpack = zlib.decompressobj(31)
    try:
        content = unpack.decompress(data)
    except zlib.error:
        return None
    return (content, len(data) - len(unpack.unused_data)) if unpack.eof else None


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """``("record", start, length, record)`` and ``("gap", start, length, reason)`` in file order."""
    view, at, gap, reason = memoryview(data), 0, None, ""

    def shut(until: int):
        if gap is not None and until > gap:
            yield "gap", gap, until - gap, reason

    while at < len(data):
        if data[at : at + 3] == _MEMBER:
            # most members are small: a window first, the rest of the file only where it doesn't do
            whole = _inflate(view[at : at + 32_768]) or _inflate(view[at : at + 2_000_000]) or _inflate(view[at:])
            problem = "broken member"
            if whole:
                content, length = whole
                try:
                    found = _parse(content) if content else None
                    if found and found[1] != len(content):
                        raise ValueError("member holds more than its record")
                except ValueError as e:
                    problem = str(e)
                else:
                    yield from shut(at)
                    gap = None
                    if found:
                        yield "record", at, length, found[0]
                    at += length
                    continue
        elif _VERSION_LINE.match(data, at):
            try:
                found, length = _parse(data[at:])
            except ValueError as e:
                problem = str(e)
            else:
                yield from shut(at)
                gap = None
                yield "record", at, length, found
                at += length
                continue
        else:
            problem = "no member or version line"
        if gap is None:
            gap, reason = at, problem
        line = _VERSION_LINE.search(data, at + 1)
        member = data.find(_MEMBER, at + 1)
        at = min((x for x in (member, line.start() if line else -1) if x >= 0), default=len(data))
    yield from shut(len(data))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records (kind ``record``) and quarantined byte ranges (kind ``gap``, with their reason) of all
    archives below ``path``, as ``READ_SCHEMA``; ``fields`` are the record's own header fields."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for kind, start, length, found in salvage(content.as_py()):
                    row = {"path": name.as_py(), "kind": kind, "start": start, "length": length}
                    row |= found if kind == "record" else {"reason": found}
                    rows.append(row | {"fields": list(row.get("fields", {}).items())})
                    held += len(row.get("payload") or b"") + 500
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, _READ_TYPES)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _READ_TYPES)

    return files.mapInArrow(read, READ_SCHEMA)


def round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Write archives of ``pages`` to the shared scratch folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **names)
    return read_archives(spark, path)
