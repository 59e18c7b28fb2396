"""WARC archives: writing with deduplication and segmentation, and reading with segment reassembly.

Writing: each row is an HTTP response, its body in chunked transfer framing. Of rows with equal payloads the one with
the largest id is a `response` record, the others are `revisit` records that refer to it. A block longer than
`segment_bytes` is split: the first segment is the response, the others are `continuation` records that name it as their
origin and carry segment numbers, the last one the total length. Records are written by Spark's text writer, whose line
separator is the blank line that ends a WARC record, so files are committed like any Spark output. A file has at most
`file_records` records of at most `segment_bytes` and a head each.

Reading: whole records are decoded where they are read. Segments are grouped by origin identifier in one shuffle, put in
order of their numbers as a stream, checked for gaps and for the total length, joined, and decoded from chunked framing.

Defined cases: a null payload counts as empty, and empty payloads are equal payloads; a null url is written as an empty
target; a null id is written without an id and read back as null (it is the smallest). Of rows that tie for the largest
id of a payload one is the response. Record identifiers hold a key of the row, so rows that repeat an id and a payload
have records and segments of their own. Empty tables give empty archives and results. Extra columns are ignored,
whatever their names. A broken record (gap, wrong length, bad framing, a head that can't be read) is returned with an
`error` and a null payload, never dropped; reading goes on at the next record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import HOT_KEYS, HOT_LEAST, fresh_path, removed, with_row_key, written

SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
FILE_RECORDS = 4_096
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
CRLF = b"\r\n"
ROWS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """Decodes chunked transfer framing; raises ValueError where it is broken."""
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if data[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is cut")
        out.append(data[at : at + size])
        at += size + 2


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '/'.join(map(str, parts)))}>"


def page_records(row: int, page_id: int | None, url: str | None, payload: bytes, first: tuple[int, int | None] | None = None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page, each without the blank line that ends it; `first` (row, page id) makes it a revisit."""
    digest, revisit = base32_sha1(payload), first is not None
    own = record_id(row, digest)
    target = " ".join((url or "").split())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = http if revisit else http + chunked(payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", own),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", len(payload)),
        ("X-Page-ID", page_id),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first[0], digest)), ("X-Refers-To-Page-ID", first[1])]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) > 1:
        fields.append(("WARC-Segment-Number", 1))
    yield _head([*fields, ("Content-Length", len(parts[0]))]) + parts[0]
    for no, part in enumerate(parts[1:], 2):
        more = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", record_id(row, digest, no)),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", target),
            ("WARC-Segment-Origin-ID", own),
            ("WARC-Segment-Number", no),
            ("WARC-Segment-Total-Length", len(block) if no == len(parts) else None),
            ("Content-Length", len(part)),
        ]
        yield _head(more) + part


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Writes `pages` as gzipped archives in the folder `path`; payloads under `min_bytes` are all responses."""
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    rows, row = with_row_key(rows.withColumn("digest", F.unhex(F.sha1("payload"))), "warc-rows")
    # Only ids and digests are grouped; payloads stay where they are.
    last = F.max(F.struct("page_id", row))
    groups = written(rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(last.alias("last"), F.count("*").alias("n")).where("n > 1"), "payload-groups")
    # A row of a group that is not its last refers to it. Groups of many rows are at most HOT_KEYS: they are broadcast.
    many = max(HOT_LEAST, rows.count() // HOT_KEYS)
    hot, some = F.broadcast(groups.where(F.col("n") >= many).select("digest", F.col("last").alias("hot"))), groups.where(F.col("n") < many)
    keyed = rows.select("digest", row, F.octet_length("payload").alias("bytes"))
    others = keyed.join(hot, "digest", "left_anti").join(some.select("digest", "last"), "digest").where(F.col(row) != F.col(f"last.{row}"))
    others = others.where(F.col("bytes") >= min_bytes).select(row, "last")
    marked = rows.join(hot, "digest", "left").join(others, row, "left")
    first = F.when((F.octet_length("payload") >= min_bytes) & (F.col(f"hot.{row}") != F.col(row)), F.col("hot")).otherwise(F.col("last"))
    marked = marked.withColumn("first", first).select(row, "page_id", "url", "payload", F.col(f"first.{row}").alias("first_row"), F.col("first.page_id").alias("first_id"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for no, page_id, url, payload, first_row, first_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for record in page_records(no, page_id, url, payload, None if first_row is None else (first_row, first_id), segment_bytes):
                    out.append(record)
                    held += len(record)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = marked.mapInArrow(render, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)
    removed(rows, groups)


_NEXT = re.compile(rb"WARC/1\.[01]\r\n[A-Za-z-]+: ")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive; one that can't be read has an `error` among its fields."""
    at = 0
    while at < len(data):
        end, fields = data.find(b"\r\n\r\n", at), {}
        try:
            if end < 0 or not data.startswith(b"WARC/", at):
                raise ValueError(f"no record at byte {at}")
            fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:] if ": " in line)
            size, after = int(fields["Content-Length"]), end + 4 + int(fields["Content-Length"])
            if size < 0 or after > len(data) or data[after : after + 4] not in (b"", CRLF + CRLF):
                raise ValueError("the block is cut")
            for number in ("WARC-Segment-Number", "WARC-Segment-Total-Length", "X-Page-ID", "X-Refers-To-Page-ID", "X-Payload-Length"):
                int(fields.get(number, 0))
            if fields["WARC-Type"] == "continuation" and not {"WARC-Segment-Origin-ID", "WARC-Segment-Number"} <= fields.keys():
                raise ValueError("a continuation names no origin or number")
            if "WARC-Segment-Number" in fields and fields["WARC-Type"] != "continuation" and "WARC-Record-ID" not in fields:
                raise ValueError("a first segment has no identifier")
        except (ValueError, KeyError) as e:
            more = _NEXT.search(data, at + 1)
            target = fields.get("WARC-Target-URI")
            yield {"WARC-Type": fields.get("WARC-Type", "unknown"), **({"WARC-Target-URI": target} if target else {}), "error": f"the record can't be read: {e}"}, b""
            at = more.start() if more else len(data)
            continue
        yield fields, data[end + 4 : after]
        at = after + 4


def _row(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda k: int(fields[k]) if k in fields else None
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    head = (number("X-Page-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], number("X-Refers-To-Page-ID"))
    if "error" in fields:
        return (*head, None, None, None, fields["error"])
    if fields["WARC-Type"] == "revisit":
        return (*head, None, number("X-Payload-Length"), digest, None)
    http, blank, body = block.partition(b"\r\n\r\n")
    try:
        if not blank:
            raise ValueError("HTTP head is cut")
        payload = unchunked(body) if b"transfer-encoding: chunked" in http.lower() else body
        if digest and base32_sha1(payload) != digest:
            raise ValueError("payload digest differs")
    except ValueError as e:
        return (*head, None, None, None, str(e))
    return (*head, payload, len(payload), base32_sha1(payload), None)


def _batch(rows: list[tuple], keep_payload: bool) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    if not keep_payload:
        cols[4] = [None] * len(rows)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in ROWS.split(", ")])


def reassemble(segments: Iterator[tuple[str, int, int | None, dict[str, str] | None, bytes]]) -> Iterator[tuple]:
    """Rows from (origin, number, total length, fields of the first segment, block), ordered by origin and number."""

    def whole(parts: list[tuple]) -> tuple:
        fields = next((p[3] for p in parts if p[3]), None)
        total = next((p[2] for p in parts if p[2] is not None), None)
        block = b"".join(p[4] for p in parts)
        if fields is None or [p[1] for p in parts] != list(range(1, len(parts) + 1)):
            bad = "a segment is missing or repeated"
        elif total is None or total != len(block):
            bad = "segments differ from the total length"
        else:
            return _row(fields, block)
        got = _row(fields, b"")[:4] if fields else (None, None, "continuation", None)
        return (*got, None, None, None, bad)

    parts: list[tuple] = []
    for segment in segments:
        if parts and parts[0][0] != segment[0]:
            yield whole(parts)
            parts = []
        parts.append(segment)
    if parts:
        yield whole(parts)


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """A row per response, revisit or broken record of all archives in the folder `path`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = ["origin", "number", "total", "head", "block"]

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, held = [], 0
                for fields, block in parse_records(gzip.decompress(data)):
                    if "WARC-Segment-Number" not in fields:
                        rows.append(_row(fields, block))
                        held += len(block) if keep_payload else 0
                        if held > 8_000_000 or len(rows) >= 4096:
                            yield _batch(rows, keep_payload)
                            rows, held = [], 0
                yield _batch(rows, keep_payload)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for fields, block in parse_records(gzip.decompress(data)):
                    if (no := fields.get("WARC-Segment-Number")) is not None:
                        first = fields["WARC-Type"] != "continuation"
                        total = fields.get("WARC-Segment-Total-Length")
                        head = "\n".join(f"{k}: {v}" for k, v in fields.items()) if first else None
                        rows.append((fields["WARC-Record-ID"] if first else fields["WARC-Segment-Origin-ID"], int(no), total and int(total), head, block))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for batch in batches:
                for origin, no, total, head, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield origin, no, total, head and dict(x.split(": ", 1) for x in head.split("\n")), block

        rows, held = [], 0
        for row in reassemble(stream()):
            rows.append(row)
            held += len(row[4] or b"") if keep_payload else 0
            if held > 8_000_000 or len(rows) >= 4096:
                yield _batch(rows, keep_payload)
                rows, held = [], 0
        yield _batch(rows, keep_payload)

    parts = files.mapInArrow(segments, "origin string, number long, total long, head string, block binary")
    joined = parts.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(join, ROWS)
    return files.mapInArrow(wholes, ROWS).unionByName(joined)


def archive_path(spark: SparkSession) -> str:
    return fresh_path(spark, "warc")
