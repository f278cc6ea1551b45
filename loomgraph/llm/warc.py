"""WARC archives: writing with segments, reading with reassembly.

Every page is a WARC 1.1 record with an HTTP response in chunked transfer framing.
Record ids name the page and the row, so no two records share one.  Blocks over
``SEGMENT`` bytes are split into a first record and continuation records.  Pages whose
payload another page holds are revisit records without a payload, which name that page
and its address.

Reading parses records by their Content-Length; continuation records are grouped by
their origin's identifier, ordered by segment number, checked against the total
length, and only then is the transfer framing decoded and the payload verified
against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path

#: Bytes of a record's block before it is segmented; of a transfer chunk; records of a file.
SEGMENT, CHUNK, FILE_RECORDS = 32_768, 8_192, 1_000
EOL = b"\r\n"
_DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(EOL, at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if body[end + 2 + size : end + 4 + size] != EOL or len(out[-1]) != size:
            raise ValueError("damaged transfer chunk")
        at = end + 4 + size


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its last line end, which the file writer adds."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + EOL + EOL + block + EOL


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == EOL:
            at += 2
            continue
        end = data.index(EOL + EOL, at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not at a WARC record")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("record shorter than its Content-Length")
        yield headers, block
        at = end + 4 + size


def _clean(value: str | None) -> str:
    return "".join(c for c in value or "" if c not in "\r\n")


def write_warc(pages: DataFrame, out: str, min_bytes: int = 0) -> None:
    """Writes gzip-compressed archives of (page_id, url, html) to the folder ``out``.

    Null html is empty, a null or missing url too.  Of pages with equal payloads of at
    least ``min_bytes`` bytes the one with the largest page_id is the response, the others
    revisit it; repeated rows of that page are all responses, pages without an id too.
    Other columns are left out.  Files are compressed whole, as Spark's writer does.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url") if "url" in pages.columns else F.lit("").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html"))
    # Equal payloads: equal digest and length.  A third of the rows may share one, so
    # its smallest part is aggregated first and the join may be split.
    last = rows.select("page_id", "url", "sha1", F.octet_length("html").alias("size")).where(F.col("size") >= min_bytes)
    last = last.groupBy("sha1", "size").agg(F.max(F.struct("page_id", "url")).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1")
    last = materialise(last.select("sha1", F.col("h.page_id").alias("holder"), F.col("h.url").alias("holder_url")), "payloads")
    again = F.col("page_id") < F.col("holder")
    placed = rows.join(last, "sha1", "left").select("page_id", "url", "html", F.when(again, F.col("holder")).alias("refers_to"), F.when(again, F.col("holder_url")).alias("holder_url"))
    placed = placed.withColumn("row", F.monotonically_increasing_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, size = [], 0
            for page, url, html, holder, holder_url, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                digest = digest32(payload)
                name = f"urn:page:{'' if page is None else page}:{row}"
                head = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", "sha1:" + digest), ("X-Payload-Length", len(payload))]
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                if holder is not None:
                    block = http
                    kind = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", _clean(holder_url)), ("WARC-Refers-To-Date", _DATE), ("X-Refers-To-Page", holder)]
                    done.append(record([*kind, *head], block))
                else:
                    block = http + chunked(payload)
                    many = len(block) > SEGMENT
                    first = [("WARC-Type", "response"), *head, ("Content-Type", "application/http;msgtype=response")]
                    done.append(record([*first, *[("WARC-Segment-Number", 1)] * many], block[:SEGMENT]))
                    for k in range(1, -(-len(block) // SEGMENT)):
                        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{k + 1}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", k + 1)]
                        if (k + 1) * SEGMENT >= len(block):
                            own.append(("WARC-Segment-Total-Length", len(block)))
                        done.append(record(own, block[k * SEGMENT : (k + 1) * SEGMENT]))
                size += len(block)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["record"])
                    done, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["record"])

    records = placed.mapInArrow(pack, "record binary").select(F.col("record").cast("string").alias("value"))
    # The text writer copies the bytes as they are and ends each record.
    records.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(out)


def _payload_of(block: bytes) -> tuple[bytes, bool]:
    head, _, body = block.partition(EOL + EOL)
    framed = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(EOL))
    return (dechunked(body) if framed else body), framed


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: origin, segment, total, kind, page_id, digest, size, refers_to, block."""
    files = spark.read.format("binaryFile").load(folder).where(F.col("length") > 0).select("content")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["origin", "segment", "total", "kind", "page_id", "digest", "size", "refers_to", "block"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        page_of = lambda x: int(k) if (k := x.strip("<>").split(":")[2]) else None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                if blob[:2] == b"\x1f\x8b":
                    blob = zlib.decompress(blob, 47)
                rows, held = [], 0
                for h, block in parse(blob):
                    kind = h["warc-type"]
                    origin = h.get("warc-segment-origin-id", h["warc-record-id"])
                    own = kind != "continuation"
                    rows.append((
                        origin, int(h.get("warc-segment-number", 0)), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, kind,
                        page_of(origin), h["warc-payload-digest"].removeprefix("sha1:") if own else None, int(h["x-payload-length"]) if own else None, int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None, block,
                    ))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(scan, "origin string, segment int, total long, kind string, page_id long, digest string, size long, refers_to long, block binary")


def reassemble(records: DataFrame) -> DataFrame:
    """One row per page (page_id, kind, digest, size, refers_to, parts), its block's parts
    in order.  Records in one piece pass by; segments meet by origin, in order of segment
    number, and their lengths must add up.  An origin is one row's record, so a group is
    one page's block however often the page comes."""
    whole = records.where((F.col("segment") == 0) & (F.col("kind") != "continuation")).select("page_id", "kind", "digest", "size", "refers_to", F.array("block").alias("parts"))
    joined = records.where((F.col("segment") > 0) | (F.col("kind") == "continuation")).groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.max("size").alias("size"), F.max("total").alias("total"),
        F.sum(F.octet_length("block")).alias("held"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    parts = F.when(F.col("held") == F.col("total"), F.col("parts.block")).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), F.col("origin"))))
    return whole.union(joined.select("page_id", F.lit("response").alias("kind"), "digest", "size", F.lit(None).cast("long").alias("refers_to"), parts.alias("parts")))


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of
    every page in the archives; payloads are verified against their digests."""
    blocks = reassemble(read_records(spark, folder))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, kind, digest, size = (batch.column(i).to_pylist() for i in range(4))
            payload = []
            for i in range(batch.num_rows):
                got = None
                if kind[i] == "response":
                    got, _ = _payload_of(b"".join(batch.column(5)[i].as_py()))
                    if len(got) != size[i] or digest32(got) != digest[i]:
                        raise ValueError(f"payload of page {page[i]} is damaged")
                payload.append(got if payloads else None)
            columns = [batch.column(0), pa.array(size, pa.int64()), batch.column(2), batch.column(1), batch.column(4)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(payload, pa.binary())] * payloads], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return blocks.mapInArrow(scan, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes archives of all pages and reads them back."""
    out = new_path(pages.sparkSession, "warc")
    write_warc(pages, out, min_bytes)
    return read_warc(pages.sparkSession, out)
