"""Web archives: write segmented WARC records, read them back and reassemble their payloads.

Writing. A response holds the HTTP head and the payload in chunked transfer framing.
A block longer than ``segment_bytes`` is cut: the first record carries segment number
1, continuation records name it as their origin, the last one states the total
length. A payload that another page holds too is written once, as the response of the
largest identifier; the others are revisit records without payload. Spark's writer
makes the files, gzip-compressed and with a bounded number of records each.

Reading. Files are parsed by content length, record by record. Segments are grouped
by origin identifier, ordered by number and checked against the total length; then
the chunked framing is decoded and the payload digest verified. Only records that
have segments are shuffled. A revisit takes its length from the response it names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.llm import common
from casewatch.session import materialize, scratch_path

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 4096, 1024, 1000
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i:i + size]), payload[i:i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; raises ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk is not as long as it says")
        parts.append(body[at:at + size])
        at += size + 2


def record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without its last line end, which the file writer adds."""
    named = [("WARC-Type", kind), *fields, ("Content-Length", len(block))]
    lines = "".join(f"{n}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n" for n, v in named if v is not None)
    return b"WARC/1.1\r\n" + common.encoded(lines) + b"\r\n" + block + b"\r\n"


def records_of(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, keeper_url: str | None, again: bool, segment: int, chunk: int) -> list[bytes]:
    """All records of one page."""
    origin = f"<urn:uuid:{uuid.uuid4()}>"
    named = [("WARC-Record-ID", origin), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
             ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", page_id)]
    if again:
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", keeper_url), ("X-Refers-To-Page", keeper)]
        return [record("revisit", named + more, HTTP_HEAD)]
    block = HTTP_HEAD + chunked(payload, chunk)
    if len(block) <= segment:
        return [record("response", named, block)]
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    out = [record("response", [*named, ("WARC-Segment-Number", 1)], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        total = len(block) if number == len(parts) else None
        out.append(record("continuation", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", origin),
                                           ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)], part))
    return out


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", page: str = "html", min_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write a record for every page, under ``path``.

    A null page is empty. Of equal payloads of at least ``min_bytes`` bytes the largest
    identifier is the response; a null identifier is the smallest. Rows that repeat an
    identifier and payload are responses each. A very long page is cut into segments; an
    empty table writes no records; other columns are not read.
    """
    body = F.coalesce(F.col(page), F.lit(""))
    rows = common.only(pages, page_id=F.col(page_id).cast("long"), url=F.col(url).cast("string"), html=body, sha=F.sha2(body, 256))
    # Payloads that repeat, as a table: pages are shuffled only where it is large, and then a hot payload is split.
    found = rows.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("keep"), F.count("*").alias("n"))
    kept = materialize(found.filter("n > 1").select("sha", "keep"))
    again = F.col("keep").isNotNull() & (F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("keep.page_id"))
    joined = rows.join(kept, "sha", "left").select("page_id", "url", "html", F.col("keep.page_id").alias("keeper"), F.col("keep.url").alias("keeper_url"), again.alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch[at:at + 500].to_pydict()
                made: list[bytes] = []
                for i, u, h, k, ku, a in zip(*(part[n] for n in ("page_id", "url", "html", "keeper", "keeper_url", "again")), strict=True):
                    made += records_of(i, u, common.encoded(h), k, ku, a, segment_bytes, chunk_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    lines = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of a file."""
    data, at = gzip.decompress(content), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not at the start of a record")
        fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        at = start + int(fields["content-length"])
        yield fields, data[start:at]
        at += 4


RECORD = "origin string, kind string, page_id long, digest string, refers_to long, number int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; a continuation's origin is that of its first segment."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def rows(content: bytes) -> Iterator[tuple]:
        for f, block in parsed(content):
            yield (f.get("warc-segment-origin-id", f["warc-record-id"]), f["warc-type"], number(f.get("x-page-id")), f.get("warc-payload-digest"),
                   number(f.get("x-refers-to-page")), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                columns = list(zip(*rows(content.as_py()), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.filter("length > 0").select("content").mapInArrow(run, RECORD)


def payload_of(numbers: list[int], blocks: list[bytes], total: int | None) -> bytes:
    """Payload of a response from its segments; raises ValueError where they do not fit together."""
    order = sorted(range(len(numbers)), key=numbers.__getitem__)
    block = b"".join(blocks[i] for i in order)
    if [numbers[i] for i in order] != list(range(1, len(numbers) + 1)) or total != len(block):
        raise ValueError("segments are missing, repeated or of another length")
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def responses(records: DataFrame, payloads: bool) -> DataFrame:
    """Reassembled responses: page, length and digest of the payload, whether all checks hold."""
    whole = records.filter("kind = 'response' AND number IS NULL").select(
        "page_id", "digest", F.array(F.lit(1)).alias("numbers"), F.array("block").alias("blocks"), F.octet_length("block").cast("long").alias("total"))
    parts = records.filter("number IS NOT NULL").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.collect_list(F.struct("number", "block")).alias("parts"), F.max("total").alias("total"))
    both = whole.unionByName(parts.select("page_id", "digest", F.col("parts.number").alias("numbers"), F.col("parts.block").alias("blocks"), "total"))
    schema = "page_id long, digest string, payload_bytes long, payload_digest string, segments int, valid boolean" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch[at:at + 500]
                rows = []
                for digest, numbers, blocks, total in zip(*(part[n].to_pylist() for n in ("digest", "numbers", "blocks", "total")), strict=True):
                    try:
                        payload = payload_of(numbers, blocks, total)
                        found = digest_of(payload)
                        rows.append((len(payload), found, len(numbers), digest in (None, f"sha1:{found}"), payload))
                    except ValueError:
                        rows.append((None, None, len(numbers), False, None))
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary()][:4 + payloads]
                columns = list(zip(*rows, strict=True))[:4 + payloads]
                made = [pa.array(v, k) for v, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["digest"], *made], [c.split()[0] for c in schema.split(", ")])

    return both.mapInArrow(run, schema)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per page of the archives under ``path``.

    ``valid`` is false, and length and digest are null, where segments are missing or
    the framing is broken; it is false too where the digest is not the recorded one. A
    revisit has the length and digest of the response it refers to; one whose response
    is missing has its recorded digest, no length, and is not valid.
    """
    records = materialize(read_records(spark, path))  # three readers: archives are parsed once
    found = responses(records, payloads)
    of_response = found.filter("valid").groupBy(F.col("page_id").alias("k"), F.col("digest").alias("d")).agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = records.filter("kind = 'revisit'").select("page_id", "digest", "refers_to").alias("v").join(
        of_response, F.expr("v.refers_to <=> k AND v.digest = d"), "left")
    nothing = [F.lit(None).cast("binary").alias("payload")] * payloads
    again = revisits.select(
        "page_id", "payload_bytes", F.substring_index("digest", ":", -1).alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to",
        F.lit(0).alias("segments"), F.col("payload_bytes").isNotNull().alias("valid"), *nothing)
    first = found.select(
        "page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
        "segments", "valid", *["payload"] * payloads)
    return first.unionByName(again)


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark)
    write_archives(common.read(spark, folder, "pages"), path)
    return read_archives(spark, path)


SQL = {"op1_warc": rf"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep,
    unhex(sha1(coalesce(html, ''))) AS d FROM pages
), bits AS (
  SELECT *, list_transform(range(1, 33), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    ('0x' || substr(hex(d) || '00', 1 + ((i - 1) * 5) // 4, 2))::INT >> (3 - ((i - 1) * 5) % 4) & 31 AS INT), 1)) AS c FROM p
)
SELECT page_id, strlen(h) AS payload_bytes, array_to_string(c, '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to, true AS valid,
  CASE WHEN page_id <> keep THEN 0 ELSE CAST(ceil((
    {len(HTTP_HEAD) + 5} + strlen(h) + (strlen(h) // {CHUNK_BYTES}) * {len(hex(CHUNK_BYTES)) + 2} +
    CASE WHEN strlen(h) % {CHUNK_BYTES} > 0 THEN 4 + length(printf('%x', strlen(h) % {CHUNK_BYTES})) ELSE 0 END
  ) / {SEGMENT_BYTES}.0) AS INT) END AS segments FROM bits
"""}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_warc": op1_warc}
