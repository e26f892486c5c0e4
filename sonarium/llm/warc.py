"""WARC archives: writing, reading, segment reassembly, chunked framing.

Archives are written by Spark's own text writer: a record is a row of raw bytes
and the record separator is the line separator, so any store that Spark writes
to will do and task commits are atomic. Records longer than a segment are cut
into a first record and continuation records (ISO 28500, record segmentation),
and a limit on records per file bounds the size of each archive. Each archive
is one gzip stream.

Reading takes whole archives through Spark's binaryFile source and parses them
by Content-Length, once; the records are kept in the shared folder, segments
beside whole ones. Continuations are grouped by their origin identifier and put
in order of their segment numbers; the total length is verified; then the HTTP
message is split and its chunked transfer framing decoded.

A segment is small here (SEGMENT_BYTES), so that most records are cut. Payloads
move only if they are segments: which row a revisit refers to is found on
digests, and revisits are written without a payload.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Production parameters: bytes of a segment and of a chunk, records of an archive.
SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 2048, 1024, 4000
BATCH_BYTES = 8_000_000

RECORD_SCHEMA = "record_id string, warc_type string, target_uri string, row_id bigint, refers_to_row bigint, payload_digest string, segment_number int, segment_origin string, total_length bigint, block binary"
MESSAGE_SCHEMA = "record_id string, warc_type string, target_uri string, row_id bigint, refers_to_row bigint, payload_digest string, status string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column."""
    letters = lambda v: F.concat(*(F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)))
    return let(F.sha1(payload), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: let(F.conv(F.substr(h, i * 5 + 1, F.lit(5)), 16, 10).cast("int"), letters)), ""))


def _raw(x: Column) -> Column:
    """Bytes as a string of the same bytes; nothing is decoded."""
    return x.cast("string")


def _pieces(x: Column, size: int) -> Column:
    """Consecutive pieces of a binary column of size bytes each; one empty piece for an empty value."""
    return let(x, lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(v) - 1) / size)).cast("int")), lambda i: F.substr(v, i * size + 1, F.lit(size))))


def chunked(payload: Column, size: int = CHUNK_BYTES) -> Column:
    """payload in chunked transfer framing (RFC 9112, 7.1), as a string of raw bytes."""
    pieces = F.filter(_pieces(payload, size), lambda c: F.octet_length(c) > 0)
    return F.concat(F.array_join(F.transform(pieces, lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit(CRLF), _raw(c), F.lit(CRLF))), ""), F.lit("0" + CRLF + CRLF))


def write_archives(df: DataFrame, path: str, row_id: str, url: str, payload: str, refers_to: str, digest: str, length: str | None = None, refers_to_url: str | None = None, date: str = "2024-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """A WARC record for each row of df: a response with payload (binary), or a revisit without it where refers_to is not null.

    length has the bytes of the payload, if payload does not hold it, and
    refers_to_url the URL of the record that a revisit refers to.
    A null payload is written as an empty one, a null row_id or url by leaving
    its field out; line breaks in url are percent-encoded. Repeated rows get a
    record each. An empty df gives no records.
    """
    revisit = F.col(refers_to).isNotNull()
    body = F.coalesce(F.col(payload), F.lit(b""))
    http = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF
    response = F.concat(F.lit(http + "Transfer-Encoding: chunked" + CRLF + CRLF), chunked(body, chunk_bytes))
    again = F.concat(F.lit(http + "Content-Length: "), (F.octet_length(body) if length is None else F.col(length)).cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, again).otherwise(response).cast("binary")
    escaped = lambda x: F.regexp_replace(F.regexp_replace(x, "\r", "%0D"), "\n", "%0A")
    target = F.lit(None).cast("string") if refers_to_url is None else escaped(F.col(refers_to_url))
    records = df.select(
        F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("id"),
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.col(row_id).cast("string").alias("row"),
        escaped(F.col(url)).alias("uri"),
        F.when(revisit, target).alias("refers_uri"),
        F.when(revisit, F.col(refers_to).cast("string")).alias("refers"),
        F.col(digest).alias("digest"),
        let(block, lambda b: F.struct(F.octet_length(b).alias("total"), _pieces(b, segment_bytes).alias("segments"))).alias("cut"),
    )
    parts = records.select("*", F.col("cut.total").alias("total"), F.size("cut.segments").alias("n"), F.posexplode("cut.segments").alias("i", "segment")).drop("cut")
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    first, several = F.col("i") == 0, F.col("n") > 1
    own = F.when(first, F.col("id")).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        field("WARC-Type", F.when(first, F.col("type")).otherwise("continuation")),
        field("WARC-Record-ID", own),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("uri")),
        field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        field("WARC-Profile", F.when(first & F.col("refers").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        field("WARC-Refers-To-Target-URI", F.when(first, F.col("refers_uri"))),
        field("WARC-Refers-To-Date", F.when(first & F.col("refers").isNotNull(), F.lit(date))),
        field("X-Row-ID", F.when(first, F.col("row"))),
        field("X-Refers-To-Row", F.when(first, F.col("refers"))),
        field("WARC-Segment-Number", F.when(several, (F.col("i") + 1).cast("string"))),
        field("WARC-Segment-Origin-ID", F.when(~first, F.col("id"))),
        field("WARC-Segment-Total-Length", F.when(several & (F.col("i") == F.col("n") - 1), F.col("total").cast("string"))),
        field("Content-Type", F.when(first, F.lit("application/http;msgtype=response"))),
        field("Content-Length", F.octet_length("segment").cast("string")),
        F.lit(CRLF),
    )
    writer = parts.select(F.concat(head, _raw(F.col("segment"))).alias("value")).write
    writer.option("lineSep", CRLF * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


class _Stream(io.RawIOBase):
    """The content of an archive, inflated as it is read; gzip members may follow one another."""

    def __init__(self, content: bytes):
        self.rest, self.plain, self.inflate = content, content[:2] != b"\x1f\x8b", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = b""
        while not data and self.rest:
            if self.plain:
                data, self.rest = self.rest[: len(into)], self.rest[len(into) :]
            else:
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
                data = self.inflate.decompress(self.rest, len(into))
                self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
                if not data and not self.inflate.eof and not self.rest:
                    break
        into[: len(data)] = data
        return len(data)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record. Raises ValueError where the bytes are no WARC record or end within one."""
    stream = io.BufferedReader(_Stream(content), 1 << 18)
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("the archive ends within a record")
        yield fields, block


def _whole(x: str | None) -> int | None:
    return int(x) if x is not None else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("row_id", pa.int64()), ("refers_to_row", pa.int64()), ("payload_digest", pa.string()), ("segment_number", pa.int32()), ("segment_origin", pa.string()), ("total_length", pa.int64()), ("block", pa.binary())])
    rows: list[tuple] = []
    held = 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        for content in batch.column(0):
            for f, block in parse_archive(content.as_py()):
                rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), _whole(f.get("x-row-id")), _whole(f.get("x-refers-to-row")), (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None, _whole(f.get("warc-segment-number")), f.get("warc-segment-origin-id"), _whole(f.get("warc-segment-total-length")), block))
                held += len(block) + 200
                if held > BATCH_BYTES:
                    yield make()
                    rows, held = [], 0
    if rows:
        yield make()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records (RECORD_SCHEMA) of all archives under path, whole ones and segments. A folder without archives has none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_parse, RECORD_SCHEMA)


def reassemble(segments: DataFrame) -> DataFrame:
    """One row (RECORD_SCHEMA's descriptive columns, status, block) for each origin of segments.

    status is ok if the numbers run from 1 without a gap and the lengths add up
    to the total in the last segment; else missing or length, with what there
    is as block. A segment that is there twice counts once. The bytes of one
    group are those of one record.
    """
    origin = F.coalesce("segment_origin", "record_id")
    first = F.col("segment_number") == 1
    keep = ["record_id", "warc_type", "target_uri", "row_id", "refers_to_row", "payload_digest"]
    grouped = segments.groupBy(origin.alias("origin")).agg(
        F.sort_array(F.collect_set(F.struct("segment_number", F.col("block")))).alias("parts"),
        F.max("total_length").alias("total"),
        F.min(F.when(first, F.struct(*keep))).alias("first"),
    )
    block = F.array_join(F.transform("parts", lambda p: _raw(p["block"])), "").cast("binary")
    n = F.size("parts")
    joined = grouped.select("first", "total", (F.forall("parts", lambda p: (p["segment_number"] >= 1) & (p["segment_number"] <= n)) & (n == F.size(F.array_distinct(F.col("parts.segment_number")))) & F.col("first").isNotNull() & F.col("total").isNotNull()).alias("complete"), block.alias("block"))
    status = F.when(~F.col("complete"), "missing").when(F.octet_length("block") != F.col("total"), "length").otherwise("ok")
    return joined.select("first.*", status.alias("status"), "block")


def dechunk(body: bytes) -> tuple[bytes, str]:
    """The payload of a chunked body, and ok or chunks (with what could be decoded). Extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return b"".join(parts), "chunks"
        if size == 0:
            return b"".join(parts), "ok"
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            return b"".join(parts), "chunks"
        at += 2


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("block")
        status, payload = batch.column(batch.schema.get_field_index("status")).to_pylist(), []
        for i, block in enumerate(batch.column(at).to_pylist()):
            head, _, body = (block or b"").partition(b"\r\n\r\n")
            if b"transfer-encoding: chunked" in head.lower():
                body, how = dechunk(body)
                status[i] = status[i] if status[i] != "ok" else how
            payload.append(body)
        columns = [batch.column(n) for n in ("record_id", "warc_type", "target_uri", "row_id", "refers_to_row", "payload_digest")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(status, pa.string()), pa.array(payload, pa.binary())], names=["record_id", "warc_type", "target_uri", "row_id", "refers_to_row", "payload_digest", "status", "payload"])


def messages(spark: SparkSession, path: str) -> DataFrame:
    """The HTTP messages of all archives under path (MESSAGE_SCHEMA): whole records and reassembled ones, framing decoded."""
    keep = ["record_id", "warc_type", "target_uri", "row_id", "refers_to_row", "payload_digest", "status", "block"]
    kept = common.shared_path(spark, "warc-records")
    read_records(spark, path).withColumn("cut", F.col("segment_number").isNotNull()).write.option("compression", "zstd").partitionBy("cut").parquet(kept)
    records = spark.read.schema(RECORD_SCHEMA + ", cut boolean").parquet(kept)
    whole = records.where("NOT cut").withColumn("status", F.lit("ok")).select(*keep)
    joined = reassemble(records.where("cut").drop("cut")).select(*keep)
    return whole.unionByName(joined).mapInArrow(_decode, MESSAGE_SCHEMA)


def archive_pages(pages: DataFrame, path: str, row_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> None:
    """Write pages as archives under path, where equal payloads of at least least_bytes are stored once.

    Of these the row with the largest row_id is the response; others with a
    smaller row_id revisit it. Rows with a null row_id, and repeated rows of
    the largest, are responses too. A null html counts as an empty payload. An
    empty table writes folders without records; other columns are not read.
    """
    rows = pages.select(F.col(row_id).alias("row"), F.col(url).alias("uri"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    narrow = common.written(rows.select("row", "uri", "digest", F.octet_length("payload").alias("bytes")), "payload-digests")
    groups = narrow.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max(F.struct("row", "uri")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("digest", F.col("kept.row").alias("keeper"), F.col("kept.uri").alias("keeper_uri"))
    revisits = common.written(narrow.join(groups, "digest").where(F.col("row") < F.col("keeper")), "revisits")
    again = revisits.select("row", "digest").distinct()
    responses = rows.join(common.few(common.written(again, "revisit-keys")), ["row", "digest"], "left_anti").withColumn("refers", F.lit(None).cast("long"))
    write_archives(responses, f"{path}/responses", "row", "uri", "payload", "refers", "digest")
    write_archives(revisits.withColumn("payload", F.lit(b"")), f"{path}/revisits", "row", "uri", "payload", "keeper", "digest", "bytes", "keeper_uri")


def op1_segment_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, status) of every page, from the archives; a null html is an empty payload."""
    path = common.shared_path(spark, "warc")
    archive_pages(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    read = messages(spark, path)
    payload = F.col("payload")
    found = read.select("row_id", "warc_type", "refers_to_row", "payload_digest", "status", F.octet_length(payload).cast("long").alias("n"), base32_sha1(payload).alias("digest"))
    found = common.written(found, "warc-index")
    responses = found.where("warc_type = 'response'")
    kept = responses.where("row_id IS NOT NULL").groupBy(F.col("row_id").alias("refers_to_row"), F.col("digest").alias("payload_digest")).agg(F.max("n").alias("of"))
    revisits = found.where("warc_type = 'revisit'").join(kept, ["refers_to_row", "payload_digest"], "left")
    whole = responses.select(F.col("row_id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "status")
    again = revisits.select(F.col("row_id").alias("page_id"), F.col("of").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to_row").alias("refers_to"), F.when(F.col("of").isNull(), "missing").otherwise(F.col("status")).alias("status"))
    return whole.unionByName(again)


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
bits AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM d),
named AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[CAST(i // 4 + 1 AS BIGINT)] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS digest,
  max(page_id) OVER (PARTITION BY h, n) AS keeper FROM bits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to, 'ok' AS status FROM named"""

QUERIES = {"op1_segment_reassembly": op1_segment_reassembly}
ORACLE = {"op1_segment_reassembly": ORACLE_SQL}
