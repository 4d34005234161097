"""WARC archives: writing pages, and reading them back with segment reassembly.

A page becomes a response record with a chunked HTTP body. Of equal payloads of
at least ``min_revisit`` bytes, that of the largest page_id is the response and
the others are revisits of it. A block longer than ``segment_bytes`` is cut: the
first segment is the response, the others are continuation records with the
same origin, and the last one carries the total length. So no record is longer
than a segment, and no archive longer than ``records_per_file`` of them.

Reading groups the segments by origin, orders them by number, checks that none
is missing and that the total length is right, and decodes the chunked framing.
Archives are written by Spark's text writer, whose line separator is the empty
line pair that ends a record, so each is one gzip member; read are also plain ones
and those with a member for each record.

Defined results: a null html is an empty payload; a null url has no target; a
null page_id is smaller than any other and is written as ``none``; rows that
repeat page_id and payload are all responses, if that page_id is the largest of
its payload, and all revisits if not; a record that is incomplete has a null
payload: one that lacks a segment, whose lengths do not add up, or in which an
archive ends. Of a broken archive, the records before the fault are read. An id
that is no integer is null when pages are read back. A very long page is many
segments, which are joined in memory again. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import new_path, written

#: Fixed values of the query's contract and of the format.
MIN_REVISIT = 1000
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in HTTP chunks."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, or None if its framing is broken."""
    out, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        begin, end = line + 2, line + 2 + size
        if size == 0:
            return b"".join(out)
        if body[end : end + 2] != b"\r\n":
            return None
        out.append(body[begin:end])
        at = end + 2
    return None


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the empty lines that end it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return VERSION + head.encode() + b"\r\n" + block


def page_records(page_id: object, url: str | None, payload: bytes, digest: str, original: object, is_revisit: bool, date: str, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """All records of a page."""
    own = record_id(page_id, digest)
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if is_revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original, digest))], block)]
    block = RESPONSE_HEAD + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common], block)]
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Segment-Number", 1)], block[:segment_bytes])]
    starts = range(segment_bytes, len(block), segment_bytes)
    for n, at in enumerate(starts, 2):
        total = len(block) if at + segment_bytes >= len(block) else None
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{n}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)]
        out.append(record(fields, block[at : at + segment_bytes]))
    return out


def write_archives(
    pages: DataFrame,
    path: str,
    min_revisit: int = MIN_REVISIT,
    segment_bytes: int = 32 << 10,
    chunk_bytes: int = 8 << 10,
    records_per_file: int = 2000,
    date: str = "2026-01-01T00:00:00Z",
    broadcast_rows: int = 200_000,
) -> None:
    """Write (page_id, url, html) as gzipped archives below ``path``."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    plain = pages.select("page_id", "url", html.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = pages.select("page_id", html.alias("payload")).where(F.octet_length("payload") >= min_revisit)
    groups = long.groupBy(F.sha1("payload").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("original")).where("n > 1")
    groups = written(groups.select("digest", "original"), "equal_payloads")
    small = groups.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = plain.join(F.broadcast(groups) if small else groups, "digest", "left")
    revisit = (F.octet_length("payload") >= min_revisit) & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    rows = rows.select("page_id", "url", "payload", "digest", "original", revisit.alias("is_revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for begin in range(0, batch.num_rows, 200):
                for page in batch.slice(begin, 200).to_pylist():
                    out += page_records(*page.values(), date, segment_bytes, chunk_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                out = []

    records = rows.mapInArrow(write, "record binary")
    writer = records.select(F.col("record").cast("string").alias("value")).write
    writer.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def unzipped(content: bytes, piece: int = 1 << 20) -> bytes:
    """The bytes of a gzipped archive, of one member or of one for each record, or of a plain one; of a broken archive what comes before the fault."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, rest = [], memoryview(content)
    try:
        while len(rest):
            member, at = zlib.decompressobj(wbits=31), 0
            while at < len(rest) and not member.eof:
                out.append(member.decompress(rest[at : at + piece]))
                at += piece
            if not member.eof:
                break
            rest = rest[min(at, len(rest)) - len(member.unused_data) :]
    except zlib.error:
        pass
    return b"".join(out)


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The records of an archive's bytes: fields by lower-case name, and the block, which is None if the archive ends before it does.

    What follows a record without a readable head is lost.
    """
    at = 0
    while (end := content.find(END, at)) >= 0:
        lines = content[at:end].decode(errors="replace").split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = fields.get("content-length", "")
        if not size.isdigit() or not {"warc-type", "warc-record-id"} <= fields.keys():
            return
        begin = end + len(END)
        at = begin + int(size)
        yield fields, content[begin:at] if at <= len(content) else None
        at += len(END)


RECORD = T.StructType(
    [
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("refers_to_id", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("segment", T.LongType()),
        T.StructField("origin", T.StringType()),
        T.StructField("total", T.LongType()),
        T.StructField("place", T.StringType()),
        T.StructField("block", T.BinaryType()),
    ]
)


def number(text: str | None) -> int | None:
    return int(text) if text and text.isdigit() else None


def archive_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``; those that are segments have a number."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows: list[dict] = []
                for n, (f, block) in enumerate(parsed(unzipped(content.as_py()))):
                    rows.append(
                        {
                            "record_type": f["warc-type"],
                            "record_id": f["warc-record-id"],
                            "refers_to_id": f.get("warc-refers-to"),
                            "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            "segment": number(f.get("warc-segment-number")),
                            "origin": f.get("warc-segment-origin-id", f["warc-record-id"]),
                            "total": number(f.get("warc-segment-total-length")),
                            "place": f"{name.as_py()}:{n:012d}",
                            "block": block,
                        }
                    )
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    return files.mapInArrow(read, RECORD)


ARROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in RECORD.fields])


def reassembled(segments: DataFrame) -> DataFrame:
    """One row for each segmented record; its block is null unless all segments are there and add up.

    Equal records may be archived more than once: the n-th copy of each segment goes to the n-th record.
    """
    copies = Window.partitionBy("origin", "segment").orderBy("place")
    groups = segments.withColumn("copy", F.row_number().over(copies)).groupBy("origin", "copy")
    parts = F.array_sort(F.collect_list(F.struct("segment", "block")))
    whole = groups.agg(
        parts.alias("parts"), F.max("total").alias("total"), F.max("segment").alias("last"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("block")).alias("bytes"), F.max("payload_digest").alias("payload_digest")
    )
    complete = (F.col("n") == F.col("last")) & (F.col("bytes") == F.col("total"))
    # joined at once, as bytes that Spark takes for a string: a running concatenation would be quadratic
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    return whole.select(F.lit("response").alias("record_type"), F.col("origin").alias("record_id"), F.lit(None).cast("string").alias("refers_to_id"), "payload_digest", F.when(complete, block).alias("block"))


def payload_of(block: bytes | None) -> tuple[bytes | None, int | None]:
    """The payload of an HTTP block, and its length as the HTTP fields say."""
    if block is None or (end := block.find(END)) < 0:
        return None, None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[:end].decode("latin-1").split("\r\n")[1:])}
    body = block[end + len(END) :]
    if fields.get("transfer-encoding", "").lower() == "chunked":
        body = unchunked(body)
    length = fields.get("content-length")
    return body, int(length) if length else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, refers_to_id, payload_digest, payload, stated_bytes) of each page in the archives.

    A revisit has no payload; its digest and stated_bytes are those of the full one.
    """
    names = ["record_type", "record_id", "refers_to_id", "payload_digest", "block"]
    # written, so that every archive is read and unzipped once
    records = written(archive_records(spark, path), "warc_records")
    blocks = records.where("segment IS NULL").select(*names).unionByName(reassembled(records.where("segment IS NOT NULL")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                both = [payload_of(x) for x in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([p for p, _ in both], pa.binary()), pa.array([n for _, n in both], pa.int64())], [*names[:4], "payload", "stated_bytes"])

    return blocks.mapInArrow(decode, T.StructType([*(RECORD[n] for n in names[:4]), T.StructField("payload", T.BinaryType()), T.StructField("stated_bytes", T.LongType())]))


def page_of(record: str) -> Column:
    """The page_id in a record's id."""
    return F.expr(f"try_cast(regexp_extract({record}, '^<urn:page:([^:]*):', 1) AS bigint)")


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each archived page."""
    records = read_archives(spark, path)
    is_revisit = F.col("record_type") == "revisit"
    return records.select(
        page_of("record_id").alias("page_id"),
        F.when(is_revisit, F.col("stated_bytes")).otherwise(F.octet_length("payload")).cast("bigint").alias("payload_bytes"),
        F.when(is_revisit, F.col("payload_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        F.when(is_revisit, page_of("refers_to_id")).alias("refers_to"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from archives."""
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return archived_pages(spark, path)


OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM m
"""
