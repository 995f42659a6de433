"""Content-addressed WARC archive.

Payload bytes are stored once, as zstd frames in a table keyed by their SHA-256; record headers are stored exactly, in a
table of their own.  Reading joins headers to payloads by digest, unpacks each payload, checks it against its digest and
puts the records together again; frames, not texts, cross the two shuffles.

A record is a response when its payload is shorter than ``least`` bytes, or when its page has the largest id of those
with the same payload (of rows that repeat that id, the first); others are revisits that refer to it.  Record ids come
from the page's id and the row's stored number, so they never repeat.

Defined cases: a null html is the empty payload; a null url is an empty target; line breaks of a url are escaped in its
header line, and a further line keeps it exactly; a null ``page_id`` counts as smaller than all others; very long
payloads are kept whole; an empty table gives an empty archive; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MADE, drop_table, require, table_path, written

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"
#: Level of the payloads' compression.
LEVEL = 3


@dataclass(frozen=True)
class Archive:
    """Places of the two tables of an archive."""

    payloads: str
    headers: str

    @classmethod
    def at(cls, path: str) -> Archive:
        return cls(f"{path}/payloads", f"{path}/headers")


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, row, bytes, sha256, sha1, record_type, refers_to, refers_row`` of each page; no payload.  Reads a
    written table, the result's ``inputFiles``.

    Winners are combined per digest before the shuffle; the join back may split a hot digest's rows.
    """
    require(pages, ("page_id", "url", "html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.monotonically_increasing_id().alias("row"), F.length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"))
    slim = written(slim, "warcrows")
    best = F.max(F.struct("page_id", (-F.col("row")).alias("row")))
    best = slim.filter(F.col("bytes") >= least).groupBy(F.col("sha256").alias("__d")).agg(best.alias("__best"))
    both = slim.join(best, F.col("sha256") == F.col("__d"), "left")
    revisit = F.col("__best").isNotNull() & (F.col("row") != -F.col("__best.row"))
    return both.select("page_id", "url", "row", "bytes", "sha256", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__best.page_id")).alias("refers_to"), F.when(revisit, -F.col("__best.row")).alias("refers_row"))


def _record_id(page_id, row):
    """A URN from the page's id and the row's number."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def header_of(rows: DataFrame, date: str = DATE) -> DataFrame:
    """``rows`` (of :func:`records`) with ``header``: the record's bytes before its payload, as text."""
    http = F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}{_END}")
    response = F.col("record_type") == "response"
    kept = F.when(response, F.col("bytes")).otherwise(F.lit(0).cast("long"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))
    refers = F.when(response, F.lit("")).otherwise(
        F.concat(
            line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("refers_row"))),
            line("WARC-Refers-To-Page", F.coalesce(F.col("refers_to").cast("string"), F.lit(""))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )
    )
    header = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("row"))),
        line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.when(F.col("url").rlike("[\\r\\n]"), line("WARC-Target-Exact", F.base64(F.encode("url", "UTF-8")))).otherwise(""),
        line("WARC-Date", F.lit(date)),
        line("WARC-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        refers,
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (kept + F.length(http)).cast("string")),
        F.lit(_END),
        http,
    )
    return rows.withColumn("header", header)


def write_archive(pages: DataFrame, archive: Archive, least: int = LEAST) -> Archive:
    """Write both tables.  A payload crosses the shuffle once per task that has it, and is stored once."""
    rows = records(pages, least)
    header_of(rows).select("header", F.unhex("sha256").alias("digest")).write.option("compression", "zstd").parquet(archive.headers)
    drop_table(pages.sparkSession, rows)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")

    def pack(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packer.compress(x.as_buffer()) for x in batch.column(1)], pa.binary())], ["digest", "frame"])

    own = pages.select(F.unhex(F.sha2(payload, 256)).alias("digest"), payload.alias("payload")).mapInArrow(pack, "digest binary, frame binary")
    own.groupBy("digest").agg(F.first("frame").alias("frame")).write.option("compression", "uncompressed").parquet(archive.payloads)
    return archive


def unpacked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``payload`` in place of ``frame``; a payload that does not have its ``digest`` raises."""
    kept = [c for c in rows.columns if c not in ("frame", "digest")]

    def run(batches):
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            payloads = []
            for digest, frame in zip(batch.column("digest"), batch.column("frame")):
                try:
                    payloads.append(unpacker.decompress(frame.as_buffer()))
                except zstandard.ZstdError as e:
                    raise ValueError(f"a stored payload cannot be unpacked: {e}") from e
                if hashlib.sha256(payloads[-1]).digest() != digest.as_py():
                    raise ValueError("a stored payload does not have its digest")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(payloads, pa.binary())], [*kept, "payload"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept), "payload binary"])
    return rows.select(*kept, "digest", "frame").mapInArrow(run, ddl)


def _field(name: str):
    return F.regexp_extract("header", r"\n" + name + r": ([^\r\n]*)\r\n", 1)


def _id_field(name: str):
    text = _field(name)
    return F.when(text != "", text).cast("long")


def read_headers(spark: SparkSession, archive: Archive) -> DataFrame:
    """A row per record: the fields parsed from its stored header, the header itself and the payload's digest."""
    exact = _field("WARC-Target-Exact")
    return spark.read.parquet(archive.headers).select(
        _id_field("WARC-Page-ID").alias("page_id"),
        F.when(exact != "", F.decode(F.unbase64(exact), "UTF-8")).otherwise(_field("WARC-Target-URI")).alias("url"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("sha1"),
        _id_field("WARC-Refers-To-Page").alias("refers_to"),
        "header",
        "digest",
    )


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """:func:`read_headers` with the full ``payload`` of each record, revisits too, in place of the digest.

    The join may split the rows of a hot payload.
    """
    return unpacked(read_headers(spark, archive).join(spark.read.parquet(archive.payloads), "digest"))


def warc_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """:func:`read_archive` with ``record``: the bytes of each WARC record as an archive file holds them; revisits carry
    no payload.  A record whose length or payload's SHA-1 is not what its header says raises."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    rows = read_archive(spark, archive).withColumn("record", F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n")))
    before = F.octet_length(F.substring_index("header", _END + _END, 1)) + 4
    long = F.length("record") - before - 4 == _field("Content-Length").cast("long")
    wrong = F.raise_error(F.lit("a record is not what its header says"))
    return rows.withColumn("record", F.when(long & (F.sha1("payload") == F.col("sha1")), F.col("record")).otherwise(wrong))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Every row of ``pages``: writes the archive to the shared folder, reads it back and rebuilds every record.

    Type and reference are read from the rebuilt record's own bytes, size and digest from the full payload.
    """
    path = table_path(spark, "warc")
    MADE.append(path)
    archive = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), Archive.at(path))
    head = F.decode(F.substring("record", F.lit(1), F.octet_length("header")), "UTF-8")
    rows = warc_records(spark, archive).select("payload", head.alias("header"))
    return rows.select(
        _id_field("WARC-Page-ID").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        _id_field("WARC-Refers-To-Page").alias("refers_to"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), s AS (
  SELECT page_id, cast(octet_length(encode(payload)) AS bigint) AS payload_bytes, sha1(payload) AS payload_digest,
         max(page_id) OVER (PARTITION BY payload) AS best FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to FROM s
"""
