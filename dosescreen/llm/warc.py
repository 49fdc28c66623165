"""WARC archives with revisit records for repeated payloads.

Digests of the payloads are shuffled without the payloads; of records with equal payloads that with the smallest page_id
stays a response, the others become revisit records that refer to it. Archives are written by Spark's text writer with
the record end as line separator, so they go wherever Spark can write; every part file is one gzip stream of complete
records. Archives are read as whole files of bounded size and cut by Content-Length. Revisit records get the size of
their payload from the original response, to which they are joined by digest.

Defined results: a NULL payload is empty; a NULL url becomes ``urn:page:`` and the page_id; rows that repeat the smallest
page_id of a payload are all responses; a NULL page_id is never an original while another page has the payload; an empty
table gives an empty archive and an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dosescreen.llm.common import ship
from dosescreen.session import STAGE_PREFIX, cut_lineage, use_checkpoints

ship(__name__)

# Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS_PER_FILE = 2000
CHUNK = 1 << 20
HEADERS = ("page_id long, record_type string, record_id string, target_uri string, payload_digest string, "
           "refers_to_id string, payload_bytes long")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: four groups of 40 bits, each eight letters."""
    hexed = F.sha1(payload)
    groups = F.array(*[F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 10).cast("long") for k in range(4)])
    letters = F.lit(BASE32)
    return F.array_join(F.transform(groups, lambda v: F.concat(*[
        F.substring(letters, (F.shiftright(v, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
        for k in range(8)])), "")


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, size, original): ``original`` is the page a revisit refers to, with its url."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn(
        "size", F.octet_length("payload").cast("long"))
    repeated = cut_lineage(
        rows.where(F.col("size") >= least_bytes).groupBy("digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("original"),
             F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = rows.join(repeated, "digest", "left")
    other = (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("original.page_id"))
    return joined.withColumn("original", F.when(other, F.col("original")))


def _uri(page_id: Column, url: Column) -> Column:
    return F.coalesce(F.regexp_replace(url, r"[\x00-\x20]", "%20"), F.concat(F.lit("urn:page:"), page_id.cast("string")),
                      F.lit("urn:page:"))


def _record_id(page_id: Column, url: Column) -> Column:
    mark = F.md5(F.concat_ws("\n", page_id.cast("string"), url).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(mark, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
                    F.lit(">"))


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z",
                   per_file: int = RECORDS_PER_FILE) -> None:
    """Write the rows of :func:`records` with fresh headers as gzip part files to ``folder``."""
    first = F.col("original")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(END))
    revisit = first.isNotNull()
    block = F.when(revisit, F.col("http")).otherwise(F.concat(F.col("http"), F.col("payload")))

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def about_first(value: Column) -> Column:
        return F.when(revisit, value)

    head = F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"))), header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", _uri(F.col("page_id"), F.col("url"))),
        header("WARC-Page-ID", F.col("page_id").cast("string")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("WARC-Profile", about_first(F.lit(PROFILE))),
        header("WARC-Refers-To", about_first(_record_id(first["page_id"], first["url"]))),
        header("WARC-Refers-To-Target-URI", about_first(_uri(first["page_id"], first["url"]))),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"))
    (rows.withColumn("http", http).withColumn("block", block).select(F.concat(head, F.col("block")).alias("record"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder))


def _inflated(data) -> Iterator[bytes]:
    """The content of a file of one or more gzip members, or of a plain file, in pieces."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        for at in range(0, len(view), CHUNK):
            yield bytes(view[at:at + CHUNK])
        return
    engine, at = zlib.decompressobj(31), 0
    while at < len(view):
        piece = bytes(view[at:at + CHUNK])
        at += len(piece)
        while piece:
            yield engine.decompress(piece)
            piece = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)


def parse(data) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """The records of an archive file: headers (names in lower case) and block. Raises where a record is cut off."""
    pieces, held = _inflated(data), bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while need(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                raise ValueError("a record's headers are cut off")
        first, *lines = bytes(held[:end]).split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError("a record does not start where it should")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}
        stop = end + 4 + int(headers[b"content-length"])
        if not need(stop + 4) or held[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield headers, bytes(held[end + 4:stop])
        del held[:stop + 4]


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Headers of all records (see ``HEADERS``), with ``payload`` if asked for.

    The digest and size of a response are those of the payload that was read; a digest that differs from the header's
    raises. A revisit record has its header's digest and no size.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), *[pa.binary()] * payloads]
        names = ["page_id", "record_type", "record_id", "target_uri", "payload_digest", "refers_to_id", "payload_bytes",
                 *["payload"] * payloads]
        for batch in batches:
            for content in batch.column(0):
                rows, volume = [], 0
                for headers, block in parse(content.as_buffer()):
                    text = {k: v.decode() for k, v in headers.items()}
                    kind, digest = text[b"warc-type"], text[b"warc-payload-digest"].removeprefix("sha1:")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of {text[b'warc-record-id']} does not have its digest")
                    page = text.get(b"warc-page-id")
                    rows.append((None if page is None else int(page), kind, text[b"warc-record-id"],
                                 text[b"warc-target-uri"], digest, text.get(b"warc-refers-to"),
                                 None if payload is None else len(payload), *[payload] * payloads))
                    volume += len(payload or b"") * payloads
                    if volume > 16 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, volume = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(work, HEADERS + ", payload binary" * payloads)


def resolve(headers: DataFrame) -> DataFrame:
    """Add ``refers_to`` (the original response's page_id) and the payload's size to revisit records, by digest."""
    rows = cut_lineage(headers)
    first = cut_lineage(rows.where("record_type = 'response'").groupBy("payload_digest")
                        .agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "payload_bytes")).alias("first")))
    revisit = F.col("record_type") == "revisit"
    return rows.join(first, "payload_digest", "left").select(
        "page_id", "record_type", "record_id", "target_uri", "payload_digest",
        F.when(revisit, F.col("first.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"))


def archived(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write deduplicated archives of ``pages`` to ``folder``, read them back and resolve the revisit records."""
    spark = pages.sparkSession
    folder = folder or f"{use_checkpoints(spark)}/{STAGE_PREFIX}warc-{uuid.uuid4().hex}"
    write_archives(records(pages, least_bytes), folder)
    return resolve(read_archives(spark, folder))
