"""WARC archives (operator 8): writing captures and assembling their transactions again.

A capture is three records: its response (or a revisit of an equal payload), its
request and its metadata, the latter two naming the response in WARC-Concurrent-To. The
records are text in UTF-8, so Spark's own text writer puts them into gzip files in any
file system that Spark knows. Reading lets Spark's text reader cut the stream of a file at every
"WARC/1.1" line, puts pieces together until a record has its Content-Length, and joins
each transaction through its concurrent-to identifiers into one nested row. So neither an archive
nor more than a batch of records is ever held whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotgrid.llm.common import BROADCAST_IDS, shared_dir, written

CRLF = "\r\n"
#: Payloads from this many bytes on are stored once.
REVISIT_BYTES = 1000
#: Captures in an archive file at most.
FILE_CAPTURES = 1000
#: The line that begins a record.
BEGIN = b"WARC/1.1\r\n"
#: Tasks that copies of one payload are dealt to where their responses are too many to be broadcast.
SALTS = 32
_HEADER = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")


def mark_revisits(pages: DataFrame, least: int = REVISIT_BYTES, broadcast_rows: int = BROADCAST_IDS) -> DataFrame:
    """Add payload_bytes, payload_digest, refers_to (the largest page_id of equal payloads, or null) and copy.

    Expects page_id, url and html. Only (page_id, digest, size) are shuffled, to find the payloads that
    occur twice or more; the greatest id of a digest is a partial aggregate, so a payload that a
    third of the pages share costs no task more than a few rows. Up to ``broadcast_rows`` such
    payloads (60 bytes each) are sent to the pages. Beyond, the large pages are joined with them,
    dealt by digest and salt. Smaller payloads are never joined.

    ``copy`` is empty where page_id is not null and unique, else a random id, which keeps the records
    of such captures apart.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha1(payload)})
    large = F.col("payload_bytes") >= least
    found = pages.where(large).groupBy("payload_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_copies")).where("_copies > 1").drop("_copies")
    firsts = written(found, "responses")
    if firsts.count() <= broadcast_rows:
        out = pages.join(F.broadcast(firsts), "payload_digest", "left")
    else:
        salted = pages.where(large).withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        dealt = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        out = salted.join(dealt, ["payload_digest", "_salt"], "left").drop("_salt").unionByName(pages.where(~large).withColumn("_last", F.lit(None).cast("long")))
    refers = F.when(large & ~F.col("_last").eqNullSafe(F.col("page_id")), F.col("_last"))
    repeated = written(pages.groupBy("page_id").agg(F.count("*").alias("_rows")).where("_rows > 1 and page_id is not null").select("page_id"), "repeated")
    random = F.concat(F.lit(":"), F.expr("uuid()"))
    if repeated.count() <= broadcast_rows:
        out = out.join(F.broadcast(repeated.withColumn("_again", F.lit(True))), "page_id", "left")
        out = out.withColumn("copy", F.when(F.col("_again").isNotNull() | F.col("page_id").isNull(), random).otherwise("")).drop("_again")
    else:
        out = out.withColumn("copy", random)
    return out.withColumn("refers_to", refers).drop("_last")


def _record_id(kind: str, page_id: Column, copy: Column | None = None) -> Column:
    return F.concat(F.lit(f"<urn:capture:{kind}:"), F.coalesce(page_id.cast("string"), F.lit("")), copy if copy is not None else F.lit(""), F.lit(">"))


def _record(kind: Column, rid: Column, url: Column, date: Column, extra: Column, block: Column) -> Column:
    head = [F.lit("WARC/1.1" + CRLF + "WARC-Type: "), kind, F.lit(CRLF + "WARC-Record-ID: "), rid, F.lit(CRLF + "WARC-Date: "), date, F.lit(CRLF + "WARC-Target-URI: "), url, F.lit(CRLF), extra]
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block, F.lit(CRLF))


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One text value a capture: its three records, of which the writer adds the last line end.

    Expects the columns of :func:`mark_revisits`. Line ends in a url are taken out, as
    a header cannot hold them. A revisit refers to the record of its response's page; only if that
    page_id is itself repeated does the record's id have a random part more.
    """
    pid, when, copy = F.col("page_id"), F.lit(date), F.col("copy")
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]+", "")
    response, revisit = _record_id("response", pid, copy), F.col("refers_to").isNotNull()
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), response, F.lit(CRLF))
    status = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF * 2}")
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(CRLF))
    refers = F.concat(
        F.lit("WARC-Refers-To: "), _record_id("response", F.col("refers_to")), F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF),
        F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF),
    )
    main = _record(
        F.when(revisit, "revisit").otherwise("response"), response, url, when,
        F.concat(F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"), digest, F.when(revisit, refers).otherwise("")),
        F.concat(status, F.when(revisit, "").otherwise(F.coalesce(F.col("html"), F.lit("")))),
    )
    ask = F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF * 2}"))
    request = _record(F.lit("request"), _record_id("request", pid, copy), url, when, F.concat(F.lit(f"Content-Type: application/http; msgtype=request{CRLF}"), concurrent), ask)
    about = F.concat(F.lit("pageId: "), F.coalesce(pid.cast("string"), F.lit("")), F.lit(CRLF))
    meta = _record(F.lit("metadata"), _record_id("metadata", pid, copy), url, when, F.concat(F.lit(f"Content-Type: application/warc-fields{CRLF}"), concurrent), about)
    return pages.select(F.concat(request, F.lit(CRLF), main, F.lit(CRLF), meta).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Write one capture per row of ``pages`` (page_id, url, html) into gzip archives under ``path``."""
    pages = pages.select("page_id", "url", "html")
    records(mark_revisits(pages, least)).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", FILE_CAPTURES).text(path)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a stream that was cut at the lines "WARC/1.1".

    A block is taken by its length, never by its text: a piece that is too short for its record
    was cut inside the block, and goes on with the next one. What comes before the first
    record of a file is skipped.
    """
    held: list[bytes] = []
    size = need = 0
    head: dict[str, str] = {}
    start = 0
    for piece in pieces:
        if not held:
            end = piece.find(b"\r\n\r\n") + 4
            if end < 4:
                continue
            head = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(piece, 0, end)}
            start, need = end, end + int(head["content-length"])
        else:
            held.append(BEGIN)
            size += len(BEGIN)
        held.append(piece)
        size += len(piece)
        if size >= need:
            yield head, b"".join(held)[start:need]
            held, size = [], 0
    if held:
        raise ValueError(f"{head['warc-record-id']}: the file ends within the record")


_RECORDS = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.string())])
_RECORDS_DDL = "type string, record_id string, concurrent_to string, refers_to string, url string, digest string, payload_bytes long, payload string"


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``; a file is streamed by one task.

    The digest and size of a response are computed from the payload that was read; those
    of a revisit, which has none, are those it states. Without ``payloads`` only the
    metadata's block, which is short, is kept.
    """

    def run(batches):
        rows, held = [], 0
        for h, block in parse(x.as_py() for b in batches for x in b.column(0)):
            kind, digest, size, keep = h["warc-type"], None, None, None
            if kind == "response":
                body = block[block.index(b"\r\n\r\n") + 4 :]
                digest, size, keep = hashlib.sha1(body).hexdigest(), len(body), body.decode() if payloads else None
                if h.get("warc-payload-digest", "sha1:" + digest) != "sha1:" + digest:
                    raise ValueError(f"{h['warc-record-id']}: the payload does not have the stated digest")
            elif kind == "revisit":
                digest, size = h["warc-payload-digest"].partition(":")[2], int(h.get("x-payload-length", 0))
            elif kind == "metadata":
                keep = block.decode()
            rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, size, keep))
            held += len(keep or "")
            if len(rows) >= 500 or held > 16_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)

    files = spark.read.option("lineSep", BEGIN.decode()).option("pathGlobFilter", "part-*").text(path)
    return files.select(F.col("value").cast("binary")).mapInArrow(run, _RECORDS_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: structs ``response`` (or revisit), ``request`` and ``metadata``.

    A request or metadata record belongs to the record it is concurrent to. All three meet
    in one grouping by that identifier; a capture without request or metadata has null
    there, and a request or metadata record without response still gives a row.
    """
    main = F.col("type").isin("response", "revisit")
    fields = F.struct("type", "record_id", "concurrent_to", "refers_to", "url", "digest", "payload_bytes", "payload")

    def one(kind):
        return F.min_by(F.when(kind, fields), F.when(kind, F.col("record_id")))

    key = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    return records.groupBy(key.alias("capture")).agg(one(main).alias("response"), one(F.col("type") == "request").alias("request"), one(F.col("type") == "metadata").alias("metadata"))


def round_trip(pages: DataFrame, path: str | None = None, payloads: bool = False) -> DataFrame:
    """Write the pages' captures, read the archives back and assemble them.

    Null html is an empty payload, null url an empty one. Every row is a capture of its own: rows
    with a repeated or null page_id too, whose records get random ids, and pages of any length. Rows
    that have the largest page_id of a payload in common are all responses; a null page_id
    revisits any other. An empty table writes no record and gives no row; extra columns are
    not archived.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/hotgrid-{uuid.uuid4().hex[:12]}/warc"
    write_archives(pages, path)
    return assemble(read_records(spark, path, payloads))


def digest_columns(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of assembled captures."""
    of = lambda c: F.regexp_extract(c, r":(-?\d+)>$", 1)
    return captures.select(
        F.regexp_extract("metadata.payload", r"pageId: (-?\d+)", 1).try_cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.refers_to").isNotNull(), of("response.refers_to").cast("long")).alias("refers_to"),
        F.col("response.url").alias("url"),
        F.col("request.record_id").alias("request_id"),
    )
