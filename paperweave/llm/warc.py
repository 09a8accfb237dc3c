"""Web archives: written by Spark, read back, and assembled to captures.

A capture is three records: a request, a response (or a revisit without a
payload) and a metadata record with the page's number. Request and metadata
name the response in ``WARC-Concurrent-To``; :func:`assembled` joins the three
through it to one nested row. Archives are gzip text files of Spark's own
writer, read with its binary reader, so any store that Spark reaches will do.

Of pages with equal payloads of at least :data:`LEAST` bytes, that with the
largest number is the response; the others revisit it.

Defined cases: a null html is an empty payload; a null url has no target;
equal rows are captures each; rows with one number are captures each, and none
revisits another; a payload may hold anything, headers included, since records
are cut by their length; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.shared import stored

LEAST = 1000
PER_FILE = 9_000   # records of a file
_END = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

RECORD = ("type string, id string, concurrent_to string, refers_to string, target string, date string, "
          "digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary")


def _record(kind, id_, block, *headers):
    """Header and block of a record; headers with a null value are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), id_)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(_END, *lines, length), F.lit(_END * 2), block)


def with_roles(pages: DataFrame) -> DataFrame:
    """``pages (page, url, payload)`` with ``digest`` and ``refers`` (null for responses).

    Only digests are shuffled, summed up first; the join that carries payloads
    is with the digests that occur again.
    """
    known = pages.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    again = stored(known.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(
        F.max("page").alias("last"), F.min("page").alias("first"))
        .where("first <> last").select(F.col("digest").alias("digest_"), "last"), "again")
    large = (F.octet_length("payload") >= LEAST) & (F.col("digest") == F.col("digest_"))
    return known.join(again, large, "left") \
        .withColumn("refers", F.when(F.col("page") != F.col("last"), F.col("last"))).drop("digest_", "last")


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html",
                   date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a request, a response or revisit, and a metadata record per page below ``path``."""
    named = pages.select(F.col(id).cast("string").alias("key"), F.col(id).alias("page"), F.col(url).alias("url"),
                         F.coalesce(F.col(html), F.lit("")).alias("payload"))
    roles = with_roles(named)
    # Records are told apart by number and digest, so that a revisit can name its response.
    def name(key, part):
        return F.concat(F.lit("<urn:capture:"), F.coalesce(key, F.lit("none")), F.lit(":"), F.col("digest"),
                        F.lit(f":{part}>"))
    own, target = name(F.col("key"), "response"), F.regexp_replace(F.col("url"), r"[\r\n]", "%0A")
    revisit = F.col("refers").isNotNull()
    when, digest = ("WARC-Date", F.lit(date)), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), own,
        F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("payload"))),
        when, ("WARC-Target-URI", target), digest,
        ("WARC-Refers-To", F.when(revisit, name(F.col("refers").cast("string"), "response"))),
        ("WARC-Profile", F.when(revisit, F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")))
    request = _record(F.lit("request"), name(F.col("key"), "request"), F.lit("GET / HTTP/1.1\r\n\r\n"), when,
                      ("WARC-Target-URI", target), ("WARC-Concurrent-To", own),
                      ("Content-Type", F.lit("application/http; msgtype=request")))
    metadata = _record(F.lit("metadata"), name(F.col("key"), "metadata"),
                       F.concat(F.lit("page-id: "), F.coalesce("key", F.lit("")), F.lit(_END)), when,
                       ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields")))
    roles.select(F.explode(F.array(request, response, metadata)).alias("value")) \
        .write.option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


def records_in(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, names in lower case, and block of every record."""
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := archive.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, archive.read(int(headers.get("content-length", 0)))


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``; without their payloads unless asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("type", pa.string()), ("id", pa.string()), ("concurrent_to", pa.string()),
                            ("refers_to", pa.string()), ("target", pa.string()), ("date", pa.string()),
                            ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for batch in batches:
            for content in batch["content"]:
                raw, rows, held = content.as_buffer(), [], 0
                data = io.BytesIO(raw)
                file = gzip.open(data) if raw[:2].to_pybytes() == b"\x1f\x8b" else data
                for h, block in records_in(io.BufferedReader(file)):
                    kind = h.get("warc-type", "")
                    body = block.partition(b"\r\n\r\n")[2] if "http" in h.get("content-type", "") else block
                    fields = [tuple(x.partition(": ")[::2]) for x in block.decode("utf-8", "replace").split(_END) if x] \
                        if "warc-fields" in h.get("content-type", "") else None
                    full = kind in ("response", "resource")
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"),
                                 h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"),
                                 len(body) if full else None, hashlib.sha1(body).hexdigest() if full else None,
                                 fields, body if full and payload else None))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assembled(records: DataFrame) -> DataFrame:
    """A row per capture: ``(id, target, date, response, request, metadata)``, the latter three nested.

    ``response`` holds the type, digest, size and payload; of a revisit those of
    the record that it refers to, whose metadata is ``response.refers``.
    """
    whole = records.where("type IN ('response', 'revisit')")
    request = records.where("type = 'request'").groupBy(F.col("concurrent_to").alias("id")) \
        .agg(F.min(F.struct(F.col("id").alias("record"), "target", "date")).alias("request"))
    metadata = records.where("type = 'metadata'").groupBy(F.col("concurrent_to").alias("id")) \
        .agg(F.min_by("fields", "id").alias("metadata"))
    joined = whole.join(request, "id", "left").join(metadata, "id", "left")
    first = stored(joined.where("type = 'response'").groupBy(F.col("id").alias("first")).agg(
        F.min("payload_bytes").alias("bytes_"), F.min("payload_digest").alias("digest_"),
        F.first("metadata").alias("refers")).join(
        whole.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("first")).distinct(), "first"), "first")
    full = joined.join(first, F.col("refers_to") == F.col("first"), "left")
    return full.select("id", "target", "date", F.struct(
        "type", F.coalesce("payload_bytes", "bytes_").alias("payload_bytes"),
        F.coalesce("payload_digest", "digest_", F.substring_index("digest", ":", -1)).alias("payload_digest"),
        "refers_to", "refers", "payload").alias("response"), "request", "metadata")
