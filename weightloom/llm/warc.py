"""WARC archives: written by Spark's text writer, read back as bytes, assembled into captures.

Every page becomes a request, a response or revisit, and a metadata record; request and
metadata name the response in WARC-Concurrent-To. A record ends with two line ends,
which is what the text writer puts after each row, so its files are WARC files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weightloom.llm.common import bounded_batches
from weightloom.session import materialize

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of an archive file (before compression), and least payload that may be revisited.
ARCHIVE_BYTES = 16 << 20
LEAST_REVISIT = 1000
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, digest string, http_length long, page long, payload binary"


def _urn(kind: str, uid: Column) -> Column:
    """A record id that says the same on every run: a name-based digest in UUID form."""
    d = F.md5(F.concat(F.lit(kind + ":"), uid))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: Column | str, rid: Column, fields: list[Column], content_type: Column | str, block: Column) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat_ws("\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), text(kind)), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}"), *fields, F.concat(F.lit("Content-Type: "), text(content_type)), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")), F.lit(""), block)


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes ``pages`` (page_id, url, html) as gzip-compressed archives below ``path``.

    The html is shuffled once, into as many archives as its bytes ask for; which page a
    payload refers to is found on digests alone, combined before their shuffle.
    """
    body = F.coalesce("html", F.lit(""))
    row = F.xxhash64("page_id", "url", "html").alias("row")
    narrow = materialize(pages.select("page_id", row, F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("bytes")), "warc-digests")
    total = narrow.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    files = max(1, -(-total[0] // ARCHIVE_BYTES), -(-total[1] // 20_000))
    groups = narrow.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "row")).alias("top")).filter("n > 1")
    groups = materialize(groups.select("digest", _name(F.col("top.page_id"), F.col("top.row")).alias("top")), "warc-payloads")
    marks = narrow.join(groups, "digest").select(F.col("page_id").alias("m_id"), F.col("row").alias("m_row"), "top").distinct()
    marks = materialize(marks, "warc-marks")
    keyed = pages.select("page_id", "url", body.alias("html"), row)
    joined = keyed.repartition(files, "row").join(marks.repartition(files, "m_row"), (F.col("row") == F.col("m_row")) & F.col("page_id").eqNullSafe(F.col("m_id")), "left")
    # wholly equal rows lie in one partition; they are numbered, and only the first can be the response
    numbered = joined.withColumn("copy", F.row_number().over(Window.partitionBy("row").orderBy("page_id")))
    numbered.select(_capture().alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _name(page: Column, row: Column) -> Column:
    return F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("null")), row.cast("string"))


def _capture() -> Column:
    """The records of one page, one after the other."""
    plain, top = _name(F.col("page_id"), F.col("row")), F.col("top")
    own = F.when(F.col("copy") == 1, plain).otherwise(F.concat_ws("/", plain, F.col("copy").cast("string")))
    revisit = F.coalesce(own != top, F.lit(False))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "")
    response = _urn("response", own)
    size, digest = F.octet_length("html").cast("string"), F.sha1(F.col("html").cast("binary"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    http = "application/http; msgtype="
    target = F.concat(F.lit("WARC-Target-URI: "), uri)
    about = F.concat(F.lit("WARC-Concurrent-To: "), response)
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn("response", top), F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}")))
    main = _record(F.when(revisit, "revisit").otherwise("response"), response, [target, F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest), refers], http + "response", F.concat(head, F.when(revisit, "").otherwise(F.col("html"))))
    request = _record("request", _urn("request", own), [target, about], http + "request", F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + END)))
    meta = _record("metadata", _urn("metadata", own), [target, about], "application/warc-fields", F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")))
    return F.concat_ws(END, main, request, meta)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives below ``path``, one row each; digests are taken from the payloads read."""
    bounded_batches(spark)
    names = [x.split()[0] for x in RECORD.split(", ")]

    def parse(data: bytes) -> Iterator[tuple]:
        for f, block in _records(zlib.decompress(data, 31)):
            kind, payload, size, page, digest = f["warc-type"], None, None, None, f.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if kind in ("response", "revisit"):
                head, _, body = block.partition(b"\r\n\r\n")
                size = int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                if kind == "response":
                    size, digest, payload = len(body), hashlib.sha1(body).hexdigest(), body if payloads else None
            elif kind == "metadata":
                page = block.decode().partition("page-id: ")[2].strip()
            yield f["warc-record-id"], kind, f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), digest, size, int(page) if page else None, payload

    types = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = list(parse(data.as_py()))
                for a in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 1000]), types)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``response`` with its ``request`` and ``metadata``, joined
    through the concurrent-to identifiers; a capture without one of these has it null."""
    main = records.filter("type IN ('response', 'revisit')")
    part = lambda kind, *fields: records.filter(F.col("type") == kind).select(F.col("concurrent_to").alias("to"), F.struct("record_id", *fields).alias(kind))
    whole = main.select("record_id", F.struct("record_id", "type", "target_uri", "refers_to", "digest", "http_length", "payload").alias("response"))
    for kind, fields in (("request", ("target_uri",)), ("metadata", ("page",))):
        whole = whole.join(part(kind, *fields), F.col("record_id") == F.col("to"), "left").drop("to")
    return whole


def archived_pages(pages: DataFrame, path: str) -> DataFrame:
    """Writes the archives to ``path``, reads them back and returns per page: page_id,
    payload_bytes, payload_digest, record_type, refers_to, request_uri.

    A null html is an empty payload; a null url has an empty target. Of equal payloads the
    largest page_id (null counts as least) is the response; of repeated rows, one. An empty
    table gives an empty table; other columns are not archived.
    """
    write_archives(pages, path)
    found = captures(read_records(pages.sparkSession, path, payloads=False))
    flat = materialize(found.select("record_id", F.col("metadata.page").alias("page_id"), "response", F.col("request.target_uri").alias("request_uri")), "warc-captures")
    target = flat.select(F.col("record_id").alias("target_id"), F.col("page_id").alias("refers_to"))
    joined = flat.join(target, F.col("response.refers_to") == F.col("target_id"), "left")
    return joined.select("page_id", F.col("response.http_length").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"), "refers_to", "request_uri")
