"""WARC archives: write captures as records, read them back, assemble transactions.

Writing: each page becomes a request, a response (or a revisit of an equal payload) and a
metadata record; request and metadata name the response in ``WARC-Concurrent-To``.  Records are
rows of a text table whose line separator is the record separator, so Spark's committed
writers make the (gzip) files and a lost task leaves nothing half written.

Reading: files come through Spark's binary reader, are parsed record by record by their
``Content-Length`` and give one row per record.  ``assembled`` joins requests and metadata with
the record they are concurrent to and emits one nested row per capture.

Defined results: a null html is an empty payload; a null url leaves the target header out; rows with the largest
page id among equal payloads are responses (repeated ones too), rows with a null page id refer to it,
or are responses if no equal payload has an id; rows equal in page id, url and payload are one
capture with ``rows`` counting them; a request or metadata record whose partner is missing is a capture
without response; a broken record becomes a row of type ``malformed`` and ends its file; no pages, no files, no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.session import share_package

SEPARATOR = "\r\n\r\n"
HEADER_END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = "file string, number long, type string, record_id string, concurrent_to string, refers_to string, uri string, stated_digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
BATCH_BYTES = 16 << 20


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five bytes give eight digits."""
    digits = F.sha1(data)
    part = lambda i: F.lpad(F.conv(F.substr(digits, F.lit(1 + 10 * i), F.lit(10)), 16, 32), 8, "0")
    return F.translate(F.upper(F.concat(*[part(i) for i in range(4)])), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substr(h, F.lit(a + 1), F.lit(n)) for a, n in ((0, 8), (8, 4), (12, 4), (16, 4), (20, 12))]), F.lit(">"))


def _record(kind: Column | str, rid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.when(v.isNotNull(), F.concat(F.lit(f"{n}: "), v)) for n, v in headers]
    return F.concat(F.concat_ws("\r\n", *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(SEPARATOR), block)


def write(pages: DataFrame, path: str, html: str = "html", url: str = "url", key: str = "page_id", least_bytes: int = 0, records_per_file: int = 8192) -> None:
    """Write one transaction per row; of equal payloads of ``least_bytes`` or more only one is stored."""
    own = pages.select(F.col(key).cast("string").alias("page"), F.col(key).alias("key"), F.regexp_replace(F.col(url), r"[\r\n]+", " ").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    own = own.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    own = own.withColumn("rid", _uuid(F.lit("response"), F.col("page"), F.col("url"), F.col("digest")))
    firsts = own.groupBy("digest", "bytes").agg(F.max(F.when(F.col("key").isNotNull(), F.struct("key", "rid"))).alias("first")).withColumnsRenamed({"digest": "d", "bytes": "b"})
    joined = own.join(firsts, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")))
    again = F.coalesce((F.col("bytes") >= least_bytes) & F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first.key")), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(SEPARATOR))
    target, concurrent = ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", F.col("rid"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    ask = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1"), F.lit(SEPARATOR))
    request = _record("request", _uuid(F.lit("request"), F.col("rid")), [target, concurrent, ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    http_type = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = F.when(again, _record("revisit", F.col("rid"), [target, digest, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.col("first.rid")), http_type], http)).otherwise(
        _record("response", F.col("rid"), [target, digest, http_type], F.concat(http, F.col("html"))))
    notes = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("page")), F.lit("via: crawl"))
    metadata = _record("metadata", _uuid(F.lit("metadata"), F.col("rid")), [target, concurrent, ("Content-Type", F.lit("application/warc-fields"))], F.concat(notes, F.lit("\r\n")))
    records = joined.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parsed(file: str, data: bytes) -> Iterator[dict]:
    """The records of one file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, number = 0, 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":  # between records
            at += 2
            continue
        end = data.find(HEADER_END, at)
        head = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        size = fields.get("content-length", "")
        start = end + len(HEADER_END)
        if not head[0].startswith("WARC/") or not size.isdecimal() or start + int(size) > len(data):
            yield {"file": file, "number": number, "type": "malformed"}
            return
        block = data[start : start + int(size)]
        cut = block.find(HEADER_END) if fields.get("content-type", "").startswith("application/http") else -1
        payload = block[cut + len(HEADER_END) :] if cut >= 0 else block
        notes = {}
        if fields.get("content-type", "").startswith("application/warc-fields"):
            notes = {k.strip(): v.strip() for k, s, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")) if s}
        stated = fields.get("warc-payload-digest", "")
        yield {"file": file, "number": number, "type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"),
               "uri": fields.get("warc-target-uri"), "stated_digest": stated.removeprefix("sha1:") or None, "payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(),
               "fields": list(notes.items()), "payload": payload}
        at, number = start + int(size), number + 1


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record; without ``payloads`` only their sizes and digests."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    share_package(spark)
    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for row in parsed(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()):
                    row = row if payloads else row | {"payload": None}
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 500
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(records, RECORD)


def assembled(records: DataFrame) -> DataFrame:
    """One row per capture: record_id, type, uri, refers_to, payload_bytes, payload_digest, stated_digest, payload, ``requests`` and ``note`` (map of its metadata fields), ``rows`` (equal captures).

    Responses, requests and metadata are joined by one grouping on the id they share (their own
    or the one they are concurrent to), so every record is parsed and shuffled once.  Copies of a
    record say the same and count once.
    """
    kind = F.col("type")
    main = ~kind.isin("request", "metadata")
    parts = ("type", "uri", "refers_to", "payload_bytes", "payload_digest", "stated_digest", "payload")
    joined = records.where("type <> 'malformed'").groupBy(F.coalesce("concurrent_to", "record_id").alias("hub")).agg(
        F.max(F.when(main, F.struct(*parts))).alias("answer"), F.count_if(main).alias("n"),
        F.collect_set(F.when(kind == "request", F.struct("record_id", "uri", "payload"))).alias("requests"),
        F.array_sort(F.flatten(F.collect_set(F.when(kind == "metadata", F.map_entries("fields"))))).alias("notes"))
    return joined.select(F.col("hub").alias("record_id"), *[F.col(f"answer.{c}").alias(c) for c in parts], "requests", _note_map().alias("note"), F.greatest("n", F.lit(1)).alias("rows"))


def _note_map() -> Column:
    """Metadata fields as a map; of equal names the first value counts."""
    firsts = F.filter("notes", lambda n, i: (i == 0) | (F.get(F.col("notes"), F.greatest(i - 1, F.lit(0)))["key"] != n["key"]))
    return F.map_from_entries(firsts)
