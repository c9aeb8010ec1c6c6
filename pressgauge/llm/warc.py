"""WARC: one archive transaction per page, and its assembly back into one nested row per capture.

A page is written as three records, request, response (or revisit) and metadata; request and metadata name the capture in
``WARC-Concurrent-To``. Reading parses records by ``Content-Length``, so payloads may hold any bytes, and joins the three
through that identifier. Null html is an empty payload, null url an empty target. Repeated rows give as many captures.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads below this many bytes are always stored whole.
MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"


def _uuid(c):
    h = F.md5(c)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, records_per_file: int = 4000) -> None:
    """Write pages(page_id, url, html) as gzip archives under ``path``.

    Of equal payloads of at least ``min_revisit`` bytes the largest page_id is the response, the rest revisit it. Digests
    are grouped with map-side combine, and only (digest, length, id) rows are shuffled, never payloads.
    """
    p = pages.select(
        "page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\s\x00-\x1f]", "%20").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("sha1", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    keyed = p.withColumn("rid", _uuid(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "url", "sha1")))
    groups = keyed.filter(F.col("bytes") >= min_revisit).groupBy("sha1", "bytes").agg(
        F.count("*").alias("n"), F.max("page_id").alias("first_id"), F.max_by(F.struct("rid", "url"), "page_id").alias("origin")
    )
    # Only shared payloads need the join; page_id tells a response from its revisits.
    j = keyed.join(groups.filter("n > 1").drop("n"), ["sha1", "bytes"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    crlf = "\r\n"

    def record(headers: list, block) -> object:
        lines = F.concat_ws(crlf, F.lit("WARC/1.1"), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
        return F.concat(lines, F.lit(crlf * 2), block)

    def head(name, value):
        return F.concat(F.lit(f"{name}: "), value)

    common = [head("WARC-Date", F.lit(DATE)), head("WARC-Target-URI", F.col("url"))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(crlf * 2))
    origin = [
        F.when(revisit, F.concat_ws(crlf, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), head("WARC-Refers-To", F.col("origin.rid")), head("WARC-Refers-To-Target-URI", F.col("origin.url")), head("X-Refers-To-Page", F.col("first_id").cast("string"))))
    ]
    capture = record(
        [head("WARC-Type", kind), head("WARC-Record-ID", F.col("rid")), *common, *origin, head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), F.lit("Content-Type: application/http; msgtype=response")],
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    other = lambda k: _uuid(F.concat(F.lit(k), F.col("rid")))
    request = record(
        [F.lit("WARC-Type: request"), head("WARC-Record-ID", other("request")), *common, head("WARC-Concurrent-To", F.col("rid")), F.lit("Content-Type: application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.when(F.col("url") == "", "/").otherwise(F.col("url")), F.lit(" HTTP/1.1"), F.lit(crlf * 2)),
    )
    meta = record(
        [F.lit("WARC-Type: metadata"), head("WARC-Record-ID", other("metadata")), *common, head("WARC-Concurrent-To", F.col("rid")), F.lit("Content-Type: application/warc-fields")],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(crlf)),
    )
    end = F.lit(crlf * 2)
    # The writer ends each value with its line separator, here the second half of the last record's end.
    value = F.concat(request, end, capture, end, meta, F.lit(crlf))
    j.select(value.alias("value")).write.option("lineSep", crlf).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _members(data: bytes) -> bytes:
    """Content of one or more gzip members."""
    out, rest = [], data
    while rest:
        d = zlib.decompressobj(31)
        out.append(d.decompress(rest))
        out.append(d.flush())
        rest = d.unused_data
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record in an uncompressed archive."""
    at, n = 0, len(data)
    while at < n:
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


RECORDS = (
    "capture_id string, record_type string, record_id string, target_uri string, refers_to_id string, refers_to long, page_id long, "
    "payload_bytes long, payload_digest string, payload binary"
)


def _read(batches, with_payload):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    for pdf in batches:
        for data in pdf["content"]:
            rows = []
            for h, block in parse_records(_members(data)):
                kind, row = h["warc-type"], dict.fromkeys(names)
                row |= {"record_type": kind, "record_id": h["warc-record-id"], "target_uri": h.get("warc-target-uri", ""), "capture_id": h.get("warc-concurrent-to", h["warc-record-id"])}
                if kind == "metadata":
                    fields = dict(x.partition(": ")[::2] for x in block.decode().split("\r\n") if x)
                    row["page_id"] = int(fields["page-id"]) if fields.get("page-id") else None
                elif kind in ("response", "revisit"):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    if kind == "response":
                        row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload if with_payload else None}
                    else:
                        said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n"))}
                        row |= {"payload_bytes": int(said["content-length"]), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "refers_to_id": h["warc-refers-to"], "refers_to": int(h["x-refers-to-page"])}
                rows.append(row)
                if len(rows) >= 2000:
                    yield frame(rows, names)
                    rows = []
            yield frame(rows, names)


def frame(rows, names):
    df = pd.DataFrame(rows, columns=names)
    for c in ("refers_to", "page_id", "payload_bytes"):
        df[c] = df[c].astype("Int64")
    return df


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives under ``path``; files are read by Spark, so any store serves."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(lambda it: _read(it, with_payload), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its request, its response or revisit, its metadata.

    Records meet by capture id in one aggregation; whole-row repeats share ids and are counted, then given back.
    """
    part = lambda *kinds: F.when(F.col("record_type").isin(*kinds), F.struct(*[c for c in records.columns if c != "capture_id"]))
    got = records.groupBy("capture_id").agg(
        F.first(part("request"), ignorenulls=True).alias("request"), F.first(part("response", "revisit"), ignorenulls=True).alias("capture"),
        F.first(part("metadata"), ignorenulls=True).alias("metadata"), F.count_if(F.col("record_type").isin("response", "revisit")).alias("copies"),
    )
    return got.filter("capture is not null").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def captures(pages: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    write_archives(pages, path)
    return assemble(read_records(pages.sparkSession, path, with_payload))
