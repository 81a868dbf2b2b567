"""WARC archives: writing captures, reading records, and assembling transactions.

Each capture is a request, a response (or revisit) and a metadata record that name the request in
``WARC-Concurrent-To``.  Records are built by SQL expressions and written by Spark's text writer with the WARC record
end as line separator, so archives are plain ``.warc`` bytes (gzip) on any file system that Spark can write.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

END = "\r\n\r\n"
RECORDS = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, page_id long, payload_bytes long, payload_digest string, payload binary"


def _lines(*parts: F.Column) -> F.Column:
    """Header lines; a null one is left out."""
    return F.concat_ws("\r\n", *parts)


def _header(name: str, value: F.Column) -> F.Column:
    return F.concat(F.lit(f"{name}: "), value)


def revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages whose payload an earlier page has.

    pages: page_id, payload_digest, payload_bytes.  Only payloads of at least ``least_bytes`` count.
    """
    usable = pages.filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    first = usable.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to < last")
    first = stored(first.select("payload_digest", "refers_to"), "payloads")
    return usable.join(first, "payload_digest").filter("page_id > refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def write_warc(
    df: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, captures_a_file: int = 1000, file_bytes: int = 64 << 20, date: str = "2025-01-01T00:00:00Z"
) -> None:
    """Write three records per row of df.  Payload: the html in UTF-8, empty for null.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the smallest id is a response and the
    others revisit it without a payload of their own.  Rows with a null id are always responses; rows that repeat the
    smallest id are so too.  A null url leaves its header out; line ends in a url are escaped.

    An archive holds at most ``captures_a_file`` captures and about ``file_bytes`` bytes of payload (a larger page has a
    file of its own): pages are written by classes of doubling size, and each class has so many captures a file.
    """
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    pages = pages.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2(F.encode("html", "utf-8"), 256))
    again = stored(revisits(pages.select("page_id", "payload_bytes", "payload_digest"), least_bytes), "revisits")
    full = pages.join(again, ["page_id", "payload_digest"], "left").withColumn("u", F.expr("uuid()"))
    is_revisit = F.col("refers_to").isNotNull()
    uri = _header("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))
    request_id = F.concat(F.lit("<urn:uuid:"), F.col("u"), F.lit(">"))
    page = _header("X-Page-Id", F.col("page_id").cast("string"))
    when = F.lit(f"WARC-Date: {date}")

    def record(kind: F.Column, own_id: F.Column, content_type: str, block: F.Column, *more: F.Column) -> F.Column:
        size = _header("Content-Length", F.octet_length(block).cast("string"))
        head = _lines(F.lit("WARC/1.1"), _header("WARC-Type", kind), _header("WARC-Record-ID", own_id), when, uri, page, *more, F.lit(f"Content-Type: {content_type}"), size)
        return F.concat(head, F.lit(END), block)

    request_block = F.lit("GET / HTTP/1.1" + END)
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), _header("Content-Length", F.col("payload_bytes").cast("string")))
    response_block = F.concat(http, F.lit(END), F.when(is_revisit, F.lit("")).otherwise(F.col("html")))
    page_urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    response_id = F.coalesce(page_urn(F.col("page_id")), F.concat(F.lit("<urn:uuid:response-"), F.col("u"), F.lit(">")))
    response_id = F.when(is_revisit, F.concat(F.lit("<urn:uuid:revisit-"), F.col("u"), F.lit(">"))).otherwise(response_id)
    concurrent = _header("WARC-Concurrent-To", request_id)
    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest")))
    refers = F.when(is_revisit, _header("WARC-Refers-To", page_urn(F.col("refers_to"))))
    fields = F.concat(F.lit("payloadBytes: "), F.col("payload_bytes").cast("string"), F.lit("\r\n"))
    records = F.array(
        record(F.lit("request"), request_id, "application/http; msgtype=request", request_block),
        record(F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")), response_id, "application/http; msgtype=response", response_block, concurrent, digest, refers),
        record(F.lit("metadata"), F.concat(F.lit("<urn:uuid:metadata-"), F.col("u"), F.lit(">")), "application/warc-fields", fields, concurrent),
    )
    doublings = F.greatest(F.ceil(F.log2(F.col("payload_bytes") * captures_a_file / file_bytes)), F.lit(0)).cast("int")
    size_class = F.least(F.coalesce(doublings, F.lit(0)), F.lit(captures_a_file.bit_length()))
    present = [r["c"] for r in pages.select(size_class.alias("c")).distinct().collect()]  # at most a few dozen numbers
    for c in sorted(present) or [0]:
        lines = full.filter(size_class == c).select(F.explode(records).alias("value"))
        captures = max(1, captures_a_file >> c)
        lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures).text(f"{path}/size-{c}")


def _inflated(raw: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of gzip members one after the other, a little at a time."""
    at, member = 0, zlib.decompressobj(31)
    while at < len(raw):
        rest = raw[at : at + step]
        at += len(rest)
        while rest:
            yield member.decompress(rest, 16 * step)
            rest = member.unconsumed_tail
            if member.eof:
                rest, member = member.unused_data, zlib.decompressobj(31)


def parse_archive(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record, by the lengths that the headers give; ``raw`` may be gzip, of many members.

    A record that is cut off by the end of the file is left out.
    """
    source = _inflated(raw) if raw[:2] == b"\x1f\x8b" else iter((raw,))
    held = bytearray()

    def find(what: bytes, begin: int) -> int:
        while (at := held.find(what, begin)) < 0:
            begin = max(begin, len(held) - len(what) + 1)
            if (more := next(source, None)) is None:
                return -1
            held.extend(more)
        return at

    while (at := find(b"WARC/", 0)) >= 0:
        del held[:at]
        stop = find(b"\r\n\r\n", 0)
        if stop < 0:
            return
        lines = held[:stop].decode("utf-8").split("\r\n")[1:]
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        end = stop + 4 + int(head["content-length"])
        while len(held) < end:
            if (more := next(source, None)) is None:
                return
            held.extend(more)
        yield head, bytes(held[stop + 4 : end])
        del held[:end]


def _record(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, payload, size, digest = head["warc-type"], None, None, None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        else:  # the payload lies in another record
            size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
            digest = head["warc-payload-digest"].rpartition(":")[2]
    page = head.get("x-page-id")
    return kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), int(page) if page else None, size, digest, payload if with_payload else None


def read_warc(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in a folder.

    ``payload_digest`` is computed from the payload that was read; of a revisit, which has none, length and digest
    are those that its headers state of the full payload.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for head, block in parse_archive(content.as_py()):
                    rows.append(_record(head, block, with_payload))
                    size += len(block) if with_payload else 0
                    if size > 8 << 20 or len(rows) == 4096:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    return files.mapInArrow(run, RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One row per response or revisit: its page_id and uri, and the nested request, capture and metadata records.

    Records are joined by the request that they name in concurrent_to; a missing request or metadata is null, and of
    several with the same id the largest counts.  Archives are parsed once, into a table.
    """
    records = stored(records, "records")
    fields = F.struct("record_type", "record_id", "refers_to", "target_uri", "page_id", "payload_bytes", "payload_digest", "payload")

    def one(kind: str, key: str) -> DataFrame:
        own = records.filter((F.col("record_type") == kind) & F.col(key).isNotNull())
        return own.groupBy(F.col(key).alias("request_id")).agg(F.max(fields).alias(kind))

    captures = records.filter(F.col("record_type").isin("response", "revisit")).select(F.col("concurrent_to").alias("request_id"), fields.alias("capture"))
    joined = captures.join(one("request", "record_id"), "request_id", "left").join(one("metadata", "concurrent_to"), "request_id", "left")
    return joined.select(F.col("capture.page_id").alias("page_id"), F.col("capture.target_uri").alias("target_uri"), "request", "capture", "metadata")
