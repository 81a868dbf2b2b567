"""Segment files: building, scanning, verifying and recovering them.

Files are read with Spark's ``binaryFile`` source (any file system), one row per file; sizes are bounded by the
rotation limit.  Writing needs a folder that all executors see, and goes through a Python data source whose files
get their final names only at commit.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.codec import MAGIC, MAX_PAYLOAD, le_bytes
from ..operators.segments import FOOTER, SEGMENT_HEADER, SENTINEL, in_order

_MAGIC = bytes.fromhex(MAGIC)


def segment_bytes(segmented: DataFrame, created_at: int = 0, sealed_at: int = 0) -> DataFrame:
    """(shard_id, seg_no, data): whole sealed files, one row each."""
    head = F.concat(F.unhex(F.lit(MAGIC)), le_bytes(F.lit(1), 1), le_bytes(F.lit(0), 1), le_bytes(F.col("shard_id"), 2), le_bytes(F.lit(created_at), 8), le_bytes(F.lit(0), 8))
    record = F.concat(le_bytes(F.octet_length("payload"), 4), le_bytes(F.crc32("payload"), 4), F.col("payload"))
    grouped = segmented.groupBy("shard_id", "seg_no").agg(in_order(record, F.col("seq")).alias("body"), F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes"))
    whole = F.concat(head, F.col("body"))
    footer = F.concat(le_bytes(F.col("n"), 8), le_bytes(F.col("bytes"), 8), le_bytes(F.crc32(whole), 4), le_bytes(F.lit(sealed_at), 8), le_bytes(F.lit(0), 4))
    return grouped.select("shard_id", "seg_no", F.concat(whole, le_bytes(F.lit(0), 4), footer).alias("data"))


@dataclass
class Scan:
    """What one file holds: its valid prefix of records, and how the rest reads."""

    payloads: list[bytes]
    error: str | None  # the one error that a reader reports after the prefix
    verdict: str  # of a sealed file
    fault: str  # none, bad_header, torn_tail, crc_mismatch, oversize: for recovery
    end: int  # end of the valid prefix


def scan_segment(raw: bytes) -> Scan:
    def number(at: int, n: int) -> int:
        return int.from_bytes(raw[at : at + n], "little")

    if len(raw) < SEGMENT_HEADER:
        return Scan([], "header", "TooShort", "bad_header", 0)
    if raw[:4] != _MAGIC or raw[4] != 1:
        return Scan([], "header", "Header", "bad_header", 0)
    payloads, at, error, fault, ended, payload_bytes = [], SEGMENT_HEADER, None, "none", False, 0
    while at + 4 <= len(raw):
        size = number(at, 4)
        if size == 0:
            ended = True
            break
        if size > MAX_PAYLOAD:
            error, fault = "oversize", "oversize"
            break
        if at + 8 + size > len(raw):
            error, fault = "torn_record", "torn_tail"
            break
        payload = raw[at + 8 : at + 8 + size]
        if zlib.crc32(payload) != number(at + 4, 4):
            error, fault = "bad_crc", "crc_mismatch"
            break
        payloads.append(payload)
        payload_bytes += size
        at += 8 + size
    foot = at + SENTINEL
    if error:
        verdict = "BadRecord"
    elif not ended:
        verdict = "NoSentinel"
        fault = "torn_tail" if at < len(raw) else fault
    elif foot + FOOTER > len(raw):
        verdict = "MissingFooter"
    elif number(foot + 16, 4) != zlib.crc32(raw[:at]):
        verdict = "CrcMismatch"
    elif number(foot, 8) != len(payloads):
        verdict = "FooterMismatch(count)"
    elif number(foot + 8, 8) != payload_bytes:
        verdict = "FooterMismatch(bytes)"
    elif foot + FOOTER < len(raw):
        verdict = "TrailingBytes"
    else:
        verdict = "ok"
    return Scan(payloads, error, verdict, fault, at)


def scan_segments(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, idx, payload, error): records of files(keys, data) up to the first bad one, which is a row with an error."""
    schema = StructType([files.schema[k] for k in keys]).add("idx", "long").add("payload", "binary").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = scan_segment(batch.column("data")[i].as_py())
                n = len(found.payloads) + (found.error is not None)
                columns = [pa.array([batch.column(k)[i].as_py()] * n, batch.column(k).type) for k in keys]
                errors = [None] * len(found.payloads) + [found.error] * (found.error is not None)
                payloads = found.payloads + [None] * (found.error is not None)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(n), pa.int64()), pa.array(payloads, pa.binary()), pa.array(errors, pa.string())], [*keys, "idx", "payload", "error"])

    return files.select(*keys, "data").mapInArrow(run, schema)


def verify_segments(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, verdict, records, fault, valid_bytes, trailing) of each sealed or open file."""
    schema = StructType([files.schema[k] for k in keys]).add("verdict", "string").add("records", "long").add("fault", "string").add("valid_bytes", "long").add("trailing", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x.as_py() for x in batch.column("data")]
            scans = [scan_segment(d) for d in data]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in keys],
                    pa.array([s.verdict for s in scans], pa.string()),
                    pa.array([len(s.payloads) for s in scans], pa.int64()),
                    pa.array([s.fault for s in scans], pa.string()),
                    pa.array([s.end for s in scans], pa.int64()),
                    pa.array([max(len(d) - s.end, 0) for d, s in zip(data, scans, strict=True)], pa.int64()),
                ],
                [*keys, "verdict", "records", "fault", "valid_bytes", "trailing"],
            )

    return files.select(*keys, "data").mapInArrow(run, schema)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, data) of all segment files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "seg_*.wab*").load(path)
    return files.select("path", F.col("content").alias("data"))


def list_segments(spark: SparkSession, path: str) -> DataFrame:
    """(shard, name, size): the listing of a folder without reading any file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    part: Column = F.split("path", "/")
    return files.select(F.element_at(part, -2).alias("shard"), F.element_at(part, -1).alias("name"), F.col("length").alias("size"))


class _Written(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class _SegmentWriter(DataSourceWriter):
    def __init__(self, folder: str, columns: list[str]):
        self.folder, self.columns = folder, columns

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        attempt, names = TaskContext.get().taskAttemptId(), []
        for row in rows:
            target = os.path.join(self.folder, f"shard_{row['shard_id']:02d}", f"seg_{row['seg_no']:08d}.wab.sealed")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(temp := f"{target}.{attempt}.tmp", "xb") as out:
                out.write(row["data"])
                out.flush()
                os.fsync(out.fileno())
            names.append((temp, target))
        return _Written(names)

    def commit(self, messages: list) -> None:
        for message in messages:
            for temp, target in message.names if message else []:
                if os.path.exists(target):
                    raise FileExistsError(target)  # never overwrite a sealed segment
                os.rename(temp, target)

    def abort(self, messages: list) -> None:
        for message in messages:
            for temp, _ in message.names if message else []:
                if os.path.exists(temp):
                    os.remove(temp)


class SegmentDataSource(DataSource):
    """``df.write.format("siltsegments").option("path", folder)`` for rows (shard_id, seg_no, data)."""

    @classmethod
    def name(cls) -> str:
        return "siltsegments"

    def schema(self) -> str:
        return "shard_id long, seg_no long, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> _SegmentWriter:
        return _SegmentWriter(self.options["path"], schema.names)
