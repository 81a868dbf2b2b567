"""Cutting shards into size-bounded segments, footers, and segment names.

A segment starts with 24 header bytes, each record adds 8 bytes and its payload, and it is sealed by the record that
brings it to the size limit: a running sum that starts again, which no window function expresses.  ``rotate`` still
splits every shard, see there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the segment format.
SEGMENT_HEADER = 24
RECORD_OVERHEAD = 8
SENTINEL = 4
FOOTER = 32
DEAD_LETTER_SHARD = 65_535


def possible_seals(sums: np.ndarray, limit: int, largest: int) -> np.ndarray:
    """Which records can end a segment at all, by the running sum of sizes after them and the largest size.

    The j-th segment of a shard ends at a sum from j * limit to j * (limit + largest - 1), so at large limits few
    records come into question, whatever the chunk starts with.
    """
    return -(-sums // (limit + largest - 1)) <= sums // limit


def rotate(records: DataFrame, max_bytes: int, *, chunk_records: int = 200_000) -> DataFrame:
    """Add ``seg_no`` (from 0 in each shard) and ``sealed`` to records(seq, shard_id, payload, ...).

    Order within a shard is by seq.  Chunks hold ``chunk_records`` consecutive values of seq.  Each chunk sends the sums
    of sizes at which a segment can end (8 bytes each, of few records unless segments are small); those of a shard pass
    one task as a sorted stream, chunk by chunk, which finds the true ends.  Chunks then number their records, and
    payloads are shuffled once, for the last join.
    """
    limit = max_bytes - SEGMENT_HEADER
    sizes = records.select("shard_id", "seq", (F.octet_length("payload") + RECORD_OVERHEAD).cast("long").alias("size"), F.floor(F.col("seq") / chunk_records).cast("long").alias("chunk"))
    totals = sizes.groupBy("shard_id", "chunk").agg(F.sum("size").alias("total"), F.max("size").alias("most"))
    before = Window.partitionBy("shard_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    based = totals.select("shard_id", "chunk", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), F.max("most").over(Window.partitionBy("shard_id")).alias("most"))
    chunks = sizes.groupBy("shard_id", "chunk")

    def candidates(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        base, most = int(right["base"].iloc[0]), int(right["most"].iloc[0])
        sums = base + np.cumsum(left.sort_values("seq")["size"].to_numpy())
        found = sums[possible_seals(sums, max(limit, 1), most)]
        return pd.DataFrame({"shard_id": right["shard_id"], "chunk": right["chunk"], "base": [base], "sums": [found.astype(np.int64).tobytes()]})

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, number = None, 0, 0
        for batch in batches:
            numbers, ends = [], []
            for own, sums in zip(batch.column("shard_id").to_pylist(), batch.column("sums"), strict=True):
                if own != shard:
                    shard, last, number = own, 0, 0
                values, found, at = np.frombuffer(sums.as_py(), np.int64), [], 0
                numbers.append(number)
                while (at := int(np.searchsorted(values, last + max(limit, 1)))) < len(values):
                    last = int(values[at])
                    found.append(last)
                number += len(found)
                ends.append(np.array(found, np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("shard_id"), batch.column("chunk"), batch.column("base"), pa.array(numbers, pa.int64()), pa.array(ends, pa.binary())], ["shard_id", "chunk", "base", "number", "ends"])

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("seq")
        before = int(right["base"].iloc[0]) + np.cumsum(left["size"].to_numpy()) - left["size"].to_numpy()
        ends = np.frombuffer(right["ends"].iloc[0], np.int64)
        seg_no = int(right["number"].iloc[0]) + np.searchsorted(ends, before, side="right")
        return pd.DataFrame({"shard_id": left["shard_id"], "seq": left["seq"], "seg_no": seg_no, "sealed": seg_no < int(right["seals"].iloc[0])})

    summaries = chunks.cogroup(based.groupBy("shard_id", "chunk")).applyInPandas(candidates, "shard_id long, chunk long, base long, sums binary")
    ordered = summaries.repartition("shard_id").sortWithinPartitions("shard_id", "chunk")
    starts = ordered.mapInArrow(chain, "shard_id long, chunk long, base long, number long, ends binary")
    seals = F.max(F.col("number") + F.octet_length("ends") / 8).over(Window.partitionBy("shard_id")).cast("long")
    starts = starts.select("*", seals.alias("seals"))
    numbered = chunks.cogroup(starts.groupBy("shard_id", "chunk")).applyInPandas(assign, "shard_id long, seq long, seg_no long, sealed boolean")
    return records.join(numbered, ["shard_id", "seq"])


def footers(segmented: DataFrame) -> DataFrame:
    """record_count and data_bytes of each segment."""
    return segmented.groupBy("shard_id", "seg_no").agg(F.count("*").alias("record_count"), F.sum(F.octet_length("payload")).alias("data_bytes"))


def size_estimate(segmented: DataFrame) -> DataFrame:
    """Bytes of a segment file with these records."""
    size = F.sum(F.octet_length("payload") + RECORD_OVERHEAD) + (SEGMENT_HEADER + SENTINEL + FOOTER)
    return segmented.groupBy("shard_id", "seg_no").agg(size.alias("file_bytes"))


def in_order(parts: Column, order: Column) -> Column:
    """Binary concatenation of a group in a given order; for groups of at most one segment or batch."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.hex(parts).alias("h"))))
    return F.unhex(F.array_join(F.transform(rows, lambda r: r["h"]), ""))


def file_crcs(segmented: DataFrame, created_at: int = 0) -> DataFrame:
    """CRC-32 of each segment's bytes up to the sentinel, with a fixed creation time."""
    from ..functions.codec import MAGIC, le_bytes

    head = F.concat(F.unhex(F.lit(MAGIC)), le_bytes(F.lit(1), 1), le_bytes(F.lit(0), 1), le_bytes(F.col("shard_id"), 2), le_bytes(F.lit(created_at), 8), le_bytes(F.lit(0), 8))
    record = F.concat(le_bytes(F.octet_length("payload"), 4), le_bytes(F.crc32("payload"), 4), F.col("payload"))
    body = segmented.groupBy("shard_id", "seg_no").agg(in_order(record, F.col("seq")).alias("body"))
    return body.select("shard_id", "seg_no", F.crc32(F.concat(head, F.col("body"))).alias("file_crc32"))


def segment_name(counter: Column) -> Column:
    return F.format_string("seg_%08d.wab", counter)


def segment_state(name: Column) -> Column:
    """From the most specific suffix; null for other files."""
    return F.when(name.endswith(".wab.confirmed"), "confirmed").when(name.endswith(".wab.sealed"), "sealed").when(name.endswith(".wab"), "active")


def next_segment_numbers(files: DataFrame) -> DataFrame:
    """files(shard, name): one more than the largest counter of any state, by shard number; 0 for a shard without any."""
    counter = F.regexp_extract("name", r"\Aseg_([0-9]+)\.wab", 1).try_cast("bigint")
    shard = F.regexp_extract("shard", r"\Ashard_([0-9]+)\z", 1).try_cast("bigint")
    return files.groupBy(shard.alias("shard_no")).agg((F.coalesce(F.max(counter), F.lit(-1)) + 1).alias("next_no")).filter("shard_no is not null")


def confirmed_verdict(data: Column) -> Column:
    """ok, or what is wrong first with a confirmation sidecar: length, magic, version, crc."""
    from ..functions.codec import le_number

    return (
        F.when(F.octet_length(data) != 36, "bad_length")
        .when(F.hex(F.substring(data, 1, 4)) != "57434F4E", "bad_magic")
        .when(le_number(data, 5, 1) != 1, "bad_version")
        .when(le_number(data, 33, 4) != F.crc32(F.substring(data, 1, 32)), "bad_crc")
        .otherwise("ok")
    )


def confirmed_bytes(sealed_at: Column, count: Column, drained_at: Column) -> Column:
    from ..functions.codec import le_bytes

    body = F.concat(F.unhex(F.lit("57434F4E01000000")), le_bytes(sealed_at, 8), le_bytes(count, 8), le_bytes(drained_at, 8))
    return F.concat(body, le_bytes(F.crc32(body), 4))


def _smooth(state: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """States after the samples, for states before them."""
    for s in samples.tolist():
        state = state * 3 // 4 + s // 4
    return state


def smoothed_sync_latency(samples: DataFrame, *, floor_us: int = 50, ceiling_us: int = 2000, start_us: int = 0, chunk_records: int = 200_000) -> DataFrame:
    """Exponential average per shard: floor(3 cur / 4) + floor(sample / 4) in order of seq, clamped when read.

    samples(shard_id, seq, sample_us).  A shard is cut into chunks of ``chunk_records`` consecutive values of seq.  A step
    keeps the order of states and draws them together, so after some hundred samples all possible states lie close: a
    chunk sends those first samples and what the rest makes of each state then possible, and these meet per shard.
    """
    rows = samples.select("shard_id", "seq", F.col("sample_us").cast("long").alias("sample_us"), F.floor(F.col("seq") / chunk_records).cast("long").alias("chunk"))

    def summary(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("seq")["sample_us"].to_numpy()
        low, high, head = 0, max(start_us, 1 << 40), 0
        while head < len(values) and high - low > 64:
            low, high, head = low * 3 // 4 + values[head] // 4, high * 3 // 4 + values[head] // 4, head + 1
        states = np.arange(low, high + 1) if high - low <= 64 else np.zeros(0, np.int64)
        after = states.copy()
        for s in values[head:].tolist():
            after = after * 3 // 4 + s // 4
        return pd.DataFrame({"shard_id": group["shard_id"].iloc[:1], "chunk": group["chunk"].iloc[:1], "head": [values[:head].tolist()], "low": [int(low)], "after": [after.tolist()]})

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        state = start_us
        for row in group.sort_values("chunk").itertuples(index=False):
            state = int(_smooth(np.array([state]), np.asarray(row.head, np.int64))[0])
            if len(row.after):
                state = int(row.after[state - row.low])
        return pd.DataFrame({"shard_id": group["shard_id"].iloc[:1], "raw_us": [state]})

    summaries = rows.groupBy("shard_id", "chunk").applyInPandas(summary, "shard_id long, chunk long, head array<long>, low long, after array<long>")
    out = summaries.groupBy("shard_id").applyInPandas(chain, "shard_id long, raw_us long")
    return out.select("shard_id", "raw_us", F.least(F.greatest("raw_us", F.lit(floor_us)), F.lit(ceiling_us)).cast("long").alias("window_us"))


def idle_seals(writes: DataFrame, max_age_ms: int) -> DataFrame:
    """writes(shard_id, at_ms): the writes after which the shard idled for max_age_ms or more, with the sealing time."""
    after = F.lead("at_ms").over(Window.partitionBy("shard_id").orderBy("at_ms"))
    return writes.select("shard_id", "at_ms", after.alias("next_ms")).filter(F.col("next_ms") - F.col("at_ms") >= max_age_ms).select("shard_id", "at_ms", (F.col("at_ms") + max_age_ms).alias("sealed_ms"))
