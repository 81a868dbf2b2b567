"""Delivery: batches, outcomes, retries, the dead-letter gate and their bookkeeping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from .segments import FOOTER, RECORD_OVERHEAD, SEGMENT_HEADER, SENTINEL, in_order

RETRY_CEILING_MS = 300_000


def sub_batches(segmented: DataFrame, size: int) -> DataFrame:
    """Add ``batch_no``: consecutive chunks of ``size`` records of each segment."""
    order = Window.partitionBy("shard_id", "seg_no").orderBy("seq")
    return segmented.withColumn("batch_no", F.floor((F.row_number().over(order) - 1) / size).cast("long"))


def records_per_commit(batched: DataFrame) -> DataFrame:
    """Sealed segments, records, commits and their ratio, per shard."""
    sealed = batched.filter("sealed")
    per_segment = sealed.groupBy("shard_id", "seg_no").agg(F.count("*").alias("n"), (F.max("batch_no") + 1).alias("c"))
    out = per_segment.groupBy("shard_id").agg(F.count("*").alias("segments"), F.sum("n").alias("records"), F.sum("c").alias("commits"))
    return out.select("*", F.round(F.col("records") / F.col("commits"), 6).alias("records_per_commit"))


def commit_outcomes(attempts: DataFrame) -> DataFrame:
    """attempts(batch, records, rejected, error): what a batch's commit leads to.

    error: null for success, timeout, transient or permanent.  A timeout is transient; a permanent error sends the
    whole batch to the dead letters; rejected records of a successful commit go there too.
    """
    bad = F.col("error") == "permanent"
    retry = F.col("error").isin("timeout", "transient")
    return attempts.select(
        "batch",
        F.when(retry, "retry").when(bad, "dead_letter_all").when(F.col("rejected") > 0, "commit_with_rejects").otherwise("commit").alias("outcome"),
        F.when(F.col("error").isNull(), F.col("records") - F.col("rejected")).otherwise(F.lit(0)).alias("committed"),
        F.when(bad, F.col("records")).when(F.col("error").isNull(), F.col("rejected")).otherwise(F.lit(0)).alias("dead_lettered"),
    )


def uncovered_batches(outcomes: DataFrame) -> DataFrame:
    """Batches whose committed and dead-lettered counts don't add up to the input: never confirmed."""
    per = outcomes.groupBy("batch").agg(F.sum("records").alias("records"), F.sum("committed").alias("committed"), F.sum("dead_lettered").alias("dead_lettered"))
    return per.filter(F.col("committed") + F.col("dead_lettered") != F.col("records"))


def segment_completeness(footers: DataFrame, segmented: DataFrame) -> DataFrame:
    """deliver, or quarantine where the rows that can be read differ from the footer's count."""
    read = segmented.groupBy("shard_id", "seg_no").agg(F.count("*").alias("rows_read"))
    both = footers.join(read, ["shard_id", "seg_no"], "left").withColumn("rows_read", F.coalesce("rows_read", F.lit(0)))
    return both.select("shard_id", "seg_no", "record_count", "rows_read", F.when(F.col("record_count") == F.col("rows_read"), "deliver").otherwise("quarantine").alias("action"))


def retry_schedule(batches: DataFrame, max_retries: int, base_ms: int) -> DataFrame:
    """One row per attempt of batches(batch, hint_ms): the wait before it, doubling from the base unless the sink gave
    a hint; none is over five minutes.  The wait after the last attempt precedes the stranding."""
    attempts = batches.select("batch", "hint_ms", F.explode(F.sequence(F.lit(0), F.lit(max_retries))).alias("attempt"))
    own = F.lit(base_ms).cast("long") * F.pow(F.lit(2.0), F.least("attempt", F.lit(30))).cast("long")
    return attempts.select("batch", "attempt", F.least(F.coalesce("hint_ms", own), F.lit(RETRY_CEILING_MS)).cast("long").alias("wait_ms"), (F.col("attempt") == max_retries).alias("then_strands"))


def after_cursor(segmented: DataFrame, ledger: DataFrame) -> DataFrame:
    """Records that a retry still has to send: those past the processed count of their segment in ledger."""
    order = Window.partitionBy("shard_id", "seg_no").orderBy("seq")
    numbered = segmented.withColumn("idx", F.row_number().over(order))
    both = numbered.join(ledger.select("shard_id", "seg_no", "processed"), ["shard_id", "seg_no"], "left")
    return both.filter(F.col("idx") > F.coalesce("processed", F.lit(0))).drop("processed")


def recovery_edges(health: DataFrame) -> DataFrame:
    """health(at, state): the times at which the sink came back to healthy."""
    before = F.lag("state").over(Window.orderBy("at"))
    return health.select("at", "state", before.alias("before")).filter("state = 'healthy' and before is not null and before <> 'healthy'").select("at")


def stranded_to_resume(unconfirmed: DataFrame, pending: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Unconfirmed segments that are neither pending nor in flight: re-queued when the sink is healthy again."""
    busy = pending.select("shard_id", "seg_no").union(in_flight.select("shard_id", "seg_no")).distinct()
    return unconfirmed.join(busy, ["shard_id", "seg_no"], "left_anti")


def batch_bytes(size: Column) -> Column:
    """Aggregate: bytes of a dead-letter file with payloads of these lengths."""
    return F.sum(size + RECORD_OVERHEAD) + (SEGMENT_HEADER + SENTINEL + FOOTER)


def dead_letter_gate(batches: DataFrame, cap: int) -> DataFrame:
    """batches(stream, seq, bytes): written or blocked, and the total after each.

    A batch that would bring the total over the cap blocks, unless it alone exceeds the cap: then it is written, since
    waiting could never help.  The decision depends on earlier ones, so the sizes of a stream pass one task, but as a
    sorted stream of which only the running total is kept.
    """

    def judge(sizes: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """(written, total after each) of the next batches of a stream."""
        written, at, n = np.zeros(len(sizes), bool), 0, len(sizes)
        level = total
        while at < n:
            if level + sizes[at:].min() > cap:  # only what exceeds the cap by itself is written from here on
                written[at:] = sizes[at:] > cap
                break
            sums = level + np.cumsum(sizes[at : at + 4096])
            stop = int(np.searchsorted(sums, cap, side="right"))
            written[at : at + stop] = True
            level = int(sums[stop - 1]) if stop else level
            at += stop
            if stop < len(sums):
                written[at] = sizes[at] > cap
                level += int(sizes[at]) if written[at] else 0
                at += 1
        return written, total + np.cumsum(np.where(written, sizes, 0))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, total = None, 0
        for batch in batches:
            streams, sizes = batch.column("stream").to_numpy(), batch.column("bytes").to_numpy()
            cuts = [0, *(np.flatnonzero(streams[1:] != streams[:-1]) + 1).tolist(), len(streams)]
            written, totals = np.zeros(len(sizes), bool), np.zeros(len(sizes), np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if streams[a] != stream:
                    stream, total = streams[a], 0
                written[a:b], totals[a:b] = judge(sizes[a:b], total)
                total = int(totals[b - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(written, "write", "block")), pa.array(totals)], ["stream", "seq", "bytes", "decision", "total"])

    rows = batches.select(F.col("stream").cast("long").alias("stream"), F.col("seq").cast("long").alias("seq"), F.col("bytes").cast("long").alias("bytes"))
    return rows.repartition("stream").sortWithinPartitions("stream", "seq").mapInArrow(fold, "stream long, seq long, bytes long, decision string, total long")


def block_episodes(states: DataFrame) -> DataFrame:
    """states(stream, at, state): one row per episode of being blocked, ended only by progress (state draining).

    Retrying in between is a flap: it neither ends the episode nor counts a new one.
    """
    order = Window.partitionBy("stream").orderBy("at")
    progress = F.sum(F.when(F.col("state") == "draining", 1).otherwise(0)).over(order)
    marked = states.withColumn("era", progress).filter("state = 'blocked'")
    return marked.groupBy("stream", "era").agg(F.min("at").alias("began"), F.max("at").alias("last_seen"), F.count("*").alias("observations")).drop("era")


def one_hot_states(current: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """One row per (stream, state): value 1 for the current state, 0 for the others."""
    return current.select("stream", F.explode(F.array(*map(F.lit, states))).alias("label"), "state").select("stream", "label", (F.col("label") == F.col("state")).cast("int").alias("value"))


def dedup_tokens(batched: DataFrame) -> DataFrame:
    """One token per batch: the SHA-256 of all (length as 8 bytes, payload) in order; it depends on batch bounds."""
    part = F.concat(codec.le_bytes(F.octet_length("payload"), 8), F.col("payload"))
    body = batched.groupBy("shard_id", "seg_no", "batch_no").agg(in_order(part, F.col("seq")).alias("body"))
    return body.select("shard_id", "seg_no", "batch_no", F.sha2("body", 256).alias("token"))


def drain_trace(attempts: DataFrame, max_retries: int) -> DataFrame:
    """attempts(segment, n, result): the states that a segment passes, from its scripted results ok, transient, full,
    and the first result with which it is done.  One row per attempt until it is confirmed or stranded."""
    order = Window.partitionBy("segment").orderBy("n")
    failures = F.sum(F.when(F.col("result") == "transient", 1).otherwise(0)).over(order)
    state = F.when(F.col("result") == "ok", "confirmed").when(F.col("result") == "full", "blocked").when(failures > max_retries, "stranded").otherwise("retrying")
    rows = attempts.select("*", state.alias("state"))
    ended = F.sum(F.when(F.col("state").isin("confirmed", "stranded"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("ended", F.coalesce(ended, F.lit(0))).filter("ended = 0").select("segment", "n", "result", "state")


def ndjson_batches(batched: DataFrame) -> DataFrame:
    """One body per batch: records joined by line ends; records that hold a line end are counted as rejected."""
    from ..functions.classify import has_newline

    bad = has_newline(F.col("payload"))
    rows = F.array_sort(F.collect_list(F.when(~bad, F.struct("seq", F.hex("payload").alias("h")))))
    body = F.unhex(F.array_join(F.transform(rows, lambda r: r["h"]), "0A"))
    out = batched.groupBy("shard_id", "seg_no", "batch_no").agg(F.count(F.when(~bad, 1)).alias("framed"), F.count(F.when(bad, 1)).alias("rejected"), body.alias("body"))
    return out.select("shard_id", "seg_no", "batch_no", "framed", "rejected", F.concat(F.lit("sha256:"), F.sha2("body", 256)).alias("idempotency_key"))
