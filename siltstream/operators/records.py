"""The record table, the one contract between operators, and its admission and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec

SHARDS = 4


def records_of_events(events: DataFrame, shards: int = SHARDS) -> DataFrame:
    """records(seq, conn_id, shard_id, tier, payload) from an event table."""
    third = F.pmod(F.col("event_id"), F.lit(3))
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("conn_id"),
        shard_route(F.col("user_id"), shards).alias("shard_id"),
        F.when(third == 0, "sync").when(third == 1, "batched").otherwise("buffered").alias("tier"),
        F.encode(F.concat_ws("|", "event_id", "user_id", "event_type", "props"), "utf-8").alias("payload"),
    )


def shard_route(connection: Column, shards: int) -> Column:
    """The shard that a connection is pinned to."""
    return F.pmod(connection, F.lit(shards)).cast("long")


def worker_route(shard: Column, workers: int) -> Column:
    return F.pmod(shard, F.lit(workers)).cast("long")


def queue_capacity(workers: int, total: int = 65_536) -> int:
    """Capacity of one worker's queue; the total is split evenly."""
    return max(total // max(workers, 1), 1)


def peer_uid_filter(connections: DataFrame, uid: int, uid_col: str = "peer_uid") -> DataFrame:
    """Keep connections of the daemon's own uid; a failed lookup (null) is a rejection."""
    return connections.filter(F.col(uid_col).eqNullSafe(F.lit(uid)))


def admit(frames: DataFrame, frame_col: str = "frame", max_payload: int = codec.MAX_PAYLOAD) -> DataFrame:
    """Add ``nack_reason`` (null = accepted), ``tier`` and ``kind`` to frames.

    The daemon reads a header first, so the order differs from decoding a whole buffer: header errors, then the cap,
    then an empty push, then the payload CRC, then message types that a client must not send.  Frames of which not all
    bytes that this takes have come are not judged yet and left out.
    """
    data = F.col(frame_col)
    # The header is read in a generator: Catalyst would copy columns of a projection into the filter below, and what
    # they read from into them.
    read = F.struct(
        codec.le_number(data, 6, 1).alias("kind"), codec.le_number(data, 7, 1).alias("tier"), codec.le_number(data, 9, 4).alias("length"), codec.header_verdict(data).alias("verdict")
    )
    read = frames.select("*", F.explode(F.when(F.octet_length(data) >= codec.HEADER_BYTES, F.array(read))).alias("_h"))
    length, kind, verdict = F.col("_h.length"), F.col("_h.kind"), F.col("_h.verdict")
    payload = F.substring(data, F.lit(codec.HEADER_BYTES + 1), length.cast("int"))
    crc = codec.le_number(data, (length + codec.HEADER_BYTES + 1).cast("int"), 4)
    push, health = codec.MESSAGE_TYPES["push"], codec.MESSAGE_TYPES["health_check"]
    reason = (
        F.when(verdict != "ok", codec.verdict_nack(verdict))
        .when(length > min(max_payload, codec.MAX_PAYLOAD), "payload_too_large")
        .when((length == 0) & (kind == push), "empty_payload")
        .when(crc != F.crc32(payload), "bad_payload_crc")
        .when(~kind.isin(push, health), "unknown_message")
    )
    by_header = (verdict != "ok") | (length > min(max_payload, codec.MAX_PAYLOAD)) | ((length == 0) & (kind == push))
    read = read.filter(by_header | (F.octet_length(data) >= length + codec.HEADER_BYTES + 4))
    judged = read.select("*", reason.alias("nack_reason"))
    tier = F.when((verdict != "ok") | F.coalesce(F.col("nack_reason") == "unknown_message", F.lit(False)), "sync").otherwise(_tier_name(F.col("_h.tier")))
    return judged.select(*frames.columns, "nack_reason", tier.alias("tier"), F.when(kind == push, "push").when(kind == health, "health_check").alias("kind"))


def _tier_name(number: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, n in codec.DURABILITIES.items():
        out = F.when(number == n, name).otherwise(out)
    return out


def nacks_by_reason(admitted: DataFrame) -> DataFrame:
    """Counts by tier and reason; header errors count under tier sync."""
    # Accepted frames go after the count: a filter below it would repeat the whole admission expression.
    return admitted.groupBy("tier", F.col("nack_reason").alias("reason")).agg(F.count("nack_reason").alias("n")).filter("n > 0")


def idle_drops(phases: DataFrame, limit_ms: int = 30_000) -> DataFrame:
    """Connections dropped in a read phase (header, payload, crc) that took longer than the deadline: the first one."""
    late = F.when(F.col("header_ms") > limit_ms, "header").when(F.col("payload_ms") > limit_ms, "payload").when(F.col("crc_ms") > limit_ms, "crc")
    return phases.select("*", late.alias("dropped_in")).filter("dropped_in is not null")
