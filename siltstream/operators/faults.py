"""Invariants of the fault model: what was acknowledged is durable, in order, once recovered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def false_acks(acked: DataFrame, durable: DataFrame) -> DataFrame:
    """Acknowledged records that aren't durable; must be empty."""
    return acked.join(durable.select("payload_hash").distinct(), "payload_hash", "left_anti")


def order_violations(stored: DataFrame) -> DataFrame:
    """stored(conn_id, seq, pos): records of a connection that are stored before an earlier one."""
    before = F.lag("pos").over(Window.partitionBy("conn_id").orderBy("seq"))
    return stored.select("conn_id", "seq", "pos", before.alias("before")).filter("pos < before").select("conn_id", "seq", "pos")


def recovered_difference(recovered: DataFrame, acked: DataFrame) -> DataFrame:
    """Records on one side only, with the side; empty if recovery gave exactly what was acknowledged."""
    lost = acked.exceptAll(recovered).withColumn("side", F.lit("lost"))
    return lost.unionByName(recovered.exceptAll(acked).withColumn("side", F.lit("extra")))


def session_counters(samples: DataFrame) -> DataFrame:
    """Sessions (a counter that falls starts a new one) in which more was acknowledged than accepted."""
    order = Window.partitionBy("instance").orderBy("ts_s")
    fell = F.coalesce((F.col("accepted") < F.lag("accepted").over(order)).cast("int"), F.lit(0))
    sessions = samples.select("*", fell.alias("fell")).withColumn("session", F.sum("fell").over(order))
    last = sessions.groupBy("instance", "session").agg(F.max("accepted").alias("accepted"), F.max("acked").alias("acked"))
    return last.filter("acked > accepted")


def group_acks(writes: DataFrame, faults: DataFrame) -> DataFrame:
    """Ack of each record of writes(batch, seq, rotated, dropped) when the group sync of its batch fails or not.

    Records of a segment that rotated within the batch are durable by its seal; those of a segment that was dropped
    after a short write are refused; the rest share the fate of one sync.  faults(batch): batches whose sync failed.
    """
    failed = faults.select("batch").distinct().withColumn("sync_failed", F.lit(True))
    both = writes.join(failed, "batch", "left")
    ack = F.when(F.col("rotated"), True).when(F.col("dropped"), False).otherwise(~F.coalesce("sync_failed", F.lit(False)))
    return both.select("batch", "seq", ack.alias("acked"))


def splitmix(seed: int, n: int) -> list[int]:
    """The first n numbers of the generator that drives the simulations."""
    mask, out = (1 << 64) - 1, []
    for _ in range(n):
        seed = (seed + 0x9E3779B97F4A7C15) & mask
        z = seed
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & mask
        out.append(z ^ (z >> 31))
    return out
