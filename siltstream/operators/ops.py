"""Operator reports: segment accounting, dead letters, metric summaries and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import segment_state


def segment_accounting(files: DataFrame) -> DataFrame:
    """files(shard, name, size): counts by state and bytes for each folder but dead_letter, and a total row.

    A quarantine folder counts as a shard here, unlike in replay and byte counts.  Confirmations have no bytes.
    """
    state = segment_state(F.col("name"))
    rows = files.filter(F.col("shard") != "dead_letter").select("shard", state.alias("state"), "size")
    count = lambda s: F.count(F.when(F.col("state") == s, 1))
    size = F.coalesce(F.sum(F.when(F.col("state").isin("active", "sealed"), F.col("size"))), F.lit(0))
    out = rows.rollup("shard").agg(count("active").alias("active"), count("sealed").alias("sealed"), count("confirmed").alias("confirmed"), size.alias("bytes"), F.grouping("shard").alias("g"))
    return out.select(F.when(F.col("g") == 1, "total").otherwise(F.col("shard")).alias("shard"), "active", "sealed", "confirmed", "bytes")


def dead_letter_list(files: DataFrame) -> DataFrame:
    """Sealed and active dead-letter files by name."""
    own = files.filter((F.col("shard") == "dead_letter") & F.col("name").rlike(r"\Adl_.*\.wab(?:\.sealed)?\z"))
    return own.select("name", "size").orderBy("name")


def requeue_plan(records: DataFrame) -> DataFrame:
    """records(segment, seq, sealed, has_sentinel, crc_ok): per segment whether all of it can be sent again.

    Only sealed segments; one bad record or a missing sentinel skips the whole segment.
    """
    per = records.filter("sealed").groupBy("segment").agg(F.bool_and("crc_ok").alias("good"), F.bool_and("has_sentinel").alias("ended"), F.count("*").alias("records"))
    return per.select("segment", "records", F.when(F.col("good") & F.col("ended"), "requeue").otherwise("skip").alias("action"))


def metrics_summary(samples: DataFrame, prefix: str = "") -> DataFrame:
    """One row from samples(metric, label, value): sums of counters, plain gauges, mean sync time, active labels."""
    total = lambda name: F.coalesce(F.sum(F.when(F.col("metric").startswith(prefix + name), F.col("value"))), F.lit(0.0)).cast("long")
    gauge = lambda name: F.coalesce(F.max(F.when((F.col("metric") == prefix + name) & F.col("label").isNull(), F.col("value"))), F.lit(0.0))
    active = lambda name: F.coalesce(F.min(F.when((F.col("metric") == prefix + name) & (F.col("value") == 1.0), F.col("label"))), F.lit("?"))
    sync_n = gauge("sync_seconds_count")
    return samples.agg(
        total("records_accepted_total").alias("accepted"),
        total("records_ack_total").alias("ack"),
        total("records_nack_total").alias("nack"),
        F.when(sync_n > 0, gauge("sync_seconds_sum") / sync_n * 1000).otherwise(F.lit(0.0)).alias("sync_avg_ms"),
        gauge("queue_depth").cast("long").alias("queue_depth"),
        gauge("flusher_panics_total").cast("long").alias("flusher_panics"),
        gauge("sync_failures_total").cast("long").alias("sync_failures"),
        active("sink_health").alias("sink_health"),
        active("sink_info").alias("sink_type"),
    )


def summary_warnings(summary: DataFrame) -> DataFrame:
    """One row per warning of a summary, in order of priority."""
    names = F.array(
        F.when(F.col("sink_type") == "noop", "records_discarded"),
        F.when(F.col("flusher_panics") > 0, "shard_offline"),
        F.when(F.col("sync_failures") > 0, "durability_hazard"),
        F.when(F.col("nack") > 0, "records_nacked"),
    )
    return summary.select(F.posexplode(names).alias("priority", "warning")).filter("warning is not null")
