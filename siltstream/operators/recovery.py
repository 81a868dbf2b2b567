"""Recovery, replay and confirmation: what is still to be delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import segment_state

RESERVED = ("quarantine", "dead_letter")


def recovery_class(fault: Column, trailing: Column, copied: Column) -> Column:
    """What becomes of an open segment: seal, truncate, truncate after a quarantine copy, quarantine, or left untouched.

    fault: none, bad_header, torn_tail, crc_mismatch or oversize; trailing: bytes after the fault; copied: whether the
    quarantine copy worked.
    """
    corrupt = (fault == "crc_mismatch") | ((fault == "oversize") & (trailing > 0))
    return (
        F.when(fault == "bad_header", "quarantine")
        .when(corrupt & ~copied, "untouched")
        .when(corrupt, "copy_and_truncate")
        .when(fault == "none", "seal")
        .otherwise("truncate")
    )


def unconfirmed(sealed: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Sealed segments (shard_id, seg_no, ...) without a confirmation, in order of shard and counter."""
    return sealed.join(confirmed.select("shard_id", "seg_no").distinct(), ["shard_id", "seg_no"], "left_anti")


def replay_counts(sealed: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Segments and records to replay in each shard; an unreadable footer (null) counts no records."""
    return unconfirmed(sealed, confirmed).groupBy("shard_id").agg(F.count("*").alias("segments"), F.sum(F.coalesce("record_count", F.lit(0))).alias("records"))


def confirmed_state(sealed: DataFrame, sidecars: DataFrame) -> DataFrame:
    """replay without a sidecar, skip with a valid one, quarantine (both files) with an invalid one.

    sidecars(shard_id, seg_no, verdict).
    """
    both = sealed.select("shard_id", "seg_no").join(sidecars.select("shard_id", "seg_no", "verdict"), ["shard_id", "seg_no"], "left")
    return both.select("shard_id", "seg_no", F.when(F.col("verdict").isNull(), "replay").when(F.col("verdict") == "ok", "skip").otherwise("quarantine").alias("action"))


def quarantine_names(files: DataFrame) -> DataFrame:
    """files(shard, name, arrival): <shard>__<name>, then with .1, .2 and so on in order of arrival."""
    base = F.concat(F.col("shard"), F.lit("__"), F.col("name"))
    nth = F.row_number().over(Window.partitionBy("shard", "name").orderBy("arrival")) - 1
    return files.select("shard", "name", "arrival", F.when(nth == 0, base).otherwise(F.concat(base, F.lit("."), nth.cast("string"))).alias("target"))


def mode_audit(files: DataFrame, wanted: int = 0o600) -> DataFrame:
    """Files by mode where it isn't the wanted one: a warning, never a refusal."""
    return files.filter(F.col("mode") != wanted).groupBy("mode").agg(F.count("*").alias("files"))


def bytes_on_disk(files: DataFrame) -> DataFrame:
    """files(shard, name, size): bytes of active and sealed segments outside the reserved folders."""
    counted = files.filter(~F.col("shard").isin(*RESERVED)).filter(segment_state(F.col("name")).isin("active", "sealed"))
    return counted.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
