"""The seven fault scenarios over made-up records: what was acknowledged is durable, in order, once recovered."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstream.operators import faults as X
from siltstream.operators import recovery as V
from siltstream.operators import segments as S
from siltstream.sources import segment_files as W
from siltstream.sources.sinks import NoopSink
from siltstream.streaming.delivery import RECORDS, Delivery

SEEDS = [1, 42]


def _records(spark, seed, n=120):
    """Records of five connections, in an order that the seed draws."""
    draws = X.splitmix(seed, n)
    return spark.createDataFrame([(i, d % 5, d % 2, "sync", bytearray(f"{seed}-{i}-{d}".encode())) for i, d in enumerate(draws)], RECORDS)


def _hashes(rows):
    return rows.select("shard_id", F.sha2("payload", 256).alias("payload_hash"))


def _files(records):
    return W.segment_bytes(S.rotate(records, 600))


def _recovered(files):
    return _hashes(W.scan_segments(files, "shard_id", "seg_no").filter("error is null"))


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize(("kind", "nth"), [("fsync", 1), ("fsync", 3), ("short_write", 25), ("none", 0)])
def test_flush_acknowledges_only_what_is_durable(spark, seed, kind, nth):
    batch = F.floor(F.col("seq") / 20).cast("long")
    last = F.max("seg_no").over(Window.partitionBy("shard_id", "batch"))
    rows = S.rotate(_records(spark, seed), 600).withColumn("batch", batch).withColumn("rotated", F.col("seg_no") < last)
    broken = rows.filter(F.col("seq") == nth).select(F.col("shard_id").alias("s"), F.col("seg_no").alias("g"), F.col("seq").alias("at")) if kind == "short_write" else rows.limit(0).select(F.col("shard_id").alias("s"), F.col("seg_no").alias("g"), F.col("seq").alias("at"))
    rows = rows.join(broken, (F.col("shard_id") == F.col("s")) & (F.col("seg_no") == F.col("g")), "left").withColumn("dropped", F.col("g").isNotNull())
    rows = rows.withColumn("rotated", F.col("rotated") & ~F.col("dropped"))
    failed = spark.createDataFrame([(nth,)] if kind == "fsync" else [], "batch long")
    acks = X.group_acks(rows.select("batch", "seq", "rotated", "dropped"), failed)
    acked = rows.join(acks, ["batch", "seq"]).filter("acked")
    durable = rows.join(failed.withColumn("bad", F.lit(True)), "batch", "left").filter("not dropped and (rotated or bad is null)")
    assert X.false_acks(_hashes(acked), _hashes(durable)).count() == 0
    n = acked.count()
    assert n == 120 if kind == "none" else 0 < n < 120


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("left_out", [0, S.FOOTER + S.SENTINEL, S.FOOTER])
def test_a_crash_at_the_seal_loses_nothing(spark, seed, left_out):
    """The rename never came (whole file), or the sentinel and footer (or the footer) were not written."""
    records = _records(spark, seed)
    files = _files(records).withColumn("data", F.expr(f"substring(data, 1, octet_length(data) - {left_out})"))
    assert X.recovered_difference(_recovered(files), _hashes(records)).count() == 0
    verdicts = {r.verdict for r in W.verify_segments(files, "shard_id", "seg_no").collect()}
    assert verdicts == {{0: "ok", S.FOOTER: "MissingFooter"}.get(left_out, "NoSentinel")}


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("index", [0, 3])
def test_a_flipped_byte_keeps_the_prefix_and_a_copy(spark, seed, index):
    files = _files(_records(spark, seed))
    whole = W.scan_segments(files, "shard_id", "seg_no")
    before = Window.partitionBy("shard_id", "seg_no").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("payload") + S.RECORD_OVERHEAD).over(before), F.lit(0)) + S.SEGMENT_HEADER + S.RECORD_OVERHEAD
    spots = whole.select("shard_id", "seg_no", "idx", at.alias("at")).filter(F.col("idx") == index).drop("idx")
    text = F.hex("data")
    flipped = F.concat(F.expr("substring(hex(data), 1, 2 * at)"), F.when(F.expr("substring(hex(data), 2 * at + 1, 2)") == "FF", "00").otherwise("FF"), F.expr("substring(hex(data), 2 * at + 3)"))
    damaged = files.join(spots, ["shard_id", "seg_no"]).select("shard_id", "seg_no", F.unhex(flipped).alias("data"), text.alias("was"))
    found = W.verify_segments(damaged, "shard_id", "seg_no")
    assert {(r.records, r.fault) for r in found.collect()} == {(index, "crc_mismatch")}
    actions = {c: {r.a for r in found.select(V.recovery_class(F.col("fault"), F.col("trailing"), F.lit(c)).alias("a")).collect()} for c in (True, False)}
    assert actions[True] == {"copy_and_truncate"} and actions[False] != {"copy_and_truncate"}
    good = W.scan_segments(damaged, "shard_id", "seg_no").filter("error is null").select("shard_id", "seg_no", "idx", "payload")
    assert good.exceptAll(whole.select("shard_id", "seg_no", "idx", "payload")).count() == 0


class Panicking(NoopSink):
    max_batch_size = 10

    def __init__(self, times):
        self.left = times

    def commit(self, batch):
        if self.left:
            self.left -= 1
            raise ZeroDivisionError("panic at the barrier")
        return super().commit(batch)


def test_a_panic_acknowledges_nothing_and_a_restart_delivers_all(spark, tmp_path):
    delivery = Delivery(Panicking(2), str(tmp_path))
    records = _records(spark, 5)
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            delivery.process(records, 0)
        assert delivery.ledger(spark).count() == 0 and not (tmp_path / "delivered").exists()
    delivery.process(records, 0)
    assert spark.read.parquet(str(tmp_path / "delivered")).count() == 120


@pytest.mark.parametrize("seed", SEEDS)
def test_interleaved_producers_keep_their_order(spark, seed):
    rows = S.rotate(_records(spark, seed), 600)
    place = F.row_number().over(Window.partitionBy("shard_id").orderBy("seg_no", "seq"))
    placed = rows.select((F.col("conn_id") * 2 + F.col("shard_id")).alias("conn_id"), "seq", place.alias("pos"))
    assert X.order_violations(placed).count() == 0
    assert X.order_violations(placed.withColumn("pos", -F.col("pos"))).count() > 0


def test_a_supervisor_gives_up_in_virtual_time(spark, tmp_path):
    class Down(NoopSink):
        def commit(self, batch):
            return batch.select("*", F.lit("retry").alias("outcome"), F.lit(None).cast("string").alias("reason"))

    clock = []
    with pytest.raises(RuntimeError, match="delivered again"):
        Delivery(Down(), str(tmp_path), max_retries=9, base_ms=1000, sleep=clock.append).process(_records(spark, 1, 4), 0)
    assert len(clock) == 10 and sum(clock) == 1 + 2 + 4 + 8 + 16 + 32 + 64 + 128 + 256 + 300
