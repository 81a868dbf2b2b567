import random
import zlib

import pytest
from pyspark.sql import functions as F

from siltstream.operators import faults
from siltstream.operators.drain import dead_letter_gate
from siltstream.operators.records import admit
from siltstream.sources.sinks import HttpSink, NoopSink, Sink
from siltstream.streaming.delivery import RECORDS, Delivery


def _records(spark, n, first=0):
    return spark.createDataFrame([(i, i % 5, i % 2, "sync", bytearray(b"r%d" % i)) for i in range(first, first + n)], RECORDS)


class Flaky(Sink):
    max_batch_size = 10

    def __init__(self):
        self.down = True

    def commit(self, batch):
        out = F.when(F.lit(self.down), "retry").when(F.col("seq") % 7 == 0, "rejected").otherwise("committed")
        return batch.select("*", out.alias("outcome"), F.lit(None).cast("string").alias("reason"))


def test_stream_delivers_once_through_failure_and_restart(spark, tmp_path):
    landing, folder, checkpoint = (str(tmp_path / x) for x in ("landing", "out", "ckpt"))
    _records(spark, 40).write.parquet(landing)
    sink = Flaky()
    delivery = Delivery(sink, folder)
    with pytest.raises(Exception, match="delivered again"):
        delivery.start(spark, landing, checkpoint, available_now=True).awaitTermination()
    sink.down = False
    delivery.start(spark, landing, checkpoint, available_now=True).awaitTermination()
    _records(spark, 25, 40).write.mode("append").parquet(landing)
    delivery.start(spark, landing, checkpoint, available_now=True).awaitTermination()
    delivered = spark.read.parquet(f"{folder}/delivered")
    dead = spark.read.parquet(f"{folder}/dead_letter")
    assert sorted(r.seq for r in delivered.collect()) == [i for i in range(65) if i % 7]
    assert sorted(r.seq for r in dead.collect()) == [i for i in range(65) if i % 7 == 0]
    assert delivered.groupBy("epoch", "shard_id", "batch_no").count().agg(F.max("count")).first()[0] <= 10
    # a replay of a micro-batch that the ledger holds does nothing
    delivery.process(_records(spark, 40), 0)
    assert spark.read.parquet(f"{folder}/delivered").count() == delivered.count()
    sink.max_batch_size = 11
    with pytest.raises(ValueError, match="batch size"):
        delivery.process(_records(spark, 40), 0)


def test_http_sink_by_record_and_by_lines(spark):
    rows = _records(spark, 6).union(spark.createDataFrame([(6, 1, 0, "sync", bytearray(b"a\nb"))], RECORDS))
    status = lambda body, key: 503 if b"r3" in body else 404 if b"r4" in body else 200
    out = {r.seq: (r.outcome, r.reason) for r in HttpSink(status).commit(rows).collect()}
    assert out[0][0] == "committed" and out[3] == ("retry", "status 503") and out[4] == ("rejected", "status 404")
    lines = {r.seq: r.outcome for r in HttpSink(lambda body, key: 200, lines=True).commit(rows).collect()}
    assert lines[6] == "rejected" and lines[0] == "committed"


def test_noop_accepts_all(spark):
    assert {r.outcome for r in NoopSink().commit(_records(spark, 3)).collect()} == {"committed"}


def test_gate_writes_a_batch_that_alone_exceeds_the_cap(spark):
    rows = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 500), (1, 4, 1)], "stream long, seq long, bytes long")
    assert [r.decision for r in dead_letter_gate(rows, 100).orderBy("seq").collect()] == ["write", "block", "write", "block"]


def test_generator_and_invariants(spark):
    assert faults.splitmix(0, 2) == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]
    a = spark.createDataFrame([("x",), ("y",)], "payload_hash string")
    assert faults.false_acks(a, a).count() == 0
    assert [r.payload_hash for r in faults.false_acks(a, a.filter("payload_hash = 'x'")).collect()] == ["y"]


def test_gate_equals_a_fold_over_each_stream(spark):
    r = random.Random(2)
    rows = [(s, i, r.choice([0, 1, 5, 40, 300, 2000])) for s in range(4) for i in range(r.choice([1, 50, 9000]))]
    want, total = [], {}
    for s, i, size in sorted(rows):
        write = total.get(s, 0) + size <= 1000 or size > 1000
        total[s] = total.get(s, 0) + (size if write else 0)
        want.append((s, i, size, "write" if write else "block", total[s]))
    out = dead_letter_gate(spark.createDataFrame(rows, "stream long, seq long, bytes long"), 1000)
    assert sorted(tuple(x) for x in out.collect()) == want


def test_frames_that_have_not_come_whole_are_not_judged(spark):
    whole = bytes.fromhex("57454952" + "01010100" + "03000000")  # magic; version, push, sync, no flags; length
    whole += zlib.crc32(whole).to_bytes(4, "little")
    frames = [bytearray((whole + b"abc" + zlib.crc32(b"abc").to_bytes(4, "little"))[:n]) for n in range(24)]
    out = admit(spark.createDataFrame([(f,) for f in frames], "frame binary"))
    assert [(len(x.frame), x.nack_reason, x.kind) for x in out.collect()] == [(23, None, "push")]
