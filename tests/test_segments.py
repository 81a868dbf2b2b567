import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstream.operators import segments as S
from siltstream.sources import segment_files as W


def _brute(sizes, limit):
    out, number, filled = [], 0, S.SEGMENT_HEADER
    for size in sizes:
        filled += size + S.RECORD_OVERHEAD
        out.append(number)
        if filled >= limit:
            number, filled = number + 1, S.SEGMENT_HEADER
    return out


@pytest.mark.parametrize("chunk", [1, 3, 17, 1000])
def test_rotation_over_chunks_equals_one_pass(spark, chunk):
    r = random.Random(chunk)
    shards = {s: [r.choice([1, 5, 40, 300]) for _ in range(r.randint(1, 60))] for s in range(4)}
    rows = [(s, i * 4 + s, bytearray(n)) for s, sizes in shards.items() for i, n in enumerate(sizes)]
    got = S.rotate(spark.createDataFrame(rows, "shard_id long, seq long, payload binary"), 200, chunk_records=chunk).orderBy("shard_id", "seq").collect()
    for s, sizes in shards.items():
        assert [x.seg_no for x in got if x.shard_id == s] == _brute(sizes, 200)


def test_published_compression_ratio(spark):
    records = spark.range(5000).select(F.lit(0).cast("long").alias("shard_id"), F.col("id").alias("seq"), F.encode(F.repeat(F.lit("x"), 256), "utf-8").alias("payload"))
    counts = S.rotate(records, 65_536, chunk_records=700).groupBy("seg_no", "sealed").count().collect()
    assert sorted(c["count"] for c in counts if c.sealed) == [249] * 20
    assert [c["count"] for c in counts if not c.sealed] == [20]


def test_rotation_of_nothing(spark):
    assert S.rotate(spark.createDataFrame([], "shard_id long, seq long, payload binary"), 100).count() == 0


def test_segment_files_round_trip_and_refuse_overwrite(spark, tmp_path):
    spark.dataSource.register(W.SegmentDataSource)
    rows = spark.createDataFrame([(0, i, bytearray(b"p%d" % i)) for i in range(30)], "shard_id long, seq long, payload binary")
    files = W.segment_bytes(S.rotate(rows, 120).filter("sealed"))
    files.write.format("siltsegments").option("path", str(tmp_path)).mode("append").save()
    back = W.scan_segments(W.read_segments(spark, str(tmp_path)), "path").orderBy("path", "idx").collect()
    sealed = S.rotate(rows, 120).filter("sealed").orderBy("seq").collect()
    assert [r.payload for r in back] == [r.payload for r in sealed]
    assert {r.verdict for r in W.verify_segments(W.read_segments(spark, str(tmp_path)), "path").collect()} == {"ok"}
    assert W.list_segments(spark, str(tmp_path)).count() == files.count()
    with pytest.raises(Exception, match="FileExistsError|exists"):
        files.write.format("siltsegments").option("path", str(tmp_path)).mode("append").save()


def test_any_bytes_scan_without_error():
    r = random.Random(1)
    good = W._MAGIC + b"\x01" + bytes(19)
    for _ in range(500):
        found = W.scan_segment((good if r.random() < 0.7 else b"") + bytes(r.choices(range(4), k=r.randint(0, 60))))
        assert found.verdict and found.fault


def test_damage_changes_files_whatever_they_hold(spark, monkeypatch):
    """The first payload byte is FF, the file checksum of segment 6 ends in FF, segment 7 counts 255 records, segment 8 holds 256 bytes."""
    from siltstream.plans import segment_queries as Q

    def checksum(payload):
        record = len(payload).to_bytes(4, "little") + zlib.crc32(payload).to_bytes(4, "little") + payload
        return zlib.crc32(W._MAGIC + b"\x01" + bytes(19) + record)

    ends_in_ff = next(p for p in (b"\xff%d" % i for i in range(10_000)) if checksum(p) >> 24 == 255)
    payloads = {k: [b"\xffabc"] * 3 for k in range(10)} | {6: [ends_in_ff], 7: [b"\xff"] * 255, 8: [b"\xff" * 128] * 2}
    rows = [(0, k, i, bytearray(p)) for k, ps in payloads.items() for i, p in enumerate(ps)]
    segmented = spark.createDataFrame(rows, "shard_id long, seg_no long, seq long, payload binary")
    monkeypatch.setattr(Q, "_files", lambda *_: W.segment_bytes(segmented))
    verdicts = ["ok", "TooShort", "Header", "NoSentinel", "BadRecord", "MissingFooter", "CrcMismatch", "FooterMismatch(count)", "FooterMismatch(bytes)", "TrailingBytes"]
    want = [(0, k, verdicts[k], 0 if k in (1, 2, 4) else len(payloads[k])) for k in range(10)]
    assert sorted(map(tuple, Q.segment_verify(spark, "").collect())) == want


def test_few_records_can_end_a_large_segment():
    r = np.random.default_rng(3)
    sizes = r.integers(100, 272, 3_000_000)
    sums = np.cumsum(sizes)
    limit = 256 << 20  # the default of the format; 3 million records are two segments
    found = S.possible_seals(sums, limit - S.SEGMENT_HEADER, int(sizes.max()))
    assert 0 < found.sum() < 10
    ends, last = [], 0
    while (at := int(np.searchsorted(sums, last + limit - S.SEGMENT_HEADER))) < len(sums):
        last = int(sums[at])
        ends.append(at)
    assert ends and found[ends].all()


@pytest.mark.parametrize(("chunk", "top"), [(1, 900), (7, 90_000), (500, 90_000), (200_000, 5)])
def test_smoothed_latency_over_chunks_equals_one_fold(spark, chunk, top):
    r = random.Random(chunk)
    rows = [(s, i * 3 + s, r.randint(0, top)) for s in range(3) for i in range(r.choice([1, 80, 1500]))]
    want = {}
    for s, _, x in sorted(rows):
        want[s] = want.get(s, 77) * 3 // 4 + x // 4
    out = S.smoothed_sync_latency(spark.createDataFrame(rows, "shard_id long, seq long, sample_us long"), start_us=77, chunk_records=chunk)
    assert {x.shard_id: x.raw_us for x in out.collect()} == want
