"""Retries, keys, the dead-letter gate and the sinks that write elsewhere."""

import hashlib
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from siltstream.operators.segments import RECORD_OVERHEAD
from siltstream.sources.sinks import ClickHouseSink, HttpSink, JdbcSink, NoopSink, ParquetSink
from siltstream.streaming.delivery import RECORDS, DeadLettersFull, Delivery


def _records(spark, n, first=0, shards=2):
    return spark.createDataFrame([(i, i % 5, i % shards, "sync", bytearray(b"r%d" % i)) for i in range(first, first + n)], RECORDS)


def _logging(path, status=200, fail_first=0, after=None):
    """A receiver that notes each request in a folder, and fails the first ones of each key."""

    def send(body, key):
        name = os.path.join(path, key.replace(":", "-"))
        seen = len([x for x in os.listdir(path) if x.startswith(os.path.basename(name))])
        with open(f"{name}.{seen}", "wb") as out:
            out.write(body)
        return (503, after) if seen < fail_first else status

    return send


def _requests(path):
    return [(n.partition(".")[0], (path / n).read_bytes()) for n in sorted(os.listdir(path))]


def test_a_whole_batch_is_one_request_with_the_same_key_on_replay(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    sink = HttpSink(_logging(str(log)), lines=True)
    sink.max_batch_size = 4
    rows = _records(spark, 20).repartition(7)
    Delivery(sink, str(tmp_path / "a")).process(rows, 0)
    first = _requests(log)
    Delivery(sink, str(tmp_path / "b")).process(rows.repartition(3), 0)
    assert sorted({k for k, _ in _requests(log)}) == sorted({k for k, _ in first}) and len(first) == 6 and len(_requests(log)) == 12
    assert sorted(b for _, b in first)[0] == b"r0\nr2\nr4\nr6"
    assert {k for k, _ in first} == {"sha256-" + hashlib.sha256(b).hexdigest() for _, b in first}


def test_retries_wait_and_skip_what_is_through(spark, tmp_path):
    log, waits = tmp_path / "log", []
    log.mkdir()
    bad = _logging(str(log), fail_first=2, after=7)
    fine = _logging(str(log))
    sink = HttpSink(lambda body, key: bad(body, key) if b"r3" in body else fine(body, key), lines=True)
    sink.max_batch_size = 2
    Delivery(sink, str(tmp_path / "out"), sleep=waits.append).process(_records(spark, 12), 0)
    assert waits == [7.0, 7.0]
    counts = sorted([b for _, b in _requests(log)].count(x) for x in {b for _, b in _requests(log)})
    assert counts == [1, 1, 1, 1, 1, 3]
    assert spark.read.parquet(str(tmp_path / "out/delivered")).count() == 12
    assert not (tmp_path / "out/_work").exists() or not os.listdir(tmp_path / "out/_work")


def test_waits_double_and_the_last_failure_strands(spark, tmp_path):
    waits = []
    delivery = Delivery(HttpSink(lambda body, key: 500), str(tmp_path), max_retries=4, base_ms=100_000, sleep=waits.append)
    with pytest.raises(RuntimeError, match="delivered again"):
        delivery.process(_records(spark, 3), 5)
    assert waits == [100.0, 200.0, 300.0, 300.0, 300.0]
    assert delivery.ledger(spark).count() == 0
    delivery.sink = NoopSink()
    delivery.process(_records(spark, 3), 5)
    assert delivery.ledger(spark).agg(F.sum("records")).first()[0] == 3


def test_dead_letters_block_at_the_cap_and_are_dropped(spark, tmp_path):
    sink = HttpSink(lambda body, key: 404)
    delivery = Delivery(sink, str(tmp_path), dead_letter_cap=150)
    delivery.process(_records(spark, 4), 0)  # 60 bytes and 4 records of 2 bytes
    held = 60 + 4 * (2 + RECORD_OVERHEAD)
    with pytest.raises(DeadLettersFull, match=f"{held} bytes"):
        delivery.process(_records(spark, 4), 1)
    delivery.process(_records(spark, 40), 2)  # alone above the cap: waiting would never help
    assert delivery.drop_dead_letters(spark, before_epoch=2) == [0] and delivery.dead_letters(spark).count() == 44
    assert delivery.drop_dead_letters(spark, before_epoch=3, dry_run=False) == [0, 2]
    delivery.process(_records(spark, 4), 1)
    assert delivery.dead_letters(spark).count() == 4


def test_requests_of_single_records_fly_together(spark, tmp_path):
    def send(body, key):
        with open(tmp_path / f"{time.monotonic_ns()}-{threading.get_ident()}", "w") as out:
            out.write("x")
        time.sleep(0.05)
        return 200 if body != b"r7" else (429, 5000)

    out = HttpSink(send, concurrency=4).commit(_records(spark, 16).coalesce(1)).collect()
    assert [r.seq for r in out] == list(range(16)) and {r.seq for r in out if r.outcome == "retry"} == {7}
    assert all(r.retry_after is None for r in out)  # beyond an hour
    assert len({n.split("-")[1] for n in os.listdir(tmp_path)}) == 4


def test_clickhouse_rows_and_token(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    sink = ClickHouseSink(_logging(str(log)), "db.events")
    assert sink.statement == "INSERT INTO db.events (payload) FORMAT RowBinary"
    rows = spark.createDataFrame([(0, 0, 0, "sync", bytearray(b"a\nb")), (1, 0, 0, "sync", bytearray(b"x" * 300)), (2, 0, 0, "sync", bytearray())], RECORDS)
    Delivery(sink, str(tmp_path / "out")).process(rows, 0)
    ((token, body),) = _requests(log)
    assert body == b"\x03a\nb" + b"\xac\x02" + b"x" * 300 + b"\x00"
    assert token == hashlib.sha256(b"".join(len(p).to_bytes(8, "little") + p for p in (b"a\nb", b"x" * 300, b""))).hexdigest()
    with pytest.raises(ValueError, match="identifier"):
        ClickHouseSink(int, "t; drop")


def test_parquet_replay_replaces(spark, tmp_path):
    delivery = Delivery(ParquetSink(str(tmp_path / "t")), str(tmp_path / "out"))
    delivery.process(_records(spark, 5), 0)
    delivery.process(_records(spark, 3, 5), 1)
    Delivery(ParquetSink(str(tmp_path / "t")), str(tmp_path / "lost")).process(_records(spark, 5), 0)  # the ledger was lost
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "t")).collect()) == list(range(8))


def test_jdbc_ignores_duplicates_in_the_database(spark):
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    try:
        spark._jvm.java.lang.Class.forName(driver)
    except Exception:
        pytest.skip("no embedded database here")
    url = "jdbc:derby:memory:silt;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    connection.createStatement().execute("CREATE TABLE t (payload VARCHAR(100) FOR BIT DATA)")
    sink = JdbcSink(url, "t", ignore_duplicates=True)
    sink.commit(_records(spark, 5))
    sink.commit(_records(spark, 8).union(_records(spark, 2)))
    got = connection.createStatement().executeQuery("SELECT COUNT(*), COUNT(DISTINCT payload) FROM t")
    got.next()
    assert (got.getInt(1), got.getInt(2)) == (8, 8)
    with pytest.raises(ValueError, match="identifier"):
        JdbcSink(url, "t WHERE 1=1")
