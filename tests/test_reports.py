"""Reports over every event, and not over a first few."""

from pyspark.sql import functions as F

import __spark_entry__ as e

from oracle import SF, connect


def test_summaries_read_the_whole_table(spark):
    con = connect()
    sums = con.sql("SELECT " + ", ".join(f"CAST(sum(event_id % 1000) FILTER (event_id % 10 = {k}) AS BIGINT)" for k in range(3)) + " FROM events").fetchall()[0]
    row = e.queries()["metrics_summary_all"](spark, SF).first()
    assert (row.accepted, row.ack, row.nack) == sums
    assert con.sql("SELECT count(*) FROM events WHERE event_id >= 60").fetchall()[0][0] > 0
    assert "event_id < 60" not in e.oracle_sql()["metrics_summary_all"] + e.oracle_sql()["summary_warnings_all"]
    assert {r.warning for r in e.queries()["summary_warnings_all"](spark, SF).collect()} == {"records_discarded", "shard_offline", "durability_hazard", "records_nacked"}


def test_printed_numbers_round_as_their_binary_values(spark):
    from siltstream.functions.classify import fmt_bytes, fmt_micros

    values = [0, 1, 999, 1000, 1023, 1024, 1150, 1250, 1280, 1350, 1450, 1792, 999_949, 999_950, 999_999, 1_250_000, 10**9 * 3, 2**30, 2**30 * 5 // 4, 2**50 + 1]
    values += [50 * i for i in range(1, 20_000, 7)]

    def size(n):
        for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
            if n >= 1024**power:
                return f"{n / 1024**power:.1f} {unit}"
        return f"{n} B"

    def micros(us):
        return f"{us / 1e6:.1f} s" if us >= 1e6 else f"{us / 1e3:.1f} ms" if us >= 1e3 else f"{us:.0f} µs"

    rows = spark.createDataFrame([(v,) for v in values], "v long")
    got = rows.select("v", fmt_bytes(F.col("v")), fmt_micros(F.col("v").cast("double")), fmt_micros(F.col("v") / 2.0)).collect()
    assert [tuple(r) for r in got] == [(v, size(v), micros(float(v)), micros(v / 2)) for v in values]


def test_printed_numbers_of_events_whose_square_leaves_a_long(spark, tmp_path):
    ids = [0, 1, 2, 3, 3_036_991, 3_036_994, 3_037_000, *range(5_999_990, 6_000_000), 95_606_101, 3 * 10**15 + 1, 10**16, -1, -2, -3, -6_000_002, None]
    spark.createDataFrame([(i,) for i in ids], "event_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in e.queries()["pretty_print"](spark, str(tmp_path)).select("event_id", "bytes", "micros").collect()]
    # The same SQL over products of 128 bits, since those of DuckDB's BIGINT end at the same ids.
    sql = e.oracle_sql()["pretty_print"].replace("event_id * event_id", "CAST(event_id AS HUGEINT) * event_id")
    con = connect()
    con.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"SELECT event_id, bytes, micros FROM ({sql})").fetchall()
    assert len(got) == len(ids) and sorted(got, key=repr) == sorted(want, key=repr)
