"""What the registered queries share: inputs derived from the event table, the same in Spark and in DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import records as R

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        CATALOG[name] = Query(build, sql)
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.records_of_events(events(spark, sf_dir))


#: The same in DuckDB.
RECORDS = """records AS (
    SELECT event_id AS seq, user_id AS conn_id, user_id % 4 AS shard_id,
        CASE event_id % 3 WHEN 0 THEN 'sync' WHEN 1 THEN 'batched' ELSE 'buffered' END AS tier,
        encode(concat_ws('|', event_id, user_id, event_type, props)) AS payload
    FROM events)"""

#: CRC-32 by its table, built from the polynomial.
CRC_TABLE = """crc_t AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END)) AS tbl)"""


def sql_crc(blob: str) -> str:
    """CRC-32 of a BLOB; needs crc_t in FROM."""
    byte = f"CAST('0x' || substr(hex({blob}), CAST(2 * i + 1 AS INT), 2) AS UBIGINT)"
    values = f"list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(octet_length({blob})), lambda i: {byte}))"
    return f"CAST(xor(list_reduce({values}, lambda c, x: xor(c >> 8, tbl[CAST(xor(c, x) & 255 AS INT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT)"


def sql_le(number: str, n: int) -> str:
    """Upper-case hex of the n lowest bytes, little-endian."""
    big = f"lpad(upper(to_hex(CAST({number} AS BIGINT))), {2 * n}, '0')"
    return "(" + " || ".join(f"substr({big}, {2 * (n - i) - 1}, 2)" for i in range(n)) + ")"


def sql_le_number(hex_text: str, at: str | int, n: int) -> str:
    """The little-endian number of n bytes from 1-based byte ``at`` of a hex text."""
    start = f"2 * ({at}) - 1"
    return f"CAST('0x' || {' || '.join(f'substr({hex_text}, CAST({start} + {2 * (n - 1 - i)} AS INT), 2)' for i in range(n))} AS BIGINT)"


class Pick:
    """A value chosen from a fixed list by event_id, as a column and as DuckDB SQL."""

    def __init__(self, values: list, salt: int = 1):
        self.values, self.salt = values, salt

    @property
    def col(self) -> Column:
        at = F.pmod(F.floor(F.col("event_id") / self.salt), F.lit(len(self.values))).cast("int") + 1
        return F.element_at(F.array(*map(F.lit, self.values)), at)

    @property
    def sql(self) -> str:
        def literal(v: object) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, str):
                return "'" + v.replace("'", "''") + "'"
            return str(v)

        return f"[{', '.join(map(literal, self.values))}][CAST((event_id // {self.salt}) % {len(self.values)} AS INT) + 1]"


CASES = 16
_TYPE = {6: 9, 14: 2, 15: 4}


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, frame): a push frame of each record, damaged in one of 15 ways by seq."""
    case = F.pmod(F.col("seq"), F.lit(CASES))
    payload = F.when(case.isin(13, 15), F.lit(b"")).otherwise(F.col("payload"))
    rec = records(spark, sf_dir).select("seq", case.alias("case"), payload.alias("payload"))
    # In steps, since each is used more than once in the next.
    case, payload, head, whole = F.col("case"), F.col("payload"), F.col("head"), F.col("whole")
    kind = F.when(case == 6, 9).when(case == 14, 2).when(case == 15, 4).otherwise(1)
    tier = F.when(case == 7, 9).otherwise(F.pmod(F.col("seq"), F.lit(3)) + 1)
    length = F.when(case == 9, 16_777_217).otherwise(F.octet_length(payload))
    body = F.concat(
        F.unhex(F.when(case == 3, "58454952").otherwise(codec.MAGIC)),
        codec.le_bytes(F.when(case == 4, 2).otherwise(1), 1),
        codec.le_bytes(kind, 1),
        codec.le_bytes(tier, 1),
        codec.le_bytes(F.when(case == 8, 1).otherwise(0), 1),
        codec.le_bytes(length, 4),
    )
    head_crc = F.crc32(head).bitwiseXOR(F.when(case == 5, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    body_crc = F.crc32(payload).bitwiseXOR(F.when(case == 10, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    frame = F.concat(head, codec.le_bytes(head_crc, 4), payload, codec.le_bytes(body_crc, 4))
    made = rec.select("*", body.alias("head")).select("seq", "case", frame.alias("whole"))
    short = F.substring(whole, F.lit(1), F.octet_length(whole) - 1)
    cut = F.when(case == 1, short).when(case == 2, F.concat(whole, F.unhex(F.lit("00")))).when(case == 11, F.substring(whole, 1, 9)).otherwise(whole)
    return made.select("seq", cut.alias("frame"))


FRAMES = f"""{RECORDS}, {CRC_TABLE}, fr0 AS (
    SELECT seq, seq % 16 AS k, CASE WHEN seq % 16 IN (13, 15) THEN encode('') ELSE payload END AS p FROM records),
fr1 AS (
    SELECT seq, k, p, CASE WHEN k = 3 THEN '58454952' ELSE '57454952' END || CASE WHEN k = 4 THEN '02' ELSE '01' END
        || CASE k WHEN 6 THEN '09' WHEN 14 THEN '02' WHEN 15 THEN '04' ELSE '01' END
        || CASE WHEN k = 7 THEN '09' ELSE '0' || CAST(seq % 3 + 1 AS VARCHAR) END || CASE WHEN k = 8 THEN '01' ELSE '00' END
        || {sql_le("CASE WHEN k = 9 THEN 16777217 ELSE octet_length(p) END", 4)} AS h FROM fr0),
fr2 AS (
    SELECT seq, k, h || {sql_le("xor(" + sql_crc("unhex(h)") + ", CASE WHEN k = 5 THEN 1 ELSE 0 END)", 4)} || hex(p)
        || {sql_le("xor(" + sql_crc("p") + ", CASE WHEN k = 10 THEN 1 ELSE 0 END)", 4)} AS f FROM fr1, crc_t),
fr AS (SELECT seq, CASE k WHEN 1 THEN substr(f, 1, length(f) - 2) WHEN 2 THEN f || '00' WHEN 11 THEN substr(f, 1, 18) ELSE f END AS f FROM fr2)"""

#: Segments of 4,096 bytes as a recursive query over each shard's records.
SEGMENTS = f"""{RECORDS}, ranked AS (
    SELECT *, octet_length(payload) + 8 AS size, row_number() OVER (PARTITION BY shard_id ORDER BY seq) AS rn FROM records),
walk AS (
    SELECT shard_id, rn, 0 AS seg_no, 24 + size AS filled FROM ranked WHERE rn = 1
    UNION ALL
    SELECT r.shard_id, r.rn, CASE WHEN w.filled >= 4096 THEN w.seg_no + 1 ELSE w.seg_no END,
        CASE WHEN w.filled >= 4096 THEN 24 + r.size ELSE w.filled + r.size END
    FROM walk w JOIN ranked r ON r.shard_id = w.shard_id AND r.rn = w.rn + 1),
seg AS (
    SELECT r.shard_id, r.seq, r.conn_id, r.tier, r.payload, r.size, w.seg_no, max(w.filled) OVER (PARTITION BY r.shard_id, w.seg_no) >= 4096 AS sealed
    FROM ranked r JOIN walk w USING (shard_id, rn))"""
SEGMENT_BYTES = 4096


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.segments import rotate

    return rotate(records(spark, sf_dir), SEGMENT_BYTES)


def segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up directory listing: (shard, name, size, mode, arrival)."""
    e = events(spark, sf_dir)
    suffix = Pick([".wab", ".wab.sealed", ".wab.confirmed", ".wab.sealed", ".tmp"], 3).col
    folder = Pick(["shard_00", "shard_01", "shard_02", "shard_10", "dead_letter", "quarantine"]).col
    stem = F.when(folder == "dead_letter", "dl_").otherwise("seg_")
    name = F.concat(stem, F.lpad(F.pmod("event_id", F.lit(97)).cast("string"), 8, "0"), suffix)
    return e.select(folder.alias("shard"), name.alias("name"), (F.col("event_id") * 31 % 5000).alias("size"), Pick([384, 384, 420, 384, 438]).col.alias("mode"), F.col("event_id").alias("arrival"))


FILES = f"""files AS (
    SELECT shard, CASE WHEN shard = 'dead_letter' THEN 'dl_' ELSE 'seg_' END || lpad(CAST(event_id % 97 AS VARCHAR), 8, '0') || suffix AS name,
        event_id * 31 % 5000 AS size, {Pick([384, 384, 420, 384, 438]).sql} AS mode, event_id AS arrival
    FROM (SELECT *, {Pick(["shard_00", "shard_01", "shard_02", "shard_10", "dead_letter", "quarantine"]).sql} AS shard,
        {Pick([".wab", ".wab.sealed", ".wab.confirmed", ".wab.sealed", ".tmp"], 3).sql} AS suffix FROM events))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples(ts_s, instance, metric, tier, le, value): nack counters that restart, a queue gauge, latency buckets."""
    e = events(spark, sf_dir)
    scrape, series = F.floor(F.col("event_id") / 12).cast("long"), F.col("event_id") % 12
    instance = F.concat(F.lit("i"), (series % 4).cast("string"))
    tier = F.element_at(F.array(*map(F.lit, ("sync", "batched", "buffered"))), (F.floor(series / 4) + 1).cast("int"))
    base = e.select((scrape * 15).alias("ts_s"), instance.alias("instance"), tier.alias("tier"), scrape.alias("k"), series.alias("s"))
    nacks = base.select("ts_s", "instance", F.lit("nack_total").alias("metric"), "tier", F.lit(None).cast("string").alias("le"), ((F.col("k") % 200) * (F.col("s") + 1)).cast("double").alias("value"))
    depth = base.filter("s < 4").select("ts_s", "instance", F.lit("queue_depth").alias("metric"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("le"), (F.col("k") * 7919 % 70000).cast("double").alias("value"))
    bounds = F.explode(F.array(*[F.struct(F.lit(le).alias("le"), F.lit(n).alias("n")) for le, n in _BUCKETS]))
    buckets = base.filter("s < 4").select("*", bounds.alias("b"))
    buckets = buckets.select("ts_s", "instance", F.lit("sync_seconds_bucket").alias("metric"), F.lit(None).cast("string").alias("tier"), F.col("b.le").alias("le"), ((F.col("k") % 200) * (F.col("b.n") + F.col("s"))).cast("double").alias("value"))
    return nacks.unionByName(depth).unionByName(buckets)


_BUCKETS = (("0.001", 2), ("0.005", 6), ("0.02", 9), ("0.1", 10), ("+Inf", 11))
SAMPLES = """base AS (
    SELECT (event_id // 12) * 15 AS ts_s, 'i' || CAST(event_id % 12 % 4 AS VARCHAR) AS instance,
        ['sync', 'batched', 'buffered'][CAST((event_id % 12) // 4 AS INT) + 1] AS tier, event_id // 12 AS k, event_id % 12 AS s FROM events),
samples AS (
    SELECT ts_s, instance, 'nack_total' AS metric, tier, NULL AS le, CAST((k % 200) * (s + 1) AS DOUBLE) AS value FROM base
    UNION ALL SELECT ts_s, instance, 'queue_depth', NULL, NULL, CAST(k * 7919 % 70000 AS DOUBLE) FROM base WHERE s < 4
    UNION ALL SELECT ts_s, instance, 'sync_seconds_bucket', NULL, b.le, CAST((k % 200) * (b.n + s) AS DOUBLE)
    FROM base, (VALUES ('0.001', 2), ('0.005', 6), ('0.02', 9), ('0.1', 10), ('+Inf', 11)) b(le, n) WHERE s < 4)"""
#: Reset-aware differences of every series.
DELTAS = f"""{SAMPLES}, d AS (
    SELECT *, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS delta
    FROM (SELECT *, lag(value) OVER (PARTITION BY instance, metric, tier, le ORDER BY ts_s) AS p FROM samples)),
inc AS (
    SELECT *, sum(delta) OVER w - first_value(delta) OVER w AS increase FROM d
    WINDOW w AS (PARTITION BY instance, metric, tier, le ORDER BY ts_s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW))"""
