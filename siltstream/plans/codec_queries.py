"""Frame codec, admission and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import codec
from ..operators import records as R
from . import base as B
from .base import Pick, query

_REASONS = list(codec.NACK_REASONS)
_DECODE = f"""
    CASE WHEN length(f) < 32 THEN 'TruncatedFrame'
        WHEN substr(f, 1, 8) <> '57454952' THEN 'BadMagic' WHEN substr(f, 9, 2) <> '01' THEN 'VersionMismatch'
        WHEN {B.sql_le_number("f", 13, 4)} <> {B.sql_crc("unhex(substr(f, 1, 24))")} THEN 'HeaderCrcMismatch'
        WHEN substr(f, 11, 2) NOT IN ('01', '02', '03', '04', '05') THEN 'UnknownMessageType'
        WHEN substr(f, 13, 2) NOT IN ('01', '02', '03') THEN 'UnknownDurability' WHEN substr(f, 15, 2) <> '00' THEN 'ReservedFlagsSet'"""
_LEN = B.sql_le_number("f", 9, 4)


@query("payload_crc32", f"WITH {B.RECORDS}, {B.CRC_TABLE} SELECT seq, {B.sql_crc('payload')} AS crc FROM records, crc_t")
def payload_crc32(spark: SparkSession, sf: str) -> DataFrame:
    return B.records(spark, sf).select("seq", F.crc32("payload").alias("crc"))


_HEAD = "'5745495201010' || CAST(seq % 3 + 1 AS VARCHAR) || '00' || " + B.sql_le("octet_length(payload)", 4)


@query(
    "frame_encode",
    f"""WITH {B.RECORDS}, {B.CRC_TABLE}, h AS (SELECT seq, payload, {_HEAD} AS h FROM records)
    SELECT seq, h || {B.sql_le(B.sql_crc("unhex(h)"), 4)} || hex(payload) || {B.sql_le(B.sql_crc("payload"), 4)} AS frame_hex FROM h, crc_t""",
)
def frame_encode(spark: SparkSession, sf: str) -> DataFrame:
    whole = codec.frame(F.lit(1), F.pmod(F.col("seq"), F.lit(3)) + 1, F.col("payload"))
    return B.records(spark, sf).select("seq", F.hex(whole).alias("frame_hex"))


@query(
    "frame_verdict",
    f"""WITH {B.FRAMES} SELECT seq, {_DECODE} WHEN {_LEN} > 16777216 THEN 'PayloadTooLarge'
        WHEN length(f) < 2 * (20 + {_LEN}) THEN 'TruncatedFrame' WHEN length(f) > 2 * (20 + {_LEN}) THEN 'TrailingBytes'
        WHEN {B.sql_le_number("f", f"17 + {_LEN}", 4)} <> {B.sql_crc(f"unhex(substr(f, 33, CAST(2 * {_LEN} AS INT)))")} THEN 'PayloadCrcMismatch' ELSE 'ok' END AS verdict
    FROM fr, crc_t""",
)
def frame_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return B.frames(spark, sf).select("seq", codec.frame_verdict(F.col("frame")).alias("verdict"))


_VERDICTS = [*codec.VERDICT_NACK, "TruncatedFrame", "TrailingBytes", "ok"]


@query(
    "verdict_to_nack",
    f"""SELECT DISTINCT v AS verdict, CASE v WHEN 'BadMagic' THEN 'bad_magic' WHEN 'VersionMismatch' THEN 'version_mismatch' WHEN 'HeaderCrcMismatch' THEN 'bad_header_crc'
        WHEN 'UnknownMessageType' THEN 'unknown_message' WHEN 'UnknownDurability' THEN 'unknown_message' WHEN 'ReservedFlagsSet' THEN 'reserved_flags_set'
        WHEN 'PayloadTooLarge' THEN 'payload_too_large' WHEN 'PayloadCrcMismatch' THEN 'bad_payload_crc' END AS nack
    FROM (SELECT {Pick(_VERDICTS).sql} AS v FROM events)""",
)
def verdict_to_nack(spark: SparkSession, sf: str) -> DataFrame:
    v = B.events(spark, sf).select(Pick(_VERDICTS).col.alias("verdict")).distinct()
    return v.select("verdict", codec.verdict_nack(F.col("verdict")).alias("nack"))


_LIST = "[" + ", ".join(f"'{r}'" for r in _REASONS) + "]"


@query(
    "nack_encode",
    f"""SELECT event_id, r AS reason, '0' || CAST(list_position({_LIST}, r) AS VARCHAR) || CASE WHEN r = 'version_mismatch' THEN '01' ELSE '' END AS payload_hex
    FROM (SELECT event_id, {Pick(_REASONS).sql} AS r FROM events)""",
)
def nack_encode(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select("event_id", Pick(_REASONS).col.alias("reason"))
    return rows.select("event_id", "reason", F.hex(codec.nack_payload(F.col("reason"))).alias("payload_hex"))


@query("nack_labels", f"SELECT DISTINCT event_id % 9 + 1 AS code, {_LIST}[CAST(event_id % 9 AS INT) + 1] AS label, event_id % 9 + 1 AS code_again FROM events")
def nack_labels(spark: SparkSession, sf: str) -> DataFrame:
    codes = B.events(spark, sf).select((F.col("event_id") % 9 + 1).alias("code")).distinct()
    label = codec.mapped(F.col("code"), {v: k for k, v in codec.NACK_REASONS.items()}).cast("string")
    return codes.select("code", label.alias("label")).select("code", "label", codec.mapped(F.col("label"), codec.NACK_REASONS).cast("long").alias("code_again"))


@query(
    "fixed_replies",
    f"""WITH {B.CRC_TABLE}, k(kind, h) AS (VALUES ('ack', '574549520102010000000000'), ('health_check_response', '574549520105010000000000'))
    SELECT kind, h || {B.sql_le(B.sql_crc("unhex(h)"), 4)} || '00000000' AS frame_hex FROM k, crc_t""",
)
def fixed_replies(spark: SparkSession, sf: str) -> DataFrame:
    kinds = spark.range(1).select(F.explode(F.array(F.lit("ack"), F.lit("health_check_response"))).alias("kind"))
    return kinds.select("kind", F.hex(F.when(F.col("kind") == "ack", codec.fixed_reply("ack")).otherwise(codec.fixed_reply("health_check_response"))).alias("frame_hex"))


_WHOLE_HEADER = "WITH {frames} , a AS (SELECT seq, f, {decode} ELSE 'ok' END AS hv FROM fr, crc_t WHERE length(f) >= 32)".format(frames=B.FRAMES, decode=_DECODE)
_ADMISSION = f"""{_WHOLE_HEADER}, adm AS (
    SELECT seq, hv, substr(f, 11, 2) AS kind_hex, substr(f, 13, 2) AS tier_hex,
        CASE WHEN hv <> 'ok' THEN CASE hv WHEN 'BadMagic' THEN 'bad_magic' WHEN 'VersionMismatch' THEN 'version_mismatch' WHEN 'HeaderCrcMismatch' THEN 'bad_header_crc'
            WHEN 'ReservedFlagsSet' THEN 'reserved_flags_set' ELSE 'unknown_message' END
        WHEN {_LEN} > 60 THEN 'payload_too_large' WHEN {_LEN} = 0 AND substr(f, 11, 2) = '01' THEN 'empty_payload'
        WHEN {B.sql_le_number("f", f"17 + {_LEN}", 4)} <> {B.sql_crc(f"unhex(substr(f, 33, CAST(2 * {_LEN} AS INT)))")} THEN 'bad_payload_crc'
        WHEN substr(f, 11, 2) NOT IN ('01', '04') THEN 'unknown_message' END AS nack_reason FROM a, crc_t
    WHERE NOT (hv = 'ok' AND {_LEN} <= 60 AND ({_LEN} > 0 OR substr(f, 11, 2) <> '01') AND length(f) < 2 * ({_LEN} + 20))),
adm2 AS (SELECT seq, nack_reason, CASE WHEN hv <> 'ok' OR nack_reason = 'unknown_message' THEN 'sync'
        ELSE CASE tier_hex WHEN '01' THEN 'sync' WHEN '02' THEN 'batched' WHEN '03' THEN 'buffered' END END AS tier,
        CASE kind_hex WHEN '01' THEN 'push' WHEN '04' THEN 'health_check' END AS kind FROM adm)"""


def _admitted(spark: SparkSession, sf: str) -> DataFrame:
    return R.admit(B.frames(spark, sf), max_payload=60)


@query("admission", f"{_ADMISSION} SELECT seq, nack_reason, tier, kind FROM adm2")
def admission(spark: SparkSession, sf: str) -> DataFrame:
    return _admitted(spark, sf).select("seq", "nack_reason", "tier", "kind")


@query("nack_by_reason", f"{_ADMISSION} SELECT tier, nack_reason AS reason, count(*) AS n FROM adm2 WHERE nack_reason IS NOT NULL GROUP BY ALL")
def nack_by_reason(spark: SparkSession, sf: str) -> DataFrame:
    return R.nacks_by_reason(_admitted(spark, sf))


@query("shard_route", "SELECT event_id, user_id % 5 AS shard_id FROM events")
def shard_route(spark: SparkSession, sf: str) -> DataFrame:
    return B.events(spark, sf).select("event_id", R.shard_route(F.col("user_id"), 5).alias("shard_id"))


@query("worker_route", "SELECT user_id % 5 % 3 AS worker_id, count(*) AS n, 65536 // 3 AS capacity FROM events GROUP BY 1")
def worker_route(spark: SparkSession, sf: str) -> DataFrame:
    routed = B.events(spark, sf).select(R.worker_route(R.shard_route(F.col("user_id"), 5), 3).alias("worker_id"))
    return routed.groupBy("worker_id").agg(F.count("*").alias("n")).withColumn("capacity", F.lit(R.queue_capacity(3)))


_UIDS = [1000, 1000, 0, None, 1001]


@query("peer_uid_filter", f"SELECT event_id, peer_uid FROM (SELECT event_id, {Pick(_UIDS).sql} AS peer_uid FROM events) WHERE peer_uid = 1000")
def peer_uid_filter(spark: SparkSession, sf: str) -> DataFrame:
    return R.peer_uid_filter(B.events(spark, sf).select("event_id", Pick(_UIDS).col.alias("peer_uid")), 1000)


_TIERS = ["sync", "batched", "buffered", "other"]


@query("tier_ack_rule", f"SELECT tier, CASE WHEN tier IN ('sync', 'batched') THEN 'after_group_sync' WHEN tier = 'buffered' THEN 'after_write' END AS ack_point, count(*) AS n FROM (SELECT {Pick(_TIERS).sql} AS tier FROM events) GROUP BY ALL")
def tier_ack_rule(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select(Pick(_TIERS).col.alias("tier"))
    return rows.select("tier", K.ack_point(F.col("tier")).alias("ack_point")).groupBy("tier", "ack_point").agg(F.count("*").alias("n"))


_FATES = ["ack", "health_check", *_REASONS, "idle_timeout"]


@query("conn_fate", f"SELECT DISTINCT e AS event, CASE WHEN e IN ('ack', 'internal_error', 'health_check') THEN 'open' ELSE 'closed' END AS connection FROM (SELECT {Pick(_FATES).sql} AS e FROM events)")
def conn_fate(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select(Pick(_FATES).col.alias("event")).distinct()
    return rows.select("event", K.connection_fate(F.col("event")).alias("connection"))


@query(
    "idle_drop",
    """SELECT event_id, CASE WHEN event_id * 7 % 40000 > 30000 THEN 'header' WHEN event_id * 13 % 40000 > 30000 THEN 'payload' ELSE 'crc' END AS dropped_in
    FROM events WHERE event_id * 7 % 40000 > 30000 OR event_id * 13 % 40000 > 30000 OR event_id * 17 % 40000 > 30000""",
)
def idle_drop(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    phases = B.events(spark, sf).select("event_id", (e * 7 % 40000).alias("header_ms"), (e * 13 % 40000).alias("payload_ms"), (e * 17 % 40000).alias("crc_ms"))
    return R.idle_drops(phases).select("event_id", "dropped_in")


_TLS = ["peer sent no certificates", "invalid peer certificate: UnknownIssuer", "bad certificate", "connection reset", "received alert: expired", "CertificateRequired; BadEncoding"]


@query(
    "tls_failure_class",
    f"""SELECT m AS message, CASE WHEN contains(m, 'no certificates') OR contains(m, 'CertificateRequired') THEN 'no_client_cert'
        WHEN contains(m, 'UnknownIssuer') OR contains(m, 'bad certificate') OR contains(m, 'expired') OR contains(m, 'BadEncoding') THEN 'bad_cert' ELSE 'other' END AS class, count(*) AS n
    FROM (SELECT {Pick(_TLS).sql} AS m FROM events) GROUP BY ALL""",
)
def tls_failure_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select(Pick(_TLS).col.alias("message"))
    return rows.select("message", K.tls_failure_class(F.col("message")).alias("class")).groupBy("message", "class").agg(F.count("*").alias("n"))


_ERRNOS = ["EMFILE", "ECONNABORTED", "ENFILE", "ENOMEM", "EINTR", "ENOBUFS"]


@query("accept_exhaustion", f"SELECT e AS errno, count(*) AS n, 50 AS backoff_ms FROM (SELECT {Pick(_ERRNOS).sql} AS e FROM events) WHERE e IN ('EMFILE', 'ENFILE', 'ENOBUFS', 'ENOMEM') GROUP BY 1")
def accept_exhaustion(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select(Pick(_ERRNOS).col.alias("errno")).filter(F.col("errno").isin(*K.EXHAUSTION))
    return rows.groupBy("errno").agg(F.count("*").alias("n")).withColumn("backoff_ms", F.lit(50))


_ERRORS = [*K.RECOVERABLE, "nack_bad_magic", "io", "protocol", "version_mismatch", "unknown_nack"]


@query("client_recoverable", f"SELECT DISTINCT e AS error, e IN ('payload_too_large_local', 'no_default_durability', 'empty_payload_local', 'nack_internal_error') AS recoverable FROM (SELECT {Pick(_ERRORS).sql} AS e FROM events)")
def client_recoverable(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select(Pick(_ERRORS).col.alias("error")).distinct()
    return rows.select("error", K.client_recoverable(F.col("error")).alias("recoverable"))
