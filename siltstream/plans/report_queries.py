"""Scalar functions, operator reports, monitoring, benchmark statistics and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from ..operators import bench as N
from ..operators import faults as T
from ..operators import ops as O
from ..operators import prom as M
from . import base as B
from .base import Pick, query

# ---------------------------------------------------------------- scalar functions
_STATUS = "event_id * 7 % 600"


def _status() -> F.Column:
    return (F.col("event_id") * 7 % 600).cast("int")


@query("http_class", f"SELECT s AS status, CASE WHEN s BETWEEN 200 AND 299 THEN 'ok' WHEN s IN (408, 429) OR s BETWEEN 500 AND 599 THEN 'transient' ELSE 'permanent' END AS class, count(*) AS n FROM (SELECT CAST({_STATUS} AS INT) AS s FROM events) GROUP BY ALL")
def http_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select(_status().alias("status"))
    return rows.select("status", K.http_class(F.col("status")).alias("class")).groupBy("status", "class").agg(F.count("*").alias("n"))


_CODES = [1205, 1213, 1062, 1064, 1146, 1045, 1290, 1317, 1044, 1048]


@query("mysql_class", f"SELECT DISTINCT c AS code, CASE WHEN c IN (1205, 1213, 1290, 1317, 1062, 1045, 1044, 1142) THEN 'transient' ELSE 'permanent' END AS class FROM (SELECT {Pick(_CODES).sql} AS c FROM events)")
def mysql_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select(Pick(_CODES).col.alias("code")).distinct()
    return rows.select("code", K.mysql_class(F.col("code")).alias("class"))


_SQLSTATES = ["40P01", "23505", "42P01", None, "57014", "22001", "57P03"]


@query("pg_class", f"SELECT s AS state, CASE WHEN s IS NULL OR s IN ('40P01', '55P03', '57014', '57P01', '57P02', '57P03', '23505') THEN 'transient' ELSE 'permanent' END AS class, count(*) AS n FROM (SELECT {Pick(_SQLSTATES).sql} AS s FROM events) GROUP BY ALL")
def pg_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select(Pick(_SQLSTATES).col.alias("state"))
    return rows.select("state", K.sqlstate_class(F.col("state")).alias("class")).groupBy("state", "class").agg(F.count("*").alias("n"))


@query("health_class", f"SELECT s AS status, CASE WHEN s BETWEEN 200 AND 399 OR s IN (401, 403, 405, 501) THEN 'healthy' WHEN s BETWEEN 400 AND 499 THEN 'degraded' ELSE 'down' END AS health, count(*) AS n FROM (SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST({_STATUS} AS INT) END AS s FROM events) GROUP BY ALL")
def health_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select(F.when(F.col("event_id") % 50 != 0, _status()).alias("status"))
    return rows.select("status", K.health_class(F.col("status")).alias("health")).groupBy("status", "health").agg(F.count("*").alias("n"))


_NAMES = ["records", "_x9", "9lives", "a-b", "tab\n", "t" * 63, "t" * 64, "t" * 65, "", "ok_2"]


@query("ident_check", f"SELECT event_id, coalesce(regexp_matches(s, '\\A[A-Za-z_][A-Za-z0-9_]{{0,63}}\\z'), false) AS mysql_ok, coalesce(regexp_matches(s, '\\A[A-Za-z_][A-Za-z0-9_]{{0,62}}\\z'), false) AS pg_ok FROM (SELECT event_id, {Pick(_NAMES).sql} AS s FROM events)")
def ident_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select("event_id", Pick(_NAMES).col.alias("name"))
    return rows.select("event_id", K.is_identifier(F.col("name"), 64).alias("mysql_ok"), K.is_identifier(F.col("name"), 63).alias("pg_ok"))


@query(
    "insert_sql_text",
    """SELECT DISTINCT n, 'INSERT IGNORE INTO `records` (`payload`) VALUES ' || array_to_string(list_transform(range(1, n + 1), lambda i: '(?)'), ',') AS mysql,
        'INSERT INTO "records" ("payload") VALUES ' || array_to_string(list_transform(range(1, n + 1), lambda i: '($' || CAST(i AS VARCHAR) || ')'), ',') || ' ON CONFLICT DO NOTHING' AS pg
    FROM (SELECT CAST(event_id % 40 + 1 AS INT) AS n FROM events)""",
)
def insert_sql_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select((F.col("event_id") % 40 + 1).cast("int").alias("n")).distinct()
    return rows.select("n", K.insert_text("records", "payload", F.col("n"), "mysql", True).alias("mysql"), K.insert_text("records", "payload", F.col("n"), "postgres", True).alias("pg"))


_AFTER = ["5", " 30 ", "0", "3600", "3601", "+5", "-1", "soon", "", None, "1.5", "99999999999999999999"]


@query("retry_after", f"SELECT event_id, CASE WHEN regexp_matches(trim(v), '\\A\\+?[0-9]+\\z') AND TRY_CAST(trim(v) AS BIGINT) BETWEEN 1 AND 3600 THEN TRY_CAST(trim(v) AS BIGINT) END AS seconds FROM (SELECT event_id, {Pick(_AFTER).sql} AS v FROM events)")
def retry_after(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select("event_id", Pick(_AFTER).col.alias("v"))
    return rows.select("event_id", K.retry_after(F.col("v")).alias("seconds"))


_URLS = [
    "https://user:pa@ss@db.example.com/x?token=abc&id=4#frag",
    "mysql://root:secret@host/db",
    "http://host/a?Password=1&k=v&API_KEY=zz",
    "no-scheme?sig=9&x=1",
    "http://user@host/p@q:1",
    "http://host/?token&secret=",
    "http://u:@h:80/",
]
_QUERY = "array_to_string(list_transform(string_split(q, '&'), lambda p: regexp_replace(p, '(?is)\\A(password|passwd|pwd|token|access_token|secret|api_key|apikey|sig|signature)=.*\\z', '\\1=<redacted>')), '&')"


@query(
    "redact_url",
    f"""WITH u AS (SELECT event_id, {Pick(_URLS).sql} AS u FROM events),
    s AS (SELECT event_id, u, CASE WHEN contains(u, '://') THEN split_part(u, '://', 1) || '://' ELSE '' END AS scheme FROM u),
    r AS (SELECT *, substr(u, length(scheme) + 1) AS rest FROM s),
    a AS (SELECT *, CASE WHEN scheme = '' THEN '' ELSE regexp_extract(rest, '\\A[^/?#]*') END AS auth FROM r),
    t AS (SELECT *, substr(rest, length(auth) + 1) AS tail FROM a),
    p AS (SELECT *, CASE WHEN contains(tail, '?') THEN split_part(tail, '?', 1) ELSE tail END AS head, regexp_extract(tail, '\\A[^?]*\\?([^#]*)', 1) AS q, regexp_extract(tail, '(?s)\\A[^?]*\\?[^#]*(.*)\\z', 1) AS frag FROM t)
    SELECT event_id, scheme || CASE WHEN contains(auth, '@') AND contains(regexp_extract(auth, '(?s)\\A(.*)@', 1), ':')
        THEN split_part(auth, ':', 1) || ':<redacted>@' || regexp_extract(auth, '[^@]*\\z') ELSE auth END || head || CASE WHEN contains(tail, '?') THEN '?' || {_QUERY} || frag ELSE '' END AS redacted FROM p""",
)
def redact_url(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select("event_id", Pick(_URLS).col.alias("u"))
    return rows.select("event_id", K.redact_url(F.col("u")).alias("redacted"))


@query("sanitize_excerpt", "SELECT doc_id, substr(regexp_replace(text, '\\p{Cc}', '.', 'g'), 1, 256) AS excerpt FROM documents")
def sanitize_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "documents").select("doc_id", K.sanitize_excerpt(F.col("text"), 256).alias("excerpt"))


_ESCAPES = ["a%20b", "100%", "%zz%41", "%C3%A9t%C3%A9", "a+b%2Bc", "", "%4"]


@query("percent_decode", f"SELECT event_id, ['a b', '100%', '%zzA', 'été', 'a+b+c', '', '%4'][CAST(event_id % 7 AS INT) + 1] AS decoded FROM events")
def percent_decode(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select("event_id", Pick(_ESCAPES).col.alias("v"))
    return rows.select("event_id", K.percent_decode(F.col("v")).alias("decoded"))


_CREDENTIALS = ["http://u:p%40s@h:8123/x", "http://h/x", "https://only@h", "http://a:b:c@h/?q=@"]


@query("split_credentials", "SELECT event_id, ['http://h:8123/x', 'http://h/x', 'https://h', 'http://h/?q=@'][k] AS url, ['u', NULL, 'only', 'a'][k] AS username, ['p@s', NULL, NULL, 'b:c'][k] AS password FROM (SELECT event_id, CAST(event_id % 4 AS INT) + 1 AS k FROM events)")
def split_credentials(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select("event_id", K.split_credentials(Pick(_CREDENTIALS).col).alias("c"))
    return rows.select("event_id", "c.url", F.col("c.user").alias("username"), "c.password")


_TIER_TEXT = ["SYNC", "Batched", "buffered", "none", "sync ", None]


@query("tier_parse", f"SELECT event_id, CASE WHEN lower(t) IN ('sync', 'batched', 'buffered') THEN lower(t) END AS tier FROM (SELECT event_id, {Pick(_TIER_TEXT).sql} AS t FROM events)")
def tier_parse(spark: SparkSession, sf: str) -> DataFrame:
    return B.events(spark, sf).select("event_id", K.tier_parse(Pick(_TIER_TEXT).col).alias("tier"))


@query(
    "agent_advice",
    """WITH a AS (SELECT event_id, event_id % 33 AS cores, user_id % 20 + 1 AS shards, event_id % 7 + 1 AS workers FROM events), b AS (SELECT *, greatest(cores - 2, 2) // 2 AS best, greatest(shards, workers) AS actual FROM a)
    SELECT event_id, best AS recommended, CASE WHEN cores > 0 THEN CASE WHEN actual > 2 * best THEN 'warn' WHEN best >= 4 AND actual * 4 < best THEN 'info' END END AS advice FROM b""",
)
def agent_advice(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select("event_id", (F.col("event_id") % 33).alias("cores"), (F.col("user_id") % 20 + 1).alias("shards"), (F.col("event_id") % 7 + 1).alias("workers"))
    return rows.select("event_id", K.recommended_agents(F.col("cores")).alias("recommended"), K.agent_advice(F.col("cores"), F.col("shards"), F.col("workers")).alias("advice"))


@query(
    "config_merge",
    """WITH l AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id % 300 END AS cli, CASE WHEN event_id % 3 = 0 THEN event_id % 200 END AS env, CASE WHEN event_id % 2 = 0 THEN event_id % 100 END AS file FROM events)
    SELECT event_id, coalesce(cli, env, file, 64) AS batch_size, coalesce(cli, env, file, 64) BETWEEN 1 AND 250 AS in_range FROM l""",
)
def config_merge(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.config import in_range, layered

    e = F.col("event_id")
    rows = B.events(spark, sf).select("event_id", F.when(e % 5 == 0, e % 300).alias("cli"), F.when(e % 3 == 0, e % 200).alias("env"), F.when(e % 2 == 0, e % 100).alias("file"))
    merged = rows.select("event_id", layered("cli", "env", "file", default=64).alias("batch_size"))
    return merged.select("event_id", "batch_size", in_range(F.col("batch_size"), 1, 250).alias("in_range"))


_PATHS = ["/var/lib/x", "relative/x", "/a/../b", "/a/..b/c", "/x/..", "/ok"]


@query("path_check", f"SELECT event_id, CASE WHEN p NOT LIKE '/%' THEN 'not_absolute' WHEN regexp_matches(p, '(?:\\A|/)\\.\\.(?:/|\\z)') THEN 'parent_component' ELSE 'ok' END AS verdict FROM (SELECT event_id, {Pick(_PATHS).sql} AS p FROM events)")
def path_check(spark: SparkSession, sf: str) -> DataFrame:
    return B.events(spark, sf).select("event_id", K.path_check(Pick(_PATHS).col).alias("verdict"))


# ---------------------------------------------------------------- operator reports
_STATE = "CASE WHEN name LIKE '%.wab.confirmed' THEN 'confirmed' WHEN name LIKE '%.wab.sealed' THEN 'sealed' WHEN name LIKE '%.wab' THEN 'active' END"


_BYTES = "CASE event_id % 3 WHEN 0 THEN event_id * 128 WHEN 1 THEN event_id * event_id * 1000003 % 20000000000 ELSE event_id % 1024 END"
_MICROS = "CASE event_id % 3 WHEN 0 THEN event_id * 50 WHEN 1 THEN event_id * event_id * 1009 % 9000000 ELSE event_id % 2000 / CAST(2 AS DOUBLE) END"


def _square_mod(e: F.Column, factor: int, modulus: int) -> F.Column:
    """``e * e * factor % modulus`` of any long; with a factor of 1,000,003 the plain product leaves the range of a long above e = 3,036,995."""
    rest = (e % modulus).cast("decimal(19,0)")
    return (rest * rest % modulus).cast("long") * factor % modulus


@query(
    "pretty_print",
    f"""WITH v AS (SELECT event_id, {_BYTES} AS n, CAST({_MICROS} AS DOUBLE) AS us FROM events)
    SELECT event_id, CASE WHEN n >= 1073741824 THEN format('{{:.1f}} GiB', CAST(n AS DOUBLE) / 1073741824) WHEN n >= 1048576 THEN format('{{:.1f}} MiB', CAST(n AS DOUBLE) / 1048576)
        WHEN n >= 1024 THEN format('{{:.1f}} KiB', CAST(n AS DOUBLE) / 1024) ELSE CAST(n AS VARCHAR) || ' B' END AS bytes,
        CASE WHEN us >= 1000000 THEN format('{{:.1f}} s', us / 1000000) WHEN us >= 1000 THEN format('{{:.1f}} ms', us / 1000) ELSE format('{{:.0f}} µs', us) END AS micros FROM v""",
)
def pretty_print(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    n = F.when(e % 3 == 0, e * 128).when(e % 3 == 1, _square_mod(e, 1_000_003, 20_000_000_000)).otherwise(e % 1024)
    us = F.when(e % 3 == 0, (e * 50).cast("double")).when(e % 3 == 1, _square_mod(e, 1009, 9_000_000).cast("double")).otherwise(e % 2000 / 2.0)
    rows = B.events(spark, sf).select("event_id", n.alias("n"), us.alias("us"))
    return rows.select("event_id", K.fmt_bytes(F.col("n")).alias("bytes"), K.fmt_micros(F.col("us")).alias("micros"))


@query(
    "segment_accounting",
    f"""WITH {B.FILES}, s AS (SELECT shard, size, {_STATE} AS state FROM files WHERE shard <> 'dead_letter')
    SELECT coalesce(shard, 'total') AS shard, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'sealed') AS sealed, count(*) FILTER (state = 'confirmed') AS confirmed,
        CAST(coalesce(sum(size) FILTER (state IN ('active', 'sealed')), 0) AS BIGINT) AS bytes FROM s GROUP BY ROLLUP (shard)""",
)
def segment_accounting(spark: SparkSession, sf: str) -> DataFrame:
    return O.segment_accounting(B.segment_files(spark, sf))


@query("dl_list", f"WITH {B.FILES} SELECT name, size FROM files WHERE shard = 'dead_letter' AND (name LIKE 'dl\\_%.wab' ESCAPE '\\' OR name LIKE 'dl\\_%.wab.sealed' ESCAPE '\\')")
def dl_list(spark: SparkSession, sf: str) -> DataFrame:
    return O.dead_letter_list(B.segment_files(spark, sf))


@query(
    "dl_requeue_plan",
    """SELECT segment, count(*) AS records, CASE WHEN bool_and(seq % 997 <> 5) AND segment % 11 <> 4 THEN 'requeue' ELSE 'skip' END AS action
    FROM (SELECT user_id % 60 AS segment, event_id AS seq FROM events) WHERE segment % 5 <> 0 GROUP BY segment""",
)
def dl_requeue_plan(spark: SparkSession, sf: str) -> DataFrame:
    s, e = F.col("user_id") % 60, F.col("event_id")
    rows = B.events(spark, sf).select(s.alias("segment"), e.alias("seq"), (s % 5 != 0).alias("sealed"), (s % 11 != 4).alias("has_sentinel"), (e % 997 != 5).alias("crc_ok"))
    return O.requeue_plan(rows)


_METRICS = ["records_accepted_total", "records_ack_total", "records_nack_total", "queue_depth", "sync_seconds_sum", "sync_seconds_count", "sink_health", "sink_info", "flusher_panics_total", "sync_failures_total"]


def _exposition(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    metric = Pick(_METRICS).col
    label = F.when(metric.startswith("records_"), Pick(["sync", "batched"], 10).col).when(metric == "sink_health", Pick(["healthy", "degraded", "down"], 10).col).when(metric == "sink_info", F.lit("noop"))
    value = F.when(metric == "sink_health", (F.floor(e / 10) % 3 == 1).cast("double")).when(metric == "sink_info", 1.0).otherwise((e % 1000).cast("double"))
    return B.events(spark, sf).select(metric.alias("metric"), label.alias("label"), value.alias("value"))


_EXPO = f"""x AS (SELECT event_id AS e, {Pick(_METRICS).sql} AS metric FROM events), ex AS (
    SELECT metric, CASE WHEN metric LIKE 'records%' THEN ['sync', 'batched'][CAST((e // 10) % 2 AS INT) + 1] WHEN metric = 'sink_health' THEN ['healthy', 'degraded', 'down'][CAST((e // 10) % 3 AS INT) + 1] WHEN metric = 'sink_info' THEN 'noop' END AS label,
        CASE WHEN metric = 'sink_health' THEN CASE WHEN (e // 10) % 3 = 1 THEN 1.0 ELSE 0.0 END WHEN metric = 'sink_info' THEN 1.0 ELSE CAST(e % 1000 AS DOUBLE) END AS value FROM x),
sm AS (SELECT CAST(sum(value) FILTER (metric = 'records_accepted_total') AS BIGINT) AS accepted, CAST(sum(value) FILTER (metric = 'records_ack_total') AS BIGINT) AS ack, CAST(sum(value) FILTER (metric = 'records_nack_total') AS BIGINT) AS nack,
    max(value) FILTER (metric = 'sync_seconds_sum') / max(value) FILTER (metric = 'sync_seconds_count') * 1000 AS sync_avg_ms, CAST(max(value) FILTER (metric = 'queue_depth') AS BIGINT) AS queue_depth,
    CAST(max(value) FILTER (metric = 'flusher_panics_total') AS BIGINT) AS flusher_panics, CAST(max(value) FILTER (metric = 'sync_failures_total') AS BIGINT) AS sync_failures,
    min(label) FILTER (metric = 'sink_health' AND value = 1.0) AS sink_health, min(label) FILTER (metric = 'sink_info' AND value = 1.0) AS sink_type FROM ex)"""


@query("metrics_summary", f"WITH {_EXPO} SELECT * FROM sm")
def metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    return O.metrics_summary(_exposition(spark, sf))


@query("summary_warnings", f"WITH {_EXPO} SELECT 0 AS priority, 'records_discarded' AS warning FROM sm WHERE sink_type = 'noop' UNION ALL SELECT 1, 'shard_offline' FROM sm WHERE flusher_panics > 0 UNION ALL SELECT 2, 'durability_hazard' FROM sm WHERE sync_failures > 0 UNION ALL SELECT 3, 'records_nacked' FROM sm WHERE nack > 0")
def summary_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return O.summary_warnings(O.metrics_summary(_exposition(spark, sf)))


@query("metrics_summary_all", B.CATALOG["metrics_summary"].sql)
def metrics_summary_all(spark: SparkSession, sf: str) -> DataFrame:
    return O.metrics_summary(_exposition(spark, sf))


@query("summary_warnings_all", B.CATALOG["summary_warnings"].sql)
def summary_warnings_all(spark: SparkSession, sf: str) -> DataFrame:
    return O.summary_warnings(O.metrics_summary(_exposition(spark, sf)))


_LINES = ['depth 4', 'acked_total{tier="sync"} 12', '# HELP x', 'lat_bucket{le="0.1",tier="a b"} 3.5', 'bad', 'n{} 1e3']


@query("prom_parse", "SELECT event_id, ['depth', 'acked_total', NULL, 'lat_bucket', NULL, 'n'][k] AS metric, [NULL, 'sync', NULL, 'a b', NULL, NULL][k] AS tier, [4.0, 12.0, NULL, 3.5, NULL, 1000.0][k] AS value FROM (SELECT event_id, CAST(event_id % 6 AS INT) + 1 AS k FROM events) WHERE k NOT IN (3, 5)")
def prom_parse(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.text_logs import parse_exposition

    rows = B.events(spark, sf).select("event_id", Pick(_LINES).col.alias("value"))
    return parse_exposition(rows, "event_id").select("event_id", "metric", F.try_element_at("labels", F.lit("tier")).alias("tier"), "value")


_BENCH = ['BENCH: {"scenario":"herd_8","throughput_rps":100}', 'BENCH: {oops', 'noise', 'BENCH: {"scenario":"herd_32","throughput_rps":250,"threads":32}', 'BENCH_STAGE: {"scenario":"sync","queue_us":2}']


@query("bench_parse", "SELECT event_id, ['herd_8', NULL, NULL, 'herd_32', NULL][k] AS scenario, [100, NULL, NULL, 250, NULL][k] AS throughput_rps, CASE WHEN k = 4 THEN 32 END AS threads FROM (SELECT event_id, CAST(event_id % 5 AS INT) + 1 AS k FROM events) WHERE k IN (1, 4)")
def bench_parse(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.text_logs import parse_bench

    rows = B.events(spark, sf).select("event_id", Pick(_BENCH).col.alias("value"))
    return parse_bench(rows, "BENCH: ", "scenario string, throughput_rps int, threads int", "event_id")


# ---------------------------------------------------------------- monitoring
@query("prom_select", f"WITH {B.SAMPLES} SELECT ts_s, instance, tier, value FROM samples WHERE metric = 'nack_total' AND tier IN ('sync', 'batched')")
def prom_select(spark: SparkSession, sf: str) -> DataFrame:
    return M.select_series(B.samples(spark, sf), "nack_total", tier="sync|batched").select("ts_s", "instance", "tier", "value")


@query("prom_increase", f"WITH {B.DELTAS} SELECT ts_s, instance, tier, increase FROM inc WHERE metric = 'nack_total'")
def prom_increase(spark: SparkSession, sf: str) -> DataFrame:
    return M.increase(M.select_series(B.samples(spark, sf), "nack_total"), 300).select("ts_s", "instance", "tier", "increase")


@query("prom_rate", f"WITH {B.DELTAS} SELECT ts_s, instance, tier, increase / 300.0 AS rate FROM inc WHERE metric = 'nack_total'")
def prom_rate(spark: SparkSession, sf: str) -> DataFrame:
    return M.rate(M.select_series(B.samples(spark, sf), "nack_total"), 300).select("ts_s", "instance", "tier", "rate")


@query("prom_sum_by", f"WITH {B.DELTAS} SELECT ts_s, tier, sum(increase) AS value FROM inc WHERE metric = 'nack_total' GROUP BY ALL")
def prom_sum_by(spark: SparkSession, sf: str) -> DataFrame:
    return M.sum_by(M.increase(M.select_series(B.samples(spark, sf), "nack_total"), 300), "increase", "tier")


@query("prom_max_by", f"WITH {B.SAMPLES} SELECT ts_s, instance, max(value) AS value FROM samples WHERE metric = 'queue_depth' GROUP BY ALL HAVING max(value) > 50000")
def prom_max_by(spark: SparkSession, sf: str) -> DataFrame:
    return M.max_by(M.select_series(B.samples(spark, sf), "queue_depth"), "value", "instance").filter("value > 50000")


@query(
    "histogram_quantile",
    f"""WITH {B.DELTAS}, b AS (SELECT ts_s, le, CASE WHEN le = '+Inf' THEN CAST('infinity' AS DOUBLE) ELSE CAST(le AS DOUBLE) END AS bound, sum(increase) AS value FROM inc WHERE metric = 'sync_seconds_bucket' GROUP BY ALL),
    r AS (SELECT *, max(value) OVER (PARTITION BY ts_s) AS total, lag(bound, 1, 0.0) OVER (PARTITION BY ts_s ORDER BY bound) AS low, lag(value, 1, 0.0) OVER (PARTITION BY ts_s ORDER BY bound) AS under FROM b),
    h AS (SELECT *, row_number() OVER (PARTITION BY ts_s ORDER BY bound) AS k FROM r WHERE total > 0 AND value >= total * 0.9)
    SELECT ts_s, CASE WHEN isinf(bound) THEN low ELSE low + (bound - low) * CASE WHEN value > under THEN (total * 0.9 - under) / (value - under) ELSE 0.0 END END AS quantile FROM h WHERE k = 1""",
)
def histogram_quantile(spark: SparkSession, sf: str) -> DataFrame:
    grown = M.increase(M.select_series(B.samples(spark, sf), "sync_seconds_bucket"), 300)
    return M.histogram_quantile(M.sum_by(grown, "increase", "le"), 0.9)


@query(
    "latency_heatmap",
    f"""WITH {B.SAMPLES}, b AS (SELECT ts_s, le, CASE WHEN le = '+Inf' THEN CAST('infinity' AS DOUBLE) ELSE CAST(le AS DOUBLE) END AS bound, sum(value) AS value FROM samples WHERE metric = 'sync_seconds_bucket' GROUP BY ALL)
    SELECT ts_s, le, value - lag(value, 1, 0.0) OVER (PARTITION BY ts_s ORDER BY bound) AS count FROM b""",
)
def latency_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return M.latency_heatmap(M.select_series(B.samples(spark, sf), "sync_seconds_bucket"))


@query("state_code", f"WITH {B.SAMPLES} SELECT ts_s, coalesce(sum(value) FILTER (metric = 'nack_total'), 0.0) + 2 * coalesce(sum(value) FILTER (metric = 'queue_depth'), 0.0) AS code FROM samples GROUP BY 1")
def state_code(spark: SparkSession, sf: str) -> DataFrame:
    return M.state_code(B.samples(spark, sf), "nack_total", "queue_depth")


@query("fsync_per_record", f"WITH {B.SAMPLES}, p AS (SELECT ts_s, coalesce(sum(value) FILTER (metric = 'queue_depth'), 0.0) AS a, coalesce(sum(value) FILTER (metric = 'nack_total'), 0.0) AS b FROM samples GROUP BY 1) SELECT ts_s, a / greatest(b, 0.001) AS ratio FROM p")
def fsync_per_record(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda m: F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0))
    sums = B.samples(spark, sf).groupBy("ts_s").agg(part("queue_depth").alias("a"), part("nack_total").alias("b"))
    return sums.select("ts_s", M.clamped_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query("prom_or_zero", f"WITH {B.SAMPLES} SELECT coalesce(sum(value), 0.0) AS value FROM samples WHERE metric = 'absent_total'")
def prom_or_zero(spark: SparkSession, sf: str) -> DataFrame:
    return M.sum_or_zero(M.select_series(B.samples(spark, sf), "absent_total"))


@query(
    "alert_eval",
    f"""WITH {B.DELTAS}, c AS (SELECT instance, ts_s, sum(increase) > 350 AS active FROM inc WHERE metric = 'nack_total' GROUP BY ALL),
    r AS (SELECT *, count(*) FILTER (NOT active) OVER (PARTITION BY instance ORDER BY ts_s) AS run FROM c),
    s AS (SELECT instance, min(ts_s) AS pending_from, max(ts_s) AS until FROM r WHERE active GROUP BY instance, run)
    SELECT instance, pending_from, pending_from + 300 AS fires_at, until FROM s WHERE until - pending_from >= 300""",
)
def alert_eval(spark: SparkSession, sf: str) -> DataFrame:
    grown = M.sum_by(M.increase(M.select_series(B.samples(spark, sf), "nack_total"), 300), "increase", "instance")
    return M.alert_firing(grown.select("instance", "ts_s", (F.col("value") > 350).alias("active")), 300, "instance")


@query("outage_headroom", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN 53687091200 / ((event_id % 10) * 1000.0 * 256) / 3600 END AS hours FROM events")
def outage_headroom(spark: SparkSession, sf: str) -> DataFrame:
    return B.events(spark, sf).select("event_id", M.outage_headroom(F.lit(53687091200), F.col("event_id") % 10 * 1000.0, F.lit(256)).alias("hours"))


# ---------------------------------------------------------------- benchmark statistics
_SAMPLES = "us AS (SELECT event_type AS scenario, event_id * 7919 % 100003 AS us FROM events)"


def _micros(spark: SparkSession, sf: str) -> DataFrame:
    return B.events(spark, sf).select(F.col("event_type").alias("scenario"), (F.col("event_id") * 7919 % 100003).alias("us"))


@query(
    "latency_percentiles",
    f"""WITH {_SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY us) - 1 AS k, count(*) OVER (PARTITION BY scenario) AS n FROM us)
    SELECT scenario, p, us FROM r, (VALUES (50.0::DOUBLE), (75.0::DOUBLE), (95.0::DOUBLE), (99.0::DOUBLE), (99.9::DOUBLE)) v(p) WHERE k = least(CAST(floor(n * p / 100) AS BIGINT), n - 1)""",
)
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return N.percentiles(_micros(spark, sf), (50.0, 75.0, 95.0, 99.0, 99.9))


@query(
    "latency_int_stats",
    f"""WITH {_SAMPLES}, m AS (SELECT scenario, CAST(sum(us) // count(*) AS BIGINT) AS mean_us FROM us GROUP BY 1)
    SELECT scenario, mean_us, CAST(floor(sqrt(CAST(sum((us - mean_us) * (us - mean_us)) // count(*) AS DOUBLE))) AS BIGINT) AS stddev_us FROM us JOIN m USING (scenario) GROUP BY 1, 2""",
)
def latency_int_stats(spark: SparkSession, sf: str) -> DataFrame:
    return N.integer_stats(_micros(spark, sf))


@query("throughput", "SELECT event_type AS scenario, event_id AS run, CAST(floor((event_id % 1000 + 1) / ((user_id % 50 + 1) / 1000.0)) AS BIGINT) AS rps FROM events")
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select(F.col("event_type").alias("scenario"), F.col("event_id").alias("run"), (F.col("event_id") % 1000 + 1).alias("records"), (F.col("user_id") % 50 + 1).alias("wall_ms"))
    return N.throughput(rows)


_RUNS = "runs AS (SELECT 's' || CAST(CASE WHEN event_id = 77 THEN -1 ELSE user_id % 6 END AS VARCHAR) AS scenario, event_id * 13 % 5000 AS rps FROM events)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    s = F.when(F.col("event_id") == 77, -1).otherwise(F.col("user_id") % 6).cast("string")
    return B.events(spark, sf).select(F.concat(F.lit("s"), s).alias("scenario"), (F.col("event_id") * 13 % 5000).alias("rps"))


@query("bench_avg", f"WITH {_RUNS} SELECT scenario, avg(rps) AS mean_rps, CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_pop(rps) END AS stddev_rps, count(*) AS runs FROM runs GROUP BY 1")
def bench_avg(spark: SparkSession, sf: str) -> DataFrame:
    return N.averages(_runs(spark, sf))


@query(
    "bench_pivot",
    """WITH r AS (SELECT ['sync', 'batched', 'buffered'][CAST(event_id % 3 AS INT) + 1] AS tier, CASE WHEN user_id % 2 = 0 THEN 'd1ms' ELSE 'd2ms' END AS deadline, event_id * 13 % 5000 AS rps FROM events),
    w AS (SELECT tier, avg(rps) FILTER (deadline = 'd1ms') AS d1ms, avg(rps) FILTER (deadline = 'd2ms') AS d2ms FROM r GROUP BY 1)
    SELECT tier, d1ms, d2ms, d1ms / d2ms AS ratio, CAST(list_position(['sync', 'batched', 'buffered'], tier) AS INT) AS place FROM w""",
)
def bench_pivot(spark: SparkSession, sf: str) -> DataFrame:
    tier = Pick(["sync", "batched", "buffered"]).col
    rows = B.events(spark, sf).select(tier.alias("tier"), F.when(F.col("user_id") % 2 == 0, "d1ms").otherwise("d2ms").alias("deadline"), (F.col("event_id") * 13 % 5000).alias("rps"))
    return N.deadline_pivot(rows)


_LEVELS = "lv AS (SELECT threads, avg(rps) AS rps, avg(io_errors) > 0 AS saturated FROM (SELECT (event_id % 16 + 1) * 8 AS threads, event_id * 13 % 5000 + (event_id % 16) * 100 AS rps, CASE WHEN event_id % 16 IN (9, 12, 15) THEN user_id % 3 ELSE 0 END AS io_errors FROM events) GROUP BY 1)"


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    rows = B.events(spark, sf).select(((e % 16 + 1) * 8).alias("threads"), (e * 13 % 5000 + e % 16 * 100).alias("rps"), F.when((e % 16).isin(9, 12, 15), F.col("user_id") % 3).otherwise(0).alias("io_errors"))
    return N.ramp_levels(rows)


@query("first_saturated", f"WITH {_LEVELS} SELECT min(threads) FILTER (saturated) AS threads FROM lv")
def first_saturated(spark: SparkSession, sf: str) -> DataFrame:
    return N.first_saturated(_levels(spark, sf))


@query("ramp_peak", f"WITH {_LEVELS} SELECT max(threads) AS threads, arg_max(rps, threads) AS rps FROM lv WHERE NOT saturated AND threads BETWEEN 8 AND 96")
def ramp_peak(spark: SparkSession, sf: str) -> DataFrame:
    return N.ramp_peak(_levels(spark, sf))


@query(
    "stage_breakdown",
    """WITH s AS (SELECT event_type AS scenario, avg(event_id % 7) AS queue_us, avg(event_id % 5) AS bridge_us, avg(event_id % 20) AS write_us, avg(event_id % 20 + 150) AS total_us FROM events GROUP BY 1)
    SELECT *, total_us - queue_us - bridge_us - write_us AS sync_us FROM s""",
)
def stage_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    rows = B.events(spark, sf).select(F.col("event_type").alias("scenario"), (e % 7).alias("queue_us"), (e % 5).alias("bridge_us"), (e % 20).alias("write_us"), (e % 20 + 150).alias("total_us"))
    return N.stage_breakdown(rows)


@query("bench_history", f"WITH {_RUNS} SELECT 0 AS run, 's0' AS scenario, 1.0 AS mean_rps UNION ALL SELECT 1, scenario, avg(rps) FROM runs GROUP BY scenario")
def bench_history(spark: SparkSession, sf: str) -> DataFrame:
    past = spark.range(1).select(F.lit(0).alias("run"), F.lit("s0").alias("scenario"), F.lit(1.0).alias("mean_rps"))
    return N.append_history(past, N.averages(_runs(spark, sf)).select(F.lit(1).alias("run"), "scenario", "mean_rps"))


@query(
    "sweep_median",
    """WITH t AS (SELECT user_id % 6 + 1 AS agents, event_id * 13 % 5000 AS rps FROM events), l AS (SELECT agents, list_sort(list(rps)) AS v, min(rps) AS min_rps, max(rps) AS max_rps FROM t GROUP BY 1)
    SELECT agents, v[CAST(len(v) // 2 + 1 AS INT)] AS median_rps, min_rps, max_rps, agents / 4.0 AS agents_per_core FROM l""",
)
def sweep_median(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select((F.col("user_id") % 6 + 1).alias("agents"), (F.col("event_id") * 13 % 5000).alias("rps"))
    return N.sweep_median(rows, 4)


# ---------------------------------------------------------------- invariants
@query("false_acks", f"WITH {B.RECORDS} SELECT a.seq, sha256(a.payload) AS payload_hash FROM records a WHERE a.seq % 101 = 7 AND sha256(a.payload) NOT IN (SELECT sha256(payload) FROM records WHERE seq % 101 <> 7)")
def false_acks(spark: SparkSession, sf: str) -> DataFrame:
    acked = B.records(spark, sf).select("seq", F.sha2("payload", 256).alias("payload_hash"))
    return T.false_acks(acked, acked.filter("seq % 101 <> 7")).select("seq", "payload_hash")


_POS = "st AS (SELECT conn_id, seq, CASE WHEN seq % 50 = 3 THEN seq - 5000 ELSE seq END AS pos FROM records)"


@query("order_violations", f"WITH {B.RECORDS}, {_POS} SELECT conn_id, seq, pos FROM (SELECT *, lag(pos) OVER (PARTITION BY conn_id ORDER BY seq) AS b FROM st) WHERE pos < b")
def order_violations(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.when(F.col("seq") % 50 == 3, F.col("seq") - 5000).otherwise(F.col("seq"))
    return T.order_violations(B.records(spark, sf).select("conn_id", "seq", pos.alias("pos")))


@query("group_ack_outcome", "SELECT event_id // 20 AS batch, event_id AS seq, CASE WHEN event_id % 20 < 5 THEN true WHEN event_id % 20 = 19 THEN false ELSE event_id // 20 % 7 <> 0 END AS acked FROM events")
def group_ack_outcome(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    batch = F.floor(e / 20).cast("long")
    rows = B.events(spark, sf).select(batch.alias("batch"), e.alias("seq"), (e % 20 < 5).alias("rotated"), (e % 20 == 19).alias("dropped"))
    return T.group_acks(rows, rows.select("batch").filter("batch % 7 = 0"))


@query("recovered_difference", f"WITH {B.RECORDS} SELECT seq, CASE WHEN seq % 200 = 9 THEN 'lost' ELSE 'extra' END AS side FROM records WHERE seq % 200 IN (9, 11)")
def recovered_difference(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.records(spark, sf).select("seq")
    return T.recovered_difference(rows.filter("seq % 200 <> 9"), rows.filter("seq % 200 <> 11"))


@query(
    "session_counters",
    """WITH s AS (SELECT 'i' || CAST(user_id % 3 AS VARCHAR) AS instance, event_id AS ts_s, event_id % 500 AS accepted, CASE WHEN event_id // 500 % 4 = 2 THEN event_id % 500 + 1 ELSE event_id % 500 // 2 END AS acked FROM events),
    f AS (SELECT *, CASE WHEN accepted < lag(accepted) OVER (PARTITION BY instance ORDER BY ts_s) THEN 1 ELSE 0 END AS fell FROM s),
    g AS (SELECT *, sum(fell) OVER (PARTITION BY instance ORDER BY ts_s) AS session FROM f)
    SELECT instance, CAST(session AS BIGINT) AS session, max(accepted) AS accepted, max(acked) AS acked FROM g GROUP BY ALL HAVING max(acked) > max(accepted)""",
)
def session_counters(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    acked = F.when(F.floor(e / 500) % 4 == 2, e % 500 + 1).otherwise(F.floor(e % 500 / 2)).cast("long")
    return T.session_counters(B.events(spark, sf).select(F.concat(F.lit("i"), (F.col("user_id") % 3).cast("string")).alias("instance"), e.alias("ts_s"), (e % 500).alias("accepted"), acked.alias("acked")))
