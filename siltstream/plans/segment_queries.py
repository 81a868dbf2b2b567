"""Segments, recovery and delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import codec
from ..operators import drain as D
from ..operators import recovery as V
from ..operators import segments as S
from . import base as B
from .base import Pick, query

_SEG = f"WITH RECURSIVE {B.SEGMENTS}"


@query("segment_rotate", f"{_SEG} SELECT shard_id, seq, CAST(seg_no AS BIGINT) AS seg_no, sealed FROM seg")
def segment_rotate(spark: SparkSession, sf: str) -> DataFrame:
    return S.rotate(B.records(spark, sf), B.SEGMENT_BYTES).select("shard_id", "seq", "seg_no", "sealed")


@query("segment_footer", f"{_SEG} SELECT shard_id, CAST(seg_no AS BIGINT) AS seg_no, count(*) AS record_count, CAST(sum(octet_length(payload)) AS BIGINT) AS data_bytes FROM seg GROUP BY ALL")
def segment_footer(spark: SparkSession, sf: str) -> DataFrame:
    return S.footers(B.segmented(spark, sf))


@query("segment_size_estimate", f"{_SEG} SELECT shard_id, CAST(seg_no AS BIGINT) AS seg_no, CAST(sum(size) + 60 AS BIGINT) AS file_bytes FROM seg GROUP BY ALL")
def segment_size_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return S.size_estimate(B.segmented(spark, sf))


@query(
    "segment_file_crc",
    f"""{_SEG}, {B.CRC_TABLE}, rec AS (SELECT shard_id, seg_no, seq, {B.sql_le("octet_length(payload)", 4)} || {B.sql_le(B.sql_crc("payload"), 4)} || hex(payload) AS h FROM seg, crc_t),
    body AS (SELECT shard_id, seg_no, '574549520100' || {B.sql_le("shard_id", 2)} || repeat('00', 16) || string_agg(h, '' ORDER BY seq) AS h FROM rec GROUP BY shard_id, seg_no)
    SELECT shard_id, CAST(seg_no AS BIGINT) AS seg_no, {B.sql_crc("unhex(h)")} AS file_crc32 FROM body, crc_t""",
)
def segment_file_crc(spark: SparkSession, sf: str) -> DataFrame:
    return S.file_crcs(B.segmented(spark, sf))


@query(
    "records_per_commit",
    f"""{_SEG}, per AS (SELECT shard_id, seg_no, count(*) AS n, (count(*) + 99) // 100 AS c FROM seg WHERE sealed GROUP BY ALL)
    SELECT shard_id, count(*) AS segments, CAST(sum(n) AS BIGINT) AS records, CAST(sum(c) AS BIGINT) AS commits, round(sum(n) / sum(c), 6) AS records_per_commit FROM per GROUP BY 1""",
)
def records_per_commit(spark: SparkSession, sf: str) -> DataFrame:
    return D.records_per_commit(D.sub_batches(B.segmented(spark, sf), 100))


@query("sub_batches", f"{_SEG} SELECT shard_id, CAST(seg_no AS BIGINT) AS seg_no, seq, (row_number() OVER (PARTITION BY shard_id, seg_no ORDER BY seq) - 1) // 50 AS batch_no FROM seg")
def sub_batches(spark: SparkSession, sf: str) -> DataFrame:
    return D.sub_batches(B.segmented(spark, sf), 50).select("shard_id", "seg_no", "seq", "batch_no")


@query(
    "dedup_token",
    f"""{_SEG}, b AS (SELECT shard_id, seg_no, seq, (row_number() OVER (PARTITION BY shard_id, seg_no ORDER BY seq) - 1) // 50 AS batch_no,
        {B.sql_le("octet_length(payload)", 8)} || hex(payload) AS h FROM seg)
    SELECT shard_id, CAST(seg_no AS BIGINT) AS seg_no, batch_no, sha256(unhex(string_agg(h, '' ORDER BY seq))) AS token FROM b GROUP BY ALL""",
)
def dedup_token(spark: SparkSession, sf: str) -> DataFrame:
    return D.dedup_tokens(D.sub_batches(B.segmented(spark, sf), 50))


@query(
    "ndjson_partition",
    f"""{_SEG}, b AS (SELECT shard_id, seg_no, seq, (row_number() OVER (PARTITION BY shard_id, seg_no ORDER BY seq) - 1) // 50 AS batch_no,
        CASE WHEN seq % 11 = 0 THEN encode(decode(payload) || chr(10)) ELSE payload END AS payload FROM seg),
    m AS (SELECT *, seq % 11 = 0 OR contains(decode(payload), chr(10)) OR contains(decode(payload), chr(13)) AS bad FROM b)
    SELECT shard_id, CAST(seg_no AS BIGINT) AS seg_no, batch_no, count(*) FILTER (NOT bad) AS framed, count(*) FILTER (bad) AS rejected,
        'sha256:' || sha256(coalesce(unhex(string_agg(hex(payload), '0A' ORDER BY seq) FILTER (NOT bad)), encode(''))) AS idempotency_key
    FROM m GROUP BY ALL""",
)
def ndjson_partition(spark: SparkSession, sf: str) -> DataFrame:
    batched = D.sub_batches(B.segmented(spark, sf), 50)
    marked = batched.withColumn("payload", F.when(F.col("seq") % 11 == 0, F.concat("payload", F.lit(b"\n"))).otherwise(F.col("payload")))
    return D.ndjson_batches(marked)


@query("idempotency_key", f"WITH {B.RECORDS} SELECT seq, 'sha256:' || sha256(payload) AS key FROM records")
def idempotency_key(spark: SparkSession, sf: str) -> DataFrame:
    return B.records(spark, sf).select("seq", K.idempotency_key(F.col("payload")).alias("key"))


@query(
    "rowbinary_encode",
    """WITH p AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT doc_id, b, octet_length(b) AS n FROM p)
    SELECT doc_id, sha256(unhex(CASE WHEN n < 128 THEN lpad(upper(to_hex(n)), 2, '0')
        WHEN n < 16384 THEN upper(to_hex((n & 127) + 128)) || lpad(upper(to_hex(n >> 7)), 2, '0')
        ELSE upper(to_hex((n & 127) + 128)) || upper(to_hex(((n >> 7) & 127) + 128)) || lpad(upper(to_hex(n >> 14)), 2, '0') END || hex(b))) AS row_sha256 FROM n""",
)
def rowbinary_encode(spark: SparkSession, sf: str) -> DataFrame:
    docs = B.table(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("b"))
    return docs.select("doc_id", F.sha2(codec.row_binary(F.col("b")), 256).alias("row_sha256"))


_STATE = "CASE WHEN name LIKE '%.wab.confirmed' THEN 'confirmed' WHEN name LIKE '%.wab.sealed' THEN 'sealed' WHEN name LIKE '%.wab' THEN 'active' END"


@query("segment_listing", f"WITH {B.FILES} SELECT shard, name, {_STATE} AS state, count(*) AS n FROM files WHERE {_STATE} IS NOT NULL GROUP BY ALL")
def segment_listing(spark: SparkSession, sf: str) -> DataFrame:
    files = B.segment_files(spark, sf).select("shard", "name", S.segment_state(F.col("name")).alias("state"))
    return files.filter("state is not null").groupBy("shard", "name", "state").agg(F.count("*").alias("n")).orderBy("shard", "name")


@query(
    "next_segment_no",
    f"""WITH {B.FILES} SELECT CAST(substr(shard, 7) AS BIGINT) AS shard_no, coalesce(max(TRY_CAST(nullif(regexp_extract(name, '^seg_([0-9]+)\\.wab', 1), '') AS BIGINT)), -1) + 1 AS next_no
    FROM files WHERE shard LIKE 'shard\\_%' ESCAPE '\\' GROUP BY 1""",
)
def next_segment_no(spark: SparkSession, sf: str) -> DataFrame:
    return S.next_segment_numbers(B.segment_files(spark, sf))


@query(
    "confirmed_parse",
    f"""WITH {B.CRC_TABLE}, h AS (SELECT event_id, '57434F4E01000000' || {B.sql_le("event_id * 1000", 8)} || {B.sql_le("user_id", 8)} || {B.sql_le("event_id", 8)} AS h FROM events)
    SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'bad_length' WHEN 2 THEN 'bad_magic' WHEN 3 THEN 'bad_version' WHEN 4 THEN 'bad_crc' ELSE 'ok' END AS verdict,
        h || {B.sql_le(B.sql_crc("unhex(h)"), 4)} AS good_hex FROM h, crc_t""",
)
def confirmed_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select("event_id", S.confirmed_bytes(F.col("event_id") * 1000, F.col("user_id"), F.col("event_id")).alias("good"))
    text, k = F.hex("good"), F.col("event_id") % 5
    damaged = (
        F.when(k == 1, F.concat(text, F.lit("00")))
        .when(k == 2, F.overlay(text, F.lit("58"), 1))
        .when(k == 3, F.overlay(text, F.lit("07"), 9))
        .when(k == 4, F.concat(F.substring(text, 1, 14), F.lit("FF"), F.substring(text, 17, 56)))
        .otherwise(text)
    )
    return rows.select("event_id", F.unhex(damaged).alias("data"), text.alias("good_hex")).select("event_id", S.confirmed_verdict(F.col("data")).alias("verdict"), "good_hex")


@query("ewma_fsync", """WITH RECURSIVE s AS (SELECT user_id % 4 AS shard_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS rn, event_id * 37 % 9000 AS sample_us FROM events),
    w AS (SELECT shard_id, rn, CAST(sample_us // 4 AS BIGINT) AS cur FROM s WHERE rn = 1
        UNION ALL SELECT s.shard_id, s.rn, CAST(w.cur * 3 // 4 + s.sample_us // 4 AS BIGINT) FROM w JOIN s ON s.shard_id = w.shard_id AND s.rn = w.rn + 1)
    SELECT shard_id, arg_max(cur, rn) AS raw_us, least(greatest(arg_max(cur, rn), 50), 2000) AS window_us FROM w GROUP BY 1""")
def ewma_fsync(spark: SparkSession, sf: str) -> DataFrame:
    samples = B.events(spark, sf).select((F.col("user_id") % 4).alias("shard_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 9000).alias("sample_us"))
    return S.smoothed_sync_latency(samples)


@query(
    "idle_seal",
    """SELECT shard_id, at_ms, at_ms + 400 AS sealed_ms FROM (SELECT user_id % 4 AS shard_id, event_id * 97 AS at_ms, lead(event_id * 97) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS next_ms FROM events)
    WHERE next_ms - at_ms >= 400""",
)
def idle_seal(spark: SparkSession, sf: str) -> DataFrame:
    writes = B.events(spark, sf).select((F.col("user_id") % 4).alias("shard_id"), (F.col("event_id") * 97).alias("at_ms"))
    return S.idle_seals(writes, 400).select("shard_id", "at_ms", "sealed_ms")


_FAULTS, _COPIED = ["none", "bad_header", "torn_tail", "crc_mismatch", "oversize", "oversize"], [True, True, False]


@query(
    "recovery_class",
    f"""WITH f AS (SELECT event_id, {Pick(_FAULTS).sql} AS fault, event_id % 4 * 10 AS rest, {Pick(_COPIED, 6).sql} AS copied FROM events)
    SELECT event_id, CASE WHEN fault = 'bad_header' THEN 'quarantine' WHEN fault = 'crc_mismatch' OR (fault = 'oversize' AND rest > 0) THEN CASE WHEN copied THEN 'copy_and_truncate' ELSE 'untouched' END
        WHEN fault = 'none' THEN 'seal' ELSE 'truncate' END AS action FROM f""",
)
def recovery_class(spark: SparkSession, sf: str) -> DataFrame:
    e = B.events(spark, sf).select("event_id", Pick(_FAULTS).col.alias("fault"), (F.col("event_id") % 4 * 10).alias("trailing"), Pick(_COPIED, 6).col.alias("copied"))
    return e.select("event_id", V.recovery_class(F.col("fault"), F.col("trailing"), F.col("copied")).alias("action"))


_LEDGER = "foot AS (SELECT shard_id, CAST(seg_no AS BIGINT) AS seg_no, count(*) AS record_count FROM seg WHERE sealed GROUP BY ALL), conf AS (SELECT * FROM foot WHERE (seg_no * 7 + shard_id) % 3 = 0)"


def _sealed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from_footers = S.footers(B.segmented(spark, sf).filter("sealed"))
    return from_footers, from_footers.filter("(seg_no * 7 + shard_id) % 3 = 0")


@query("replay_unconfirmed", f"{_SEG}, {_LEDGER} SELECT shard_id, count(*) AS segments, CAST(sum(record_count) AS BIGINT) AS records FROM foot WHERE (shard_id, seg_no) NOT IN (SELECT (shard_id, seg_no) FROM conf) GROUP BY 1")
def replay_unconfirmed(spark: SparkSession, sf: str) -> DataFrame:
    return V.replay_counts(*_sealed(spark, sf))


@query("confirmed_state", f"{_SEG}, {_LEDGER} SELECT shard_id, seg_no, CASE WHEN (seg_no * 7 + shard_id) % 3 <> 0 THEN 'replay' WHEN seg_no % 5 = 0 THEN 'quarantine' ELSE 'skip' END AS action FROM foot")
def confirmed_state(spark: SparkSession, sf: str) -> DataFrame:
    sealed, confirmed = _sealed(spark, sf)
    sidecars = confirmed.select("shard_id", "seg_no", F.when(F.col("seg_no") % 5 == 0, "bad_crc").otherwise("ok").alias("verdict"))
    return V.confirmed_state(sealed, sidecars)


@query(
    "quarantine_names",
    f"""WITH {B.FILES}, n AS (SELECT *, row_number() OVER (PARTITION BY shard, name ORDER BY arrival) - 1 AS k FROM files)
    SELECT shard, name, arrival, shard || '__' || name || CASE WHEN k = 0 THEN '' ELSE '.' || CAST(k AS VARCHAR) END AS target FROM n""",
)
def quarantine_names(spark: SparkSession, sf: str) -> DataFrame:
    return V.quarantine_names(B.segment_files(spark, sf))


@query("mode_audit", f"WITH {B.FILES} SELECT mode, count(*) AS files FROM files WHERE mode <> 384 GROUP BY 1")
def mode_audit(spark: SparkSession, sf: str) -> DataFrame:
    return V.mode_audit(B.segment_files(spark, sf))


@query("wab_bytes", f"WITH {B.FILES} SELECT CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE shard NOT IN ('quarantine', 'dead_letter') AND {_STATE} IN ('active', 'sealed')")
def wab_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return V.bytes_on_disk(B.segment_files(spark, sf))


_OUT_ERRORS = [None, "timeout", "transient", "permanent", None]
_ATTEMPTS = f"att AS (SELECT event_id AS batch, event_id % 100 + 1 AS records, CASE WHEN event_id % 3 = 0 THEN event_id % 7 % (event_id % 100 + 1) ELSE 0 END AS rejected, {Pick(_OUT_ERRORS).sql} AS error FROM events)"
_OUTCOMES = f"""{_ATTEMPTS}, outc AS (SELECT batch, records, CASE WHEN error IN ('timeout', 'transient') THEN 'retry' WHEN error = 'permanent' THEN 'dead_letter_all' WHEN rejected > 0 THEN 'commit_with_rejects' ELSE 'commit' END AS outcome,
    CASE WHEN error IS NULL THEN records - rejected ELSE 0 END AS committed, CASE WHEN error = 'permanent' THEN records WHEN error IS NULL THEN rejected ELSE 0 END AS dead_lettered FROM att)"""


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    n = e % 100 + 1
    return B.events(spark, sf).select(e.alias("batch"), n.alias("records"), F.when(e % 3 == 0, e % 7 % n).otherwise(0).alias("rejected"), Pick(_OUT_ERRORS).col.alias("error"))


@query("commit_outcome", f"WITH {_OUTCOMES} SELECT batch, outcome, committed, dead_lettered FROM outc")
def commit_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return D.commit_outcomes(_attempts(spark, sf))


@query("count_coverage", f"WITH {_OUTCOMES} SELECT batch, records, CAST(committed - batch % 2 AS BIGINT) AS committed, CAST(dead_lettered AS BIGINT) AS dead_lettered FROM outc WHERE committed - batch % 2 + dead_lettered <> records")
def count_coverage(spark: SparkSession, sf: str) -> DataFrame:
    att = _attempts(spark, sf)
    out = D.commit_outcomes(att).join(att.select("batch", "records"), "batch").withColumn("committed", F.col("committed") - F.col("batch") % 2)
    return D.uncovered_batches(out)


@query("sink_noop_commit", f"WITH {B.RECORDS} SELECT shard_id, count(*) AS committed, 0 AS rejected FROM records GROUP BY 1")
def sink_noop_commit(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.sinks import NoopSink

    out = NoopSink().commit(B.records(spark, sf))
    return out.groupBy("shard_id").agg(F.count(F.when(F.col("outcome") == "committed", 1)).alias("committed"), F.count(F.when(F.col("outcome") != "committed", 1)).cast("int").alias("rejected"))


@query("segment_complete", f"{_SEG}, {_LEDGER} SELECT shard_id, seg_no, record_count, record_count - CASE WHEN seg_no % 4 = 1 THEN 1 ELSE 0 END AS rows_read, CASE WHEN seg_no % 4 = 1 THEN 'quarantine' ELSE 'deliver' END AS action FROM foot")
def segment_complete(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = B.segmented(spark, sf).filter("sealed")
    first = F.row_number().over(Window.partitionBy("shard_id", "seg_no").orderBy("seq")) == 1
    damaged = rows.withColumn("_first", first).filter(~(F.col("_first") & (F.col("seg_no") % 4 == 1)))
    return D.segment_completeness(S.footers(rows).drop("data_bytes"), damaged)


@query(
    "retry_schedule",
    """SELECT event_id AS batch, a AS attempt, least(CASE WHEN event_id % 3 = 0 THEN event_id % 500 * 1000 ELSE 250 * CAST(pow(2, a) AS BIGINT) END, 300000) AS wait_ms, a = 12 AS then_strands
    FROM events, range(13) r(a)""",
)
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return D.retry_schedule(B.events(spark, sf).select(e.alias("batch"), F.when(e % 3 == 0, e % 500 * 1000).alias("hint_ms")), 12, 250)


@query("resume_cursor", f"{_SEG}, n AS (SELECT shard_id, CAST(seg_no AS BIGINT) AS seg_no, seq, row_number() OVER (PARTITION BY shard_id, seg_no ORDER BY seq) AS idx FROM seg) SELECT shard_id, seg_no, seq, idx FROM n WHERE idx > CASE WHEN seg_no % 3 = 0 THEN 0 ELSE seg_no % 3 * 40 END")
def resume_cursor(spark: SparkSession, sf: str) -> DataFrame:
    seg = B.segmented(spark, sf)
    ledger = seg.filter("seg_no % 3 <> 0").select("shard_id", "seg_no", (F.col("seg_no") % 3 * 40).alias("processed")).distinct()
    return D.after_cursor(seg, ledger).select("shard_id", "seg_no", "seq", "idx")


@query(
    "resume_stranded",
    f"""{_SEG}, {_LEDGER} SELECT shard_id, seg_no FROM foot WHERE (seg_no * 7 + shard_id) % 3 <> 0 AND seg_no % 4 <> 0 AND seg_no % 5 <> 0""",
)
def resume_stranded(spark: SparkSession, sf: str) -> DataFrame:
    sealed, confirmed = _sealed(spark, sf)
    waiting = V.unconfirmed(sealed, confirmed)
    return D.stranded_to_resume(waiting.select("shard_id", "seg_no"), waiting.filter("seg_no % 4 = 0"), waiting.filter("seg_no % 5 = 0"))


_GATE = "g AS (SELECT user_id % 8 AS stream, event_id AS seq, event_id * 53 % 900 + CASE WHEN event_id % 211 = 0 THEN 60000 ELSE 0 END AS bytes, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS rn FROM events)"


def _gate_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    size = e * 53 % 900 + F.when(e % 211 == 0, 60000).otherwise(0)
    return B.events(spark, sf).select((F.col("user_id") % 8).alias("stream"), e.alias("seq"), size.alias("bytes"))


@query(
    "dead_letter_gate",
    f"""WITH RECURSIVE {_GATE}, w AS (
        SELECT stream, rn, seq, bytes, CASE WHEN bytes <= 50000 OR bytes > 50000 THEN bytes ELSE 0 END AS total, true AS written FROM g WHERE rn = 1
        UNION ALL SELECT g.stream, g.rn, g.seq, g.bytes, CASE WHEN w.total + g.bytes <= 50000 OR g.bytes > 50000 THEN w.total + g.bytes ELSE w.total END, w.total + g.bytes <= 50000 OR g.bytes > 50000
        FROM w JOIN g ON g.stream = w.stream AND g.rn = w.rn + 1)
    SELECT stream, seq, bytes, CASE WHEN written THEN 'write' ELSE 'block' END AS decision, total FROM w""",
)
def dead_letter_gate(spark: SparkSession, sf: str) -> DataFrame:
    return D.dead_letter_gate(_gate_rows(spark, sf), 50_000)


@query("dead_letter_segments", f"WITH {_GATE} SELECT stream, count(*) AS records, CAST(sum(bytes + 8) + 60 AS BIGINT) AS file_bytes, 65535 AS shard_id FROM g WHERE seq % 10 = 3 GROUP BY 1")
def dead_letter_segments(spark: SparkSession, sf: str) -> DataFrame:
    bad = _gate_rows(spark, sf).filter("seq % 10 = 3").groupBy("stream").agg(F.count("*").alias("records"), D.batch_bytes(F.col("bytes")).alias("file_bytes"))
    return bad.select("stream", "records", "file_bytes", F.lit(S.DEAD_LETTER_SHARD).alias("shard_id"))


_STATES = ["draining", "blocked", "retrying", "blocked", "retrying", "blocked", "draining"]


@query(
    "block_episodes",
    f"""WITH s AS (SELECT user_id % 8 AS stream, event_id AS t, {Pick(_STATES, 9).sql} AS state FROM events), e AS (SELECT *, count(*) FILTER (state = 'draining') OVER (PARTITION BY stream ORDER BY t) AS era FROM s)
    SELECT stream, min(t) AS began, max(t) AS last_seen, count(*) AS observations FROM e WHERE state = 'blocked' GROUP BY stream, era""",
)
def block_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return D.block_episodes(B.events(spark, sf).select((F.col("user_id") % 8).alias("stream"), F.col("event_id").alias("at"), Pick(_STATES, 9).col.alias("state")))


@query("one_hot_state", "SELECT event_id AS stream, l AS label, CASE WHEN l = ['draining', 'retrying', 'blocked'][CAST(event_id % 3 AS INT) + 1] THEN 1 ELSE 0 END AS value FROM events, (VALUES ('draining'), ('retrying'), ('blocked')) v(l)")
def one_hot_state(spark: SparkSession, sf: str) -> DataFrame:
    states = ("draining", "retrying", "blocked")
    return D.one_hot_states(B.events(spark, sf).select(F.col("event_id").alias("stream"), Pick(list(states)).col.alias("state")), states)


_RESULTS = ["transient", "full", "transient", "transient", "ok", "transient", "transient"]


@query(
    "drain_trace",
    f"""WITH a AS (SELECT user_id % 50 AS segment, event_id AS n, {Pick(_RESULTS).sql} AS result FROM events),
    b AS (SELECT *, count(*) FILTER (result = 'transient') OVER (PARTITION BY segment ORDER BY n) AS f FROM a),
    c AS (SELECT *, CASE WHEN result = 'ok' THEN 'confirmed' WHEN result = 'full' THEN 'blocked' WHEN f > 4 THEN 'stranded' ELSE 'retrying' END AS state FROM b),
    d AS (SELECT *, coalesce(count(*) FILTER (state IN ('confirmed', 'stranded')) OVER (PARTITION BY segment ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM c)
    SELECT segment, n, result, state FROM d WHERE ended = 0""",
)
def drain_trace(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select((F.col("user_id") % 50).alias("segment"), F.col("event_id").alias("n"), Pick(_RESULTS).col.alias("result"))
    return D.drain_trace(rows, 4)


# ---------------------------------------------------------------- whole files, read back
def _files(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.segment_files import segment_bytes

    return segment_bytes(B.segmented(spark, sf).filter("sealed"))


def _inverted(text: Column, at: Column) -> Column:
    """A hex text with the byte at ``at`` inverted: another byte whatever it was."""
    byte = F.translate(F.substring(text, 2 * at + 1, F.lit(2)), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.concat(F.substring(text, F.lit(1), 2 * at), byte, F.substring(text, 2 * at + 3, F.length(text)))


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Sealed files, damaged in one of nine ways by their number."""
    h, k, n = F.hex("data"), F.col("seg_no") % 10, F.octet_length("data")
    cut = lambda drop: F.substring(h, F.lit(1), 2 * (n - drop))
    bad = (
        F.when(k == 1, F.substring(h, 1, 20))
        .when(k == 2, _inverted(h, F.lit(0)))
        .when(k == 3, cut(36))
        .when(k == 4, _inverted(h, F.lit(32)))
        .when(k == 5, cut(32))
        .when(k == 6, _inverted(h, n - 13))  # the file's checksum
        .when(k == 7, _inverted(h, n - 32))  # the count
        .when(k == 8, _inverted(h, n - 24))  # the bytes
        .when(k == 9, F.concat(h, F.lit("00")))
        .otherwise(h)
    )
    return _files(spark, sf).select("shard_id", "seg_no", F.unhex(bad).alias("data"))


@query("segment_scan", f"{_SEG} SELECT shard_id, CAST(seg_no AS BIGINT) AS seg_no, row_number() OVER (PARTITION BY shard_id, seg_no ORDER BY seq) - 1 AS idx, hex(payload) AS payload_hex FROM seg WHERE sealed")
def segment_scan(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.segment_files import scan_segments

    return scan_segments(_files(spark, sf), "shard_id", "seg_no").select("shard_id", "seg_no", "idx", F.hex("payload").alias("payload_hex"))


@query(
    "segment_verify",
    f"""{_SEG}, {_LEDGER} SELECT shard_id, seg_no, ['ok', 'TooShort', 'Header', 'NoSentinel', 'BadRecord', 'MissingFooter', 'CrcMismatch', 'FooterMismatch(count)', 'FooterMismatch(bytes)', 'TrailingBytes'][CAST(seg_no % 10 AS INT) + 1] AS verdict,
        CASE WHEN seg_no % 10 IN (1, 2, 4) THEN 0 ELSE record_count END AS records FROM foot""",
)
def segment_verify(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.segment_files import verify_segments

    return verify_segments(_damaged(spark, sf), "shard_id", "seg_no").select("shard_id", "seg_no", "verdict", "records")


@query(
    "reader_prefix",
    f"{_SEG}, {_LEDGER} SELECT shard_id, seg_no, CASE WHEN seg_no % 10 IN (1, 2, 4) THEN 0 ELSE record_count END AS good, CASE WHEN seg_no % 10 IN (1, 2) THEN 'header' WHEN seg_no % 10 = 4 THEN 'bad_crc' END AS error FROM foot",
)
def reader_prefix(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.segment_files import scan_segments

    rows = scan_segments(_damaged(spark, sf), "shard_id", "seg_no")
    return rows.groupBy("shard_id", "seg_no").agg(F.count("payload").alias("good"), F.max("error").alias("error"))


@query(
    "recover_prefix",
    f"""{_SEG}, {_LEDGER} SELECT shard_id, seg_no, CASE WHEN seg_no % 10 IN (1, 2, 4) THEN 0 ELSE record_count END AS records,
        CASE seg_no % 10 WHEN 1 THEN 'quarantine' WHEN 2 THEN 'quarantine' WHEN 4 THEN 'copy_and_truncate' ELSE 'seal' END AS action FROM foot""",
)
def recover_prefix(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.segment_files import verify_segments

    found = verify_segments(_damaged(spark, sf), "shard_id", "seg_no")
    return found.select("shard_id", "seg_no", "records", V.recovery_class(F.col("fault"), F.col("trailing"), F.lit(True)).alias("action"))


#: Even segments lose their end anywhere; in odd ones a byte of a checksum or payload is inverted.
_CUT, _RECORD, _BYTE = "1 + (seg_no * 7919 + shard_id * 104729) % {length}", "seg_no * 31 % n", "4 + seg_no * 17 % (size - 4)"


@query(
    "recover_torn",
    f"""{_SEG}, rec AS (
        SELECT shard_id, seg_no, 24 + sum(size) OVER w AS ends, count(*) OVER p AS n, {_CUT.format(length="(sum(size) OVER p + 60)")} AS c FROM seg WHERE sealed
        WINDOW w AS (PARTITION BY shard_id, seg_no ORDER BY seq), p AS (PARTITION BY shard_id, seg_no)),
    f AS (SELECT shard_id, CAST(seg_no AS BIGINT) AS seg_no, any_value(n) AS n, any_value(c) AS c, count(*) FILTER (ends <= c) AS good, coalesce(max(ends) FILTER (ends <= c), 24) AS done FROM rec GROUP BY ALL)
    SELECT shard_id, seg_no, CASE WHEN seg_no % 2 = 1 THEN {_RECORD} ELSE good END AS records,
        CASE WHEN seg_no % 2 = 1 THEN CASE WHEN shard_id % 2 = 0 THEN 'copy_and_truncate' ELSE 'untouched' END
            WHEN c < 24 THEN 'quarantine' WHEN c = done OR (good = n AND c - done >= 4) THEN 'seal' ELSE 'truncate' END AS action FROM f""",
)
def recover_torn(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.segment_files import verify_segments

    whole = Window.partitionBy("shard_id", "seg_no")
    rec = B.segmented(spark, sf).filter("sealed").select("shard_id", "seg_no", "seq", (F.octet_length("payload") + 8).alias("size"))
    order = whole.orderBy("seq")
    rec = rec.select("*", (F.row_number().over(order) - 1).alias("i"), F.sum("size").over(order).alias("filled"), F.count("*").over(whole).alias("n"))
    hit = rec.filter(f"i = {_RECORD}").select("shard_id", "seg_no", F.expr(f"24 + filled - size + {_BYTE}").cast("int").alias("at"))
    files = _files(spark, sf).join(hit, ["shard_id", "seg_no"]).withColumn("h", F.hex("data"))
    kept = F.substring("h", F.lit(1), (2 * F.expr(_CUT.format(length="octet_length(data)"))).cast("int"))
    flipped = _inverted(F.col("h"), F.col("at"))
    torn = files.select("shard_id", "seg_no", F.unhex(F.when(F.col("seg_no") % 2 == 0, kept).otherwise(flipped)).alias("data"))
    action = V.recovery_class(F.col("fault"), F.col("trailing"), F.col("shard_id") % 2 == 0)
    return verify_segments(torn, "shard_id", "seg_no").select("shard_id", "seg_no", "records", action.alias("action"))
