"""The queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import render_chats
from .decontaminate import mark_benchmark
from .html import extract_main_text
from .minhash import near_duplicates
from .mixing import mix_sources
from .quality import is_held_out, score_quality, train_quality
from .shared import new_path, remove_at_exit
from .substring import remove_repeats
from .topk import exact_top_k
from .urls import filter_urls, seed_urls, train_url_filter
from .warc import read_warc, transactions, write_warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs, id_col="doc_id", text_col="text", window=13, block=7)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_chats(_read(spark, sf_dir, "conversations"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=5, percent=75, bands=64, rows=6)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = mark_benchmark(docs, _read(spark, sf_dir, "benchmark"), window=10, k=5)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(_read(spark, sf_dir, "pages"), path, least_bytes=100)
    remove_at_exit(spark, path)
    out = transactions(read_warc(spark, path, with_payload=False))
    refers_to = F.regexp_extract("capture.refers_to", r"\A<urn:page:(-?[0-9]+)>\z", 1)
    return out.select(
        "page_id",
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        F.when(F.col("capture.refers_to").isNotNull(), refers_to.cast("long")).alias("refers_to"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, _read(spark, sf_dir, "labels").select("doc_id", "quality"), max_docs=2000)
    scored = score_quality(docs, model)
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_read(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op9_url_filters(spark: SparkSession, sf_dir: str, labelled: DataFrame | None = None) -> DataFrame:
    """``labelled`` (url, label 1 = block) takes the place of the URLs made by rule."""
    model = train_url_filter(seed_urls(spark) if labelled is None else labelled, max_rows=5000)
    return filter_urls(_read(spark, sf_dir, "pages"), model).select("page_id", "host", "path", "rule", "verdict")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_read(spark, sf_dir, "documents"), factor=1.5, weights=(5, 2, 1), most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9 that rules decide: host, path and rule of every page, and the rule's verdict."""
    model = train_url_filter(seed_urls(spark).limit(0))
    judged = filter_urls(_read(spark, sf_dir, "pages"), model)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("by_rule"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10 that chance has no part in."""
    mixed = op10_mixing(spark, sf_dir)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("taken") <= 2 * F.col("size")).alias("within_twice"))


def quality_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that isn't learned."""
    return _read(spark, sf_dir, "documents").select("doc_id", is_held_out("doc_id").alias("held_out"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_html_extraction": op2_html_extraction,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_warc": op4_warc,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_url_filters": op9_url_filters,
    "op10_mixing": op10_mixing,
    "url_rules": url_rules,
    "mixing_targets": mixing_targets,
    "quality_folds": quality_folds,
}

_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": """
        WITH turns AS (
            SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS rank
            FROM conversations WHERE conv_id IS NOT NULL
        ), whole AS (
            SELECT conv_id, list({'r': role, 't': text} ORDER BY rank) AS turns, count(*) AS n,
                string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY rank) AS rendered
            FROM turns GROUP BY conv_id
        ), same AS (SELECT min(conv_id) AS conv_id, turns, n, min(rendered) AS rendered, count(*) AS copies FROM whole GROUP BY turns, n)
        SELECT conv_id, n AS n_turns, copies, rendered FROM same s
        WHERE NOT EXISTS (SELECT 1 FROM same l WHERE l.n > s.n AND l.turns[1] = s.turns[1] AND l.turns[1:s.n] = s.turns)
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY payload_digest)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.payload_digest,
            CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first_id < page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op8_exact_top_k": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op3_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACED}') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
        rep AS (SELECT k, min(doc_id) AS rep FROM sets GROUP BY k),
        own AS (SELECT s.* FROM s SEMI JOIN rep ON s.doc_id = rep.rep),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM own x JOIN own y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        near AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * met >= 75 * (na.n + nb.n - met)),
        links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
        reach AS (SELECT rep AS a, rep AS b FROM rep UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        root AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root.root, w.doc_id) AS component_id, coalesce(root.root, w.doc_id) = w.doc_id AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN rep USING (k) LEFT JOIN root ON root.a = rep.rep
    """,
    "op6_substring_dedup": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
        first AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (g) WHERE m < doc_id),
        pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op7_benchmark_decontamination": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS ws FROM benchmark),
        asked AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT item, ws, least(len(ws), 10) AS k, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
        win AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM asked))),
        met AS (SELECT doc_id, i, k, item FROM win JOIN asked USING (k, g)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "url_rules": f"""
        WITH r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        rules(by_rule, h, s) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        fit AS (SELECT page_id, h || s AS rule, by_rule, row_number() OVER (PARTITION BY page_id ORDER BY length(h || s) DESC) AS k
            FROM p JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, s))
        SELECT page_id, host, path, rule, by_rule FROM p LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (page_id)
    """,
    "mixing_targets": f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
        lv AS (SELECT 2.0 * source_size / w AS level FROM s UNION SELECT 0.0),
        filled AS (SELECT level, sum(least(2.0 * source_size, w * level)) AS words FROM lv, s GROUP BY level),
        top AS (SELECT max(level) AS level, max(words) AS words FROM filled WHERE words <= (SELECT 1.5 * sum(source_size) FROM s)),
        free AS (SELECT sum(w) AS w FROM s, top WHERE 2.0 * source_size / s.w > top.level),
        t AS (SELECT source, source_size, least(2.0 * source_size, s.w * (top.level + coalesce((SELECT 1.5 * sum(source_size) FROM s) - top.words, 0) / coalesce(free.w, 1))) AS target FROM s, top, free)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(CAST(target AS DOUBLE), 6) AS target, true AS within_twice FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    """,
    "quality_folds": """
        WITH RECURSIVE bit AS (SELECT i, i AS c, 0 AS n FROM range(256) r(i)
            UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, n + 1 FROM bit WHERE n < 8),
        tab AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE n = 8)
        SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda a, x: xor(t[CAST(xor(a, x) % 256 AS INT) + 1], a // 256)), 4294967295) % 5 = 0 AS held_out FROM documents, tab
    """,
}
