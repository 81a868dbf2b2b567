"""The registered queries themselves: against their SQL, and for the columns that have none."""

import pytest
from pyspark.sql import functions as F

from oracle import SF, connect, rows
from siltstream.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op2_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op3_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op4_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op7_benchmark_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op8_exact_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op9_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op10_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}


@pytest.fixture(scope="module")
def results(spark):
    found = {}

    def get(name):
        if name not in found:
            found[name] = QUERIES[name](spark, SF).toPandas()
        return found[name]

    return get


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(results, name):
    assert rows(results(name)) == rows(connect().sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["op2_html_extraction", "op5_quality_classifier", "op9_url_filters", "op10_mixing"])
def test_columns(spark, name):
    out = QUERIES[name](spark, SF)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) == COLUMNS[name]


def test_texts_of_pages(results):
    out = results("op2_html_extraction")
    assert len(out) == connect().sql("SELECT count(*) AS n FROM pages").df()["n"][0]
    assert (out["text"].map(len) == out["n_chars"]).all()


def test_scores_of_documents(results):
    out = results("op5_quality_classifier").merge(connect().sql("SELECT * FROM labels").df(), on="doc_id")
    assert out["score"].between(0, 1).all() and ((out["score"] >= 0.3).astype(int) == out["predicted"]).all()
    assert (out["predicted"] == out["quality"]).mean() > 0.95


def test_verdicts_follow_rules(results):
    both = results("op9_url_filters").merge(results("url_rules"), on="page_id")
    ruled = both[both["by_rule"].notna()]
    assert len(ruled) and (ruled["verdict"] == ruled["by_rule"]).all() and both["verdict"].isin(["allow", "block"]).all()


def test_mix_is_near_its_targets(spark, results):
    out = results("op10_mixing").merge(connect().sql("SELECT doc_id, source FROM documents").df(), on="doc_id")
    for _, own in out.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max()
    assert out["taken"].sum() == pytest.approx(out["size"].sum() * 1.5, rel=0.05)
    again = QUERIES["op10_mixing"](spark, SF).agg(F.sum(F.xxhash64("doc_id", "taken").cast("decimal(38,0)"))).first()[0]
    assert again == QUERIES["op10_mixing"](spark, SF).agg(F.sum(F.xxhash64("doc_id", "taken").cast("decimal(38,0)"))).first()[0]
