"""Each pipeline stage against what its operator's brute-force version says on the stage's own input."""

import re

import corpus_pipeline
from siltstream.llm.shared import stored
from test_text_operators import brute_components, brute_hits, brute_repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = steps[name] = stored(stage(spark, docs, SF), f"test-{name}")
    columns = steps["documents"].columns
    assert all(steps[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    rows = {n: {r.doc_id: r for r in d.collect()} for n, d in steps.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [i for i in rows["documents"] if i in labels]
    assert sum((i in rows["quality"]) == (labels[i] == 1) for i in judged) >= 0.97 * len(judged)
    component, _ = brute_components([(i, r.text) for i, r in rows["quality"].items()])
    assert set(rows["near_dedup"]) == {i for i, c in component.items() if i == c}
    for i, _, removed, kept in brute_repeats([(i, r.text) for i, r in rows["near_dedup"].items()]):
        out, before = rows["substring_dedup"][i], rows["near_dedup"][i]
        assert out.text == (kept if removed else before.text) and out.n_chars == (len(kept) if removed else before.n_chars)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {i: n for i, _, n, _ in brute_hits([(i, r.text) for i, r in rows["substring_dedup"].items()], items)}
    assert set(rows["decontaminate"]) == {i for i, n in hits.items() if n == 0}
    mixed = steps["mixing"].collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(words(r.text) for r in rows["decontaminate"].values())
    assert {r.doc_id for r in mixed} <= set(rows["decontaminate"]) and max(r.copy for r in mixed) <= 2
    assert len({(r.doc_id, r.copy) for r in mixed}) == len(mixed)
    assert abs(sum(words(r.text) for r in mixed) - 1.5 * total) < 0.02 * total


def test_stages_take_empty_tables_nulls_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(5).unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, None, None, None, None), (900000, "", "en", None, 0), (900001, None, None, "s", 0)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        assert stage(spark, odd, SF).count() >= 0, name
    kept = corpus_pipeline.near_dedup(spark, odd, SF).collect()
    assert len({r.doc_id for r in kept}) == len(kept)
