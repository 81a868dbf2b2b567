"""A training corpus from ``documents``: quality, near-duplicates, repeats, benchmark passages, mixing.

Each stage takes what its predecessor kept, as Parquet, and returns the columns of ``documents``; the last adds
``copy``.  The result holds each document as many times as the mix takes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstream.llm.decontaminate import mark_benchmark
from siltstream.llm.minhash import near_duplicates
from siltstream.llm.mixing import mix_sources
from siltstream.llm.quality import score_quality, train_quality
from siltstream.llm.shared import free_name, stored
from siltstream.llm.substring import remove_repeats


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[F.Column]]:
    """docs with the columns that an operator would replace (in any case of letters) under free names, and the
    columns of docs as they were, to select from the operator's result."""
    taken = [c for c in docs.columns if c.lower() in names]
    other = dict(zip(taken, free_name(docs, *taken), strict=True))
    return docs.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that score below 0.3; the classifier learns from the labelled rows that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train_quality(docs.select("doc_id", "text"), labels, max_docs=2000)
    (score,) = free_name(docs, "quality_score")
    scored = score_quality(docs, model, score_col=score)
    return scored.filter(F.col(score) >= 0.3).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group.

    Of rows with equal id and text one stays, that with the smallest other columns; different texts under one id all
    stay.  Rows without an id stay as they are.
    """
    found = near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=75, bands=64, rows=6)
    kept = found.filter("kept and doc_id is not null").select("doc_id").distinct()
    own = docs.join(kept, "doc_id", "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if others:
        own = own.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("first")).select("doc_id", "text", "first.*")
    else:
        own = own.distinct()
    return own.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words that a window of 13 words repeats from a smaller id; texts without such words stay as they are."""
    own, columns = _aside(docs, "kept_text", "n_words", "n_removed")
    out = remove_repeats(own, window=13, block=7)
    cut = F.col("n_removed") > 0
    changed = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents in which a window of 10 words of a benchmark item occurs."""
    own, columns = _aside(docs, "n_words", "n_hit", "items")
    marked = mark_benchmark(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, k=5)
    return marked.filter("n_hit = 0").select(*columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks: 0 to 2 copies, numbered from 1 in ``copy``.

    Rows equal in id, text and source share their copies evenly.  Where docs has a column ``copy``, the number's name
    gets a leading underscore.
    """
    taken = mix_sources(docs, factor=1.5, weights=(5, 2, 1), most=2.0).filter("size > 0")
    key, place, m, c, r, copy = free_name(docs, "mix_key", "mix_place", "mix_rows", "mix_copies", "mix_row", "copy")
    ident = F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("source").isNull(), F.col("source").cast("string")).alias(place)
    taken = taken.groupBy(F.col("text_key").alias(key), ident).agg(F.count("*").alias(m), F.sum("copies").alias(c))
    both = docs.select("*", F.xxhash64("text").alias(key), ident).join(taken, [key, place])
    numbered = both.withColumn(r, F.row_number().over(Window.partitionBy(key, place).orderBy(key)))
    own = F.floor(F.col(c) / F.col(m)) + (F.col(r) <= F.col(c) % F.col(m)).cast("int")
    return numbered.filter(own > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), own.cast("int"))).alias(copy))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]

#: A trained classifier and random rounding have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
