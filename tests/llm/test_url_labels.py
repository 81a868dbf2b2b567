"""Labelled URLs of one's own take the place of those made by rule."""

from pyspark.sql import functions as F

from siltstream.llm.queries import op9_url_filters

from oracle import SF


def test_labelled_table_is_taken(spark):
    labelled = spark.read.parquet(f"{SF}/pages.parquet").select("url", F.lit(1).alias("label"))
    free = op9_url_filters(spark, SF, labelled).filter("rule is null")
    assert {r.verdict for r in free.select("verdict").distinct().collect()} == {"block"}
