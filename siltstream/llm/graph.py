"""Connected components of a table of links, by distributed minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) of each id in links (a long, b long): root is the smallest id that can be reached.

    Each step takes the smallest label among neighbours (with partial aggregation, so a vertex with very many links
    is no hot group) and then the label of that label; both halves are stored, so joins on a hot label can be
    split.  Stops when the sum of all labels, which only falls, stays.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    edges = stored(edges, f"{name}-edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("root")), f"{name}-labels")
    before = None
    while True:
        total = labels.agg(F.sum(F.col("root").cast("decimal(38,0)")).alias("s")).first()["s"]
        if total == before:
            drop(edges)
            return labels
        before = total
        heard = edges.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "root").union(labels)
        nearest = stored(heard.groupBy("id").agg(F.min("root").alias("root")), f"{name}-nearest")
        jump = nearest.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = stored(nearest.join(jump, "root").select("id", F.col("next").alias("root")), f"{name}-labels")
        drop(labels, nearest)
        labels = after
