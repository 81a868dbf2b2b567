"""Monitoring queries over a samples table, with the semantics of the dashboards' expressions.

samples(ts_s, instance, metric, tier, le, value): one row per series and scrape; the label columns may be null.
``increase`` is the plain reset-aware difference; it isn't extrapolated to the edges of the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("instance", "metric", "tier", "le")


def select_series(samples: DataFrame, metric: str, **patterns: str) -> DataFrame:
    """Label matchers: fully anchored patterns."""
    out = samples.filter(F.col("metric") == metric)
    for label, pattern in patterns.items():
        out = out.filter(F.coalesce(F.col(label), F.lit("")).rlike(rf"\A(?:{pattern})\z"))
    return out


def with_delta(samples: DataFrame) -> DataFrame:
    """Add ``delta`` since the previous scrape of the series; a counter that fell has started again from 0."""
    before = F.lag("value").over(Window.partitionBy(*SERIES).orderBy("ts_s"))
    return samples.withColumn("delta", F.when(before.isNull(), F.lit(0.0)).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def increase(samples: DataFrame, window_s: int) -> DataFrame:
    """Add ``increase`` over the last window_s seconds, both ends included for the samples' values."""
    # The first sample in a window has its delta outside it.
    w = Window.partitionBy(*SERIES).orderBy("ts_s").rangeBetween(-window_s, 0)
    with_d = with_delta(samples)
    return with_d.withColumn("increase", F.sum("delta").over(w) - F.first("delta").over(w))


def rate(samples: DataFrame, window_s: int) -> DataFrame:
    return increase(samples, window_s).withColumn("rate", F.col("increase") / F.lit(float(window_s)))


def sum_by(samples: DataFrame, value: str, *labels: str) -> DataFrame:
    return samples.groupBy("ts_s", *labels).agg(F.sum(value).alias("value"))


def max_by(samples: DataFrame, value: str, *labels: str) -> DataFrame:
    return samples.groupBy("ts_s", *labels).agg(F.max(value).alias("value"))


def bucket_bound(le: Column) -> Column:
    return F.when(le == "+Inf", F.lit(float("inf"))).otherwise(le.cast("double"))


def histogram_quantile(buckets: DataFrame, q: float, *labels: str) -> DataFrame:
    """The q-quantile of cumulative buckets(ts_s, labels, le, value) by linear interpolation.

    The first bound whose count reaches q of all; from 0 in the first bucket; the highest finite bound in the last.
    """
    keys = ("ts_s", *labels)
    order = Window.partitionBy(*keys).orderBy("bound")
    rows = buckets.withColumn("bound", bucket_bound(F.col("le")))
    rows = rows.select("*", F.max("value").over(Window.partitionBy(*keys)).alias("total"), F.lag("bound", 1, 0.0).over(order).alias("low"), F.lag("value", 1, 0.0).over(order).alias("under"))
    rank = F.col("total") * F.lit(q)
    hit = rows.filter((F.col("value") >= rank) & (F.col("total") > 0)).groupBy(*keys).agg(F.min(F.struct("bound", "low", "under", "value", "total")).alias("b"))
    b = F.col("b")
    inside = b["low"] + (b["bound"] - b["low"]) * F.when(b["value"] > b["under"], (b["total"] * F.lit(q) - b["under"]) / (b["value"] - b["under"])).otherwise(F.lit(0.0))
    return hit.select(*keys, F.when(b["bound"] == float("inf"), b["low"]).otherwise(inside).alias("quantile"))


def latency_heatmap(buckets: DataFrame) -> DataFrame:
    """Counts per bucket: differences of the cumulative counts, summed over series."""
    total = buckets.groupBy("ts_s", "le").agg(F.sum("value").alias("value")).withColumn("bound", bucket_bound(F.col("le")))
    before = F.lag("value", 1, 0.0).over(Window.partitionBy("ts_s").orderBy("bound"))
    return total.select("ts_s", "le", (F.col("value") - before).alias("count"))


def state_code(samples: DataFrame, one: str, two: str) -> DataFrame:
    """sum(a) + 2 * sum(b): a code for a panel of states."""
    value = lambda m: F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0))
    return samples.groupBy("ts_s").agg((value(one) + 2 * value(two)).alias("code"))


def clamped_ratio(part: Column, whole: Column, least: float = 0.001) -> Column:
    return part / F.greatest(whole, F.lit(least))


def sum_or_zero(samples: DataFrame) -> DataFrame:
    """One row even where no series matches."""
    return samples.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def alert_firing(conditions: DataFrame, for_s: int, *labels: str) -> DataFrame:
    """conditions(labels, ts_s, active): the spans in which an alert fires, i.e. runs of true of for_s or longer."""
    order = Window.partitionBy(*labels).orderBy("ts_s")
    runs = conditions.withColumn("run", F.sum(F.when(F.col("active"), 0).otherwise(1)).over(order)).filter("active")
    spans = runs.groupBy(*labels, "run").agg(F.min("ts_s").alias("pending_from"), F.max("ts_s").alias("until"))
    return spans.filter(F.col("until") - F.col("pending_from") >= for_s).select(*labels, "pending_from", (F.col("pending_from") + for_s).alias("fires_at"), "until")


def outage_headroom(free_bytes: Column, rate_per_s: Column, record_bytes: Column) -> Column:
    """Hours until the disk is full while the sink is away; null without traffic."""
    per_s = rate_per_s * record_bytes
    return F.when(per_s != 0, free_bytes / per_s / 3600)
