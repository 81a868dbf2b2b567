"""Benchmark statistics with the reference rules, which differ from the built-in ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIER_ORDER = ("sync", "batched", "buffered")


def percentiles(samples: DataFrame, points: tuple[float, ...]) -> DataFrame:
    """samples(scenario, us): the value at zero-based position min(trunc(n p / 100), n - 1) of the sorted samples."""
    order = Window.partitionBy("scenario").orderBy("us")
    ranked = samples.select("scenario", "us", (F.row_number().over(order) - 1).alias("at"))
    n = samples.groupBy("scenario").agg(F.count("*").alias("n"))
    wanted = n.select("scenario", F.explode(F.array(*map(F.lit, points))).alias("p"), "n")
    wanted = wanted.select("scenario", "p", F.least(F.floor(F.col("n") * F.col("p") / 100), F.col("n") - 1).cast("int").alias("at"))
    return ranked.join(wanted, ["scenario", "at"]).select("scenario", "p", "us")


def integer_stats(samples: DataFrame) -> DataFrame:
    """Whole-number mean; deviation from the population variance about that mean, also by whole-number division."""
    mean = samples.groupBy("scenario").agg(F.expr("sum(us) div count(*)").alias("mean_us"))
    off = (F.col("us") - F.col("mean_us")) * (F.col("us") - F.col("mean_us"))
    spread = samples.join(mean, "scenario").groupBy("scenario", "mean_us").agg(F.sum(off).alias("s"), F.count("*").alias("n"))
    return spread.select("scenario", "mean_us", F.floor(F.sqrt(F.expr("s div n"))).cast("long").alias("stddev_us"))


def throughput(runs: DataFrame) -> DataFrame:
    return runs.select("scenario", "run", F.floor(F.col("records") / (F.col("wall_ms") / 1000.0)).cast("long").alias("rps"))


def averages(runs: DataFrame) -> DataFrame:
    """Mean and population deviation over runs; 0 for a single run."""
    spread = F.when(F.count("*") < 2, F.lit(0.0)).otherwise(F.stddev_pop("rps"))
    return runs.groupBy("scenario").agg(F.avg("rps").alias("mean_rps"), spread.alias("stddev_rps"), F.count("*").alias("runs"))


def deadline_pivot(runs: DataFrame) -> DataFrame:
    """runs(tier, deadline, rps): means side by side and their ratio, tiers in their usual order."""
    wide = runs.groupBy("tier").pivot("deadline", ["d1ms", "d2ms"]).agg(F.avg("rps"))
    place = F.array_position(F.array(*map(F.lit, TIER_ORDER)), F.col("tier")).cast("int")
    return wide.select("tier", "d1ms", "d2ms", (F.col("d1ms") / F.col("d2ms")).alias("ratio"), place.alias("place")).orderBy("place")


def ramp_levels(runs: DataFrame) -> DataFrame:
    """runs(threads, rps, io_errors): means per level; saturated where errors occurred."""
    level = runs.groupBy("threads").agg(F.avg("rps").alias("rps"), F.avg("io_errors").alias("io_errors"))
    return level.select("threads", "rps", (F.col("io_errors") > 0).alias("saturated"))


def first_saturated(levels: DataFrame) -> DataFrame:
    return levels.agg(F.min(F.when(F.col("saturated"), F.col("threads"))).alias("threads"))


def ramp_peak(levels: DataFrame, low: int = 8, high: int = 96) -> DataFrame:
    """Throughput of the last level that isn't saturated, which needn't be the largest."""
    good = levels.filter(~F.col("saturated") & F.col("threads").between(low, high))
    return good.agg(F.max("threads").alias("threads"), F.max_by("rps", "threads").alias("rps"))


def stage_breakdown(stages: DataFrame) -> DataFrame:
    """Mean of each stage; what the others leave of the total is the sync."""
    mean = stages.groupBy("scenario").agg(*[F.avg(c).alias(c) for c in ("queue_us", "bridge_us", "write_us", "total_us")])
    return mean.select("*", (F.col("total_us") - F.col("queue_us") - F.col("bridge_us") - F.col("write_us")).alias("sync_us"))


def append_history(history: DataFrame, row: DataFrame) -> DataFrame:
    return history.unionByName(row)


def sweep_median(trials: DataFrame, cores: int) -> DataFrame:
    """Upper median, least and most of the trials of each agent count, and its ratio to the cores."""
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rps DESC)").cast(trials.schema["rps"].dataType)
    out = trials.groupBy("agents").agg(upper.alias("median_rps"), F.min("rps").alias("min_rps"), F.max("rps").alias("max_rps"))
    return out.select("*", (F.col("agents") / F.lit(float(cores))).alias("agents_per_core"))
