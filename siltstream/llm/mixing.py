"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents: a whole part, the same
for all, and a fraction.  Pairs of fractional documents trade probability, in random direction and measured in
words, until one of them is integral; so every trade keeps the words that the source is expected to give, and each
document keeps its own expectation.  What is left of a group of documents is one fractional document; the leftovers
of a source meet in further groups, level by level, down to one last document that is rounded by chance.  So a
source's words miss the target by less than the size of one of its documents.

Rows that are equal are one unit of up to ``PIECE`` documents, whose common probability mass has a whole part of its
own: so a row that repeats without end fills no group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, stored
from .words import U64, mix

#: Equal rows in one unit.
PIECE = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _ranked(sizes: DataFrame) -> DataFrame:
    """Add ``rank`` (from 0, by code point, null last) to one row per source, without bringing all to one task.

    Sources are dealt out by range and numbered within their partition; only the number of rows of each partition
    goes to the driver.
    """
    by_source = F.col("source").asc_nulls_last()
    dealt = sizes.repartitionByRange(partitions(sizes.sparkSession), by_source).sortWithinPartitions(by_source)
    dealt = stored(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "mix-ranks")
    counts = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row per partition
    starts, total = [], 0
    for part in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    # A number of monotonically_increasing_id has the partition above its lowest 33 bits.
    rank = F.element_at(F.lit(starts), F.col("part") + 1) + F.col("place") % F.lit(1 << 33)
    return dealt.select(*sizes.columns, rank.cast("long").alias("rank"))


def source_targets(sizes: DataFrame, factor: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0) -> DataFrame:
    """Add ``target`` to one row per source (source string, source_size long).

    Sources by code point, null last, weigh ``weights`` in turn and share ``factor`` times all sizes; no target is
    above ``most`` times its source's size, and what is above goes to the others by weight.  The level (words a
    weight) rises with each source found above its limit, until no more are.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(_ranked(sizes).select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(most)).alias("cap")), "mix-weights")
    sums = ranked.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    total = factor * float(sums["size"] or 0)
    level, full = total / sums["w"] if sums["w"] else 0.0, 0
    while True:
        above = F.col("cap") < F.col("w") * F.lit(level)
        held = ranked.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, F.col("cap"))).alias("cap"), F.sum(F.when(~above, F.col("w"))).alias("w")).first()
        if held["n"] == full or not held["w"]:
            break
        full, level = held["n"], (total - held["cap"]) / held["w"]
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


def _chance(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = mix(a.astype(np.int64).view(U64) + mix(b.astype(np.int64).view(U64)) * U64(3) + U64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return (x >> U64(11)).astype(float) / 2.0**53


def _trader(level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda group: _trade(group, level, last)


def _round(p: np.ndarray, size: np.ndarray, key: np.ndarray, level: int) -> tuple[np.ndarray, int]:
    """(probabilities of which at most one is still fractional, its position or -1)."""
    p = p.copy()
    luck = _chance(level, key, np.roll(key, 1)).tolist()
    held = -1
    for i in range(len(p)):
        if held < 0:
            held = i
            continue
        up = min(1 - p[held], p[i] * size[i] / size[held])
        down = min(p[held], (1 - p[i]) * size[i] / size[held])
        step = up if luck[i] * (up + down) < down else -down
        p[held] += step
        p[i] -= step * size[held] / size[i]
        for j in (held, i):
            if abs(p[j] - round(p[j])) < 1e-9:
                p[j] = round(p[j])
        still = [j for j in (held, i) if 0 < p[j] < 1]
        held = still[-1] if still else -1
    return p, held


def _trade(group: pd.DataFrame, level: int, last: bool) -> pd.DataFrame:
    """Round all units of a group but one; that of the last group of a source is rounded by chance."""
    group = group.sort_values(["size", "key", "p"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    p, size, key = group["p"].to_numpy(float), group["size"].to_numpy(float), group["key"].to_numpy(np.int64)
    p, held = _round(p, size, key, level)
    if last and held >= 0:
        p[held] = float(_chance(level + 500, key[held : held + 1], key[held : held + 1])[0] < p[held])
    return group.assign(p=p)


def mix_sources(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    factor: float = 1.5,
    weights: tuple[int, ...] = (5, 2, 1),
    most: float = 2.0,
    group_rows: int = 4096,
    fan_in: int = 64,
    seed: int = 0,
) -> DataFrame:
    """One row per row of df: ``id_col``, ``source_col``, ``text_key`` (hash of the text), ``size`` (words),
    ``source_size``, ``target`` (its source's), ``copies`` and ``taken`` (copies * size).

    The choice depends on ids, texts, sources and ``seed`` only, so reruns agree; over all seeds a document is taken
    target / source_size times on average.  Null sources are one source, the last by
    order.  Null or empty texts have size 0 and give nothing.  Rows that repeat are rounded as separate documents.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col)).alias("text_key"), size.alias("size"))
    units = docs.groupBy("id", "source", "text_key", "size").agg(F.count("*").alias("n"))
    units = stored(units, "mix-sizes")
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.ceil(F.col("n") / PIECE)).otherwise(0)).alias("n"))
    sums = stored(sums, "mix-sources")
    targets = source_targets(sums.select("source", "source_size"), factor, weights, most)
    planned = sums.join(targets.drop("source_size"), sums["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    groups = F.greatest(F.ceil(F.col("n") / group_rows), F.lit(1)).cast("long")
    planned = stored(planned.select(F.col("source").alias("s"), "source_size", "target", groups.alias("groups")), "mix-targets")
    most_groups = planned.agg(F.max("groups").alias("m")).first()["m"] or 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    pieces = units.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE).cast("int"))).alias("piece"))
    pieces = pieces.select("id", "source", "text_key", "size", "piece", F.least(F.lit(PIECE), F.col("n") - F.col("piece") * PIECE).cast("long").alias("m"))
    rows = pieces.join(planned, pieces["source"].eqNullSafe(planned["s"]))
    tiny = F.lit(1e-9)
    whole = F.floor(rate + F.lit(1e-12))
    mass = F.when(F.col("size") > 0, F.greatest(rate - whole, F.lit(0.0))).otherwise(F.lit(0.0)) * F.col("m")
    extra = F.floor(mass + tiny)
    part = F.when(mass - extra > tiny, mass - extra).otherwise(F.lit(0.0))
    key = F.xxhash64(F.lit(seed), "id", "text_key", "source", "piece")
    rows = rows.select("id", "source", "text_key", "size", "m", "source_size", "target", whole.cast("long").alias("whole"), extra.cast("long").alias("extra"), part.alias("p"), key.alias("key"), F.pmod(key, F.col("groups")).alias("bucket"))
    rows = stored(rows, "mix-rows")
    schema = rows.schema
    settled = [rows.filter("p <= 0 or p >= 1")]
    rows = rows.filter("p > 0 and p < 1")
    level = 0
    while True:
        last = most_groups == 1
        traded = rows.groupBy("source", "bucket").applyInPandas(_trader(level, last), schema)
        traded = stored(traded, f"mix-level{level}")
        settled.append(traded.filter("p <= 0 or p >= 1"))
        if last:
            break
        rows = traded.filter("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("long"))
        most_groups = -(-most_groups // fan_in)
        level += 1
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    each = out.select("*", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("nth"))
    copies = F.col("whole") + F.when(F.col("nth") <= F.col("extra"), 1).when(F.col("nth") == F.col("extra") + 1, F.col("p").cast("long")).otherwise(0)
    return each.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "text_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
