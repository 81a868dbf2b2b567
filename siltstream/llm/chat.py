"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation several times, each time with the turns so far.  Every prefix of every conversation
gets a rolling hash; a conversation whose whole hash is a proper prefix of another one, or a copy of one with a
smaller id, goes (anti-join), and the maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Turns of one conversation are numbered and hashed in blocks of so many turn numbers, so that no task needs one
#: whole long conversation.
BLOCK = 256
_SUMS = ("a", "b", "c", "d")


def _halves(rank: Column, role: Column, text: Column) -> list[Column]:
    """128 bits of hash for a turn at its rank, as four numbers of 32 bits whose sums don't overflow."""
    out = []
    for seed in (17, 43):
        h = F.xxhash64(F.lit(seed), rank, role.isNull(), role, text.isNull(), text)
        out += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return out


def numbered_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, rank from 1, role, text, block): turns by number (null last), then role, then text."""
    rows = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)).cast("long"))
    sizes = rows.groupBy("conv", "block").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    in_block = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    local = rows.select("*", F.row_number().over(in_block).alias("at"))
    return local.join(sizes, ["conv", "block"]).select("conv", (F.col("offset") + F.col("at")).alias("rank"), "role", "text", "block")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv, n, a, b, c, d): the rolling hash of the first n turns, for every n; the last one has ``whole`` true."""
    hashed = turns.select("conv", "block", "rank", *[x.alias(s) for x, s in zip(_halves(F.col("rank"), F.col("role"), F.col("text")), _SUMS, strict=True)])
    totals = hashed.groupBy("conv", "block").agg(F.max("rank").alias("end"), *[F.sum(s).alias(f"t{s}") for s in _SUMS])
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv")
    totals = totals.select("conv", "block", F.max("end").over(every).alias("length"), *[F.coalesce(F.sum(f"t{s}").over(earlier), F.lit(0)).alias(f"t{s}") for s in _SUMS])
    so_far = Window.partitionBy("conv", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.select("conv", "block", F.col("rank").alias("n"), *[F.sum(s).over(so_far).alias(s) for s in _SUMS])
    joined = local.join(totals, ["conv", "block"])
    return joined.select("conv", "n", *[(F.col(s) + F.col(f"t{s}")).alias(s) for s in _SUMS], (F.col("n") == F.col("length")).alias("whole"))


def collapse_snapshots(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, n_turns, copies) of the maximal conversations.

    A conversation goes if its turns (roles and texts, in order) are the first turns of a longer one, or all turns of
    one with a smaller id; copies counts the ids with the same turns.  Null roles and texts equal each other only.
    Rows with a null conversation id belong to none.  Repeated rows are turns of their own.
    """
    return _maximal(stored(numbered_turns(df, conv_col, turn_col, role_col, text_col), "turns"))


def _maximal(turns: DataFrame) -> DataFrame:
    hashes = stored(prefix_hashes(turns), "prefixes")
    whole = hashes.filter("whole").groupBy("n", *_SUMS).agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    prefixes = hashes.filter("not whole").select("n", *_SUMS).distinct()
    return whole.join(prefixes, ["n", *_SUMS], "left_anti").select("conv", F.col("n").alias("n_turns"), "copies")


def render_chats(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", start: str = "<|{role}|>\n", end: str = "<|end|>\n") -> DataFrame:
    """(``conv_col``, n_turns, copies, rendered): the maximal conversations, one string each, turns in order.

    A null role is written as 'unknown', a null text as ''.
    """
    turns = stored(numbered_turns(df, conv_col, turn_col, role_col, text_col), "turns")
    kept = stored(_maximal(turns), "maximal")
    before, _, after = start.partition("{role}")
    line = F.concat(F.lit(before), F.coalesce("role", F.lit("unknown")), F.lit(after), F.coalesce("text", F.lit("")), F.lit(end))
    lines = turns.join(kept.select("conv"), "conv", "left_semi").select("conv", F.struct("rank", line.alias("line")).alias("x"))
    texts = lines.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "").alias("rendered"))
    return kept.join(texts, "conv").select(F.col("conv").alias(conv_col), "n_turns", "copies", "rendered")
