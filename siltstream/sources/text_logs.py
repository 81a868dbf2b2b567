"""Text sources: metric expositions and benchmark logs, from any table with a ``value`` line column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = r"\A([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)\z"


def parse_exposition(lines: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, metric, labels map, value) of each sample line; comments and malformed lines go."""
    parts = [F.regexp_extract("value", _LINE, i) for i in (1, 2, 3)]
    pairs = F.regexp_extract_all(parts[1], F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)="([^"]*)"'), 0)
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"\A([^=]*)=", 1), F.regexp_extract(p, r'\A[^=]*="(.*)"\z', 1)))
    number = parts[2].try_cast("double")
    rows = lines.select(*keep, parts[0].alias("metric"), F.map_from_entries(entries).alias("labels"), number.alias("number"))
    return rows.filter("metric <> '' and number is not null").select(*keep, "metric", "labels", F.col("number").alias("value"))


def parse_bench(lines: DataFrame, prefix: str, schema: str, *keep: str) -> DataFrame:
    """(kept columns, fields of schema) of the lines with this prefix; malformed objects go."""
    rows = lines.filter(F.col("value").startswith(prefix))
    rows = rows.select(*keep, F.from_json(F.substring("value", F.lit(len(prefix) + 1), F.length("value")), schema, {"mode": "PERMISSIVE"}).alias("j"))
    return rows.select(*keep, "j.*").filter("scenario is not null")
