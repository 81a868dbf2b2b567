"""Layered settings: command line, environment, file, default; then range checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def layered(*layers: str, default: object) -> Column:
    """The first layer that has a value."""
    return F.coalesce(*map(F.col, layers), F.lit(default))


def in_range(value: Column, least: object, most: object) -> Column:
    return value.between(least, most)
