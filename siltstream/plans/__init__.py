"""The registered queries and their DuckDB counterparts."""

from __future__ import annotations

from . import codec_queries, report_queries, segment_queries  # noqa: F401  (they register)
from .base import CATALOG

__all__ = ["CATALOG"]
