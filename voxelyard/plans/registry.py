"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def load() -> None:
    """Register all scene queries."""
    from . import iterative_queries, merge_queries, scene_queries, text_queries, frame_queries, mask_queries, eval_queries, graph_queries, source_queries  # noqa: F401
