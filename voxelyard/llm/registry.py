"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, license_scan, stages
from .chat_format import op5_chat_format
from .decontaminate import op10_benchmark_leaks
from .fingerprints import op3_fingerprints
from .jaccard_join import op1_jaccard_join
from .language_id import op8_language_id
from .license_scan import op2_license_scan
from .packing import op4_curve_packing
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op7_token_counts
from .token_store import op6_token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_license_scan": op2_license_scan,
    "op3_fingerprints": op3_fingerprints,
    "op4_curve_packing": op4_curve_packing,
    "op5_chat_format": op5_chat_format,
    "op6_token_store": op6_token_store,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_benchmark_leaks": op10_benchmark_leaks,
    "pipeline": stages.run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_scan.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
}
