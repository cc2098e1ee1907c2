"""The training-data queries and their SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op1_decontamination": "decontamination",
    "op2_token_counts": "token_counts",
    "op3_mixing": "mixing",
    "op4_warc": "warc",
    "op5_substring_dedup": "substring_dedup",
    "op6_token_files": "token_files",
    "op7_secrets": "secrets",
    "op8_near_dedup": "near_dedup",
    "op9_lm_scores": "lm_scoring",
    "op10_quality_rules": "quality_rules",
    "op11_vector_links": "vector_links",
    "op12_merkle_manifest": "merkle",
    "op13_periodic_runs": "periodic_runs",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in _MODULES.items()}
    return found


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {name: sql for name, sql in oracles.SQL.items() if name in _MODULES}
