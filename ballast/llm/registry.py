"""Queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES = {
    "op1_license_scan": "licenses",
    "op2_imatch": "imatch",
    "op3_url_filter": "urls",
    "op4_toxicity": "toxicity",
    "op5_simhash": "simhash",
    "op6_decontaminate": "decontaminate",
    "op7_lm_score": "lm",
    "op8_language_id": "language",
    "op9_substring_dedup": "repeats",
    "op10_byte_bpe": "bpe",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"ballast.llm.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in _QUERIES.items():
        sql = getattr(import_module(f"ballast.llm.{module}"), f"{name.split('_')[0].upper()}_SQL", None)
        if sql:
            found[name] = sql
    return found
