"""The queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_order_minhash": "fingerprints",
    "op2_signature_sniffing": "media",
    "op3_license_rules": "licenses",
    "op4_cost_balanced_packing": "packing",
    "op5_zstd_novelty": "secrets",
    "op6_positive_unlabelled": "quality",
    "op7_sainte_lague_mixing": "mixing",
    "op8_setsketch_near_duplicates": "near_duplicates",
    "op9_counterfactual_toxicity": "toxicity",
    "op10_separator_scan": "separators",
}


def _query(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return importlib.import_module(f"textloom.llm.{module}").query


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(module) for name, module in MODULES.items()} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"textloom.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
