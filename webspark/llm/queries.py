"""Queries of the text operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_importable
from .common import read


def _query(module: str, function: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_importable(spark)
        operator = getattr(import_module(f"{__package__}.{module}"), function)
        return operator(*(read(spark, sf_dir, t) for t in tables))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": _query("neardup", "found", "fetch_results"),
    "p1_classes": _query("neardup", "classes", "fetch_results"),
    "p2_found": _query("encoding", "found", "fetch_results"),
    "p2_restored": _query("encoding", "restored", "fetch_results"),
    "p3_found": _query("personal", "found", "fetch_results", "analysis_results", "name_parts"),
    "p3_redacted": _query("personal", "redacted", "fetch_results", "analysis_results", "name_parts"),
    "p4_found": _query("stuffing", "found", "fetch_results"),
    "p4_labels": _query("stuffing", "labelled_pages", "fetch_results"),
    "p4_links": _query("stuffing", "stuffed_links", "fetch_results", "extracted_links"),
    "p5_found": _query("repeats", "found", "fetch_results"),
    "p5_cleaned": _query("repeats", "cleaned", "fetch_results"),
    "p6_found": _query("residue", "found", "fetch_results"),
    "p6_labels": _query("residue", "labels", "fetch_results"),
    "p6_kept": _query("residue", "kept", "fetch_results"),
    "p7_found": _query("mainbody", "found", "fetch_results"),
    "p7_main_body": _query("mainbody", "main_body", "fetch_results"),
    "p8_ids": _query("tokens", "encoded", "documents"),
    "p8_round_trip": _query("tokens", "round_trip", "documents"),
    "p9_mixture": _query("mixing", "mixture", "documents", "source_targets"),
    "p9_shares": _query("mixing", "shares", "documents", "source_targets"),
    "p10_found": _query("truncation", "found", "documents"),
    "p10_by_source": _query("truncation", "by_source", "documents"),
}

#: None of these operators can be written in SQL; tests/llm holds their brute-force checks.
ORACLES: dict[str, str] = {}
