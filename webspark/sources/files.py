"""Whole files as rows: texts, JSON, sizes, and writers of single results."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON files of any layout; broken records are kept in ``_corrupt_record``."""
    reader = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.count("*").alias("n_files"), F.sum("length").alias("size_bytes"))


def write_json(value: object, path: str) -> bool:
    """One small result to a file, parents made; False if that fails."""
    try:
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps(value, ensure_ascii=False, default=str), encoding="utf-8")
        return True
    except (OSError, TypeError, ValueError):
        return False
