"""Deduplication and set operators.  First-wins always by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row a key: the first in ``order``.  Spark keeps one row a group before the shuffle
    (group limit), so a hot key does not gather its rows in one task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def exact_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the content hash and the id of the first row of equal content."""
    h = df.select(F.col(id_col), F.md5(text_col).alias("content_hash")).where("content_hash is not null")
    first = h.groupBy("content_hash").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n_copies"))
    return h.join(first, "content_hash").select(id_col, "content_hash", "first_id", "n_copies")


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def only_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_semi")
