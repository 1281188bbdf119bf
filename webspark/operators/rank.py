"""Top-k, caps and scores of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of sources of seeds.
SOURCE_ORDER = {"original": 0, "duckduckgo_api": 1, "google": 2, "bing": 3, "duckduckgo_lite": 4, "duckduckgo_html": 5, "duckduckgo": 6}


def top_per(df: DataFrame, keys: list[str], k: int, *order: str | Column, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key; ranks start at 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def rank_score(rank: Column, step: float) -> Column:
    return F.lit(1.0) - (rank - 1) * F.lit(step)


def source_order(source: Column, order: dict[str, int] = SOURCE_ORDER) -> Column:
    out = None
    for name, n in order.items():
        out = F.when(source == name, n) if out is None else out.when(source == name, n)
    return out.otherwise(99)


def running_rank(df: DataFrame, keys: list[str], order: str, width: int = 1_000_000, rank: str = "rank") -> DataFrame:
    """Rank of each row within its key by a whole-number column, from 1.

    Rows are ranked inside ranges of ``width`` values and the ranges' counts are added up, so
    a key that holds a third of all rows is ranked by many tasks.
    """
    part = F.floor(F.col(order) / width).cast("bigint")
    rows = df.withColumn("_part", part)
    counts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order))
    return rows.join(starts, [*keys, "_part"]).withColumn(rank, F.col("_start") + inside).drop("_part", "_start")


def numbered(df: DataFrame, parts: list[Column], order: list[Column], name: str) -> DataFrame:
    """Number of each row, from 1, in the order of ``parts`` and then ``order``.

    Rows are numbered inside each combination of ``parts`` and the counts before it are added,
    so the whole table is never sorted in one task; only the counts of the parts are.
    """
    keys = [f"_part{i}" for i in range(len(parts))]
    rows = df.select("*", *(c.alias(k) for c, k in zip(parts, keys)))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.join(starts, keys).withColumn(name, F.col("_start") + inside).drop("_start", *keys)
