"""Reading the input tables and typed projections of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fetched(fetch: DataFrame, min_length: int = 100) -> DataFrame:
    """Fetch records as a fetcher reports them: html shorter than ``min_length`` is a failure."""
    size = F.length(F.coalesce("html", F.lit("")))
    return fetch.select("fetch_id", "url", "final_url", "engine", size.alias("content_length"), (size >= min_length).alias("success"))


def hybrid(fetch: DataFrame, min_length: int = 500) -> DataFrame:
    """Which engine serves each page: plain HTTP unless it failed or gave little, or the host
    is known to need a browser."""
    from ..functions import url

    bad = ~F.coalesce("success", F.lit(False)) | (F.length(F.coalesce("html", F.lit(""))) < min_length)
    pages = fetch.select("fetch_id", url.bare_host(F.coalesce("url", F.lit(""))).alias("host"), bad.alias("bad"))
    sticky = pages.where("bad").select("host").distinct().withColumn("sticky", F.lit(True))
    return pages.join(sticky, "host", "left").select(
        "fetch_id", "host", F.when(F.col("bad"), "fallback").when(F.col("sticky"), "browser").otherwise("http").alias("route")
    )
