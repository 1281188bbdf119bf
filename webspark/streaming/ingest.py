"""Pages as a stream: files in, duplicates out, stages and counts kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import url as U


def pages(spark: SparkSession, folder: str, schema, per_trigger: int = 16) -> DataFrame:
    """Fetch records as their files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def new_content(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """First record of each content within the watermark; older state is dropped."""
    timed = stream.withColumn("ts", F.col("loaded_at").cast("timestamp")).withColumn("content_hash", F.md5(F.coalesce("html", F.lit(""))))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["content_hash"])


def host_counts(stream: DataFrame, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Records by host and day of loading, late ones up to the watermark included."""
    timed = stream.withColumn("ts", F.col("loaded_at").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", window).alias("w"), U.bare_host(F.coalesce("final_url", F.lit(""))).alias("host")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "host", "n")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet until the files there are read; restarts go on where they stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
