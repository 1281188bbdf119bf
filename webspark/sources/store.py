"""Staged store: raw, extracted and analysed pages in partitioned Parquet, one catalog over all."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType
from pyspark.sql.utils import AnalysisException

STAGES = ("raw", "extracted", "analyzed", "reports")


class Store:
    """``root`` holds the stages' tables; every saved row has url, stage, content hash, time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, df: DataFrame, stage: str, content: str, category: str = "general", skip_duplicates: bool = True) -> None:
        """Append rows ``(url, <content>, created_at, ...)`` of a stage; content already there is
        skipped, by an anti-join on its hash, and of equal new content the first url is kept."""
        rows = df.withColumn("content_hash", F.md5(F.coalesce(F.col(content).cast("string"), F.lit("")))).withColumn("category", F.lit(category))
        if skip_duplicates:
            first = rows.groupBy("content_hash").agg(F.min("url").alias("url"))
            rows = rows.join(first, ["content_hash", "url"], "left_semi").dropDuplicates(["content_hash"])
            known = self.stage(stage)
            if known is not None:
                rows = rows.join(known.select("content_hash"), "content_hash", "left_anti")
        rows.withColumn("stage", F.lit(stage)).write.mode("append").partitionBy("stage").parquet(f"{self.root}/pages")

    def stage(self, stage: str) -> DataFrame | None:
        """Rows of a stage (its partition only), or None."""
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/pages").where(F.col("stage") == stage)
        except AnalysisException:
            return None

    def latest(self, stage: str) -> DataFrame:
        """Latest row of each url of a stage."""
        rows = self.stage(stage)
        cols = [c for c in rows.columns if c != "url"]
        return rows.groupBy("url").agg(F.max_by(F.struct(*cols), F.struct("created_at", "content_hash")).alias("r")).select("url", "r.*")

    def unprocessed(self, stage: str, next_stage: str) -> DataFrame:
        rows, done = self.stage(stage).select("url").distinct(), self.stage(next_stage)
        return rows if done is None else rows.join(done.select("url").distinct(), "url", "left_anti")

    def catalog(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/pages").select("url", "stage", "category", "content_hash", "created_at")

    def save_processed(self, df: DataFrame, text: str, category: str = "general") -> None:
        """Extracted rows with the time of processing and their metadata as one JSON text."""
        self.save(self._described(df, text, "processed_at"), "extracted", text, category)

    def save_analysis(self, df: DataFrame, result: str, urls: str, category: str = "general") -> None:
        """Analysed rows with the time of analysis and whether they recommend urls."""
        rows = self._described(df, result, "analyzed_at").withColumn("has_urls", F.coalesce(F.size(urls) > 0, F.lit(False)))
        self.save(rows, "analyzed", result, category)

    def _described(self, df: DataFrame, content: str, at: str) -> DataFrame:
        plain = [c for c in df.columns if c not in (content, "created_at") and not isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType))]
        return df.withColumn(at, F.col("created_at")).withColumn("metadata", F.to_json(F.struct(*plain)))

    def export(self, path: str, stage: str | None = None) -> None:
        """The catalog, of one stage or all, as JSON lines."""
        rows = self.catalog()
        (rows if stage is None else rows.where(F.col("stage") == stage)).write.mode("overwrite").json(path)

    def clean(self, category: str, before) -> None:
        """Drop rows of a category older than ``before``."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/pages")
        self._swap(rows.where(~((F.col("category") == category) & (F.col("created_at") < F.lit(before)))))

    def clean_all(self) -> None:
        """Drop every row of every stage."""
        self._fs().delete(self._path("pages"), True)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("pages").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _swap(self, kept: DataFrame) -> None:
        """Write the rows kept beside the table, then exchange the folders by renames: readers
        find the old table or the new one, and a failed write leaves the old one as it is."""
        fs = self._fs()
        fs.delete(self._path("pages_new"), True)
        kept.write.partitionBy("stage").parquet(f"{self.root}/pages_new")
        fs.delete(self._path("pages_old"), True)
        fs.rename(self._path("pages"), self._path("pages_old"))
        fs.rename(self._path("pages_new"), self._path("pages"))
        fs.delete(self._path("pages_old"), True)


def save_report(text: str, root: str, category: str, name: str, task: dict) -> str:
    """A report in its category's folder, and the task's description beside the folders."""
    folder = Path(root) / "reports" / category
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    (Path(root) / "task.json").write_text(json.dumps(task, ensure_ascii=False, default=str), encoding="utf-8")
    return str(folder / name)


def save_state(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/state/{name}")


def load_state(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/state/{name}")
    except AnalysisException:
        return None
