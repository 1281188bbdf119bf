"""Shared helpers of the text operators: reading, sites, staged tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where it is unset and all runs on one machine (tests) a temporary folder is made and
    set; a cluster without a shared folder is an error, as its executors could not read it.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = os.path.join(tempfile.gettempdir(), "webspark-shared")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


_staged: list[tuple[SparkSession, str, DataFrame]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and is computed once.

    The files are compressed Parquet, so a lost executor costs no recomputation.  Results are
    lazy and read them, so they stay until ``release`` or the end of the program.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webspark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _staged.append((spark, path, back))
    return back


def release(*tables: DataFrame) -> None:
    """Delete what was staged so far; call it when the results have been written.

    With ``tables`` only these go: staged ones that nothing lazy reads any more.
    """
    gone = [x for x in _staged if not tables or any(x[2] is t for t in tables)]
    _staged[:] = [x for x in _staged if not any(x is y for y in gone)]
    for spark, path, _ in reversed(gone):
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended: whoever owns the folder clears it
            continue


atexit.register(release)


def site(url: Column) -> Column:
    """Host of a url: lower case, without port and a leading ``www.``; '' where there is none."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def with_html(fetch: DataFrame) -> DataFrame:
    """Records that have html (not null, not empty)."""
    return fetch.where(F.col("html").isNotNull() & (F.col("html") != ""))


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for the Python work that follows.

    A large table comes with at least as many input splits as there are cores and stays as
    it is; only a table of fewer splits, which is small, is shuffled once.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
