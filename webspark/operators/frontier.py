"""Crawl frontier: insert with reasons, order, rounds, breadth-first levels.

A frontier is a table of urls with (priority, depth, seq); seen urls are a table of hashes.
A round is one plan: admit, rank, take, expand.  Between rounds the state is written to the
shared folder, so plans do not grow and a lost executor costs one round at most.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import url as U
from .links import filter_reason


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where it is unset and all
    runs on one machine."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "webspark-shared")).rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/webspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def insert_status(items: DataFrame, order: list[str], max_depth: int = 3, allowed: list[str] | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Status of each row on insertion, first failure first: invalid, depth, filtered,
    duplicate, added.  ``order`` says which of equal urls comes first; ``seen`` has
    ``url_hash`` of urls known before."""
    # The canonical url is bound once as a lambda variable; as a column it would be put into
    # every branch of the checks.
    checked = F.transform(
        F.array(U.normalize(F.coalesce("url", F.lit("")))),
        lambda u: F.struct(u.alias("norm"), (U.netloc(u) == "").alias("empty"), (filter_reason(u, allowed or []) != "allowed").alias("refused")),
    )[0]
    rows = items.withColumn("c", checked).withColumn("norm", F.col("c.norm")).withColumn("url_hash", F.md5("norm"))
    rows = rows.withColumn(
        "pre", F.when((F.coalesce("url", F.lit("")) == "") | F.col("c.empty"), "invalid").when(F.col("depth") > max_depth, "depth").when(F.col("c.refused"), "filtered")
    ).drop("c")
    if seen is not None:
        rows = rows.join(seen.select("url_hash", F.lit(True).alias("known")).distinct(), "url_hash", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("boolean"))
    # The first of a url is an aggregate, combined map-side, so a url that holds a tenth of all
    # rows is not ranked in one task; only rows equal to the first in every column of the
    # order are told apart by rank.
    open_rows = rows.where("pre is null")
    first = open_rows.groupBy("url_hash").agg(F.min(F.struct(*order)).alias("_first"))
    open_rows = open_rows.join(first, "url_hash").withColumn("_late", F.struct(*order) != F.col("_first"))
    late = open_rows.where("_late").withColumn("status", F.lit("duplicate"))
    rank = F.row_number().over(Window.partitionBy("url_hash").orderBy(*order))
    early = open_rows.where("not _late").withColumn("status", F.when(F.col("known") | (rank > 1), "duplicate").otherwise("added"))
    open_rows = early.unionByName(late).drop("_first", "_late")
    shut = rows.where("pre is not null").withColumn("status", F.col("pre"))
    return open_rows.unionByName(shut).drop("pre", "known")


def pop(frontier: DataFrame, n: int, *order: str) -> DataFrame:
    """Next ``n`` items in (priority, depth, order)."""
    return frontier.orderBy("priority", "depth", *order).limit(n)


def explore(frontier: DataFrame, n: int, epsilon: float, seed: int, pool: int = 11) -> DataFrame:
    """``n`` next items; each place goes, with probability ``epsilon``, to one of the ``pool``
    best that are left, chosen by a seeded hash, so a run repeats exactly.

    Only the best ``n + pool`` rows are drawn from, in one task: ``n`` is the size of a batch.
    """
    columns = frontier.columns

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=columns), *batches]).sort_values(["priority", "depth", "seq"])
        left, order = list(range(len(rows))), []
        while left and len(order) < n:
            h = blake2b(f"{seed} {len(order)}".encode(), digest_size=8).digest()
            lucky = int.from_bytes(h[:4], "little") % 1000 < int(epsilon * 1000)
            order.append(left.pop(int.from_bytes(h[4:], "little") % min(pool, len(left)) if lucky else 0))
        yield rows.iloc[order]

    return frontier.orderBy("priority", "depth", "seq").limit(n + pool).coalesce(1).mapInPandas(draw, frontier.schema)


def crawl(seeds: DataFrame, edges: DataFrame, max_depth: int, batch: int | None = None, max_pages: int | None = None) -> DataFrame:
    """Visit pages over ``edges(src, dst)`` from ``seeds(url)``: ``(url, depth, round)``.

    With ``batch`` None a round takes a whole level (breadth first); a small ``batch`` follows
    the priority order more closely.  Every url is visited once, at its least depth met.
    """
    frontier = saved(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    visited, round_no, left = None, 0, max_pages
    while True:
        take = frontier if batch is None else frontier.orderBy("depth", "url").limit(batch)
        if left is not None:
            take = take.orderBy("depth", "url").limit(left)
        take = saved(take.withColumn("round", F.lit(round_no)), "round")
        n = take.count()
        if not n:
            break
        visited = take if visited is None else visited.unionAll(take)
        if left is not None:
            left -= n
            if left <= 0:
                break
        out = take.where(F.col("depth") < max_depth).join(edges.withColumnRenamed("src", "url"), "url").select(F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth"))
        rest = frontier.join(take.select("url"), "url", "left_anti") if batch is not None else None
        new = out if rest is None else out.unionAll(rest)
        new = new.groupBy("url").agg(F.min("depth").alias("depth")).join(visited.select("url"), "url", "left_anti")
        frontier = saved(new, "frontier")
        round_no += 1
    return visited if visited is not None else take  # no seeds: no rows


def score(base: Column, ai: Column, link_type: Column, depth: Column, penalty: float = 0.1) -> Column:
    bonus = F.lit(0.0)
    for name, value in U.TYPE_BONUS.items():
        bonus = F.when(link_type == name, F.lit(value)).otherwise(bonus)
    return -(base + ai * 2 + bonus - depth * F.lit(penalty))
