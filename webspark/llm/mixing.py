"""Mixing sources to target weights (problem 9).

The size of the mixture is the largest at which no source needs more than its allowed
repeats.  Slots of ``block_tokens`` tokens are dealt to sources by a low-discrepancy
schedule: the golden-ratio sequence mapped through the cumulative weights.  Each source's
documents are shuffled anew for every repeat and packed into blocks by their running token
count; the k-th slot of a source takes its k-th block.  A document belongs to the block that
holds its middle, so it is never split, and what a source's blocks hold together differs from
their nominal tokens by at most half a document, however many blocks there are.

Running counts are taken inside hash buckets of bounded size and added up over buckets, so
no source, however large, is sorted in one task.  Null, empty texts have no tokens and are
never drawn.  Sources without documents keep a reached share of 0 and the other weights are
scaled up; several target rows of one source are added up (the least repeats hold).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .tokens import token_counts

BLOCK_TOKENS = 512
#: Tokens a bucket of the running count holds on average, and slots of the running rank.
BUCKET_TOKENS = 2_000_000
BUCKET_SLOTS = 500_000
#: Sources of a mixture; their plan is made on the driver and broadcast.
MAX_SOURCES = 10_000
SEED = 17
GOLDEN = (math.sqrt(5) - 1) / 2


def plan(counts: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> list[dict]:
    """One entry a source of ``targets``: tokens there are, weight, slots and repeats.

    The result has a row for each source of the table of targets, which is a parameter of the
    mixture, of at most ``MAX_SOURCES`` sources (more are an error)."""
    wanted = targets.groupBy("source").agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    there = counts.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint")).alias("tokens"))
    rows = [r.asDict() for r in wanted.join(there, "source", "left").orderBy("source").limit(MAX_SOURCES + 1).collect()]
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"a mixture has at most {MAX_SOURCES} sources")
    for r in rows:
        r["tokens"] = r["tokens"] or 0
        r["live"] = r["tokens"] > 0 and r["target_share"] > 0 and r["max_repeats"] > 0
    whole = sum(r["target_share"] for r in rows if r["live"])
    total = min((r["tokens"] * r["max_repeats"] * whole / r["target_share"] for r in rows if r["live"]), default=0)
    edge = 0.0
    for r in rows:
        r["weight"] = r["target_share"] / whole if r["live"] else 0.0
        r["low"], edge = edge, edge + r["weight"]
        r["high"] = edge
        r["size"] = total * r["weight"]
        r["repeats"] = min(r["max_repeats"], math.ceil(r["size"] / r["tokens"])) if r["live"] else 0
    n_slots = max(1, int(total // block_tokens)) if total else 0
    for r in rows:
        r["n_slots"] = n_slots
    return rows


def _blocks(counts: DataFrame, rows: list[dict], block_tokens: int) -> DataFrame:
    """``(source, block, doc_id, use_no, n_tokens)``: shuffled blocks of every repeat."""
    spark = counts.sparkSession
    live = [r for r in rows if r["repeats"]]
    table = spark.createDataFrame(
        [(r["source"], r["repeats"], r["tokens"], max(1, r["tokens"] // BUCKET_TOKENS)) for r in live], "source string, repeats int, tokens bigint, buckets bigint"
    )
    uses = counts.where("n_tokens > 0").join(F.broadcast(table), "source").withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    uses = uses.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "use_no")).withColumn("bucket", F.pmod("h", "buckets"))
    sums = uses.groupBy("source", "use_no", "bucket").agg(F.sum(F.col("n_tokens").cast("bigint")).alias("n"))
    before = Window.partitionBy("source", "use_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "use_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "use_no", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = uses.join(starts, ["source", "use_no", "bucket"]).withColumn(
        "at", (F.col("use_no") - 1) * F.col("tokens") + F.col("start") + F.coalesce(F.sum(F.col("n_tokens").cast("bigint")).over(inside), F.lit(0))
    )
    return placed.select("source", F.expr(f"(`at` + n_tokens div 2) div {block_tokens}").alias("block"), "doc_id", "use_no", "n_tokens")


def _slots(spark, rows: list[dict]) -> DataFrame:
    """``(slot, source, block)``: the schedule, slots ranked within their source."""
    n = rows[0]["n_slots"] if rows else 0
    slots = spark.range(n).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("x"))
    source = None
    live = [r for r in rows if r["repeats"]]
    for r in live:
        hit = F.col("x") < F.lit(r["high"])
        source = F.when(hit, F.lit(r["source"])) if source is None else source.when(hit, F.lit(r["source"]))
    source = source.otherwise(F.lit(live[-1]["source"])) if live else F.lit(None).cast("string")
    slots = slots.select("slot", source.alias("source"), F.expr(f"slot div {BUCKET_SLOTS}").alias("part"))
    per = slots.groupBy("source", "part").agg(F.count("*").alias("n"))
    starts = per.select("source", "part", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1
    return slots.join(starts, ["source", "part"]).select("slot", "source", (F.col("start") + rank).alias("block"))


def mixture(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixture in order of slots: ``(slot, source, doc_id, use_no, n_tokens)``."""
    counts = staged(token_counts(documents), "tokens")
    rows = plan(counts, targets, block_tokens)
    return _slots(counts.sparkSession, rows).join(_blocks(counts, rows, block_tokens), ["source", "block"]).select("slot", "source", "doc_id", "use_no", "n_tokens")


def shares(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Shares reached: ``(source, target_share, reached_share, tokens, draws, most_uses)``."""
    drawn = staged(mixture(documents, targets, block_tokens), "mixture")
    by_doc = drawn.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum(F.col("n_tokens").cast("bigint")).alias("n"))
    by = by_doc.groupBy("source").agg(F.sum("n").alias("tokens"), F.sum("uses").alias("draws"), F.max("uses").alias("most_uses"))
    total = by.agg(F.sum("tokens")).first()[0] or 1
    wanted = targets.groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"))
    return wanted.join(by, "source", "left").select(
        "source",
        "target_share",
        (F.coalesce("tokens", F.lit(0)) / F.lit(float(total))).alias("reached_share"),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tokens", "draws", "most_uses")),
    )
