"""Both plans of size switches, bounds of mixtures, and staged tables."""

import os
import random

from pyspark.sql import functions as F

from webspark.llm import common, mixing, repeats


def test_repeated_lines_by_either_plan(spark, monkeypatch):
    rows = [(i, f"http://s{i % 3}.test/", f"<p>text number {chr(97 + i % 26) * 5}</p><p>all rights of s{i % 3} kept</p>") for i in range(90)]
    fetch = spark.createDataFrame(rows, "fetch_id bigint, final_url string, html string")
    few = sorted(map(tuple, repeats.cleaned(fetch).collect()))
    monkeypatch.setattr(repeats, "FEW_LINES", 0)
    many = sorted(map(tuple, repeats.cleaned(fetch).collect()))
    assert few == many and all(n == 1 and "rights" not in text for _, text, n in few)


def test_sources_keep_to_their_shares(spark):
    """What a source's blocks hold differs from their nominal tokens by half a document at most."""
    rng = random.Random(14)
    rows = [(i, "abc"[i % 3], " ".join(["one"] * rng.randint(1, 300))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 1), ("c", 0.1, 1)], "source string, target_share double, max_repeats int")
    slots = mixing.mixture(docs, targets, 64)
    plan = mixing.plan(mixing.token_counts(docs), targets, 64)
    dealt = {r["source"]: r["n"] for r in mixing._slots(spark, plan).groupBy("source").agg(F.count("*").alias("n")).collect()}
    got = {r["source"]: (r["n"], r["most"]) for r in slots.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("most")).collect()}
    for source, n in dealt.items():
        assert abs(got[source][0] - 64 * n) <= got[source][1] / 2 + 1, source


def test_staged_tables_are_released(spark):
    df = common.staged(spark.range(3), "three")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    common.release()
    assert not os.path.exists(folder)
