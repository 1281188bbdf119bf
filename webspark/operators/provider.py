"""Model steps behind a provider: any callable from prompts to answers, with a cache table.

The default provider is the rules of ``score``.  Prompts are made unique and joined with the
cache before the provider sees them; a ``when`` around a Python function would not keep rows
from it, so misses are split off as their own plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str | None]]


def cache_key(model: str, system: str, prompt: Column) -> Column:
    return F.md5(F.concat(F.lit(model), F.lit(system), F.coalesce(prompt, F.lit(""))))


def cut(text: Column, size: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, size)


def ask(df: DataFrame, prompt: str, make: Callable[[], Provider], model: str = "rules", system: str = "", cache: DataFrame | None = None, retries: int = 3) -> DataFrame:
    """``df`` with ``answer``, ``answer_ok``, ``answer_error`` and ``from_cache``.

    ``make`` is called once a partition and gives the provider (one client a partition);
    ``cache`` has ``(cache_key, response)``.  A batch that fails is asked prompt by prompt, each
    up to ``retries`` times; one that fails to the end has ``answer_ok`` false and the error.
    """
    keyed = df.withColumn("cache_key", cache_key(model, system, F.col(prompt)))
    asked = keyed.groupBy("cache_key").agg(F.first(prompt).alias("prompt"))
    known = cache.select("cache_key", F.col("response").alias("answer")).dropDuplicates(["cache_key"]) if cache is not None else None
    if known is not None:
        asked = asked.join(known.select("cache_key"), "cache_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in batches:
            prompts = ["" if p is None else p for p in pdf["prompt"]]
            errors: list[str | None] = [None] * len(prompts)
            try:
                answers = list(provider(prompts))
            except Exception:  # noqa: BLE001 - a provider may fail in any way
                answers = [None] * len(prompts)
                for i, p in enumerate(prompts):
                    for _ in range(retries):
                        try:
                            answers[i], errors[i] = provider([p])[0], None
                            break
                        except Exception as e:  # noqa: BLE001
                            errors[i] = f"{type(e).__name__}: {e}"[:500]
            yield pd.DataFrame({"cache_key": pdf["cache_key"], "answer": answers, "answer_error": errors})

    fresh = asked.mapInPandas(run, "cache_key string, answer string, answer_error string").withColumn("from_cache", F.lit(False))
    both = fresh if known is None else fresh.unionByName(known.withColumn("from_cache", F.lit(True)).withColumn("answer_error", F.lit(None).cast("string")))
    return keyed.join(both, "cache_key", "left").withColumn("answer_ok", F.col("answer").isNotNull())
