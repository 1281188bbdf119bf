"""Lines repeated across one site's documents (problem 5).

For each (site, line) the share of the site's records with the line is compared with the
share outside the site by a log-likelihood ratio; the Benjamini-Hochberg procedure controls
the false-discovery rate over all pairs tested.  Lines found so are removed from each
document by an anti-join and the rest is put together again by position.

Nulls: records without html have no lines; a null final_url gives the site ''.  A line is
counted once a record, records delivered again count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dom
from .common import site, spread, staged, with_html

MIN_RECORDS = 6
MIN_SHARE = 0.25
#: False-discovery rate.
ALPHA = 0.05
#: A line frequent everywhere is repeated all the same: outside shares count up to this.
CEILING = 0.05


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        lines = [[dom.digits0(t.lower()) for _, t, _ in dom.parse(h).lines] for h in pdf["html"]]
        yield pd.DataFrame({"fetch_id": pdf["fetch_id"], "site": pdf["site"], "lines": lines})


def page_lines(fetch: DataFrame) -> DataFrame:
    """Visible normalised lines of each record in order: ``(fetch_id, site, lines)``."""
    pages = spread(with_html(fetch.select("fetch_id", "final_url", "html")))
    pages = pages.select("fetch_id", site(F.col("final_url")).alias("site"), "html")
    return pages.mapInPandas(_lines, "fetch_id bigint, site string, lines array<string>")


def _xlogx(observed: Column, expected: Column) -> Column:
    return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(F.lit(0.0))


def _log_likelihood(a: Column, n1: Column, b: Column, n2: Column) -> Column:
    """Log-likelihood ratio of a of n1 records within against b of n2 outside; 0 if no excess."""
    p = (a + b) / (n1 + n2)
    g = 2 * (_xlogx(a, n1 * p) + _xlogx(n1 - a, n1 * (1 - p)) + _xlogx(b, n2 * p) + _xlogx(n2 - b, n2 * (1 - p)))
    return F.when(a * n2 > b * n1, g).otherwise(F.lit(0.0))


def excess_lines(pages: DataFrame) -> DataFrame:
    """Lines significantly more frequent within their site than outside:
    ``(site, line, n_records, n_site, n_outside, llr)``.

    Counts are combined map-side by (site, line); totals by line are sums of those counts.
    """
    counts = pages.select("site", F.explode(F.array_distinct("lines")).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n_records"))
    sites = pages.groupBy("site").agg(F.count("*").alias("n_site"))
    # Totals by line from the counts of all sites; only lines that some site repeats matter.
    by_line = counts.groupBy("line").agg(F.sum("n_records").alias("n_all"), F.max("n_records").alias("most")).where(F.col("most") >= MIN_RECORDS)
    all_records = pages.count()
    tested = counts.where(F.col("n_records") >= MIN_RECORDS).join(by_line.select("line", "n_all"), "line").join(sites, "site")
    a, n1 = F.col("n_records").cast("double"), F.col("n_site").cast("double")
    n2 = F.greatest(F.lit(float(all_records)) - n1, F.lit(1.0))
    b = F.least(F.col("n_all") - F.col("n_records") + F.lit(0.5), n2 * CEILING)
    scored = staged(
        tested.select("site", "line", "n_records", "n_site", (F.col("n_all") - F.col("n_records")).alias("n_outside"), _log_likelihood(a, n1, b, n2).alias("llr")),
        "excess",
    )
    # P(chi-square > llr) for one degree of freedom, as a logarithm; the bound of the normal
    # tail is used, which is never too small.  Ranks come from a histogram of at most 8 000 bins.
    log_p = F.when(F.col("llr") > 1, -F.col("llr") / 2 - 0.5 * F.log(F.lit(math.pi) * F.col("llr") / 2)).otherwise(F.lit(0.0))
    scored = scored.withColumn("bin", F.greatest(F.ceil(log_p * 10), F.lit(-8000)).cast("int"))
    bins = sorted((r["bin"], r["n"]) for r in scored.groupBy("bin").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in bins)
    seen, limit = 0, None
    for edge, n in bins:
        seen += n
        if edge / 10 <= math.log(ALPHA * seen / total):
            limit = edge
    return scored.where(F.col("bin") <= F.lit(limit if limit is not None else -10**6)).drop("bin")


def repeated(pages: DataFrame) -> DataFrame:
    """Excess lines that stand in enough of their site's records: ``(site, line)``."""
    return excess_lines(pages).where((F.col("n_records") >= MIN_RECORDS) & (F.col("n_records") >= MIN_SHARE * F.col("n_site"))).select("site", "line")


def found(fetch: DataFrame) -> DataFrame:
    return repeated(staged(page_lines(fetch), "lines"))


#: Repeated lines are broadcast up to this many; more meet the lines of pages under salts, so
#: that the repeated line of the largest site is no single task's.
FEW_LINES = 100_000
SALTS = 32


def without(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Anti-join of ``rows`` with ``lines`` on (site, line), whatever share of rows one key holds."""
    lines = staged(lines, "repeated")
    if lines.count() <= FEW_LINES:
        return rows.join(F.broadcast(lines), ["site", "line"], "left_anti")
    salted = lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.hash("fetch_id"), F.lit(SALTS))).join(salted, ["site", "line", "salt"], "left_anti").drop("salt")


def cleaned(fetch: DataFrame) -> DataFrame:
    """Each record's text without its site's repeated lines: ``(fetch_id, text, n_removed)``."""
    pages = staged(page_lines(fetch), "lines")
    rows = pages.select("fetch_id", "site", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    rest = without(rows, repeated(pages)).groupBy("fetch_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("x"))
    whole = pages.select("fetch_id", F.size("lines").alias("n"))
    return whole.join(rest, "fetch_id", "left").select(
        "fetch_id",
        F.coalesce(F.array_join(F.col("x.line"), "\n"), F.lit("")).alias("text"),
        (F.col("n") - F.coalesce(F.size("x"), F.lit(0))).cast("int").alias("n_removed"),
    )
