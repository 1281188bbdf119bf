"""Links of pages: extraction, filters, caps, per page in document order."""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import url as U
from ..functions.text import collapse
from .dedup import first_by
from .rank import top_per

_HREF = r"(?is)(?:^|\s)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"


#: What ends the text of an anchor that is left open: the next anchor and any block element.
_ANCHOR_END = r"(?is)(?:</a\b|<a>|</?(?:p|div|li|ul|ol|dl|dt|dd|td|th|tr|table|h[1-6]|section|article|nav|footer|header|aside|main|blockquote|form|body|html)\b).*$"


def anchors(pages: DataFrame) -> DataFrame:
    """``(fetch_id, base, pos, href, text)`` of every anchor; comments and scripts are skipped.

    Pages are projected away before the explode, so html never travels with the links.
    """
    page = F.regexp_replace(H.drop(H.drop(F.col("html"), "script"), "style"), "(?s)<!--.*?-->", "")
    # A start tag begins an anchor whether or not the one before was closed.
    starts = F.split(page, r"(?i)<a\s")
    pieces = F.filter(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda x: F.contains(x, F.lit(">")))
    rows = pages.where("html is not null").select("fetch_id", F.coalesce("final_url", "url").alias("base"), F.posexplode(pieces).alias("pos", "x"))
    attr = F.substring_index("x", ">", 1)
    href = F.concat(*(F.coalesce(F.regexp_extract(attr, _HREF, i), F.lit("")) for i in (1, 2, 3)))
    inner = F.regexp_replace(F.substring(F.col("x"), F.length(attr) + 2, F.length("x")), _ANCHOR_END, "")
    label = collapse(H.unescape(H.strip_tags(inner)))
    titled = F.regexp_extract(attr, r"(?is)(?:^|\s)title\s*=\s*[\"']([^\"']*)", 1)
    return rows.select("fetch_id", "base", "pos", F.trim(H.unescape(href)).alias("href"), F.when(label != "", label).otherwise(titled).alias("text"))


def skipped(href: Column) -> Column:
    """References that are no pages."""
    return (href == "") | href.rlike("^(#|javascript:|mailto:|tel:)")


def extract(pages: DataFrame, cap: int = 20) -> DataFrame:
    """Links of each page: skipped ones out, absolute, first of equal ones, text cut at 100,
    capped with internal links first."""
    a = anchors(pages).where(~skipped(F.col("href")))
    a = a.withColumn("url", U.resolve(F.col("href"), F.coalesce("base", F.lit(""))))
    a = first_by(a, ["fetch_id", "url"], "pos").withColumn("is_internal", U.is_internal(F.col("url"), F.coalesce("base", F.lit(""))))
    n = F.count("*").over(Window.partitionBy("fetch_id"))
    order = F.when((F.col("n") > cap) & ~F.col("is_internal"), 1).otherwise(0)
    return top_per(a.withColumn("n", n), ["fetch_id"], cap, order, "pos", rank="link_no").select(
        "fetch_id", "link_no", "url", F.substring("text", 1, 100).alias("text"), "is_internal"
    )


def valid_link(url: Column, patterns: list[str]) -> Column:
    """http(s), with a host, no exclude pattern in the lowercased url."""
    return U.part(url, 1).isin("http", "https") & (U.netloc(url) != "") & ~U.any_in(F.lower(url), patterns)


def extract_v2(links: DataFrame) -> DataFrame:
    """Links typed and given priorities, equal keys once, best first."""
    ok = links.where(valid_link(F.col("url"), U.EXCLUDE_PATTERNS_V2[:-4])).select("fetch_id", "link_no", "url", F.substring("text", 1, 200).alias("text"), "is_internal")
    ok = ok.withColumn("key", U.link_key_v2(F.col("url"))).withColumn("type", U.classify(F.col("url"))).withColumn("priority", U.link_priority_v2(F.col("url"), F.col("text")))
    return first_by(ok, ["fetch_id", "key"], F.desc("priority"), "link_no", "url").drop("key")


def filter_reason(url: Column, allowed: list[str], patterns: list[str] = U.EXCLUDE_PATTERNS, extensions: list[str] = U.EXCLUDED_EXTENSIONS) -> Column:
    """Why a url is not admitted, first failure first; 'allowed' if it is."""
    low_path = F.lower(U.part(url, 3))
    pattern = U.first_in(url, patterns)
    ext = F.nullif(F.regexp_extract(low_path, "(" + "|".join(re.escape(e) for e in extensions) + ")$", 1), F.lit(""))
    out = F.when(F.coalesce(url, F.lit("")) == "", F.lit("empty")).when(~F.lower(U.part(url, 1)).isin("http", "https"), F.lit("scheme"))
    if allowed:
        out = out.when(~U.any_in(U.host(url), allowed), F.lit("domain"))
    return out.when(pattern.isNotNull(), F.concat(F.lit("pattern:"), pattern)).when(ext.isNotNull(), F.concat(F.lit("extension:"), ext)).otherwise("allowed")


def fetch_gate(url: Column, allowed: list[str], patterns: list[str]) -> Column:
    """Whether a fetcher takes the url: patterns against the lowercased url, hosts either way."""
    h = U.bare_host(url)
    ok = U.part(url, 1).isin("http", "https") & (h != "") & ~U.any_in(F.lower(url), patterns)
    if allowed:
        hit = F.lit(False)
        for a in allowed:
            hit = hit | F.contains(h, F.lit(a)) | F.contains(F.lit(a), h)
        ok = ok & hit
    return ok
