"""HTML extraction by native expressions (the engine's default extractor).

Regular expressions stay inside whole-stage code and run at scan speed; pages are read
defensively (comments and scripts out first).  Elements are unrolled, not back-referenced,
so that the same expressions run elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

#: Elements whose subtrees are no content.
DROPPED = ("script", "style", "nav", "footer", "header", "aside")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&amp;", "&"))
HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]*)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_US = r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"
PHONE_INTL = r"\b\+?\d{1,3}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
PHONE_12 = r"\b\d{4}[-.\s]?\d{4}[-.\s]?\d{4}\b"
URL_IN_TEXT = r"https?://[^\s<>\"'{}|\\^`\[\]]+"


#: Comments and dropped elements in one pass, leftmost first.
DROP_ALL = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in DROPPED)


def drop(html: Column, tag: str) -> Column:
    return F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", " "), "(?s)<[^>]*>", " ")


def unescape(t: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, t)


def text(html: Column) -> Column:
    """Visible text without the dropped elements, entities decoded, white space collapsed."""
    return collapse(unescape(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), DROP_ALL, " "), "(?s)<[^>]*>", " ")))


def _first(html: Column, pattern: str) -> Column:
    t = collapse(unescape(strip_tags(F.regexp_extract(F.coalesce(html, F.lit("")), pattern, 1))))
    return F.when(t != "", t)


def title(html: Column) -> Column:
    """First of the title element, the first h1 and og:title; '' if there is none."""
    return F.coalesce(
        _first(html, r"(?is)<title[^>]*>(.*?)</title"),
        _first(html, r"(?is)<h1[^>]*>(.*?)</h1"),
        _first(html, r"(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)"),
        F.lit(""),
    )


def language(html: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1))


def description(html: Column) -> Column:
    return F.coalesce(_first(html, r"(?is)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)"), F.lit(""))


def meta(html: Column, *names: str) -> Column:
    """Content of the first meta element of one of the names (or properties); '' without one."""
    listed = "|".join(n.replace(".", r"\.") for n in names)
    return F.coalesce(_first(html, rf"(?is)<meta[^>]*(?:name|property)=[\"']?(?:{listed})[\"']?[^>]*content=[\"']([^\"']*)"), F.lit(""))


def emails(t: Column, cap: int | None = 20) -> Column:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(EMAIL), 0)))
    return F.slice(found, 1, cap) if cap else found


def phones(t: Column, patterns: tuple[str, ...] = (PHONE_US, PHONE_INTL), cap: int | None = 10) -> Column:
    t = F.coalesce(t, F.lit(""))
    found = F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(t, F.lit(p), 0) for p in patterns))))
    return F.slice(found, 1, cap) if cap else found


def urls_in_text(t: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(URL_IN_TEXT), 0)))
