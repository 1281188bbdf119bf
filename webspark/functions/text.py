"""Text scalar functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it, in a form Java and RE2 read alike.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WS_BUT_SPACE = WS.replace(r"\s", r"\t\n\f\r")
WORD = r"[\p{L}\p{N}_]"


def strip(t: Column) -> Column:
    return F.regexp_replace(t, f"^{WS}+|{WS}+$", "")


def collapse(t: Column) -> Column:
    # Lone spaces, most of all white space, are left as they are; afterwards only spaces are
    # left to trim.
    return F.trim(F.regexp_replace(t, f" *{_WS_BUT_SPACE}{WS}*|  +", " "))


def clean(t: Column, c1: bool = False) -> Column:
    """Null to '', white space collapsed, control characters dropped, trimmed."""
    controls = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f" + (r"\x{80}-\x{9f}" if c1 else "") + "]"
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), f"{WS}+", " "), controls, ""))


def truncate(t: Column, size: int = 100, suffix: str = "...") -> Column:
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size - len(suffix)), F.lit(suffix))).otherwise(t)


def sentences(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, "[.!?。！？]+"), lambda s: clean(s)), lambda s: s != "")


def words(t: Column) -> Column:
    return F.filter(F.split(t, f"{WS}+"), lambda w: w != "")


def word_count(t: Column) -> Column:
    return F.size(words(F.coalesce(t, F.lit(""))))


def _last(t: Column, char: str) -> Column:
    """0-based place of the last ``char``; -1 if there is none."""
    at = F.locate(char, F.reverse(t))
    return F.when(at > 0, F.length(t) - at).otherwise(-1)


def summary(t: Column, size: int = 500) -> Column:
    """Collapsed; longer texts end at the last full stop of their first ``size`` characters if
    it is past the middle, else in dots."""
    c = collapse(F.coalesce(t, F.lit("")))
    cut = F.substring(c, 1, size)
    at = _last(cut, ".")
    return F.when(F.length(c) <= size, c).when(at > size // 2, F.substring(cut, F.lit(1), (at + 1).cast("int"))).otherwise(F.concat(cut, F.lit("...")))


def preview(t: Column, size: int = 500) -> Column:
    """As ``summary`` with the full stop past 60 %, else cut at the last space with dots."""
    c = F.coalesce(t, F.lit(""))
    cut = F.substring(c, 1, size)
    at = _last(cut, ".")
    space = _last(cut, " ")
    shorter = F.when(space > 0, F.substring(cut, F.lit(1), space.cast("int"))).otherwise(cut)
    return F.when(F.length(c) <= size, c).when(at > F.lit(size * 0.6), F.substring(cut, F.lit(1), (at + 1).cast("int"))).otherwise(F.concat(shorter, F.lit("...")))


def short_hash(t: Column) -> Column:
    return F.substring(F.sha2(t, 256), 1, 16)


def sanitize_storage(name: Column, size: int = 50) -> Column:
    """Lowercase letters, digits and ``_`` of any script; 'unnamed' if nothing is left."""
    n = F.regexp_replace(F.lower(name), f"[^{WORD[1:-1]}]", "_")
    n = F.regexp_replace(F.regexp_replace(n, "_+", "_"), "^_+|_+$", "")
    n = F.regexp_replace(F.substring(n, 1, size), "_+$", "")
    return F.when(n == "", F.lit("unnamed")).otherwise(n)


def sanitize_namer(name: Column, size: int = 50) -> Column:
    n = F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_")
    n = F.regexp_replace(F.regexp_replace(n, "_+", "_"), "^_+|_+$", "")
    return F.regexp_replace(F.substring(n, 1, size), "_+$", "")


def rule_name(title: Column) -> Column:
    """Name from a title by rule: its first words, or a hash where it has none."""
    t = F.regexp_replace(F.lower(title), r"[^a-z0-9\s\x{4e00}-\x{9fff}]", "")
    by_hash = F.concat(F.lit("page_"), F.substring(F.md5(title), 1, 8))
    cjk = F.slice(F.regexp_extract_all(t, F.lit("[a-z]+"), 0), 1, 4)
    latin = F.slice(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 2), 1, 6)
    ws = F.when(t.rlike(r"[\x{4e00}-\x{9fff}]"), cjk).otherwise(latin)
    return sanitize_namer(F.when(F.size(ws) > 0, F.array_join(ws, "_")).otherwise(by_hash))


def name_v2(category: Column, url: Column, title: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.substring(F.coalesce(title, F.lit("")), 1, 30), f"[^{WORD[1:-1]}-]", "_"), "_+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    return F.concat_ws("_", category, F.substring(F.md5(url), 1, 8), F.when(t == "", F.lit("page")).otherwise(t))


def llm_name(answer: Column, category: Column, title: Column) -> Column:
    """A model's answer made a name; else category and a hash of the title."""
    n = F.regexp_replace(F.regexp_replace(F.coalesce(answer, F.lit("")), f"[^{WORD[1:-1]}-]", "_"), "_+", "_")
    n = F.regexp_replace(F.substring(n, 1, 30), "^_+|_+$", "")
    return F.when(n != "", n).otherwise(F.concat_ws("_", category, F.substring(F.md5(F.coalesce(title, F.lit(""))), 1, 8)))
