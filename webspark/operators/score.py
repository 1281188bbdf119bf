"""Keyword scoring and classification: the deterministic side of every model step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of intent categories, in the order that breaks ties.
CATEGORY_KEYWORDS = {
    "admission": "招生 申请 录取 admission apply enrollment",
    "research": "研究 科研 论文 research paper lab",
    "contact": "联系 电话 邮箱 contact email phone",
    "email": "邮件 邮箱 email mail",
    "policy": "政策 规定 要求 policy requirement rule",
    "news": "新闻 动态 最新 news update announcement",
    "event": "活动 讲座 会议 event seminar conference",
    "data": "数据 统计 排名 data statistics ranking",
    "content": "内容 文章 介绍 content article about",
}
# Words left out of search keywords.
STOPWORDS = (
    "i want to find search for about the a an of in on at from with is are was were please help me get show give need looking"
    " 我 想 要 找 搜索 关于 的 了 和 与 在 请 帮 给 查 看"
).split()


def keyword_relevance(text: Column, keywords: list[str]) -> Column:
    """Share of the keywords found in the lowercased text; 0.5 without keywords."""
    if not keywords:
        return F.lit(0.5)
    t = F.lower(F.coalesce(text, F.lit("")))
    hits = sum((F.contains(t, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    return hits / F.lit(float(len(keywords)))


def keyword_matches(text: Column, keywords: list[str]) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(t, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))


def guess_category(intent: Column) -> Column:
    """Category with most keywords in the text; the earlier one wins ties, none gives general."""
    best, name = F.lit(0), F.lit("general")
    for category, kws in CATEGORY_KEYWORDS.items():
        n = keyword_matches(intent, kws.split())
        name = F.when(n > best, F.lit(category)).otherwise(name)
        best = F.greatest(best, n)
    return name


def search_keywords(intent: Column) -> Column:
    """First five words that are no stopwords, then two quoted phrases; the whole text if fewer than two."""
    ws = F.regexp_extract_all(F.lower(intent), F.lit(r"[\p{L}\p{N}_]+"), 0)
    stop = F.array(*map(F.lit, STOPWORDS))
    ws = F.slice(F.filter(ws, lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1)), 1, 5)
    phrases = F.slice(F.regexp_extract_all(intent, F.lit('"([^"]+)"'), 1), 1, 2)
    both = F.concat(ws, phrases)
    return F.when(F.size(both) < 2, F.array(intent)).otherwise(both)


def full_query(keywords: Column, site: Column) -> Column:
    """Keywords joined by OR, several words quoted, in parentheses if more than one, with the site."""
    quoted = F.transform(keywords, lambda k: F.when(F.contains(k, F.lit(" ")), F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k))
    joined = F.array_join(quoted, " OR ")
    body = F.when(F.size(keywords) > 1, F.concat(F.lit("("), joined, F.lit(")"))).otherwise(joined)
    return F.when(site != "", F.concat(body, F.lit(" site:"), site)).otherwise(body)
