"""Result pages of search engines against written results.

The test data has no stored result pages, so the query reads the examples below; they and
their results are fixed values.
"""

from __future__ import annotations

from ..sources import serp
from .registry import query

PAGES = [
    (1, "bing", """<ol><li class="b_algo"><h2><a href="https://a.test/1">First title</a></h2><div class="b_caption"><p>First text</p></div></li>
<li class="b_algo"><h2><a href="https://www.bing.com/x">own</a></h2></li><li class="b_algo"><h2><a href="https://b.test/2">Second</a></h2><p>Second text</p></li></ol>"""),
    (2, "duckduckgo_lite", """<table><tr><td><a class="result-link" href="https://a.test/1">One</a></td></tr><tr><td><a class=result-link href="https://a.test/1">Again</a></td></tr>
<tr><td><a class=result-link href="//c.test/3">Three</a></td></tr></table>"""),
    (3, "google", """<div class="g"><a href="https://a.test/1"><h3>Title</h3></a><div class="VwiC3b">Snippet</div></div><div class="g"><a href="https://maps.google.com/">x</a></div>"""),
    (4, "duckduckgo_html", """<div class="result"><a class="result__a" href="//a.test/1">T</a><a class="result__snippet">S</a></div>"""),
    (5, "google", "please solve the CAPTCHA"),
    (6, "bing", None),
    (7, "unknown", "<a href='https://a.test/1'>x</a>"),
]
_WANT = [
    (1, "https://a.test/1", "bing", 1, 1.0), (1, "https://b.test/2", "bing", 3, 0.8), (2, "https://a.test/1", "duckduckgo_lite", 1, 1.0), (2, "https://c.test/3", "duckduckgo_lite", 3, 0.8),
    (3, "https://a.test/1", "google", 1, 1.0), (4, "https://a.test/1", "duckduckgo_html", 1, 1.0),
]


@query("seed_urls", sql="SELECT * FROM (VALUES " + ", ".join(f"({q}, '{u}', '{s}', {r}, CAST({x} AS DOUBLE))" for q, u, s, r, x in _WANT) + ") v(query_id, url, source, seed_rank, relevance_score)")
def serp_results(seed_urls):
    """Results of stored pages of four engines; blocked, missing and unknown pages give none."""
    pages = seed_urls.sparkSession.createDataFrame(PAGES, "query_id bigint, engine string, html string")
    return serp.parse(pages).select("query_id", "url", "source", "seed_rank", "relevance_score")
