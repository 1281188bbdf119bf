"""Search-result pages as a source: parsers of four layouts, rows of seeds.

Each engine has a list of selectors; the first that finds anything is used.  Parsing runs in
Arrow batches over a table of stored result pages, so any number of pages is read in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEED_URL

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

# Selectors of results, links and snippets by engine, first hit wins.
SELECTORS: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {
    "duckduckgo_lite": [("a.result-link", "", ()), ("td a[href^=http]", "", ()), (".result__a", "", ()), ("a[rel=nofollow]", "", ())],
    "bing": [("li.b_algo", "h2 a", (".b_caption p", "p")), ("div.b_algo", "h2 a", (".b_caption p", "p")), (".b_algo", "a", ("p",)), ("li[class*=algo]", "h2 a", ("p",))],
    "google": [(s, "a[href^=http]", ("div.VwiC3b", "span.aCOpRe", "div.IsZvec", ".st")) for s in ("div.g", "div[data-sokoban-container]", "div.tF2Cxc", "div[class*=g ]")],
    "duckduckgo_html": [(s, "a.result__a", ("a.result__snippet",)) for s in ("div.result", "div.results_links_deep", "div.links_deep")] + [("tr", "a[href^=http]", ("td",))],
}
# Hosts of the engines themselves, and steps and bases of scores by rank.
OWN_HOSTS = {"duckduckgo_lite": ("duckduckgo.com",), "bing": ("bing.com", "microsoft.com", "msn.com"), "google": ("google.",), "duckduckgo_html": ("duckduckgo.com",)}
BLOCKED = r"(?i)captcha|unusual traffic"


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "texts")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None) -> None:
        self.tag, self.attrs, self.up = tag, attrs, up
        self.kids: list[Node] = []
        self.texts: list = []

    def text(self) -> str:
        return "".join((t if isinstance(t, str) else t.text()).strip() for t in self.texts)

    def walk(self) -> Iterator[Node]:
        for k in self.kids:
            yield k
            yield from k.walk()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        self.at.texts.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.texts.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    return b.root


_STEP = re.compile(r"^([a-z0-9]*)((?:\.[\w-]+)*)(?:\[([\w-]+)(?:([\^*]?=)([^\]]*))?\])?$")


def _fits(node: Node, step: str) -> bool:
    tag, classes, attr, how, value = _STEP.match(step).groups()
    if tag and node.tag != tag:
        return False
    own = node.attrs.get("class", "").split()
    if any(c and c not in own for c in classes.split(".")):
        return False
    if attr:
        got = node.attrs.get(attr)
        if got is None or (how == "=" and value not in got.split()) or (how == "^=" and not got.startswith(value)) or (how == "*=" and value not in got):
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Nodes that fit a selector of steps (tag, classes, one attribute) under one another."""
    steps = re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", selector)
    out = []
    for node in root.walk():
        if _fits(node, steps[-1]):
            up, left = node.up, steps[:-1]
            while left and up is not None and up is not root.up:
                if _fits(up, left[-1]):
                    left = left[:-1]
                up = up.up
            if not left:
                out.append(node)
    return out


def results(html: str, engine: str, most: int = 10) -> list[tuple[str, str, str, str, int, float]]:
    """Rows (url, title, snippet, source, rank, score); ranks count skipped items too."""
    root = tree(html)
    own = OWN_HOSTS[engine]
    foreign = lambda u: u.startswith("http") and not any(h in u for h in own)
    items: list[Node] = []
    link_sel, snippets = "", ()
    for box, link_sel, snippets in SELECTORS[engine]:
        items = select(root, box)
        if items:
            break
    rows, seen = [], set()
    if not items:
        if engine in ("google", "duckduckgo_html"):
            return []
        for a in select(root, "a[href]"):
            u, t = a.attrs["href"], a.text()
            if foreign(u) and u not in seen and (engine != "bing" or len(t) > 5):
                seen.add(u)
                n = len(rows)
                rows.append((u, t[:100] or u, "", engine, n + 1, 0.8 - n * 0.05 if engine == "bing" else 1 - n * 0.1))
                if len(rows) >= most + 5:
                    break
        return rows
    for rank, item in enumerate(items, 1):
        link = item if not link_sel else next(iter(select(item, link_sel)), None) or next(iter(select(item, "a[href^=http]")), None)
        if link is None:
            continue
        u = link.attrs.get("href", "")
        if u.startswith("//"):
            u = "https:" + u
        if not foreign(u) or u in seen:
            continue
        heading = next(iter(select(item, "h3")), None) if engine == "google" else None
        title = (heading or link).text()
        if engine == "google" and not title:
            continue
        if not link_sel:
            up = link.up
            snippet_node = next((n for n in (select(up.up, "td") if up and up.up else []) if link not in list(n.walk())), None)
        else:
            snippet_node = next((n for s in snippets for n in select(item, s)[:1]), None)
        seen.add(u)
        rows.append((u, (title or u)[:100], (snippet_node.text() if snippet_node else "")[:200], engine, rank, 1 - (rank - 1) * 0.1))
        if len(rows) >= most + 5:
            break
    return rows


def blocked(html: Column) -> Column:
    return html.rlike(BLOCKED)


def parse(pages: DataFrame, most: int = 10) -> DataFrame:
    """Seeds of stored result pages ``(query_id, engine, html)``; blocked pages give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(q, *r) for q, e, h in zip(pdf["query_id"], pdf["engine"], pdf["html"]) if e in SELECTORS for r in results(h, e, most)]
            yield pd.DataFrame(rows, columns=["query_id", "url", "title", "snippet", "source", "seed_rank", "relevance_score"])

    ok = pages.where(F.col("html").isNotNull() & ~blocked(F.col("html"))).select("query_id", "engine", "html")
    return ok.mapInPandas(run, "query_id bigint, " + SEED_URL)
