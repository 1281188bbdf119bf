"""Main body of web pages by wrapper induction (problem 7).

1. Two example pages of each site are chosen by the smallest content hash.
2. The block tree of every page is aligned with the trees of its site's examples by
   simple tree matching.  Nodes with the same text as their partner are template,
   varying nodes are slots that may hold content.
3. Slots that are constant only across sites (bylines, share prompts of sites with a
   single page) are found from the masked line counts over all records: a line that
   stands beside many different articles belongs to no article.
4. What remains inside the container of the page's heading is its main body.

Null or empty html gives no rows; repeated records give equal rows each.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from hashlib import blake2b, md5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .common import site, staged, with_html

# Names of months in the languages of the corpus, for masking dates.
MONTHS = (
    "january february march april may june july august september october november december "
    "januar februar märz mai juni juli oktober dezember "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre "
    "janeiro fevereiro março maio junho julho setembro outubro novembro dezembro "
    "января февраля марта апреля мая июня июля августа сентября октября ноября декабря"
).split()
_MONTHS = frozenset(MONTHS)
# A month behind a number, found from the number; and a word before one, if it is a month.
_MONTH_AFTER = re.compile(r"(0\s)(?:de\s)?(?:" + "|".join(MONTHS) + r")\b")
_WORD_BEFORE = re.compile(r"\b[^\W\d_]+(?=\s0)")
_ROLE = re.compile(r"role\s*=\s*[\"']?(?:dialog|alertdialog|navigation|banner|contentinfo|complementary|search|menu)", re.I)
_COPYRIGHT = re.compile(r"^©\s*(?:[0-9]+\s*)?")
_CJK = re.compile("[㐀-鿿]")
_FINISHED = re.compile("[.!?。！？…][\"'”’»)\\]]*$")
_KEEP = frozenset("h1 h2 td th li dt dd caption figcaption pre".split())
_LOW = frozenset("h3 h4 h5 h6".split())

#: A masked line is template if it stands beside at least this many different articles,
MIN_CONTEXTS = 5
#: and if alignment finds it constant in at least this share of its records
#: (for headings of blocks: if it stands beside running text that often).
MIN_CONSTANT = 0.12
MIN_PROSE = 0.4
#: A block of links or attributes is a main body from this many characters on.
MIN_LIST = 200


def hash64(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def n_words(norm: str) -> int:
    n = norm.count(" ") + 1
    return n if norm.isascii() or not _CJK.search(norm) else len(dom.words(norm))


def brand_of(page: dom.Page) -> str:
    """Name of the site as the page gives it: in its copyright line, else behind the title."""
    for _, text, _ in reversed(page.lines):
        if text[0] == "©":
            return _COPYRIGHT.sub("", text.lower()).strip(" .")
    parts = page.title.rsplit(" - ", 1)
    return dom.normalise(parts[1]) if len(parts) == 2 else ""


def mask(norm: str, brand: str) -> str:
    if len(brand) > 1:
        norm = norm.replace(brand, "§")
    if "0 " in norm:
        norm = _MONTH_AFTER.sub(r"\1µ", norm)
    if " 0" in norm:
        norm = _WORD_BEFORE.sub(lambda m: "µ" if m[0] in _MONTHS else m[0], norm)
    return norm


class Body:
    """Lines inside the container of a page, with what is known of each from the page alone;
    ``plain`` are the lines with the site's name and dates masked."""

    __slots__ = ("page", "container", "lines", "norms", "kinds", "masks", "prose", "heading", "brand", "attr_words", "plain")


def _excluded(page: dom.Page, has_h1: list[bool]) -> list[bool]:
    """Nodes under navigation, asides, footers, mastheads and dialogs."""
    out = [False] * len(page.tag)
    tag, parent, attr = page.tag, page.parent, page.attr
    for i in range(1, len(out)):
        if out[parent[i]]:
            out[i] = True
            continue
        t = tag[i]
        if t in ("nav", "aside"):
            out[i] = not has_h1[i]
        elif t == "footer":
            out[i] = not any(tag[a] in ("blockquote", "figure") for a in page.ancestors(i))
        elif t == "header":
            out[i] = not has_h1[i]
        elif attr[i] and "role" in attr[i] and _ROLE.search(attr[i]):
            out[i] = not has_h1[i]
    return out


def segment(page: dom.Page) -> Body:
    """Find the container of the page's article and classify the lines in it.

    kinds: 0 content whatever the counts say, 1 may be a template line, 2 part of a block
    under a low heading (its mask is the heading's), 3 dropped (links to other pages).
    """
    tag, parent = page.tag, page.parent
    n = len(tag)
    lines = page.lines
    own = [0] * n
    chars = [0] * n
    has_h1 = [False] * n
    h1 = 0
    for i in range(1, n):
        if tag[i] == "h1":
            if not h1:
                h1 = i
            for a in page.ancestors(i):
                has_h1[a] = True
    size = [0] * n
    legal = [False] * n
    for node, text, link in lines:
        own[node] += 1
        size[node] += len(text)
        chars[node] += len(text) - min(link, len(text))
        legal[node] |= text[0] == "©"
    named = [0] * n
    for node, text in page.titles:
        named[node] += len(text)
    total, plain = own[:], chars[:]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        plain[p] += plain[i]
        size[p] += size[i]
        named[p] += named[i]
        legal[p] |= legal[i]
    out = _excluded(page, has_h1)
    if h1:
        c = h1
        while c > 0 and (total[c] == total[h1] and named[c] == named[h1] or tag[c] == "header"):
            c = parent[c]
    else:
        # Without a heading: the article element, else the block of most text that is not made
        # of links and holds no copyright line.  Where links or attributes make up most of the
        # page outside its menus, the block that holds most of them is the main body; a page
        # of none of these has none.
        c, best = n, 0
        blocks = [i for i in page.kids[0] if not out[i] and (total[i] or named[i]) and not legal[i]]
        for i in range(1, n):
            if not out[i] and tag[i] in ("main", "article"):
                c = i
                break
        else:
            for i in blocks:
                if plain[i] > best and plain[i] >= 0.6 * size[i]:
                    c, best = i, plain[i]
            mass = sum(size[i] + named[i] for i in blocks)
            for i in blocks:
                if size[i] + named[i] > max(best, MIN_LIST, 0.5 * mass):
                    c, best = i, size[i] + named[i]
            if c == n:  # a notice beside link blocks: the block with most finished sentences
                said = [0] * n
                for node, text, link in lines:
                    if tag[node] == "p" and link * 2 < len(text) and _FINISHED.search(text):
                        said[node] += len(text)
                for i in range(n - 1, 0, -1):
                    said[parent[i]] += said[i]
                c = max(blocks, key=lambda i: said[i], default=n)
                if c < n and not said[c]:
                    c = n
            if c == n and own[0]:
                c = 0
    inside = [False] * (n + 1)
    inside[c] = True
    for i in range(c + 1, n):
        inside[i] = inside[parent[i]]
    body = Body()
    body.page, body.container = page, c
    body.brand = brand_of(page)
    # Blocks under low headings: the heading's parent, or its following siblings in a flat page.
    group = [0] * n
    for i in range(c + 1, n):
        if inside[i] and not out[i]:
            if tag[i] in _LOW or (tag[i] == "h2" and parent[i] != c and tag[parent[i]] != "header" and not has_h1[parent[i]]):
                p = parent[i]
                if p != c and not has_h1[p]:
                    group[p] = i
                else:
                    on = False
                    for s in page.kids[p]:
                        if s == i:
                            on = True
                        elif on and tag[s] in dom.HEADINGS:
                            break
                        if on:
                            group[s] = i
    for i in range(c + 1, n):
        if not group[i] and inside[i]:
            group[i] = group[parent[i]]
    members: dict[int, list[int]] = {}
    keep: list[int] = []
    for k, (node, _, _) in enumerate(lines):
        if inside[node] and not out[node]:
            keep.append(k)
            if group[node]:
                members.setdefault(group[node], []).append(k)
    dropped: set[int] = set()
    for ks in members.values():
        rest = [k for k in ks if tag[lines[k][0]] not in dom.HEADINGS]
        linked = sum(1 for k in rest if lines[k][2] >= 0.8 * len(lines[k][1]))
        if rest and linked * 2 >= len(rest):
            dropped.update(ks)
    body.lines, body.norms, body.kinds, body.masks, body.plain = [], [], [], [], []
    body.heading = 0
    prose = 0
    seen_h1 = not h1
    quoted = "blockquote" in tag
    for k in keep:
        node, text, link = lines[k]
        norm = dom.digits0(text.lower())
        plain = mask(norm, body.brand)
        t = tag[node]
        if t == "h1":
            seen_h1 = True
            if not body.heading:
                body.heading = hash64(norm)
        full_link = link >= 0.8 * len(text)
        m = 0
        if k in dropped:
            kind = 3
        elif c == 0 and not seen_h1 and (full_link or " | " in norm or len(norm) < 40):
            kind = 3
        elif c == 0 and norm.startswith("©"):
            kind = 3
        elif group[node]:
            kind = 2
            first = members[group[node]][0]
            m = hash64("#" + mask(dom.digits0(lines[first][1].lower()), body.brand))
        elif t in _KEEP or full_link or quoted and any(tag[a] == "blockquote" for a in page.ancestors(node)):
            kind = 0
        else:
            if n_words(norm) >= 12:
                prose += 1
            kind = 1
            m = hash64(plain)
        body.plain.append(plain)
        body.lines.append(k)
        body.norms.append(norm)
        body.kinds.append(kind)
        body.masks.append(m)
    body.prose = prose
    body.attr_words = sum(len(t.split()) for node, t in page.titles if inside[node] and not out[node])
    return body


# -- Alignment of trees --------------------------------------------------------------------


class Tree:
    """Container subtree prepared for matching: labels, texts and subtree keys."""

    __slots__ = ("tag", "kids", "text", "key", "size", "lines", "depth")

    def __init__(self, body: Body) -> None:
        page = body.page
        if body.container >= len(page.tag):
            self.tag, self.kids, self.text, self.key, self.size, self.lines, self.depth = ["#none"], [[]], [()], [0], [1], [()], 1
            return
        at: dict[int, list[int]] = {}
        for j, k in enumerate(body.lines):
            at.setdefault(page.lines[k][0], []).append(j)
        # Nodes in page order, so a parent stands before its children, however deep they are.
        nodes, todo, number = [], [body.container], {}
        while todo:
            node = todo.pop()
            number[node] = len(nodes)
            nodes.append(node)
            todo.extend(reversed(page.kids[node]))
        self.tag = [page.tag[node] for node in nodes]
        self.lines = [at.get(node, ()) for node in nodes]
        self.text = [tuple(body.plain[j] for j in ls) for ls in self.lines]
        self.kids = [[number[k] for k in page.kids[node]] for node in nodes]
        self.size, self.key, self.depth = [1] * len(nodes), [0] * len(nodes), 0
        deep = [1] * len(nodes)
        for me in range(len(nodes) - 1, -1, -1):
            kids = self.kids[me]
            self.size[me] += sum(self.size[k] for k in kids)
            self.key[me] = hash((self.tag[me], self.text[me], tuple(self.key[k] for k in kids)))
            deep[me] += max((deep[k] for k in kids), default=0)
        self.depth = deep[0]


def match(a: Tree, b: Tree, i: int = 0, j: int = 0, memo: dict | None = None) -> int:
    """Size of the maximum match of two ordered trees by simple tree matching.

    Roots must have the same element; children match in order.  A node whose text agrees
    with its partner's counts three, so equal texts are preferred among equal elements.
    """
    if a.tag[i] != b.tag[j]:
        return 0
    if memo is None:
        memo = {}
    known = memo.get((i, j))
    if known is not None:
        return known[0]
    own = 3 if a.text[i] and a.text[i] == b.text[j] else 1
    ka, kb = a.kids[i], b.kids[j]
    if not ka or not kb:
        memo[i, j] = (own, None)
        return own
    if a.key[i] == b.key[j]:
        score = 3 * a.size[i]
        memo[i, j] = (score, "same")
        return score
    w = [[match(a, b, x, y, memo) if a.tag[x] == b.tag[y] else 0 for y in kb] for x in ka]
    prev = [0] * (len(kb) + 1)
    table = [prev]
    for row in w:
        cur = [0]
        last = 0
        for y, v in enumerate(row):
            best = prev[y + 1]
            if last > best:
                best = last
            if v and prev[y] + v > best:
                best = prev[y] + v
            cur.append(best)
            last = best
        table.append(cur)
        prev = cur
    score = own + prev[-1]
    memo[i, j] = (score, (w, table))
    return score


def constant_lines(a: Tree, b: Tree) -> set[int]:
    """Lines of ``a`` whose node is aligned with a node of ``b`` of the same text."""
    memo: dict = {}
    deep = 3 * min(a.depth, b.depth) + 1000  # ``match`` goes as deep as the trees
    if deep > sys.getrecursionlimit():
        sys.setrecursionlimit(deep)
    if not match(a, b, 0, 0, memo):
        return set()
    found: set[int] = set()
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        if a.text[i] and a.text[i] == b.text[j]:
            found.update(a.lines[i])
        how = memo.get((i, j), (0, None))[1]
        if how is None:
            continue
        ka, kb = a.kids[i], b.kids[j]
        if how == "same":
            todo.extend(zip(ka, kb))
            continue
        w, table = how
        x, y = len(ka), len(kb)
        while x and y:
            if table[x][y] == table[x - 1][y]:
                x -= 1
            elif table[x][y] == table[x][y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                todo.append((ka[x], kb[y]))
    return found


# -- Spark ---------------------------------------------------------------------------------

#: One row a page.  kind 0: content; 1 and 2: content unless ``mask`` is a template line;
#: 4: constant by alignment, kept without its text for the counts.
#: ``extra`` holds what another operator asked for, one value a line; ``notes`` the same of the page.
PAGE_SCHEMA = "fetch_id bigint, heading bigint, prose int, lines array<string>, kinds array<tinyint>, masks array<bigint>, extra array<int>, notes int"

#: What a caller may ask of each page: (body, indices of its lines) -> (one int a line, one int).
Extra = Callable[[Body, list[int]], tuple[list[int], int]]


def _segment_rows(batches: Iterator[pd.DataFrame], text: str, extra: Extra | None) -> Iterator[pd.DataFrame]:
    group: tuple | None = None
    examples: list[tuple[Body, Tree]] = []
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            if (r.site, r.key) != group:
                group, examples = (r.site, r.key), []
            body = segment(dom.parse(r.html))
            if r.lead:  # an example of the pages that follow
                examples.append((body, Tree(body)))
                continue
            kinds = body.kinds
            if examples and any(k == 1 for k in kinds):
                tree = None
                for other, other_tree in examples:
                    if other.heading == body.heading:
                        continue
                    tree = tree or Tree(body)
                    same = {j for j in constant_lines(tree, other_tree) if kinds[j] == 1}
                    prose = sum(1 for j in same if n_words(body.norms[j]) >= 12)
                    if prose * 2 <= body.prose or prose == 0:  # else a copy of this very page
                        kinds = [4 if j in same else k for j, k in enumerate(kinds)]
            use = [j for j, k in enumerate(kinds) if k != 3]
            texts = [body.norms[j] if kinds[j] != 4 else "" for j in use]
            if text == "none":
                texts = [""] * len(use)
            elif text == "hash":
                texts = [t and md5(t.encode("utf-8", "surrogatepass")).hexdigest()[:16] for t in texts]
            more, notes = extra(body, use) if extra else ([], 0)
            rows.append((r.fetch_id, body.heading, body.prose, texts, [kinds[j] for j in use], [body.masks[j] for j in use], more, notes))
        yield pd.DataFrame(rows, columns=["fetch_id", "heading", "prose", "lines", "kinds", "masks", "extra", "notes"])


#: Records of one site that meet its examples under one key.
PER_KEY = 2000
#: Sites of more records than that are broadcast with their number of keys up to this many
#: sites; more are joined, under ``SALTS`` salts so that no site is one task's.
FEW_SITES = 50_000
SALTS = 64


def with_examples(pages: DataFrame, per_site: int = 2) -> DataFrame:
    """``pages`` (fetch_id, site, html) grouped and sorted by (site, key), each group led by up
    to ``per_site`` example pages of its site (``lead`` is true): those of the least content
    hash in each of as many hash classes.

    Only ids and hashes are aggregated; the html of the chosen records is fetched by id and
    travels once a group.  A site has one key for every ``PER_KEY`` records, so however many
    of all rows one site holds, they spread over as many groups, while small sites are not
    multiplied.  Groups are streamed, never held.
    """
    h = F.xxhash64("html")
    chosen = staged(
        pages.select("fetch_id", "site", h.alias("h")).groupBy("site", F.pmod("h", F.lit(per_site)).alias("c")).agg(F.min_by("fetch_id", "h").alias("fetch_id"), F.count("*").alias("n")),
        "sites",
    )
    size = chosen.groupBy("site").agg(F.sum("n").alias("n")).select("site", F.ceil(F.col("n") / PER_KEY).cast("int").alias("keys"))
    hot = size.where("keys > 1")
    if hot.limit(FEW_SITES + 1).count() <= FEW_SITES:
        known = pages.join(F.broadcast(hot), "site", "left")
    else:
        salts = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        known = pages.withColumn("salt", F.pmod(F.hash("fetch_id"), F.lit(SALTS))).join(salts, ["site", "salt"], "left").drop("salt")
    keyed = known.select("fetch_id", "site", F.pmod(F.xxhash64("fetch_id"), F.coalesce("keys", F.lit(1))).cast("int").alias("key"), "html", F.lit(False).alias("lead"))
    examples = (
        pages.join(chosen.select("fetch_id"), "fetch_id", "left_semi")
        .select("fetch_id", "site", "html")
        .join(size, "site")
        .select("fetch_id", "site", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("key"), "html", F.lit(True).alias("lead"))
    )
    return keyed.unionAll(examples).repartition("site", "key").sortWithinPartitions("site", "key", F.col("lead").desc(), "fetch_id")


def page_bodies(fetch: DataFrame, text: str = "line", extra: Extra | None = None) -> DataFrame:
    """Candidate main-body lines of each record, one row a record (``PAGE_SCHEMA``).

    ``text`` says what stands in ``lines``: the normalised line, its "hash", or "none".
    """
    pages = with_html(fetch.select("fetch_id", "final_url", "html")).select("fetch_id", site(F.col("final_url")).alias("site"), "html")
    pages = with_examples(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _segment_rows(batches, text, extra)

    return pages.mapInPandas(run, PAGE_SCHEMA)


def template_masks(bodies: DataFrame) -> DataFrame:
    """Masked lines that stand beside many different articles: column ``mask``.

    Counts cover all records; they are aggregated by (line, article heading) before the
    number of different headings is taken, so frequent lines are combined map-side.
    """
    each = bodies.select(
        "heading", (F.col("prose") >= 2).cast("int").alias("p"), F.explode(F.array_distinct(F.arrays_zip("masks", "kinds"))).alias("x")
    ).select("heading", "p", F.col("x.masks").alias("mask"), F.col("x.kinds").alias("kind"))
    by_context = (
        each.where("mask <> 0")
        .groupBy("mask", "heading")
        .agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.sum((F.col("kind") == 4).cast("int")).alias("f"), F.max((F.col("kind") == 2).cast("int")).alias("g"))
    )
    total = by_context.groupBy("mask").agg(F.count("*").alias("contexts"), *(F.sum(c).alias(c) for c in "npf"), F.max("g").alias("g"))
    constant = F.when(F.col("g") == 1, F.col("p") >= MIN_PROSE * F.col("n")).otherwise(F.col("f") >= MIN_CONSTANT * F.col("n"))
    return total.where((F.col("contexts") >= MIN_CONTEXTS) & constant).select("mask")


def main_lines(bodies: DataFrame) -> DataFrame:
    """Main-body lines ``(fetch_id, pos, line)`` of staged ``page_bodies``."""
    rows = bodies.select("fetch_id", F.posexplode(F.arrays_zip("lines", "masks", "kinds")).alias("pos", "x")).select(
        "fetch_id", "pos", F.col("x.lines").alias("line"), F.col("x.masks").alias("mask"), F.col("x.kinds").alias("kind")
    )
    fixed = rows.where("kind = 0").drop("mask", "kind")
    free = rows.where("kind in (1, 2)").join(template_masks(bodies), "mask", "left_anti").select("fetch_id", "pos", "line")
    return fixed.unionAll(free)


#: Template lines up to this many are carried in the plan; more are joined.
FEW_TEMPLATES = 10_000


def clean_bodies(bodies: DataFrame) -> DataFrame:
    """Staged ``page_bodies`` with template lines taken out: one row a record with the arrays
    ``lines`` and ``extra`` of its main body, in page order, and ``notes``.

    A page without main body keeps its row, with empty arrays.  The template lines of a crawl
    are few (their number is counted, not assumed); beyond ``FEW_TEMPLATES`` only the masks of
    lines are exploded and joined, and the pages move once.
    """
    rows = F.arrays_zip("lines", "kinds", "masks", "extra")
    templates = template_masks(bodies)
    few = [r["mask"] for r in templates.limit(FEW_TEMPLATES + 1).collect()]
    if len(few) <= FEW_TEMPLATES:
        kept = F.filter(rows, lambda x: (x.kinds != 4) & ~x.masks.isin(few)) if few else F.filter(rows, lambda x: x.kinds != 4)
    else:
        free = bodies.select("fetch_id", F.explode(F.array_distinct("masks")).alias("mask")).where("mask <> 0")
        bad = free.join(templates, "mask", "left_semi").groupBy("fetch_id").agg(F.collect_set("mask").alias("bad"))
        bodies = bodies.join(bad, "fetch_id", "left")
        kept = F.filter(rows, lambda x: (x.kinds != 4) & ~((x.masks != 0) & F.coalesce(F.array_contains("bad", x.masks), F.lit(False))))
    return bodies.select("fetch_id", kept.getField("lines").alias("lines"), kept.getField("extra").alias("extra"), "notes")


def main_body(fetch: DataFrame) -> DataFrame:
    """Main body of each record as lines ``(fetch_id, pos, line)``, template and menus removed."""
    return main_lines(staged(page_bodies(fetch), "bodies"))


def found(fetch: DataFrame) -> DataFrame:
    """Distinct main-body lines of each record as hashes (p7_found)."""
    return main_lines(staged(page_bodies(fetch, "hash"), "bodies")).select("fetch_id", F.col("line").alias("line_hash")).distinct()
