"""Tolerant HTML reader of the text operators: visible lines and a block tree.

One scan over the markup yields a small tree of block elements and the visible
lines with their place in it.  Inline elements never bound a line and are not
nodes.  The scan never fails: open elements, missing end tags, unquoted
attributes, unterminated comments and markup inside scripts are all accepted.
"""

from __future__ import annotations

import re
from html import unescape

# Elements that do not bound a line, elements without visible text,
# and elements without content.
INLINE = frozenset("a b i u em strong span small abbr time code sub sup".split())
HIDDEN = frozenset("script style noscript template head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Block elements that end an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split()
)
# Element -> siblings of the same kind it ends, and the elements that shield them.
_ENDS_SAME = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}

_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title|</head|<body|\Z)", re.I | re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_WS = re.compile("[ \t\r 　\f\v]+")
_ODD = re.compile("[\t\r\u00a0\u3000\f\v]|  ")
_DIGITS = re.compile("[0-9]+")
_WORD = re.compile("[㐀-鿿]|[^\\s㐀-鿿]+")
_HOLDS = frozenset("p td div li section article main".split())


def normalise(text: str) -> str:
    """The normalised form of one line; entities must be decoded already."""
    text = _WS.sub(" ", text).strip().lower()
    return _DIGITS.sub("0", text)


def digits0(text: str) -> str:
    """Each run of 0-9 as ``0``."""
    return _DIGITS.sub("0", text)


def words(text: str) -> list[str]:
    """Words of a normalised line; each CJK character is a word by itself."""
    return _WORD.findall(text)


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag; names in lower case, entities decoded."""
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


class Page:
    """Block tree and visible lines of one page.

    ``tag``, ``parent``, ``attr`` and ``kids`` describe the nodes (0 is the root);
    ``lines`` holds ``(node, text, link_chars, first_link_attr)`` in page order, with
    ``text`` collapsed but in its own case.  ``titles`` are texts of title attributes and
    alt texts with the node they stand under; ``noscript`` the texts of noscript elements;
    ``code`` the texts inside code samples by node.
    """

    __slots__ = ("tag", "parent", "attr", "kids", "lines", "title", "noscript", "titles", "code")

    def __init__(self) -> None:
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.attr: list[str] = [""]
        self.kids: list[list[int]] = [[]]
        self.lines: list[tuple[int, str, int]] = []
        self.title = ""
        self.noscript: list[str] = []
        self.titles: list[tuple[int, str]] = []
        self.code: dict[int, list[str]] = {}

    def ancestors(self, node: int):
        while node > 0:
            yield node
            node = self.parent[node]


def _collapse(text: str) -> str:
    return _WS.sub(" ", text).strip() if _ODD.search(text) else text.strip(" ")


def parse(html: str) -> Page:
    """Read a page.  Null or empty html gives a page without nodes or lines."""
    page = Page()
    if not html:
        return page
    m = _TITLE.search(html)
    if m:
        page.title = _WS.sub(" ", unescape(m[1]).replace("\n", " ")).strip()
    tag, parent, attr, kids, lines = page.tag, page.parent, page.attr, page.kids, page.lines
    pieces = html.split("<")
    last = len(pieces)
    cur = 0
    buf: list[str] = [pieces[0]] if pieces[0].strip() else []
    link, link_chars, in_code = False, 0, False
    i = 1

    def flush(node: int) -> None:
        nonlocal link_chars
        whole = "".join(buf)
        buf.clear()
        if "&" in whole:
            whole = unescape(whole)
        if "\n" in whole:
            share = link_chars / max(1, len(whole.strip()))
            for part in whole.split("\n"):
                part = _collapse(part)
                if part:
                    lines.append((node, part, int(len(part) * min(1.0, share))))
        else:
            whole = _collapse(whole)
            if whole:
                lines.append((node, whole, link_chars))
        link_chars = 0

    while i < last:
        piece = pieces[i]
        i += 1
        head, close, text = piece.partition(">")
        first = piece[:1]
        closing = first == "/"
        if not closing and not first.isalpha():
            if piece[:3] == "!--":
                # A comment ends at the first "-->", else at the end of the page.
                while "-->" not in piece and i < last:
                    piece = pieces[i]
                    i += 1
                text = piece.partition("-->")[2]
                if text:
                    buf.append(text)
                    if link:
                        link_chars += len(text)
            elif first in ("!", "?"):
                if text:
                    buf.append(text)
            else:  # a bare "<"
                buf.append("<" + piece)
            continue
        if not close:
            if i < last:  # a tag cut by the next one, or markup inside an attribute
                if head.count('"') % 2 or head.count("'") % 2:
                    pieces[i] = piece + "<" + pieces[i]
                    continue
            else:
                head, text = piece, ""
        elif head.count('"') % 2:  # ">" inside a quoted value
            k = piece.find('"', len(head))
            k = piece.find(">", k) if k >= 0 else -1
            if k >= 0:
                head, text = piece[:k], piece[k + 1 :]
            elif i < last and '"' in pieces[i]:
                pieces[i] = piece + "<" + pieces[i]
                continue
        raw = ""
        name = head[1:] if closing else head
        for stop in (" ", "\n", "\t", "/"):
            at = name.find(stop)
            if at >= 0:
                raw = name[at:]
                name = name[:at]
                if stop == " ":
                    at = name.find("\n")
                    if at >= 0:
                        name = name[:at]
                    break
        name = name.lower()
        if name in INLINE:
            if name == "a":
                link = not closing
                if raw and "title" in raw:
                    t = attributes(raw).get("title")
                    if t:
                        page.titles.append((cur, t))
            elif name == "code":
                in_code = not closing
            if text:
                buf.append(text)
                if link:
                    link_chars += len(text)
                if in_code:
                    page.code.setdefault(cur, []).append(_collapse(unescape(text)))
            continue
        if name in HIDDEN:
            if not closing and not raw.endswith("/"):
                ends = "/" + name
                inner = [text] if name == "noscript" else None
                k = i
                while k < last:
                    low = pieces[k][: len(ends) + 1].lower()
                    if low.startswith(ends) and low[len(ends) :] in (">", " ", "\n", "\t", ""):
                        break
                    if name == "head" and low.startswith("body"):
                        break
                    if inner is not None:
                        inner.append(pieces[k].partition(">")[2])
                    k += 1
                if inner is not None:
                    page.noscript.append(_collapse(unescape(" ".join(inner)).replace("\n", " ")))
                if k >= last and name == "head":  # an open head: what follows is read as body
                    continue
                if k < last and name == "head" and pieces[k][:1] != "/":
                    i = k
                    continue
                i = k + 1
                text = pieces[k].partition(">")[2] if k < last else ""
            if text:
                buf.append(text)
                if link:
                    link_chars += len(text)
            continue
        if buf:
            flush(cur)
        if closing:
            node = cur
            while node > 0 and tag[node] != name:
                node = parent[node]
            if node > 0:
                cur = parent[node]
                if name == "pre":
                    in_code = False
            link = False
        elif name in VOID:
            if raw and ("alt" in raw or "content" in raw or "title" in raw or "value" in raw):
                values = attributes(raw)
                for key in ("alt", "title", "content", "value"):
                    if values.get(key):
                        page.titles.append((cur, values[key]))
        elif name not in ("html", "body"):
            if name in _ENDS_P:
                node = cur
                while node > 0 and tag[node] not in _HOLDS:
                    node = parent[node]
                if node > 0 and tag[node] == "p":
                    cur = parent[node]
            same = _ENDS_SAME.get(name)
            if same:
                node = cur
                while node > 0 and tag[node] not in same[1]:
                    if tag[node] in same[0]:
                        cur = parent[node]
                        break
                    node = parent[node]
            if name == "pre":
                in_code = True
            new = len(tag)
            tag.append(name)
            parent.append(cur)
            attr.append(raw)
            kids.append([])
            kids[cur].append(new)
            cur = new
            link = False
        if text:
            buf.append(text)
            if in_code:
                page.code.setdefault(cur, []).append(_collapse(unescape(text)))
    if buf:
        flush(cur)
    return page
