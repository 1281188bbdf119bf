"""Garbled text from wrong character encoding (problem 2).

A text that was decoded with the wrong encoding is mapped back to that encoding's bytes;
an automaton of the byte structure (UTF-8, or the double-byte sets) finds the maximal
well-formed multibyte spans, and those spans only are decoded.  Spans are restored inside
out until nothing changes, so text garbled twice comes back too.  Where characters were
lost (U+FFFD) the record is named but the span stays as it is.

Null or empty html is never garbled and is returned unchanged.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, with_html


def _c1(error: UnicodeError):
    """Bytes an encoding leaves undefined came through as controls; what it lacks becomes '?'."""
    part = error.object[error.start : error.end]
    return bytes(ord(c) if 0x80 <= ord(c) < 0xA0 else 0x3F for c in part), error.end


codecs.register_error("webspark.c1", _c1)

# Single-byte encodings text is commonly misread with; the second list is of
# Cyrillic ones, whose own letters use the bytes of UTF-8 and so need more evidence.
LATIN_CODECS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1250")
CYRILLIC_CODECS = ("cp1251", "koi8_r", "cp866")
#: Double-byte encodings.
WIDE_CODECS = ("gbk", "cp932", "big5")

_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_UTF8_WIDE = re.compile(rb"(?:[\xe3-\xe9][\x80-\xbf][\x80-\xbf]|\xef[\xbc\xbd][\x80-\xbf]){2,}[\xe3-\xef][\x80-\xbf]")
_PLAUSIBLE = re.compile("[ -ſЀ-џҐґ‐-⁄€№™　-〿一-鿿＀-￯﻿�\U0001f300-\U0001faffÀ-ÿ]+")
_STRONG = re.compile("[¡-ÿ‐-⁄€™﻿�]")
_RUN = re.compile("[^\x00-\x7f]+")
# A run of letters of the upper Latin-1 half alone is no word of any language: Cyrillic or
# double-byte text read as Western.
_HIGH = re.compile("(?<![A-Za-zĀ-ɏ])[¡-ÿŒœŠšŸŽžƒˆ˜–-…‰‹›™]{4,}(?![A-Za-z])")
_LETTERS = re.compile("[À-ÖØ-öø-ÿ]")
# Russian read with another Cyrillic set has capitals after small letters, or letters of
# other Cyrillic alphabets and signs inside words.
_CASE = re.compile("(?<![Ѐ-џ])[а-я][А-Я]{3,}(?![а-я])")
_FOREIGN = re.compile("[Ђ-ЅЈ-ЌЏђ-ѕј-ќџ¤¦§¬°±µ†‡‰]")
_CYRILLIC_WORD = re.compile("[Ѐ-џ¤¦§¬°±µ†‡‰]{4,}")
_CYRILLIC_RUN = re.compile("[Ѐ-џ¤¦§¬°±µ†‡‰]+(?:[ ,.:;]+[Ѐ-џ¤¦§¬°±µ†‡‰]+)*")
_LOST = re.compile("�|锟斤拷|ï¿½")
_REFERENCES = ("&#", "&Atilde;", "&Acirc;", "&acirc;", "&ETH;", "&Ntilde;", "&atilde;")


def _pair(codec: str) -> str:
    """Expression of a UTF-8 lead byte and a following byte, as ``codec`` shows them."""

    def shown(low: int, high: int) -> str:
        chars = []
        for b in range(low, high + 1):
            try:
                chars.append(bytes([b]).decode(codec))
            except UnicodeDecodeError:
                chars.append(chr(b))
        return "[" + re.escape("".join(chars)) + "]"

    return shown(0xC2, 0xF4) + shown(0x80, 0xBF)


#: Texts without any of these hold nothing garbled: a quick scan before the automata.
_SUSPECT = re.compile(
    "|".join([*map(_pair, LATIN_CODECS), "[─-▟\x80-\x9f]", "[Ѐ-џ][Ђ-ЅЈ-ЌЏђ-ѕј-ќџ¤¦§¬°±µ†‡‰\xa0]", "[¡-ÿ]{4}", "[а-я][А-Я]{3}"])
)
_WIDE_CHARS = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff61-\uff9f]")


_REFERENCE = re.compile(r"&#?\w+;")


def _plain(m: re.Match) -> str:
    char = unescape(m[0])
    return m[0] if char.isascii() else char


def _decode(part: bytes, cyrillic: bool) -> str | None:
    try:
        out = part.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if not _PLAUSIBLE.fullmatch(out) and not all("\x80" <= c < "\xa0" or _PLAUSIBLE.fullmatch(c) for c in out):
        return None
    strong = _STRONG.search(out)
    if cyrillic:
        return out if len(out) >= 3 or any("‐" <= c <= "™" for c in out) else None
    return out if strong or len(out) >= 2 else None


def _single(text: str, codec: str, cyrillic: bool) -> tuple[str, int]:
    raw = text.encode(codec, "webspark.c1")
    if len(raw) != len(text):
        return text, 0
    out, at, n = [], 0, 0
    for m in _UTF8.finditer(raw):
        better = _decode(m[0], cyrillic)
        if better is not None:
            out.append(text[at : m.start()])
            out.append(better)
            at, n = m.end(), n + 1
    if not n:
        return text, 0
    out.append(text[at:])
    return "".join(out), n


def _wide(text: str, codec: str) -> tuple[str, int]:
    """Runs of characters whose double-byte codes form UTF-8 of ideographs."""
    n = 0

    def fix(m: re.Match) -> str:
        nonlocal n
        run = m[0]
        raw = run.encode(codec, "replace")
        if not _UTF8_WIDE.search(raw):
            return run
        n += 1
        if "?" in raw.decode("latin-1") or "�" in run:
            return run
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return run

    if not _UTF8_WIDE.search(text.encode(codec, "replace")):
        return text, 0
    return _RUN.sub(fix, text), n


def _as_western(text: str) -> tuple[str, int]:
    """Cyrillic or Chinese read as Western: whole runs of upper Latin-1 characters."""
    n = 0

    def fix(m: re.Match) -> str:
        nonlocal n
        run = m[0]
        raw = run.encode("cp1252", "webspark.c1")
        if len(set(run)) < 3 or sum(len(u) for u in _UTF8.findall(raw)) * 2 >= len(raw):
            return run  # UTF-8, left to its automaton
        if len(_LETTERS.findall(run)) * 2 < len(run):
            return run
        n += 1
        if len(raw) % 2 == 0 and re.fullmatch(rb"(?:[\xa1-\xf7][\xa1-\xfe])+", raw):
            try:
                wide = raw.decode("gbk")
                if all("　" <= c <= "鿿" or "＀" <= c <= "￯" for c in wide) and re.search(r"[的在和了与将学院为年月]", wide):
                    return wide
            except UnicodeDecodeError:
                pass
        best = max(("cp1251", "koi8_r"), key=lambda c: len(re.findall("[оеаинтсрвл]", raw.decode(c, "replace"))))
        return raw.decode(best, "replace")

    return _HIGH.sub(fix, text), n


def _as_cyrillic(text: str) -> tuple[str, int]:
    """Russian read with another Cyrillic set: whole phrases that hold an impossible word."""
    n = 0

    def fix(m: re.Match) -> str:
        nonlocal n
        phrase = m[0]
        if not any(len(_FOREIGN.findall(w)) >= 2 or _CASE.search(w) for w in _CYRILLIC_WORD.findall(phrase)):
            return phrase
        n += 1
        options = [phrase]
        for read in ("cp1251", "koi8_r", "cp866"):
            for true in ("cp1251", "koi8_r", "cp866"):
                if read != true:
                    try:
                        options.append(phrase.encode(read).decode(true))
                    except UnicodeError:
                        pass
        return max(options, key=lambda w: len(re.findall("[оеаинтсрвлкмдпу]", w)) - len(re.findall("[^а-яё ,.:;]", w)))

    return _CYRILLIC_RUN.sub(fix, text), n


def restore(html: str) -> tuple[str, list[str], bool]:
    """Restored html, the encodings it had been read with, and whether characters are lost."""
    if not html or (html.isascii() and "&" not in html):
        return html, [], False
    text, used = html, []
    if any(r in html for r in _REFERENCES):  # garbled text may be written in references
        text = _REFERENCE.sub(_plain, html)
    lost = bool(_LOST.search(text))
    wide = _WIDE_CHARS.search(text)
    if not wide and not _SUSPECT.search(text):
        return html, [], lost
    text, n = _as_western(text)
    if n:
        used.append("western")
    for _ in range(4):
        before = text
        if not _SUSPECT.search(text):
            break
        for codec in LATIN_CODECS:
            text, n = _single(text, codec, False)
            if n:
                used.append(codec)
        for codec in CYRILLIC_CODECS:
            text, n = _single(text, codec, True)
            if n:
                used.append(codec)
        if text == before:
            break
    for codec in WIDE_CODECS if wide else ():
        text, n = _wide(text, codec)
        if n:
            used.append(codec)
    text, n = _as_cyrillic(text)
    if n:
        used.append("cyrillic")
    if not used:
        return html, [], lost
    return text, list(dict.fromkeys(used)), lost


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for fetch_id, html in zip(pdf["fetch_id"], pdf["html"]):
            text, used, lost = restore(html)
            if used or lost:
                rows.append((fetch_id, text, used, lost))
        yield pd.DataFrame(rows, columns=["fetch_id", "html", "encodings", "lost"])


def restored(fetch: DataFrame) -> DataFrame:
    """Garbled records: ``(fetch_id, html, encodings, lost)`` with the html put right."""
    pages = spread(with_html(fetch.select("fetch_id", "html")).where(F.col("html").rlike("[^\\x00-\\x7f]|&[A-Za-z#]")))
    return pages.mapInPandas(_run, "fetch_id bigint, html string, encodings array<string>, lost boolean")


def found(fetch: DataFrame) -> DataFrame:
    return restored(fetch).select("fetch_id")
