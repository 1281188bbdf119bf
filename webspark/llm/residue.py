"""Template residue and error-page text (problem 6).

1. Main bodies with an unfilled placeholder in the title, a heading or a paragraph outside
   code are residue, whatever else they say.
2. Main bodies made up of error messages, filler or script notices get a trusted label from
   a few certain phrases; so do pages without a main body but with a notice about scripts.
3. Trusted labels of kind 2 spread to near-duplicates, which finds the notices that hold no
   such phrase: four independent SimHashes over runs of five words inside the sentences of a
   body (headings apart), a sketch of 256 bits.  ``TABLES`` tables are keyed by ``KEY_BITS`` bits each;
   a labelled text looks up its keys and all keys one bit off.  Candidates are verified by
   Hamming distance and by the share of common runs, and labels spread along verified links
   until no text is new.  A link of similarity 0.8 is met with a chance below one (README
   has the measured recall), so a component may lose a text that hangs on one such link.

Null or empty html is never a case.  Equal texts are one text; labels go to all records.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .common import staged
from .mainbody import Body, clean_bodies, n_words, page_bodies
from .neardup import WordHashes, mixed

SHINGLE = 5
MIN_SIMILARITY = 0.8
#: Independent SimHashes of 64 bits; similarity 0.8 differs in 15 % of the bits on average.
HASHES = 4
MAX_BITS = 64
TABLES = 36
KEY_BITS = 24
#: Keys looked up in one round are broadcast up to this many.
FEW_PROBES = 200_000
_RNG = np.random.RandomState(11)
_MUL = (_RNG.randint(1, 2**62, HASHES, dtype=np.int64) * 2 + 1).astype(np.uint64)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_KEYS = np.array([_RNG.permutation(64 * HASHES)[:KEY_BITS] for _ in range(TABLES)])
#: Residue phrases must cover this share of a main body's words,
MIN_SHARE = 0.5
#: or stand in a body of at most this many words.
SHORT = 40

# Forms of unfilled placeholders.
_PLACEHOLDER = re.compile(
    r"\{\{[^{}]{0,80}\}\}|\$\{[^{}]{1,80}\}|#\{[^{}]{1,80}\}|\{%[^%]{0,80}%\}|<%[^%]{0,80}%>|%%?[A-Za-z]{2,}(?:_[A-Za-z]+)*%%?(?![0-9])"
    r"|\[\[[A-Za-z_.]{2,60}\]\]|\[(?:insert|your|add|enter)\b[^\]]{0,60}\]|\[[A-Z]{2,}(?:_[A-Z]+)+\]|\b__[A-Za-z]+(?:_[A-Za-z]+)*__\b"
    r"|\{[a-z]+(?:[_.][a-z]+)+\}|\{[0-9]\}|<<[a-z][a-z_. ]{0,40}>>|\bxx/xx/xxxx\b|\[(?:to be|tb[acd]|name|title|date)\b[^\]]{0,60}\]",
    re.I,
)
# Phrases that are certain signs of error pages, blocks, notices about scripts and
# filler.  Vague ones ("try again", "not be found", "was deleted") are left to the spread of labels.
PHRASES = """
page not found | error 404 | 404 error | does not exist | no longer available | access denied | forbidden | permission denied | not authorised | not authorized
bad gateway | gateway timeout | internal server error | service unavailable | temporarily unavailable | something went wrong | an error has occurred
under construction | coming soon | scheduled maintenance | down for maintenance | verify you are human | not a robot | captcha | unusual traffic | security service | checking your browser | too many requests
enable javascript | turn on javascript | requires javascript | javascript is required | javascript is disabled | scripts are required | scripting disabled | disabled javascript
traceback (most recent | fatal error | parse error | mysqli_ | stack trace | syntax error | to be supplied | sample copy | sample text | dummy text | dummy paragraph | placeholder | asdf | lorem ipsum | [object object]
nicht gefunden | zugriff verweigert | wartungsarbeiten | aktivieren sie javascript | javascript aktivieren | blindtext | serverfehler
introuvable | accès refusé | en maintenance | activez javascript | erreur interne | en construction
página no existe | no encontrada | acceso denegado | active javascript | habilite javascript | javascript está | en mantenimiento | error interno
não encontrada | acesso negado | ative o javascript | habilite o javascript | em manutenção | erro interno
не найдена | не найден | доступ запрещён | включите javascript | ошибка сервера | технические работы
页面不存在 | 未找到 | 拒绝访问 | 启用javascript | 服务器错误 | 维护中 | 建设中 | 敬请期待
"""
_WHOLE = frozenset("undefined null nan oops! oops error ??? tbd todo n/a".split())
_LITERALS = [p.strip() for line in PHRASES.strip().split("\n") for p in line.split("|") if p.strip()]


# Words of the usual Latin filler.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation"
    " ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat"
    " cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# Every filler line of some length holds one of the longer words.
_FILLER_SIGNS = tuple(w for w in sorted(_LATIN) if len(w) >= 6)
_FILLER = frozenset(w + mark for w in _LATIN for mark in ("", ".", ",", ";", "...", "…", "!", "?"))


def _matcher():
    """What a text holds: 1 for a phrase, 2 for a sign of filler, 3 for both.  One pass of an
    automaton where the library is there, else one search a word."""
    literals = [*((dom.digits0(p), 1) for p in _LITERALS), *((w, 2) for w in _FILLER_SIGNS)]
    try:
        import ahocorasick
    except ImportError:
        return lambda text: max((v for p, v in literals if v == 1 and p in text), default=0) | max((v for p, v in literals if v == 2 and p in text), default=0)
    automaton = ahocorasick.Automaton()
    for p, v in literals:
        automaton.add_word(p, v | automaton.get(p, 0))
    automaton.make_automaton()

    def held(text: str) -> int:
        out = 0
        for _, v in automaton.iter(text):
            out |= v
            if out == 3:
                break
        return out

    return held


_held = None


def holds(text: str) -> int:
    """Of normalised text: 1 a phrase, 2 a sign of filler."""
    global _held
    if _held is None:
        _held = _matcher()
    return _held(text)


def has_phrase(norm: str) -> bool:
    return norm in _WHOLE or bool(holds(norm) & 1)


_SCRIPTS = re.compile("javascript|script", re.I)
_STOPS = frozenset(".!?…。！？")
_OPEN_SIGN = re.compile(r"[{}%\[\]_<X]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")


def is_residue(norm: str, ws: list[str]) -> bool:
    """Whether a line is an error message, a notice or filler; a line of more than ``SHORT``
    words by the words of the sentences that hold a phrase."""
    if has_phrase(norm):
        if len(ws) <= SHORT:
            return True
        if sum(len(dom.words(x)) for x in _SENTENCE.split(norm) if has_phrase(x)) >= MIN_SHARE * len(ws):
            return True
    return len(ws) >= 4 and sum(map(_FILLER.__contains__, ws)) >= 0.6 * len(ws) and bool(holds(norm) & 2)


def _features(body: Body, use: list[int]) -> tuple[list[int], int]:
    """Words * 8 + heading * 4 + residue phrase * 2 + placeholder of each line; notes of the page."""
    page = body.page
    out = []
    maybe = holds("\n".join(body.norms)) or not _WHOLE.isdisjoint(body.norms)
    for j in use:
        k = body.lines[j]
        node, text, _ = page.lines[k]
        norm = body.norms[j]
        open_text = text
        for sample in page.code.get(node, ()):
            if sample:
                open_text = open_text.replace(sample, " ")
        held = 1 if _OPEN_SIGN.search(open_text) and _PLACEHOLDER.search(open_text) else 0
        phrase = 1 if maybe and is_residue(norm, dom.words(norm)) else 0
        out.append(n_words(norm) * 8 + (page.tag[node] in dom.HEADINGS) * 4 + phrase * 2 + held)
    notes = 1 if _PLACEHOLDER.search(page.title) else 0
    if any(_SCRIPTS.search(t) for t in page.noscript):
        notes |= 2
    return out, notes


def runs(text: str, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of the runs of ``SHINGLE`` words inside the sentences of a text's lines;
    a shorter sentence is one run.  So a notice agrees with itself whatever heading or other
    sentence stands beside it."""
    ws: list[str] = []
    cuts: list[int] = []
    for line in text.split("\n"):
        ws += dom.words(line)
        cuts.append(len(ws) - 1)
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    last = np.fromiter([w[-1] in _STOPS for w in ws], bool, len(ws))
    last[cuts] = True
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts + 1
    out = []
    if len(ws) >= SHINGLE:
        sentence = np.repeat(np.arange(len(size)), size)
        out.append(mixed(h, SHINGLE)[sentence[: 1 - SHINGLE] == sentence[SHINGLE - 1 :]])
    for k in range(1, SHINGLE):
        at = starts[size == k]
        if len(at):
            out.append(mixed(h[at[:, None] + np.arange(k)], k)[:, 0])
    return np.unique(np.concatenate(out))


def sketch(sh: np.ndarray) -> np.ndarray:
    """``HASHES`` SimHashes of a set of run hashes; the first is of the hashes as they are."""
    if not len(sh):
        return np.zeros(HASHES, np.int64)
    h = np.empty((len(sh), HASHES), np.uint64)
    h[:, 0] = sh
    with np.errstate(over="ignore"):
        h[:, 1:] = (sh ^ (sh >> np.uint64(31)))[:, None] * _MUL[1:]
        h[:, 1:] = (h[:, 1:] ^ (h[:, 1:] >> np.uint64(29))) * _MIX
        h[:, 1:] ^= h[:, 1:] >> np.uint64(32)
    bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > len(sh), bitorder="little").view("<i8")


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Label by rule and SimHashes of each record's main body."""
    hashes = WordHashes()
    for pdf in batches:
        rows = []
        made: dict[str, tuple[np.ndarray, int]] = {}  # equal bodies of a batch are sketched once
        for fetch_id, lines, extra, notes in zip(pdf["fetch_id"], pdf["lines"], pdf["extra"], pdf["notes"]):
            extra = [int(x) for x in extra]
            total = sum(x // 8 for x in extra)
            residue = sum(x // 8 for x in extra if x & 2)
            if notes & 1 or any(x & 1 for x in extra):
                label = "placeholder"
            elif total == 0:
                label = "scripts" if notes & 2 else ""
            elif residue and (residue >= MIN_SHARE * total or total <= SHORT):
                label = "residue"
            else:
                label = ""
            text = "\n".join([line for line, x in zip(lines, extra) if not x & 4] or lines)
            if text not in made:
                sh = runs(text, hashes)
                made[text] = (sketch(sh), len(sh))
            rows.append((fetch_id, label, text, *made[text]))
        yield pd.DataFrame(rows, columns=["fetch_id", "label", "text", "sketch", "n_runs"])


def labelled(fetch: DataFrame) -> DataFrame:
    """``(fetch_id, label, text, sketch, n_runs)`` of each record with html, labels by rule alone."""
    bodies = clean_bodies(staged(page_bodies(fetch, extra=_features), "bodies"))
    return bodies.mapInPandas(_sketched, "fetch_id bigint, label string, text string, sketch array<bigint>, n_runs int")


def _resketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for pdf in batches:
        every = [runs(t, hashes) for t in pdf["text"]]
        pdf["sketch"] = [sketch(sh) for sh in every]
        pdf["n_runs"] = [len(sh) for sh in every]
        yield pdf[["text_id", "text", "sketch", "n_runs"]]


def keys(sketches: np.ndarray) -> np.ndarray:
    """``TABLES`` keys of each sketch: the number of the table and ``KEY_BITS`` of its bits."""
    bits = np.unpackbits(np.ascontiguousarray(sketches, "<i8").view(np.uint8), axis=1, bitorder="little")
    return (bits[:, _KEYS].astype(np.int64) << np.arange(KEY_BITS)).sum(axis=2) + (np.arange(TABLES) << KEY_BITS)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            pdf["keys"] = list(keys(np.array(pdf["sketch"].tolist())))
            yield pdf[["sketch_id", "keys"]]


def _sketch_tables(texts: DataFrame) -> DataFrame:
    """A row for each table of each sketch: ``(sketch_id, key)``."""
    each = texts.select("sketch_id", "sketch").mapInPandas(_keyed, "sketch_id bigint, keys array<bigint>")
    return each.select("sketch_id", F.explode("keys").alias("key"))


def _agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for pdf in batches:
        keep = []
        for a, b in zip(pdf["text_a"], pdf["text_b"]):
            x, y = (runs(t, hashes) for t in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= MIN_SIMILARITY * (len(x) + len(y) - both))
        yield pdf.loc[keep, ["text_id"]]


def spread_sketches(texts: DataFrame, trusted: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Ids of all texts linked, over any number of links, to a trusted text.

    ``texts`` has ``(text_id, sketch, n_runs)`` of the different texts (the last two are made
    where they are missing, from a column ``text``), ``trusted`` ids, ``source`` the texts
    ``(text_id, text)``, which may repeat; only those of candidates are moved.  Each round meets only the texts labelled in
    the round before with the tables, and makes tables only of texts whose number of runs lets
    them be similar enough: texts are in bands of ``1 / MIN_SIMILARITY``, and a link joins
    equal or neighbouring bands.  Of texts with one sketch the least is compared first; those
    it rejects meet all the others.
    """
    if "sketch" not in texts.columns:
        texts = staged(texts.select("text_id", "text").mapInPandas(_resketched, "text_id bigint, text string, sketch array<bigint>, n_runs int"), "sketches")
    source = texts.select("text_id", "text") if source is None else source
    band = F.floor(F.log(F.greatest("n_runs", F.lit(1))) / F.lit(math.log(1 / MIN_SIMILARITY)) + F.lit(1e-9)).cast("int")
    texts = texts.withColumn("band", band).withColumn("sketch_id", F.xxhash64("sketch", "band"))
    free = texts.join(trusted, "text_id", "left_anti")
    sketches = staged(free.select("sketch_id", "sketch", "band").dropDuplicates(["sketch_id"]), "sketches")
    flips = F.concat(F.array(F.col("key")), *(F.array(F.col("key").bitwiseXOR(F.lit(1 << b))) for b in range(KEY_BITS)))
    distance = sum(F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("other")[i])) for i in range(HASHES))

    def agreed(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs, "pairs")
        ids = pairs.select(F.explode(F.array("text_id", "from_id")).alias("text_id")).distinct()
        held = staged(source.join(ids, "text_id", "left_semi").dropDuplicates(["text_id"]), "held")
        both = pairs.join(held.withColumnRenamed("text", "text_a"), "text_id").join(held.select(F.col("text_id").alias("from_id"), F.col("text").alias("text_b")), "from_id")
        return staged(both.mapInPandas(_agree, "text_id bigint").distinct(), "spread")

    known = new = trusted
    while True:
        front = staged(texts.join(new, "text_id", "left_semi").select(F.col("text_id").alias("from_id"), "sketch_id", "sketch", "band"), "front")
        # A band is a power of 1.25, so there are fewer than a hundred.
        bands = {r["band"] + d for r in front.select("band").distinct().collect() for d in (-1, 0, 1)}
        tables = _sketch_tables(sketches.where(F.col("band").isin(sorted(bands))))
        probes = _sketch_tables(front.dropDuplicates(["sketch_id"])).select(F.col("sketch_id").alias("from_sketch"), F.explode(flips).alias("key"))
        # What a text looks up is many times its own size, so the plan cannot know its size.
        few = front.count() * TABLES * (KEY_BITS + 1) <= FEW_PROBES
        met = tables.join(F.broadcast(probes) if few else probes.hint("merge"), "key").select("sketch_id", "from_sketch").distinct()
        other = front.select(F.col("sketch_id").alias("from_sketch"), F.col("sketch").alias("other")).dropDuplicates(["from_sketch"])
        links = met.join(sketches, "sketch_id").join(other, "from_sketch").where(distance <= MAX_BITS).select("sketch_id", "from_sketch")
        left = free.select("text_id", "sketch_id").join(known, "text_id", "left_anti")
        near = staged(links.join(left, "sketch_id").select("text_id", "from_sketch"), "near")
        front = front.select("from_id", F.col("sketch_id").alias("from_sketch"))
        least = front.groupBy("from_sketch").agg(F.min("from_id").alias("from_id"))
        new = agreed(near.join(least, "from_sketch").select("text_id", "from_id"))
        others = front.join(least, ["from_sketch", "from_id"], "left_anti")
        rejected = near.join(new, "text_id", "left_anti")
        new = new.unionAll(agreed(rejected.join(others, "from_sketch").select("text_id", "from_id")))
        if new.isEmpty():
            return known
        known = known.unionAll(new)


def labels(fetch: DataFrame) -> DataFrame:
    """Residue pages with the reason: ``(fetch_id, label)``; label is placeholder, residue,
    scripts or near_duplicate."""
    pages = staged(labelled(fetch).withColumn("text_id", F.xxhash64("text")), "texts")
    # All of fixed width, so the texts themselves are neither sorted nor shuffled.
    texts = (
        pages.where("text <> ''")
        .groupBy("text_id")
        .agg(*(F.first(F.col("sketch")[i]).alias(f"s{i}") for i in range(HASHES)), F.first("n_runs").alias("n_runs"), F.max((F.col("label") == "residue").cast("int")).alias("trusted"))
        .select("text_id", F.array(*(f"s{i}" for i in range(HASHES))).alias("sketch"), "n_runs", "trusted")
    )
    texts = staged(texts, "distinct")
    all_ids = spread_sketches(texts.select("text_id", "sketch", "n_runs"), texts.where("trusted = 1").select("text_id"), pages.select("text_id", "text"))
    by_rule = pages.where("label <> ''").select("fetch_id", "label")
    spread = pages.where("label = ''").join(all_ids, "text_id", "left_semi").select("fetch_id", F.lit("near_duplicate").alias("label"))
    return by_rule.unionAll(spread)


def found(fetch: DataFrame) -> DataFrame:
    return labels(fetch).select("fetch_id")


def kept(fetch: DataFrame) -> DataFrame:
    """Records without residue, those without html included: all columns of ``fetch``."""
    return fetch.join(found(fetch), "fetch_id", "left_anti")
