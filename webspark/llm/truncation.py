"""Text cut off by field limits (problem 10).

Per source, text lengths are modelled as log-normal, right-censored at a field limit; the
parameters are fitted by maximum likelihood on the source's whole length histogram.  The
excess of values at a candidate limit over the fitted density gives each value's posterior
of having been censored there.  It is combined, as odds, with what the ending shows: inside
a word, sentence, list item, JSON value, table row or log line, a mark of omission, or a
finished form.  An end mark and an open sentence decide alone, as the problem's statement
has it; dots after few words, list items, search wishes, page addresses and bare words are
cut or whole as the length says.

Null, empty and blank texts are never cases.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, staged

#: Likelihood ratio of each kind of ending, cut against whole.  "item", "wish" and "address"
#: are finished forms without an end mark.
ODDS = {"whole": 0.001, "remark": 0.001, "item": 0.05, "wish": 0.05, "address": 0.05, "dots": 10.0, "bare": 1.0, "cut": 2000.0}
#: Odds of a cut text away from any limit, and the most that a limit can give.
OFF_LIMIT = 0.025
MOST_ODDS = 100.0
#: A closing fragment with dots in at least so many different texts is a remark.
MIN_REMARKS = 3
#: A candidate limit holds at least so many values, and so many times what the fit expects.
MIN_AT_LIMIT = 5
MIN_EXCESS = 4.0

_TERMINAL = re.compile(r"[.!?。！？؟]['\"”’»›)\]）】」』*_`]*$")
_DOTS = re.compile(r"\s*(?:\.{3,}|…+|\[(?:\.{3}|…)\]|\((?:\.{3}|…)\)|\[(?:more|truncated|cut)\]|\((?:more|truncated|cut)\)|>>|»»)$", re.I)
_URL = re.compile(r"(?:https?://|www\.)\S+$")
_LIST = re.compile(r"^\s*(?:[-*•–+]|\d+[.)])\s+")
_TITLE = re.compile(r"^[(（\[【《«“\"].*[)）\]】》»”\"]$", re.S)
_LOG = re.compile(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d\S* ?\|? ?")
_SENTENCE = re.compile(r"(?<=[.!?。！？])['\"”’»)\]]*\s+|(?<=[。！？])['\"”’»）]*|\n+")


def _json_open(text: str) -> bool | None:
    """Whether a JSON value in the text is unfinished; None if there is none."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    depth, inside, skip, closed = 0, False, False, False
    for c in text[start:]:
        if inside:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth <= 0:
                closed = True
                break
    return not closed


def graded(text: str | None, category: str | None) -> tuple[str, str]:
    """Kind of ending (see ``ODDS``; "empty" for blank texts) and the closing fragment with dots."""
    t = (text or "").strip().rstrip("​‌‍﻿")
    if not t:
        return "empty", ""
    if category == "intent":
        return ("whole" if _TERMINAL.search(t) else "wish"), ""
    head = t[:400].lstrip()
    if head.startswith(("{", "[{", "```json")) or "```json" in head or (category == "llm_json" and "{" in head):
        open_value = _json_open(t[t.find("{") :] if "{" in t else t)
        if open_value or t.count("```") % 2:
            return "cut", ""
        return "whole", ""
    if t.count("```") % 2:
        return "cut", ""
    if t.endswith("```"):
        return "whole", ""
    lines = t.split("\n")
    last = lines[-1].strip()
    if last.startswith("|"):
        width = next((l.count("|") for l in lines if l.lstrip().startswith("|")), 0)
        return ("whole" if last.endswith("|") and last.count("|") >= width else "cut"), ""
    logs = sum(bool(_LOG.match(l)) for l in lines)
    if logs * 2 > len(lines) or category == "log":
        return ("whole" if _TERMINAL.search(last) and _LOG.match(last) else "cut"), ""
    m = _DOTS.search(t)
    if m:
        body = t[: m.start()]
        parts = [p for p in _SENTENCE.split(body) if p and p.strip()]
        fragment = parts[-1].strip() if parts else ""
        if _TERMINAL.search(body):
            return "whole", ""
        size = len(fragment.split()) if fragment.isascii() or " " in fragment else len(fragment) // 2
        return ("dots" if size <= 5 else "cut"), fragment
    if _TERMINAL.search(t):
        return "whole", ""
    if _URL.search(last):
        return "address", ""
    if last.startswith("#"):
        return "cut", ""
    if _LIST.match(last):
        items = [l.strip() for l in lines[:-1] if _LIST.match(l)]
        bare = [l for l in items if not _TERMINAL.search(l)]
        if (bare and len(bare) == len(items)) or (not items and len(last.split()) <= 5):
            return "item", ""
        return "cut", ""
    if _TITLE.match(last):
        return "whole", ""
    if category is None and len(lines) == 1 and not re.search(r"[.!?。！？,，、;；:：]", t) and len(t) < 60:
        return "bare", ""
    return "cut", ""


def ending(text: str | None, category: str | None) -> tuple[str, str]:
    """``graded`` with all finished forms as "whole"."""
    kind, fragment = graded(text, category)
    return ("whole" if kind in ("item", "wish", "address") else kind), fragment


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, source, category, text in zip(pdf["doc_id"], pdf["source"], pdf["category"], pdf["text"]):
            kind, fragment = graded(text, category)
            rows.append((doc_id, source, len(text or ""), kind, fragment))
        yield pd.DataFrame(rows, columns=["doc_id", "source", "length", "ending", "fragment"])


def endings(documents: DataFrame) -> DataFrame:
    return spread(documents.select("doc_id", "source", "category", "text")).mapInPandas(
        _endings, "doc_id bigint, source string, length int, ending string, fragment string"
    )


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limit: float, rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of log lengths, values at or over ``limit`` being censored there:
    maximum likelihood by the EM algorithm on a histogram."""
    x, n = np.log(np.maximum(lengths, 1).astype(float)), counts.astype(float)
    cens = lengths >= limit
    total = n.sum()
    c = math.log(limit)
    n_c = n[cens].sum()
    free, fn = x[~cens], n[~cens]
    if not len(free):
        return c, 1.0
    mu, sd = float(np.average(free, weights=fn)), max(0.15, math.sqrt(float(np.cov(free, fweights=fn.astype(int), bias=True)) if len(free) > 1 else 0.04))
    for _ in range(rounds):
        if not n_c:
            break
        a = (c - mu) / sd
        tail = max(1e-12, 0.5 * math.erfc(a / math.sqrt(2)))
        hazard = math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / tail
        e1 = mu + sd * hazard
        e2 = mu * mu + sd * sd + sd * (c + mu) * hazard
        new = ((fn * free).sum() + n_c * e1) / total
        var = ((fn * free**2).sum() + n_c * e2) / total - new * new
        mu, sd = new, max(0.05, math.sqrt(max(var, 0.0025)))
    return mu, sd


def _limits(source: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidate limits of one source with the posterior of censoring of a value there."""
    pdf = pdf.sort_values("length")
    length, n = pdf["length"].to_numpy(), pdf["n"].to_numpy()
    rows = []
    upto = np.concatenate([[0], np.cumsum(n)])
    near = upto[np.searchsorted(length, length * 1.15, "right")] - upto[np.searchsorted(length, length * 0.85)]
    for i in np.flatnonzero(n >= MIN_AT_LIMIT):
        around = (near[i] - n[i]) / max(1, int(length[i] * 1.15) - int(length[i] * 0.85))
        if n[i] < MIN_EXCESS * max(around, 0.2):
            continue
        mu, sd = fit_censored(length, n, float(length[i]))
        z = (math.log(max(length[i], 1)) - mu) / sd
        density = math.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi) * max(length[i], 1))
        expected = max(n.sum() * density, around)
        if n[i] >= MIN_EXCESS * max(expected, 0.2):
            rows.append((source[0], int(length[i]), float(max(0.0, 1 - expected / n[i]))))
    return pd.DataFrame(rows, columns=["source", "length", "posterior"])


def limits(ends: DataFrame) -> DataFrame:
    """Field limits by source: ``(source, length, posterior)``.

    The histogram of a source has a row for each length met, however many texts there are.
    """
    histogram = ends.where("ending <> 'empty'").groupBy("source", "length").agg(F.count("*").alias("n"))
    return histogram.groupBy("source").applyInPandas(_limits, "source string, length int, posterior double")


def judged(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, length, ending, posterior, truncated)`` of each document."""
    ends = staged(endings(documents), "endings")
    remarks = ends.where("ending = 'dots' and fragment <> ''").groupBy("fragment").agg(F.countDistinct("length").alias("n")).where(F.col("n") >= MIN_REMARKS).select("fragment", F.lit(True).alias("known"))
    # Only the few endings with dots meet the remarks.
    dots = ends.where("ending = 'dots'").join(remarks, "fragment", "left")
    rest = ends.where("ending <> 'dots'").withColumn("known", F.lit(None).cast("boolean"))
    both = dots.unionByName(rest).join(limits(ends), ["source", "length"], "left")
    kind = F.when(F.col("known") & (F.col("ending") == "dots"), F.lit("remark")).otherwise(F.col("ending"))
    odds = F.lit(0.0)
    for name, value in ODDS.items():
        odds = F.when(kind == name, F.lit(value)).otherwise(odds)
    posterior = F.coalesce("posterior", F.lit(0.0))
    at = F.when(posterior > 0, F.least(posterior / F.greatest(1 - posterior, F.lit(1e-9)), F.lit(MOST_ODDS))).otherwise(F.lit(OFF_LIMIT))
    return both.select("doc_id", "source", "length", kind.alias("ending"), posterior.alias("posterior"), (odds * at > 1).alias("truncated"))


def found(documents: DataFrame) -> DataFrame:
    return judged(documents).where("truncated").select("doc_id")


def by_source(documents: DataFrame) -> DataFrame:
    """Share of cut texts by source: ``(source, n_texts, n_truncated, share)``."""
    return judged(documents).groupBy("source").agg(
        F.count("*").alias("n_texts"), F.sum(F.col("truncated").cast("bigint")).alias("n_truncated"), F.avg(F.col("truncated").cast("double")).alias("share")
    )
