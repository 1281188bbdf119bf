"""Chunking: paragraph packing as a native fold, character windows as Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

_SENTENCE_END = re.compile(r"[.!?。！？]\s+")


def pack_paragraphs(text: Column, size: int = 1000, overlap: int = 200, least: int = 100, sep: str = "\n\n") -> Column:
    """Paragraphs joined while they fit; a full chunk of at least ``least`` characters is
    emitted and the next begins with its last ``overlap`` ones.  Paragraphs are never split."""
    paras = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), sep), lambda p: strip(p)), lambda p: p != "")
    empty = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        cur, out = acc.getField("cur"), acc.getField("out")
        fits = F.length(cur) + F.length(p) <= size
        joined = F.when(cur == "", p).otherwise(F.concat(cur, F.lit("\n\n"), p))
        tail = F.when(F.length(cur) > overlap, F.substring(cur, -overlap, overlap)).otherwise(cur)
        again = F.when(cur == "", p).otherwise(F.concat(tail, F.lit("\n\n"), p))
        emit = (cur != "") & (F.length(cur) >= least)
        return F.struct(
            F.when(fits, joined).otherwise(again).alias("cur"),
            F.when(fits | ~emit, out).otherwise(F.concat(out, F.array(cur))).alias("out"),
        )

    def end(acc: Column) -> Column:
        cur = acc.getField("cur")
        return F.when((cur != "") & (F.length(cur) >= least), F.concat(acc.getField("out"), F.array(cur))).otherwise(acc.getField("out"))

    return F.aggregate(paras, empty, step, end)


def window_chunks(text: str, size: int = 1000, overlap: int = 200, least: int = 50) -> list[tuple[int, int, str]]:
    """Windows of ``size`` ending behind the last full stop of their last ``overlap`` characters."""
    if size <= 2 * overlap:
        raise ValueError("size must be over twice the overlap")
    if not text:
        return []
    if len(text) < least:
        return [(0, len(text), text)]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            stop = text.rfind(".", end - overlap, end)
            if stop > start:
                end = stop + 1
        part = text[start:end].strip()
        if len(part) >= least:
            out.append((start, min(end, len(text)), part))
        start = end - overlap if end < len(text) else end
    return out


def sentence_chunks(text: str, size: int = 10_000, overlap: int = 200) -> list[tuple[int, int, str]]:
    """Windows ending behind the last sentence end of their last 200 characters."""
    out, start = [], 0
    while start < len(text or ""):
        end = min(start + size, len(text))
        if end < len(text):
            back = max(end - 200, 0)
            ends = [m.end() for m in _SENTENCE_END.finditer(text[back:end])]
            if ends and back + ends[-1] > start + overlap:
                end = back + ends[-1]
        part = text[start:end].strip()
        if part:
            out.append((start, end, part))
        start = end - overlap if end < len(text) else end
    return out


def scan_back_chunks(text: str, size: int = 5000, overlap: int = 200) -> list[tuple[int, int, str]]:
    """Windows ending behind the nearest sentence character at or up to 200 before their end."""
    out, start = [], 0
    while start < len(text or ""):
        end = start + size
        if end < len(text):
            for i in range(end, max(end - 200, start), -1):
                if text[i] in ".!?。":
                    end = i + 1
                    break
        part = text[start:end].strip()
        if part:
            out.append((start, end, part))
        start = end - overlap if end < len(text) else end
    return out


def chunked(df: DataFrame, id_col: str, text_col: str, how: Callable[..., list], **options) -> DataFrame:
    """``(id, chunk_id, chunk_start, chunk_end, chunk)`` rows by a window function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, a, b, c) for i, t in zip(pdf[id_col], pdf[text_col]) if t for n, (a, b, c) in enumerate(how(t, **options))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_id", "chunk_start", "chunk_end", "chunk"])

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} bigint, chunk_id int, chunk_start int, chunk_end int, chunk string")
