"""Near-duplicate pages by MinHash buckets that are searched where they lie (problem 1).

Each distinct main body gets a signature of ``HASHES`` MinHashes of two bytes.  It goes, with a
sketch of ``WINDOW`` further MinHashes of a byte, into ``KEYS`` buckets, one for the value of
each of as many MinHashes.  Inside a bucket bodies that agree on four MinHashes of one of the
``TABLES`` and on ``AGREE`` of the sketch are candidates; only these leave the bucket, and they
are verified exactly on their three-word sequences.  Bodies that merely share phrases meet in
numbers that grow as the square of the crawl: they are compared in memory and never written.
A pair of ``MIN_SIMILARITY`` itself is met with a chance of at least ``TARGET`` (see
``tests/llm/test_pages.py``), so the recall does not depend on how similar the other pairs are.

Equal bodies are one class; only classes are compared, and pairs of records are made at the
end, since the query lists them all.  Null or empty html and bodies under ``MIN_WORDS``
words give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .common import release, staged
from .mainbody import clean_bodies, page_bodies

MIN_WORDS = 60
SHINGLE = 3
MIN_SIMILARITY = 0.5
TARGET = 0.99
HASHES = 296
#: A body's buckets; the MinHashes that name them are the last ones of a signature, sketches
#: are windows of the others.
KEYS = 12
WINDOW = 96
STEP = (HASHES - KEYS - WINDOW) // (KEYS - 1)
#: Places in a sketch whose four bytes make the label of a table.
TABLES = np.array([np.sort(np.random.RandomState(5 + t).permutation(WINDOW)[:4]) for t in range(32)])
#: At ``MIN_SIMILARITY`` 50 are expected beside an agreeing label and fewer than 40 have a chance of 0.03,
#: in one of the six buckets that such a pair shares on average.
AGREE = 40
#: Rows of whole buckets, and pairs, that are worked on at once.
AT_ONCE = 100_000
#: Ids up to this many are broadcast (two numbers each); more are joined by a shuffle.
FEW_IDS = 500_000

_RNG = np.random.RandomState(7)
_MUL = _RNG.randint(0, 2**31, HASHES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.randint(0, 2**32, HASHES, dtype=np.int64).astype(np.uint32)
_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class WordHashes(dict):
    """Hashes of words, kept between calls while they are few."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k of the hashes ``h``, along the last axis."""
    n = h.shape[-1] - k + 1
    with np.errstate(over="ignore"):
        out = np.zeros((*h.shape[:-1], n), np.uint64)
        for i in range(k):
            out = (out ^ h[..., i : n + i]) * _C1
            out ^= out >> np.uint64(29)
        out *= _C2
        out ^= out >> np.uint64(32)
    return out


def shingles(ws: list[str], k: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of the runs of k words, sorted; a shorter text is one run."""
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    return np.unique(mixed(h, min(k, len(h))))


def signature(sh: np.ndarray) -> bytes:
    """``HASHES`` MinHashes of two bytes: all the low bytes, then all the high ones."""
    with np.errstate(over="ignore"):
        least = ((sh >> np.uint64(32)).astype(np.uint32)[:, None] * _MUL + _ADD).min(axis=0)
        two = (least.astype(np.uint64) * _C3) >> np.uint64(48)
        return (two & np.uint64(255)).astype(np.uint8).tobytes() + (two >> np.uint64(8)).astype(np.uint8).tobytes()


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for pdf in batches:
        rows = []
        for fetch_id, lines in zip(pdf["fetch_id"], pdf["lines"]):
            text = " ".join(lines)
            ws = dom.words(text)
            if len(ws) < MIN_WORDS:
                continue
            sh = shingles(ws, SHINGLE, hashes)
            body = int.from_bytes(blake2b(sh.tobytes(), digest_size=8).digest(), "little", signed=True)
            rows.append((fetch_id, body, text, signature(sh)))
        yield pd.DataFrame(rows, columns=["fetch_id", "body", "text", "sig"])


def signed_bodies(fetch: DataFrame) -> DataFrame:
    """Staged ``(fetch_id, body, text, sig)`` of each record; ``body`` names its set of sequences."""
    bodies = staged(page_bodies(fetch), "bodies")
    signed = clean_bodies(bodies).select("fetch_id", "lines").mapInPandas(_signatures, "fetch_id bigint, body bigint, text string, sig binary")
    signed = staged(signed, "signed")
    release(bodies)
    return signed


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    kept: dict[int, np.ndarray] = {}

    def of(body: int, text: str) -> np.ndarray:
        if body not in kept:
            if len(kept) > 2000:
                kept.clear()
            kept[body] = shingles(dom.words(text), SHINGLE, hashes)
        return kept[body]

    for pdf in batches:
        out = []
        for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]):
            x, y = of(a, ta), of(b, tb)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": out})


def bucket_pairs(key: np.ndarray, body: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates ``(a, b)``, a < b, among rows of whole buckets; each once a bucket."""
    shared = np.zeros(len(key), bool)
    shared[1:] = key[1:] == key[:-1]
    shared[:-1] |= shared[1:]
    key, body, sketch = key[shared], body[shared], sketch[shared]
    bucket = key.astype(np.int64).astype(np.uint64) << np.uint64(32)
    for t, places in enumerate(TABLES):
        label = bucket | np.ascontiguousarray(sketch[:, places]).view(np.uint32).ravel()
        order = np.argsort(label)
        label = label[order]
        at, off = np.arange(len(label) - 1), 1
        while len(at := at[label[at] == label[at + off]]):
            for k in range(0, len(at), AT_ONCE):
                x, y = order[at[k : k + AT_ONCE]], order[at[k : k + AT_ONCE] + off]
                same = sketch[x] == sketch[y]
                met = np.flatnonzero(same.sum(axis=1) >= AGREE)
                if t:  # an earlier table had the rest
                    met = met[~same[met][:, TABLES[:t]].all(axis=2).any(axis=1)]
                a, b = body[x[met]], body[y[met]]
                met = a != b
                yield np.minimum(a, b)[met], np.maximum(a, b)[met]
            off += 1
            at = at[at + off < len(label)]


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates of buckets that come in the order of their keys; a bucket is held as a whole."""

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held: list[tuple[np.ndarray, ...]] = []
        for pdf in batches:
            if not len(pdf):
                continue
            held.append((pdf["key"].to_numpy(), pdf["body"].to_numpy(), np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, WINDOW)))
            if sum(len(x[0]) for x in held) >= AT_ONCE and held[0][0][0] != held[-1][0][-1]:
                key, body, sketch = map(np.concatenate, zip(*held))
                whole = np.searchsorted(key, key[-1])
                held = [(key[whole:], body[whole:], sketch[whole:].copy())]
                yield key[:whole], body[:whole], sketch[:whole]
        if held:
            yield tuple(map(np.concatenate, zip(*held)))

    found: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for part in parts():
        for ab in bucket_pairs(*part):
            found.append(ab)
            n += len(ab[0])
            if n >= AT_ONCE:
                yield pd.DataFrame(dict(zip("ab", map(np.concatenate, zip(*found)))))
                found, n = [], 0
    if found:
        yield pd.DataFrame(dict(zip("ab", map(np.concatenate, zip(*found)))))


def _only(df: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``df`` whose id is among ``ids``; broadcast only after the ids are counted."""
    return df.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, columns, "left_semi")


def _once(signed: DataFrame, first: DataFrame) -> DataFrame:
    """Rows of ``signed`` that are in ``first``; where few are or few are not, these few move."""
    ids = ["body", "fetch_id"]
    n, kept = signed.count(), first.count()
    if n - kept <= min(kept, FEW_IDS):
        return signed.join(F.broadcast(signed.select(ids).join(first, ids, "left_anti")), ids, "left_anti")
    return _only(signed, first, ids)


def similar_classes(signed: DataFrame) -> DataFrame:
    """Pairs of different bodies ``(a, b, similarity)`` of at least ``MIN_SIMILARITY``."""
    # One record stands for each body; equal bodies differ at most in the order of repeats.
    first = staged(signed.groupBy("body").agg(F.min("fetch_id").alias("fetch_id")), "classes")
    buckets = F.array(
        *(
            F.struct(
                F.hash(F.lit(k), F.substring("sig", HASHES - KEYS + k + 1, 1), F.substring("sig", 2 * HASHES - KEYS + k + 1, 1)).alias("key"),
                F.substring("sig", k * STEP + 1, WINDOW).alias("sketch"),
            )
            for k in range(KEYS)
        )
    )
    rows = _once(signed.select("body", "fetch_id", "sig"), first).select("body", F.explode(buckets).alias("x")).select("x.key", "body", "x.sketch")
    pairs = rows.repartition("key").sortWithinPartitions("key").mapInPandas(_met, "a bigint, b bigint")
    pairs = staged(pairs.distinct(), "candidates")
    ids = first.join(pairs.select(F.explode(F.array("a", "b")).alias("body")).distinct(), "body", "left_semi")
    texts = _only(signed.select("body", "fetch_id", "text"), ids, ["body", "fetch_id"])
    both = pairs.join(texts.select(F.col("body").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("body").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return staged(both.mapInPandas(_verify, "a bigint, b bigint, similarity double").where(F.col("similarity") >= MIN_SIMILARITY), "similar")


def found(fetch: DataFrame) -> DataFrame:
    """All pairs of records whose main bodies agree (p1_found)."""
    signed = signed_bodies(fetch)
    members = signed.select("fetch_id", "body")
    links = similar_classes(signed).select("a", "b").unionAll(members.groupBy("body").agg(F.count("*").alias("n")).where("n > 1").select(F.col("body").alias("a"), F.col("body").alias("b")))
    pairs = links.join(members.select(F.col("body").alias("a"), F.col("fetch_id").alias("x")), "a").join(members.select(F.col("body").alias("b"), F.col("fetch_id").alias("y")), "b")
    pairs = pairs.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("fetch_id_a"), F.greatest("x", "y").alias("fetch_id_b"))


def classes(fetch: DataFrame) -> DataFrame:
    """One row a record with a body of enough words: ``(fetch_id, class_id, n_links)``; records
    of one class have equal bodies, ``n_links`` counts the other classes that agree with it."""
    signed = signed_bodies(fetch)
    links = similar_classes(signed).select(F.explode(F.array("a", "b")).alias("body")).groupBy("body").agg(F.count("*").alias("n_links"))
    names = signed.groupBy("body").agg(F.min("fetch_id").alias("class_id"))
    return signed.select("fetch_id", "body").join(names, "body").join(links, "body", "left").select(
        "fetch_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
