"""Byte-level BPE as a lazily determinised finite-state transducer (problem 8).

The merges compile into a transducer over bytes.  Its states hold the last tokens of those
prefixes of the input that a later token may still start from; on a byte, the tokens that
can end here are tried, and the one compatible with the token before it (their joint bytes
encode to just these two) is the encoding's last token at this place.  Tokens on which all
remaining continuations agree are emitted at once, so output lags by a bounded lookahead.
States and transitions are made when first met and kept, so frequent words cost one table
lookup a byte; whole words are kept as well.

Null and empty texts give an empty list; strings that look like special tokens are text.
Ids decode to the text's exact bytes; ``StreamDecoder`` decodes ids as they come with an
incremental UTF-8 automaton.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

# Fixed value: the pattern that parts a text into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary of the installed public tokenizers, else under /opt/tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    root = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(root / name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encoder of words; see the module's text."""

    #: Words kept with their ids, and states kept, before the tables start anew.
    MAX_WORDS = 300_000
    MAX_STATES = 200_000

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.text = {i: t for t, i in ranks.items()}
        # Trie of all tokens: node -> {byte: node}; the token that ends at a node.
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for b in t:
                node = self.child[node].setdefault(b, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    self.token.append(-1)
            self.token[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self._reset()

    def _reset(self) -> None:
        # A state: branches, each (tokens pending since the emitted part, trie node of the
        # token under way); the empty state has one branch at the root.
        self.states: list[tuple] = [(((), 0),)]
        self.index: dict[tuple, int] = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.last: list[int] = [-1]
        self.index[(self.states[0], -1)] = 0

    def merge(self, word: bytes) -> list[int]:
        """Plain merging by rank: the definition the transducer is compiled from."""
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b may follow token a; a = -1 at the start of a word."""
        known = self.pairs.get((a, b))
        if known is None:
            if a < 0:
                known = self.merge(self.text[b]) == [b]
            else:
                known = self.merge(self.text[a] + self.text[b]) == [a, b]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Transition on a byte: next state and tokens emitted."""
        last = self.last[state]
        live, ended = [], None
        for pending, node in self.states[state]:
            after = self.child[node].get(byte)
            if after is None:
                continue
            live.append((pending, after))
            t = self.token[after]
            if t >= 0 and ended is None and self.compatible(pending[-1] if pending else last, t):
                ended = (*pending, t)
        if ended is not None:
            live.append((ended, 0))
        # Emit the tokens all branches share.
        common = live[0][0]
        for pending, _ in live[1:]:
            n = 0
            for x, y in zip(common, pending):
                if x != y:
                    break
                n += 1
            common = common[:n]
        if common:
            live = [(pending[len(common) :], node) for pending, node in live]
            last = common[-1]
        key = (tuple(live), last)
        to = self.index.get(key)
        if to is None:
            to = len(self.states)
            self.index[key] = to
            self.states.append(key[0])
            self.last.append(last)
            self.moves.append({})
        self.moves[state][byte] = (to, common)
        return to, common

    def encode_word(self, word: bytes) -> list[int]:
        if len(self.states) > self.MAX_STATES:
            self._reset()
        out: list[int] = []
        state = 0
        for byte in word:
            step = self.moves[state].get(byte)
            if step is None:
                step = self._move(state, byte)
            state, emitted = step
            if emitted:
                out.extend(emitted)
        for pending, node in self.states[state]:
            if node == 0:
                out.extend(pending)
                return out
        raise ValueError("the vocabulary lacks a byte")

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        words = self.words
        for w in _WORDS.findall(text):
            ids = words.get(w)
            if ids is None:
                ids = self.encode_word(w.encode("utf-8", "surrogatepass"))
                if len(words) >= self.MAX_WORDS:
                    words.clear()
                if len(w) <= 64:
                    words[w] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        return b"".join(self.text[int(i)] for i in ids).decode("utf-8", "replace")


_WORDS = regex.compile(PATTERN)


class StreamDecoder:
    """Text of ids as they come: bytes of unfinished characters wait for the next id."""

    def __init__(self, text: dict[int, bytes]) -> None:
        self.text = text
        self.need = 0
        self.held = bytearray()

    def push(self, token: int) -> str:
        out = bytearray()
        for b in self.text[token]:
            if self.need and 0x80 <= b < 0xC0:
                self.held.append(b)
                self.need -= 1
                if not self.need:
                    out += self.held
                    self.held.clear()
                continue
            if self.need:  # an unfinished character
                out += self.held
                self.held.clear()
                self.need = 0
            if b < 0x80:
                out.append(b)
            else:
                self.need = 1 if 0xC2 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 if 0xF0 <= b < 0xF5 else 0
                (self.held if self.need else out).append(b)
        return out.decode("utf-8", "replace")

    def end(self) -> str:
        rest = bytes(self.held).decode("utf-8", "replace")
        self.held.clear()
        self.need = 0
        return rest


_made: dict[str, Transducer] = {}


def transducer(path: str | None = None) -> Transducer:
    """The transducer of a vocabulary, made once a process."""
    path = path or default_path()
    if path not in _made:
        _made[path] = Transducer(load_ranks(path))
    return _made[path]


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` of each document (p8_ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [t.encode(x) for x in pdf["text"]]})

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": [len(t.encode(x)) for x in pdf["text"]]})

    return spread(documents.select("doc_id", "source", "text")).mapInPandas(run, "doc_id bigint, source string, n_tokens int")


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, exact)``: whether the ids, decoded as a stream, give the text back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(path)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = t.encode(text)
                d = StreamDecoder(t.text)
                rows.append((doc_id, len(ids), "".join([*map(d.push, ids), d.end()]) == (text or "")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "exact"])

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id bigint, n_tokens int, exact boolean")
