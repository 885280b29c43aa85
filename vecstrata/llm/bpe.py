"""Token counts by rank-synchronous array merging.

Pre-tokens are held together as one ragged array of symbols.  In each round every
sequence finds the lowest rank among its neighbouring pairs and merges all
occurrences of that pair, left to right, at the same time as every other sequence
merges its own; sequences without a ranked pair leave.  What survives is counted.

The scan is one Arrow pass without a shuffle.  Pre-tokens repeat a great deal, so
a worker keeps the counts of those it has merged in a table of bounded size.

Null text: empty, so 0 bytes and 0 tokens.  Special strings inside a text count as
the one token that the library makes of them.  Repeated rows and ties: one result
row for each input row.  Texts are counted whole, however long, runs of blanks of any length
included.  Further columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: Pre-tokens a worker remembers; the table is emptied when it is full.
CACHE_WORDS = 300_000
_NONE = np.int64(1) << 40


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if it is
    a visible Latin-1 character, else the next free code point from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankMerger:
    """The merge table of a byte-level BPE file (tokenizers' JSON) as arrays."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, size = spec["model"]["vocab"], 1 + max(spec["model"]["vocab"].values())
        self.size = np.int64(size)
        self.byte_id = np.zeros(256, np.int64)
        for sign, byte in byte_symbols().items():
            self.byte_id[byte] = vocab[sign]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.order[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, symbols of each word) that survive when no pair is ranked any more."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out_n, done = np.zeros(len(words), np.int64), []
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(sym), _NONE)
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            n = np.diff(np.r_[start, len(seq)])
            low = np.minimum.reduceat(rank, start)
            over = low == _NONE
            if over.any():
                gone = np.repeat(over, n)
                out_n[seq[start[over]]] = n[over]
                done.append((seq[gone], sym[gone]))
                sym, seq, rank, n, low = sym[~gone], seq[~gone], rank[~gone], n[~over], low[~over]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, n)
            at = np.arange(len(hit))
            first = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], at, 0))
            take = np.flatnonzero(hit & ((at - first) % 2 == 0))  # of overlapping pairs every other, from the left
            sym[take] = self.made[rank[take]]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            place = np.cumsum(keep) - 1
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            stale = np.unique(np.r_[place[take], np.maximum(place[take] - 1, 0)])
            rank[stale] = _NONE
            stale = stale[stale < len(seq) - 1]
            stale = stale[seq[stale] == seq[stale + 1]]
            rank[stale] = self.ranks(sym[stale], sym[stale + 1])
        if done:
            seq, sym = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
            sym = sym[np.argsort(seq, kind="stable")]
        return sym, out_n

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        parts, extra = [], []
        for text in texts:
            text = text or ""
            if self.split is not None and self.split.search(text):
                pieces = self.split.split(text)
                extra.append(len(pieces) - 1)
                parts.append([w for p in pieces for w in self.pattern.findall(p)])
            else:
                extra.append(0)
                parts.append(self.pattern.findall(text))
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        new = list(set().union(*parts) - known.keys())
        if new:
            known.update(zip(new, self.merge([w.encode() for w in new])[1].tolist()))
        return [x + sum(map(known.__getitem__, words)) for x, words in zip(extra, parts)]


@lru_cache(2)
def merger(path: str, pattern: str) -> RankMerger:
    return RankMerger(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of each whole text, by the vocabulary file at ``path``
    and its pre-token ``pattern``; the file must be there on every executor."""

    def work(ids, texts):
        return {"doc_id": ids, "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": merger(path, pattern).count(texts)}

    return map_texts(docs, work, "doc_id long, n_bytes long, n_tokens long", text)
