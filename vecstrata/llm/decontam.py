"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are the runs of ASCII letters and digits and of characters beyond ASCII, A-Z
lower-cased.  A benchmark item gives the windows of ``n`` consecutive words; an item of
fewer words, but not none, is one window.  A document word inside any occurrence of a
window is hit.

The windows are 64-bit hashes in one sorted array for each window length, with the words
themselves beside them: a document's windows are hashed at once, looked up, and every hit is
verified word by word.  About 5 bytes are held for a byte of benchmark text.  The benchmark
is collected and broadcast in blocks of at most ``BLOCK_BYTES`` of text.  If there is one
block, the documents are read once and never shuffled; if there are more, each block scans
the written documents in a pass of its own, its broadcast is destroyed, and only the hits
(a row for each document that has any) are merged and joined, so what a worker holds is
bounded however large the benchmark grows.

Null text has no words: no hits.  Items with a null id hit like others; together they are
one item, a null at the end of the list that the digest leaves out.  An empty benchmark hits
nothing; an empty table gives an empty result.  Repeated items count once; repeated documents
are each answered.  A document without words is never contaminated.  Texts are read whole,
however long.  Further columns, whatever their names, are carried.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Carried, arrow_schema, slices
from .common import written as materialize

WINDOW, BLOCK_BYTES = 13, 8 << 20

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before lower-casing
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_KEEP).split() if text else []


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words) if seed else map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, m: int) -> np.ndarray:
    """The hash of each window of ``m`` words, from the words' hashes."""
    n = len(hashes) - m + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(m if n > 0 else 0):
        out = out * _STEP + hashes[k : k + n]
    return out ^ (out >> np.uint64(29))


class Windows:
    """Windows of one length: their distinct hashes in order, where each stands first, and
    the items that have it."""

    def __init__(self, hashes: np.ndarray, place: np.ndarray, item: np.ndarray):
        order = np.lexsort((item, hashes))
        hashes, place, item = hashes[order], place[order], item[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]]
        self.again = (place[np.flatnonzero(new)][np.cumsum(new) - 1][~new], place[~new])  # to be equal
        own = new | np.r_[True, item[1:] != item[:-1]]
        self.hashes, self.place, self.item = hashes[new], place[new].astype(np.int32), item[own].astype(np.int32)
        self.start = np.r_[np.flatnonzero(new[own]), own.sum()].astype(np.int32)
        self.bits = np.uint64(64 - max(10, int(8 * len(self.hashes)).bit_length()))
        self.maybe = np.zeros(1 << int(64 - self.bits), bool)
        self.maybe[self.hashes >> self.bits] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes``, windows) of equal hashes."""
        near = np.flatnonzero(self.maybe[hashes >> self.bits])
        if not len(near):
            return near, near
        at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[near]
        return near[same], at[same]


class Matcher:
    """The windows of some benchmark items."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int = WINDOW):
        self.ids: list[str | None] = sorted({item for item, _ in items}, key=lambda x: (x is None, x))
        number = {item: k for k, item in enumerate(self.ids)}
        rows = [(number[item], words) for item, text in items if (words := words_of(text))]
        self.text = b" ".join(b" ".join(words) for _, words in rows)  # one space between any two words
        gaps = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32)
        self.begin = np.r_[0, gaps + 1].astype(np.int32)
        self.end = np.r_[gaps, len(self.text)].astype(np.int32)
        self.seed = 0
        while not self._hashed(rows, n):  # two different windows have one hash: once in millions of blocks
            self.seed += 1

    def _hashed(self, rows: list[tuple[int, list[bytes]]], n: int) -> bool:
        """Make the windows; whether different windows have different hashes."""
        found: dict[int, list] = {}
        at = 0
        for item, words in rows:
            m = min(n, len(words))
            h = window_hashes(word_hashes(words, self.seed), m)
            found.setdefault(m, []).append((h, at + np.arange(len(h)), np.full(len(h), item)))
            at += len(words)
        self.windows = {m: Windows(*(np.concatenate(part) for part in zip(*made))) for m, made in sorted(found.items())}
        fine = all(self.words(a, m) == self.words(b, m) for m, held in self.windows.items() for a, b in zip(*(x.tolist() for x in held.again)))
        for held in self.windows.values():
            del held.again
        return fine

    def words(self, at: int, m: int) -> bytes:
        return self.text[self.begin[at] : self.end[at + m - 1]]

    def nbytes(self) -> int:
        arrays = [self.begin, self.end, *(a for w in self.windows.values() for a in (w.hashes, w.place, w.item, w.start, w.maybe))]
        return len(self.text) + sum(a.nbytes for a in arrays)

    def find(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str | None]]:
        """(which words are hit, items that occur); None if no word is hit."""
        hashes, hit, found = word_hashes(words, self.seed), None, set()
        for m, held in self.windows.items():
            if len(words) < m:
                continue
            for i, k in zip(*(x.tolist() for x in held.find(window_hashes(hashes, m)))):
                if b" ".join(words[i : i + m]) == self.words(held.place[k], m):  # verify
                    if hit is None:
                        hit = np.zeros(len(words), bool)
                    hit[i : i + m] = True
                    found.update(held.item[held.start[k] : held.start[k + 1]].tolist())
        return hit, {self.ids[k] for k in found}


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple[str | None, str | None]], int]]:
    """(items, number of blocks): collected blocks of about ``limit`` bytes, at least one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // limit + 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.collect()], n


def runs(hit: np.ndarray) -> list[int]:
    """Start and end of each maximal run of true, in one flat list."""
    return np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).tolist()


_FOUND = "n_words long,runs array<long>,items array<string>"


def scan(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text",
    finish: Callable | None = None, schema: StructType | None = None,
) -> DataFrame:
    """All columns of ``docs`` (none is named like these) and n_words, runs (flat starts and
    ends of hit runs of words) and items (those that occur).

    With ``finish``, instead, what it makes of each record batch and the three lists, of
    ``schema``: in the same pass if there is one block."""
    extra = arrow_schema(_FOUND)

    def with_lists(part: pa.RecordBatch, *lists: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, f.type) for v, f in zip(lists, extra))], names=[*part.schema.names, *extra.names])

    def against(rows: DataFrame, block: list, make: Callable, kind: StructType) -> tuple:
        sent = rows.sparkSession.sparkContext.broadcast(Matcher(block, n))

        def run(batches):
            for part in slices(batches, text):
                counts, spans, items = [], [], []
                for content in part.column(text).to_pylist():
                    words = words_of(content)
                    hit, found = sent.value.find(words)
                    counts.append(len(words))
                    spans.append([] if hit is None else runs(hit))
                    items.append(sorted(found, key=lambda x: (x is None, x)))
                yield make(part, counts, spans, items)

        return rows.mapInArrow(run, kind), sent

    def listed(rows: DataFrame) -> StructType:
        return rows.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.array().cast("array<long>"), "items": F.array().cast("array<string>")}).schema

    tagged, hits = None, None
    for block, n_blocks in blocks(benchmark, block_bytes):
        if n_blocks == 1:
            return against(docs, block, finish or with_lists, schema or listed(docs))[0]
        if tagged is None:
            tagged = materialize(docs.withColumn("uid", F.monotonically_increasing_id()), "documents-to-scan")
        slim = tagged.select("uid", text)
        made, sent = against(slim, block, with_lists, listed(slim))
        first = hits is None  # the first pass counts the words too
        made = materialize(made.where(F.lit(first) | (F.size("runs") > 0)).select("uid", "n_words", "runs", "items"), "benchmark-hits")
        sent.destroy()
        sizes = made if first else sizes
        some = made.where(F.size("runs") > 0).select("uid", "runs", "items")
        hits = some if hits is None else hits.union(some)
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")  # of as many rows as there are blocks
    merged = hits.groupBy("uid").agg(F.collect_list("runs").alias("all_runs"), items)

    def together(batches):
        for b in batches:
            spans = []
            for lists in b.column("all_runs").to_pylist():
                hit = np.zeros(max(x[-1] for x in lists), bool)
                for x in lists:
                    for start, stop in zip(x[::2], x[1::2]):
                        hit[start:stop] = True
                spans.append(runs(hit))
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(spans, extra.field("runs").type), b.column("items")], names=["uid", "runs", "items"])

    merged = materialize(merged.mapInArrow(together, "uid long, runs array<long>, items array<string>"), "merged-hits")
    out = tagged.join(sizes.select("uid", "n_words"), "uid").join(merged, "uid", "left").drop("uid")
    out = out.withColumns({"runs": F.coalesce("runs", F.array().cast("array<long>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    if finish is None:
        return out
    own = docs.columns

    def finished(batches):
        for b in batches:
            yield finish(b.select(own), *(b.column(c).to_pylist() for c in extra.names))

    return out.mapInArrow(finished, schema)


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items and hit_runs of every document."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), benchmark, n, block_bytes)
    n_hit = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.col("runs").alias("hit_runs"))


def cut_words(text: str, spans: list[int]) -> str:
    """``text`` without the given runs of words."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join(out) + text[last:]


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, percent: int = 5, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its contaminated documents (at least ``percent`` of the words hit);
    from the others the hit words are cut out and ``n_chars``, if there, counted anew."""
    own = Carried(docs)
    at = own[text]

    def cut(part: pa.RecordBatch, counts: list, spans: list, _: list) -> pa.RecordBatch:
        texts, choose = [], []
        for k, (content, found, total) in enumerate(zip(part.column(at).to_pylist(), spans, counts)):
            hit = sum(found[1::2]) - sum(found[::2])
            if found and 100 * hit >= percent * total:
                continue
            choose.append(k)
            texts.append(cut_words(content, found) if found else content)
        part = part.take(pa.array(choose, pa.int64()))
        cols = dict(zip(part.schema.names, part.columns)) | {at: pa.array(texts, part.schema.field(at).type)}
        return pa.RecordBatch.from_arrays(list(cols.values()), schema=part.schema)

    out = own.back(scan(own.frame, benchmark, n, block_bytes, at, cut, own.frame.schema))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in own else out


def items_digest(items: str = "items") -> Column:
    """SHA-256 of the sorted item ids, comma-joined."""
    return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)
