"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become token ids and a separator; only longer ones are cut into pieces of the
sequence length, the first piece taking the remainder.  Full pieces are sequences of their
own.  The others are dealt by hash into blocks of about ``BLOCK_ITEMS`` pieces, and each
block is packed by several islands, a task each:

* an individual is a grouping of pieces into sequences, the first ones made by best fit
  over decreasing, slightly shuffled and wholly random orders;
* crossover injects whole well-filled sequences of one parent into another, removes the
  sequences that hold a duplicate, and puts back the displaced pieces, along with those of
  some badly filled sequences: first each takes the place of a shorter one wherever that
  fills the sequence better (the shorter one is displaced instead), then best fit;
* every island makes ``LEAST_CHILDREN`` children at least, and then stops early only at the
  count that the total length allows, below which there is nothing to find;
* between epochs each island's elite migrates to the next island of its block.

Sequences of the winning islands that are not well filled are then pooled over blocks and
packed again in the same way, their present grouping being one of the individuals, so the
count never rises.  Only ids and lengths are shuffled, about 30 bytes a piece; blocks have
a bounded size, whatever the table's.

Null text: empty, so one piece that is the separator.  Repeated rows and doc_ids are
packed each for itself; ties in fitness and lengths fall by the islands' seeded order.
Texts are encoded whole, however long, runs of blanks of any length included.  Further
columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import written as materialize
from .bpe import byte_symbols
from .common import doc_text, slices

LENGTH, SEPARATOR = 2048, 0
BLOCK_ITEMS, ISLANDS, EPOCHS, POPULATION, CHILDREN, LEAST_CHILDREN = 16384, 2, 2, 8, 16, 2
#: A sequence filled less is packed again with those of other blocks.
WELL_FILLED = 0.985


@lru_cache(2)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers JSON file: the same ids, made faster."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    sign = byte_symbols()
    ranks = {bytes(sign[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(2)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def token_ids(text: str | None, path: str, pattern: str) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    enc = encoder(path, pattern)
    try:
        return enc.encode_to_numpy(text, allowed_special=enc.special_tokens_set, disallowed_special=())
    except ValueError:  # its pattern matcher gives up on blanks by the hundred thousand; the library does not
        return np.array(library(path).encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, keep_ids: bool = False, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, token_ids] of every piece of every document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", token_ids array<int>" * keep_ids

    def run(batches):
        for part in slices(batches):
            rows, ids = [], []
            for doc, content in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                toks = np.append(token_ids(content, path, pattern), np.uint32(SEPARATOR)).astype("<u4")
                cuts = [0, *range((len(toks) - 1) % length + 1, len(toks) + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(toks[a:b].tobytes())))
                    if keep_ids:
                        ids.append(toks[a:b].astype(np.int32))
            cols = [pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                at = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids))))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return doc_text(docs, text).mapInArrow(run, schema)


class Packing:
    """A grouping of items: ``bin`` of each item, ``load`` of each bin (0: no longer used)."""

    def __init__(self, size: np.ndarray, room: int, bins: np.ndarray | None = None):
        self.size, self.room = size, room
        self.bin = np.full(len(size), -1, np.int64) if bins is None else np.unique(bins, return_inverse=True)[1].astype(np.int64)
        self.load = np.bincount(self.bin, size, minlength=0).astype(np.int64) if bins is not None else np.zeros(0, np.int64)

    def best_fit(self, items: np.ndarray) -> None:
        """Put ``items``, in this order, each into the fullest bin that has room, or a new one."""
        by_rest: list[list[int]] = [[] for _ in range(self.room + 1)]
        load, there = self.load.tolist(), 0
        for b, n in enumerate(load):
            if n and n < self.room:
                by_rest[self.room - n].append(b)
                there |= 1 << (self.room - n)
        size, place = self.size, self.bin
        for i, s in zip(items.tolist(), size[items].tolist()):
            fit = there >> s
            if fit:
                rest = s + (fit & -fit).bit_length() - 1
                b = by_rest[rest].pop()
                if not by_rest[rest]:
                    there ^= 1 << rest
                load[b] += s
            else:
                b, rest = len(load), self.room
                load.append(s)
            place[i] = b
            rest -= s
            if rest:
                by_rest[rest].append(b)
                there |= 1 << rest
        self.load = np.array(load, np.int64)

    def rank(self) -> tuple[int, float]:
        """Fewer sequences first; among as many, the more unequal filling."""
        used = self.load[self.load > 0]
        return len(used), -float(((used / self.room) ** 2).sum())

    def replace(self, items: np.ndarray) -> np.ndarray:
        """Let each of ``items`` (in no bin, longest first) take the place of a shorter piece
        where it leaves the least room; what is in no bin afterwards."""
        size, load = self.size, self.load
        slack = np.where(load > 0, self.room - load, 0)
        there = np.flatnonzero((self.bin >= 0) & (slack[self.bin] > 0))  # only bins with room can be filled better
        there = there[np.argsort(size[there] + slack[self.bin[there]], kind="stable")]
        most = size[there] + slack[self.bin[there]]  # what may stand there
        out, swaps = [], 0
        for i in items.tolist():
            s = size[i]
            at = int(np.searchsorted(most, s))
            near = at + np.flatnonzero(size[there[at : at + 256]] < s)[:1] if at < len(there) else ()
            while len(near):
                k = int(near[0])
                j, b = there[k], self.bin[there[k]]
                if self.bin[j] >= 0 and size[j] + self.room - load[b] == most[k]:
                    break
                near = k + 1 + np.flatnonzero(size[there[k + 1 : at + 256]] < s)[:1]  # that bin has changed since
            if not len(near):
                out.append(i)
                continue
            load[b] += s - size[j]
            self.bin[i], self.bin[j] = b, -1
            out.append(int(j))
            swaps += 1
        return np.array(out, np.int64) if out else np.zeros(0, np.int64)

    def child(self, other: Packing, rng: np.random.Generator) -> Packing:
        """Well-filled bins of ``other`` injected whole into this one."""
        used = np.flatnonzero(other.load > 0)
        good = used[np.argsort(-other.load[used], kind="stable")][: max(1, len(used) * 2 // 3)]
        inject = rng.choice(good, max(1, int(len(good) * rng.uniform(0.05, 0.35))), replace=False)
        taken = np.isin(other.bin, inject)
        out = Packing(self.size, self.room)
        out.bin, load = self.bin.copy(), self.load.copy()
        gone = np.zeros(len(load), bool)
        gone[self.bin[taken]] = True  # they hold duplicates
        mine = np.flatnonzero(load > 0)
        worst = mine[np.argsort(load[mine], kind="stable")][: max(2, len(mine) // 10)]
        gone[rng.choice(worst, max(1, len(worst) // 2), replace=False)] = True
        loose = np.flatnonzero(gone[self.bin] & ~taken)
        load[gone] = 0
        new = np.full(len(other.load), -1, np.int64)
        new[inject] = len(load) + np.arange(len(inject))
        out.bin[loose] = -1
        out.bin[taken] = new[other.bin[taken]]
        out.load = np.r_[load, other.load[inject]]
        by_size = lambda rows: rows[np.lexsort((rng.random(len(rows)), -self.size[rows]))]
        for _ in range(3):
            loose = out.replace(by_size(loose))
        out.best_fit(by_size(loose))
        return out


def evolve(size: np.ndarray, room: int, seed: int, elites: list[np.ndarray], population: int = POPULATION, children: int = CHILDREN) -> Packing:
    """The best grouping found from the ``elites`` and best-fit beginnings; ends early only
    at the least count that the total length allows, after LEAST_CHILDREN."""
    rng, least = np.random.default_rng(seed), -(-int(size.sum()) // room)
    people = [Packing(size, room, e) for e in elites]
    for k in range(max(2, population - len(people))):
        p = Packing(size, room)
        p.best_fit(rng.permutation(len(size)) if k % 4 == 3 else np.argsort(-size * (1 + 0.02 * k * rng.random(len(size))), kind="stable"))
        people.append(p)
    people.sort(key=Packing.rank)
    for made in range(children):
        if made >= LEAST_CHILDREN and people[0].rank()[0] <= least:
            break
        a, b = np.sort(rng.integers(0, len(people), (2, 2)).min(axis=1))  # the better of two, twice
        people.append(people[a].child(people[b if a != b else (b + 1) % len(people)], rng))
        people.sort(key=Packing.rank)
        people = people[: max(population, 2)]
    return people[0]


_SOLVED = "block long, island int, uid long, length long, bin long, load long, offset long, n_bins long, worth double"


def _epoch(rows: DataFrame, room: int, epoch: int) -> DataFrame:
    """Rows (block, island, uid, length, elite, bin): each island evolves from the elites it has."""

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        pdf = pdf.sort_values(["elite", "uid"])
        first = pdf["elite"].to_numpy() == pdf["elite"].iloc[0]
        uid, size = pdf["uid"].to_numpy()[first], pdf["length"].to_numpy()[first].astype(np.int64)
        elites = [g["bin"].to_numpy() for e, g in pdf.groupby("elite") if e >= 0]
        best = evolve(size, room, hash((block, island, epoch)) & 0xFFFFFFFF, elites)
        order = np.argsort(best.bin, kind="stable")
        b, s = best.bin[order], size[order]
        before = np.cumsum(s) - s
        head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        offset = before - np.repeat(before[head], np.diff(np.r_[head, len(b)]))
        n, worth = best.rank()
        name = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(b)]))
        return pd.DataFrame({"block": block, "island": island, "uid": uid[order], "length": s, "bin": name, "load": best.load[b], "offset": offset, "n_bins": n, "worth": worth})

    return rows.groupBy("block", "island").applyInPandas(solve, _SOLVED)


def pack_items(items: DataFrame, room: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Pack (block, uid, length, bin or null): islands, epochs with migration, the best of each block."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    rows = items.select("block", spread, "uid", "length", F.when(F.col("bin").isNull(), -1).otherwise(islands).alias("elite"), F.coalesce("bin", F.lit(0)).cast("long").alias("bin"))
    for epoch in range(epochs):
        now = materialize(_epoch(rows, room, epoch), "packing-epoch")
        own = now.select("block", "island", "uid", "length", F.col("island").alias("elite"), "bin")
        guests = now.select("block", ((F.col("island") + 1) % islands).cast("int").alias("island"), "uid", "length", F.col("island").alias("elite"), "bin")
        rows = own.union(guests) if islands > 1 else own
    best = now.groupBy("block").agg(F.min(F.struct("n_bins", "worth", "island")).alias("best")).select("block", F.col("best.island").alias("island"))
    return now.join(best, ["block", "island"]).select("block", "uid", "length", "bin", "load", "offset")


def pack(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, keep_ids: bool = False, text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Every piece of every document (see ``pieces``) with sequence_id and offset."""
    made = materialize(pieces(docs, path, pattern, length, keep_ids, text).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    items = made.where(F.col("length") < length).select("uid", "length")
    blocks = max(1, -(-items.count() // block_items))
    first = materialize(pack_items(items.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"), "uid", "length", F.lit(None).cast("long").alias("bin")), length), "packed")
    poor = first.where(F.col("load") < int(WELL_FILLED * length))
    again = max(1, -(-poor.count() // block_items))
    name = F.col("block") * (1 << 24) + F.col("bin")
    second = pack_items(poor.select(F.pmod(F.xxhash64("block", "bin"), F.lit(again)).alias("block"), "uid", "length", name.alias("bin")), length)
    place = first.where(F.col("load") >= int(WELL_FILLED * length)).select("uid", (2 * name).alias("sequence_id"), "offset").union(second.select("uid", (2 * name + 1).alias("sequence_id"), "offset"))
    full = made.where(F.col("length") == length).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    cols = [c for c in made.columns if c != "uid"] + ["sequence_id", "offset"]
    return made.where(F.col("length") < length).join(place, "uid").select(cols).union(full.select(cols))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token ids: (sequence_id, token_ids, doc_ids, starts), for ``pack(keep_ids=True)``."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "token_ids", "doc_id"))).alias("r"))
    return rows.select("sequence_id", F.flatten("r.token_ids").alias("token_ids"), F.col("r.doc_id").alias("doc_ids"), F.col("r.offset").alias("starts"))
