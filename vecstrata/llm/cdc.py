"""Substring dedup by content-defined chunks of a gear rolling hash.

A chunk ends where the top bits of the gear hash (h = 2h + G[byte], 32 bits, so the last 32
bytes count) are zero, but not before ``LEAST`` and at ``MOST`` bytes at the latest, never
inside a UTF-8 character.  As the ends depend on the bytes around them alone, an insertion
shifts chunks without changing those further on.  Chunks are compared by a 96-bit digest:
the first in (doc_id, reading order, start) stays, all others go where a run of them has
``LEAST_RUN`` bytes or more, or makes up its whole document.

Documents are written as slices of some MB.  A slice sends each digest it has once, with
the smallest doc_id, as packed arrays of 16 bytes a digest.  A shard of digests reads them
as a sorted stream and holds each digest with its first place alone, so a chunk that a third
of all documents share is one entry a slice and never gathered: whatever is not first is
answered at once, and the few places that were first for a while are named at the end.
Slices take the answers and cut their documents.

Null text: empty, no chunks.  A null doc_id comes last.  Repeated rows and doc_ids are
documents of their own (the one read first comes first).  Texts are read whole; one longer
than a slice is a slice of its own.  Further columns are not read.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, sliced
from .common import written as materialize

LEAST, BITS, MOST, LEAST_RUN = 16, 4, 1024, 48
#: Text bytes of a slice and of a shard; entries that a shard merges at once; partitions at most.
SLICE, SHARD_BYTES, MERGE, PARTITIONS = 4 << 20, 16 << 20, 500_000, 1 << 15
GEAR = np.random.default_rng(9).integers(0, 1 << 32, 256, dtype=np.uint32)
_BLOCK = 1 << 22
_LAST = np.int64((1 << 63) - 1)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash at every byte, in five doubling steps."""
    h, k = GEAR[data], 1
    while k < 32:
        later = h.copy()
        later[k:] += h[:-k] << np.uint32(k)
        h, k = later, 2 * k
    return h


def cut_points(data: bytes, least: int = LEAST, bits: int = BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks of ``data``, the last being its length."""
    raw, found = np.frombuffer(data, np.uint8), []
    for at in range(0, len(raw), _BLOCK):  # a block starts 31 bytes early, so its hashes are those of the whole
        lead = min(at, 31)
        h = gear_hash(raw[at - lead : at + _BLOCK])[lead:]
        found.append(np.flatnonzero(h >> np.uint32(32 - bits) == 0) + at + 1)
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    ends = ends[ends < len(raw)]
    ends = ends[raw[ends] & 0xC0 != 0x80]
    out, last = [], 0
    for e in [*ends.tolist(), len(raw)]:
        while e - last > most:
            forced = last + most
            while raw[forced] & 0xC0 == 0x80:
                forced -= 1
            out.append(forced)
            last = forced
        if e - last >= least or e == len(raw) > last:
            out.append(e)
            last = e
    return out


class Slice:
    """The chunks of a slice's documents, and its entries: the distinct digests, by shard
    and digest, each at its first place."""

    def __init__(self, doc_ids: list, lens: list, data: bytes, shards: int):
        self.doc_ids, self.lens, self.data = doc_ids, lens, data
        self.order_of = np.array([_LAST if d is None else d for d in doc_ids], np.int64)  # ascending
        stops, n_chunks, at = [], [], 0
        for size in lens:
            own = cut_points(data[at : at + size])
            stops += [at + e for e in own]
            n_chunks.append(len(own))
            at += size
        self.stop = np.array(stops, np.int64)
        self.doc = np.repeat(np.arange(len(lens)), n_chunks)
        self.start = np.r_[0, self.stop[:-1]][: len(stops)]  # chunks are gapless, also from document to document
        digest = b"".join(hashlib.blake2b(data[a:b], digest_size=12).digest() for a, b in zip(self.start.tolist(), stops))
        pairs = np.frombuffer(digest, [("a", "<u8"), ("b", "<u4")])
        a, b = pairs["a"].astype(np.uint64), pairs["b"].astype(np.uint32)
        shard = (a % np.uint64(shards)).astype(np.int64)
        o = np.lexsort((b, a, shard))  # stable: equal digests stay in the order of their places
        new = np.ones(len(o), bool)
        new[1:] = (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])
        self.head = o[new]
        self.entry = np.empty(len(o), np.int64)
        self.entry[o] = np.cumsum(new) - 1
        self.a, self.b, self.shard = a[self.head], b[self.head], shard[self.head]

    def deal(self):
        """(shard, packed entries)."""
        cuts = np.flatnonzero(np.r_[True, self.shard[1:] != self.shard[:-1], True]) if len(self.shard) else []
        for x, y in zip(cuts, cuts[1:]):
            docs, local = np.unique(self.doc[self.head[x:y]], return_inverse=True)
            parts = [np.array([y - x, len(docs)], "<i8"), self.order_of[docs].astype("<i8"), self.a[x:y].astype("<u8"), self.b[x:y].astype("<u4"), local.astype("<u4")]
            yield int(self.shard[x]), b"".join(p.tobytes() for p in parts)

    def gone(self, replies: list, within: bool) -> np.ndarray:
        """Which chunks are not the first of their digest."""
        dup = np.zeros(len(self.head), bool)
        for r in replies or []:
            x = int(np.searchsorted(self.shard, r["shard"]))
            if r["dup"] is not None:
                n = int(np.searchsorted(self.shard, r["shard"], "right")) - x
                dup[x : x + n] |= np.unpackbits(np.frombuffer(r["dup"], np.uint8), count=n).astype(bool)
            else:
                dup[x + np.frombuffer(r["lost"], "<i4")] = True
        first = self.head[self.entry] if len(self.head) else self.entry
        again = first != np.arange(len(first)) if within else self.doc[first] != self.doc
        return dup[self.entry] | again if len(self.head) else np.zeros(0, bool)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest's two parts, doc_id order) of packed entries."""
    n, m = np.frombuffer(blob, "<i8", 2)
    at = 16 + 8 * m
    ids = np.frombuffer(blob, "<i8", m, 16)
    a, b = np.frombuffer(blob, "<u8", n, at), np.frombuffer(blob, "<u4", n, at + 8 * n)
    return a, b, ids[np.frombuffer(blob, "<u4", n, at + 12 * n)]


_DEALT, _REPLY = "shard int,slice_id long,blob binary", "slice_id long,shard int,dup binary,lost binary"


class ShardTable:
    """The first place of every digest of one shard, from a stream of its packed entries."""

    def __init__(self, merge: int):
        self.merge, self.rows = merge, []
        self.start(None)

    def start(self, shard: int | None) -> None:
        self.shard, self.held, self.n = shard, [], 0
        self.a, self.b = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.id, self.slice, self.at = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slice_id: int, blob: bytes) -> None:
        self.held.append((slice_id, *unpack(blob)))
        self.n += len(self.held[-1][1])
        if self.n >= self.merge:
            self.settle()

    def settle(self) -> None:
        """Merge what is held into the table; answer it, and name the places that lost theirs."""
        if not self.held:
            return
        size = [len(h[1]) for h in self.held]
        old = len(self.a)
        a, b, ids = (np.concatenate([mine, *(h[k] for h in self.held)]) for k, mine in ((1, self.a), (2, self.b), (3, self.id)))
        where = np.r_[self.slice, np.repeat([h[0] for h in self.held], size)]
        at = np.concatenate([self.at, *(np.arange(n) for n in size)])
        o = np.lexsort((at, where, ids, b, a))
        new = np.ones(len(o), bool)
        new[1:] = (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])
        late = np.empty(len(o), bool)
        late[o] = ~new
        lost = np.flatnonzero(late[:old])
        for s in np.unique(where[lost]).tolist():
            self.rows.append((s, self.shard, None, at[lost[where[lost] == s]].astype("<i4").tobytes()))
        k = old
        for (s, *_), n in zip(self.held, size):
            self.rows.append((s, self.shard, np.packbits(late[k : k + n]).tobytes(), None))
            k += n
        first = o[new]
        self.a, self.b, self.id, self.slice, self.at = a[first], b[first], ids[first], where[first], at[first]
        self.held, self.n = [], 0

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        schema = arrow_schema(_REPLY)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def shard_replies(batches, merge: int):
    """Replies to rows (shard, slice_id, blob) sorted by shard."""
    table = ShardTable(merge)
    for batch in batches:
        for shard, slice_id, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "slice_id", "blob"))):
            if shard != table.shard:
                table.settle()
                table.start(shard)
            table.add(slice_id, blob)
            if len(table.rows) >= 1000:
                yield table.taken()
    table.settle()
    yield table.taken()


def removed_runs(start: np.ndarray, stop: np.ndarray, gone: np.ndarray, size: int, least_run: int) -> list[int]:
    """Flat starts and ends of the maximal runs of gone chunks of one document that are long
    enough or the whole of it."""
    edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
    if not len(edge):
        return []
    a, b = start[edge[::2]], stop[edge[1::2] - 1]
    long = (b - a >= least_run) | (b - a == size)
    return np.stack([a[long], b[long]], axis=1).ravel().tolist()


def dedup(
    docs: DataFrame, text: str = "text", least_run: int = LEAST_RUN, keep_text: bool = True, within: bool = True,
    merge: int = MERGE, slice_bytes: int = SLICE, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (flat starts and ends) [,
    kept: the bytes that are left] of every document: without the chunks that an earlier
    document has, or (``within``) that it has itself, further up."""
    source = materialize(sliced(docs, text, slice_bytes), "slices")
    total = source.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = total // shard_bytes + 1

    def opened(b, i: int) -> Slice:
        return Slice(b.column("doc_ids")[i].as_py(), b.column("lens")[i].as_py(), b.column("data")[i].as_py(), shards)

    def deal(batches):
        for b in batches:
            for i in range(b.num_rows):
                slice_id = b.column("slice_id")[i].as_py()
                for shard, blob in opened(b, i).deal():
                    yield pa.RecordBatch.from_pydict({"shard": [shard], "slice_id": [slice_id], "blob": [blob]}, schema=arrow_schema(_DEALT))

    dealt = source.mapInArrow(deal, _DEALT).repartitionById(min(shards, PARTITIONS), "shard").sortWithinPartitions("shard")
    replies = dealt.mapInArrow(lambda batches: shard_replies(batches, merge), _REPLY)
    by_slice = replies.groupBy("slice_id").agg(F.collect_list(F.struct("shard", "dup", "lost")).alias("replies"))
    # hashed, as sorting would hold whole partitions of slices
    asked = materialize(by_slice, "slice-replies").hint("shuffle_hash")
    schema = "doc_id long,n_bytes long,n_removed long,n_spans long,kept_sha256 string,removed array<long>" + ",kept binary" * keep_text
    arrow = arrow_schema(schema)

    def cut(batches):
        for b in batches:
            for i in range(b.num_rows):
                s = opened(b, i)
                gone = s.gone(b.column("replies")[i].as_py(), within)
                bound = np.searchsorted(s.doc, np.arange(len(s.lens) + 1))
                out, at = [], 0
                for k, (doc, size) in enumerate(zip(s.doc_ids, s.lens)):
                    x, y = bound[k], bound[k + 1]
                    removed = removed_runs(s.start[x:y] - at, s.stop[x:y] - at, gone[x:y], size, least_run)
                    data = s.data[at : at + size]
                    edge = [0, *removed, size]
                    kept = b"".join(data[p:q] for p, q in zip(edge[::2], edge[1::2])) if removed else data
                    row = (doc, size, size - len(kept), len(removed) // 2, hashlib.sha256(kept).hexdigest(), removed)
                    out.append((*row, kept) if keep_text else row)
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

    return source.join(asked, "slice_id", "left").select("doc_ids", "lens", "data", "replies").mapInArrow(cut, schema)
