"""Suffix-array dedup: bytes of long strings that also start in an earlier document.

``suffix_array`` is the linear grouping construction.  Suffixes start in groups by their
first symbol; groups are taken in descending order, each suffix finds the previous smaller
suffix by pointer jumps, and the suffixes found move up into new groups by how often they
were found, so that groups come to be the classes of equal Lyndon prefixes.  One ascending
sweep along the same pointers then emits the order within every group.  Nothing is renamed
or solved recursively.

A suffix array of a corpus can't be one machine's, so the strings are dealt first.  Every
window of ``LENGTH`` bytes names the least-hashed ``GRAM``-byte gram in it (the leftmost of
equals); neighbouring windows with the same gram are a run of one string.  Equal windows
have equal grams at equal places, so whatever is equal meets where the gram is dealt to:

1. documents are written as slices of some MB; a slice deals its runs, equal ones once with
   their smallest doc_id, as packed arrays (gram, run, document) of 12 bytes a run;
2. a shard finds the runs that are equal as a whole (identical strings are pre-aggregated,
   not sorted), and the grams that stand in different runs: those alone can hold partial
   matches, at the edges of copied passages;
3. these different runs are fetched once each and dealt by gram; suffix arrays over them,
   built in bounded batches, bring equal windows together, and every window that also
   stands in a run with a smaller doc_id is marked;
4. slices take both answers and cut their documents.

A passage that a third of all documents share is one entry a slice.  A shard reads its
entries as a sorted stream and holds ``SHARD_ENTRIES`` at most: what is above goes by the
most frequent grams, which are called hot unseen, all their entries with them.  The edges
of such a passage differ from copy to copy; runs of hot grams, and of grams that stand in
more than ``HOT`` different runs, are dealt window by window: the smallest doc_id of each
window is a grouped minimum, combined on the map side, and a join that adaptive execution
can split marks the others.  So no task holds all runs of a gram or all copies of a window.

Null text: empty.  A null doc_id comes after all others.  Rows with the same doc_id do not
remove each other's bytes; ties fall by nothing else, so equal rows lose equal bytes.  Texts
are read whole; one longer than a slice is a slice of its own.  Further columns are not
read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written as materialize
from ..scratch import temporary
from .common import arrow_schema, sliced

LENGTH, GRAM = 50, 26
#: Text bytes of a slice, window starts handled at once, symbols of one suffix array, text
#: bytes of a shard.
SLICE, BLOCK, BATCH_SYMBOLS, SHARD_BYTES = 2 << 20, 1 << 16, 1 << 16, 16 << 20
#: Different runs of one gram that one suffix array may take; entries that a shard may hold;
#: partitions at most.
HOT, SHARD_ENTRIES, PARTITIONS = 2048, 3_000_000, 1 << 15
_LAST = np.int64((1 << 63) - 1)
_TABLE = np.random.default_rng(50).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_POSITION = np.uint64((1 << 22) - 1)


def suffix_array(text) -> list[int]:
    """The suffixes of a sequence of comparable symbols in ascending order."""
    n, first = len(text), {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    members = [first[c] for c in sorted(first)]  # of a group; suffixes that moved on stay listed
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    above, below = [*range(1, len(members)), -1], list(range(-1, len(members) - 1))
    previous, done, found, finished = [-1] * n, bytearray(n), [0] * n, []
    at = len(members) - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = own
        if own:
            finished.append(at)
            for i in own:
                done[i] = 1
            hit = []
            for i in own:
                j = i - 1
                while j >= 0 and done[j]:  # not smaller: jump on
                    j = previous[j]
                previous[i] = j
                if j >= 0:
                    if not found[j]:
                        hit.append(j)
                    found[j] += 1
            moved: dict = {}
            for p in hit:
                moved.setdefault((found[p], group[p]), []).append(p)
                found[p] = 0
            for times, g in sorted(moved, reverse=True):  # found more often: further up
                new, over = len(members), above[g]
                members.append(moved[times, g])
                for p in members[new]:
                    group[p] = new
                above.append(over)
                below.append(g)
                above[g] = new
                if over >= 0:
                    below[over] = new
        at = below[at]
    slot, free = [0] * len(members), 1
    for g in reversed(finished):
        slot[g] = free
        free += len(members[g])
    out = [n] * (n + 1)
    for k in range(n + 1):
        j = out[k] - 1
        while j >= 0 and done[j]:
            done[j] = 0
            g = group[j]
            out[slot[g]] = j
            slot[g] += 1
            j = previous[j]
    return out[1:]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    step, back = np.uint64(_STEP), np.uint64(pow(_STEP, -1, 1 << 64))
    return np.cumprod(np.r_[np.uint64(1), np.full(n, step)]), np.cumprod(np.r_[np.uint64(1), np.full(n, back)])


_UP, _DOWN = _powers(BLOCK + LENGTH)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def runs(data: np.ndarray, lens: np.ndarray) -> dict[str, np.ndarray]:
    """The runs of concatenated documents: ``start`` and ``stop`` (first and last window),
    ``gram`` (its place), ``doc``, and hashes of gram and whole run."""
    doc_of = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    out: list[tuple] = []
    width = LENGTH - GRAM + 1
    for base in range(0, max(len(data) - LENGTH + 1, 0), BLOCK):
        b = data[base : base + BLOCK + LENGTH - 1]
        n = len(b)
        sums = np.r_[np.uint64(0), np.cumsum(_TABLE[b] * _UP[:n])]
        gram = _mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: n - GRAM + 1])
        low, reach = (gram & ~_POSITION) | np.arange(len(gram), dtype=np.uint64), 1
        while 2 * reach <= width:
            low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        place, doc = (low & _POSITION).astype(np.int32), doc_of[base : base + len(low)]
        inside = doc == doc_of[base + LENGTH - 1 : base + LENGTH - 1 + len(low)]  # the window ends in the document it starts in
        new = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(inside & np.r_[True, new | ~inside[:-1]])
        stop = np.flatnonzero(inside & np.r_[new | ~inside[1:], True])
        p = place[start].astype(np.int64)
        shape = (p - start).astype(np.uint64) << np.uint64(8) | (stop - start).astype(np.uint64)
        whole = _mix((sums[stop + LENGTH] - sums[start]) * _DOWN[start] ^ _mix(shape + np.uint64(1)))
        out.append((start + base, stop + base, p + base, doc[start], gram[p], whole))
    names = ("start", "stop", "gram", "doc", "gram_hash", "run_hash")
    if not out:
        return dict(zip(names, (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2))
    return {k: np.concatenate(v) for k, v in zip(names, zip(*out))}


class Slice:
    """A slice's runs in the order dealt: by shard, equal runs together and by doc_id; ``head``
    has the first of each group of equal runs (an entry), ``entry`` the entry of each run."""

    def __init__(self, doc_ids: list, lens: list, data: bytes, shards: int):
        self.doc_ids, self.lens, self.data = doc_ids, np.array(lens, np.int64), np.frombuffer(data, np.uint8)
        self.order_of = np.array([_LAST if d is None else d for d in doc_ids], np.int64)  # ascending, see sliced
        r = runs(self.data, self.lens)
        mixed = _mix(r["gram_hash"] + np.uint64(77))
        shard = (mixed >> np.uint64(32)) % np.uint64(shards)
        tag, run = mixed & np.uint64(0xFFFFFFFF), r["run_hash"] >> np.uint64(16)
        # one sort of (shard, part of a hash of gram and run, place): equal runs stay in the order
        # of their documents; should others fall between them, they are two entries
        low, high = np.uint64(len(run).bit_length()), np.uint64(int(shards).bit_length())
        key = _mix(tag * np.uint64(_STEP) ^ run) >> (low + high) << low | np.arange(len(run), dtype=np.uint64)
        o = (np.sort(shard << (np.uint64(64) - high) | key) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        self.runs = {k: v[o] for k, v in r.items()}
        self.run, self.key = run[o], self.order_of[self.runs["doc"]]
        self.shard, self.tag = shard[o].astype(np.int64), tag[o].astype(np.uint32)
        new = np.ones(len(o), bool)
        new[1:] = (self.shard[1:] != self.shard[:-1]) | (self.tag[1:] != self.tag[:-1]) | (self.run[1:] != self.run[:-1])
        self.head = np.flatnonzero(new)
        self.entry = np.cumsum(new) - 1

    def deal(self):
        """(shard, packed entries)."""
        h = self.head
        cuts = np.flatnonzero(np.r_[True, self.shard[h][1:] != self.shard[h][:-1], True]) if len(h) else []
        for a, b in zip(cuts, cuts[1:]):
            e = h[a:b]
            docs, local = np.unique(self.runs["doc"][e], return_inverse=True)
            ids = self.order_of[docs]
            run = self.run[e]
            parts = [np.array([len(e), len(ids)], "<i8"), ids.astype("<i8"), self.tag[e].astype("<u4"), (run & np.uint64(0xFFFFFFFF)).astype("<u4"), (run >> np.uint64(32)).astype("<u2"), local.astype("<u2")]
            yield int(self.shard[h[a]]), b"".join(p.tobytes() for p in parts)

    def answers(self, replies: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per entry: repeated elsewhere under a smaller doc_id; to be fetched; of a hot
        gram.  ``replies`` has (shard, dup, send, hot) of each shard dealt to."""
        of_shard = {r["shard"]: r for r in replies or []}
        dup, send, hot = (np.zeros(len(self.head), bool) for _ in range(3))
        shards = self.shard[self.head]
        for s in np.unique(shards).tolist():
            a, b = np.searchsorted(shards, [s, s + 1])
            for bits, name in ((dup, "dup"), (send, "send"), (hot, "hot")):
                bits[a:b] = np.unpackbits(np.frombuffer(of_shard[s][name], np.uint8), count=b - a).astype(bool)
        return dup, send, hot


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tag, run, doc_id order) of packed entries."""
    n, m = np.frombuffer(blob, "<i8", 2)
    at = 16
    ids = np.frombuffer(blob, "<i8", m, at)
    at += 8 * m
    tag = np.frombuffer(blob, "<u4", n, at)
    low = np.frombuffer(blob, "<u4", n, at + 4 * n).astype(np.uint64)
    high = np.frombuffer(blob, "<u2", n, at + 8 * n).astype(np.uint64)
    return tag, low | high << np.uint64(32), ids[np.frombuffer(blob, "<u2", n, at + 10 * n)]


def compare_entries(tag: np.ndarray, run: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dup, send, hot): entries whose run stands under a smaller id too; those of the
    smallest id of each different run of a gram whose runs have different ids (one, unless
    that id is repeated); and whether its gram has more than HOT of these."""
    n = len(tag)
    o = np.lexsort((ids, run, tag))
    t, r, d = tag[o], run[o], ids[o]
    gram = np.ones(n, bool)
    gram[1:] = t[1:] != t[:-1]
    cls = gram.copy()
    cls[1:] |= r[1:] != r[:-1]
    first = np.flatnonzero(cls)
    dup, send, hot = (np.zeros(n, bool) for _ in range(3))
    least_of_run = d[first][np.cumsum(cls) - 1]
    dup[o] = d > least_of_run
    begin, own = np.flatnonzero(gram), np.cumsum(gram) - 1
    least, most = np.minimum.reduceat(least_of_run, begin), np.maximum.reduceat(least_of_run, begin)
    sent = (d == least_of_run) & (least < most)[own]
    send[o] = sent
    hot[o] = (np.bincount(own[sent], minlength=len(begin)) > HOT)[own]
    return dup, send, hot


def _common(group: np.ndarray, side: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row the longest start of ``side`` shared with another row of its group."""
    words = np.ascontiguousarray(side).view(">u8").astype(np.uint64)
    o = np.lexsort((*words.T[::-1], group))
    same = (side[o[1:]] == side[o[:-1]]).cumprod(axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    same = np.minimum(np.minimum(same, size[o[1:]]), size[o[:-1]]) * (group[o[1:]] == group[o[:-1]])
    out = np.zeros(len(group), np.int64)
    out[o[1:]] = same
    out[o[:-1]] = np.maximum(out[o[:-1]], same)
    return out


def trimmed(group: np.ndarray, bodies: list[bytes], gram_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the part of each body that some other body of its gram may share: what
    lies beyond the longest common extension to either side can't be in an equal window."""
    most = LENGTH - GRAM
    size = np.array([len(b) for b in bodies], np.int64)
    right_size = size - gram_at - GRAM
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    base = np.cumsum(size) - size
    k = np.arange(most)
    left = np.where(k < gram_at[:, None], flat[np.maximum(base[:, None] + gram_at[:, None] - 1 - k, 0)], 0).astype(np.uint8)
    right = np.where(k < right_size[:, None], flat[np.minimum(base[:, None] + gram_at[:, None] + GRAM + k, len(flat) - 1)], 0).astype(np.uint8)
    return gram_at - _common(group, left, gram_at), gram_at + GRAM + _common(group, right, right_size)


def repeated_windows(bodies: list[bytes], ids: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """(body, offset) of every window of ``length`` bytes that also stands in a body with a
    smaller id: neighbours in the suffix array of all bodies, each with its own terminator."""
    text: list[int] = []
    for k, b in enumerate(bodies):
        text += [x + len(bodies) for x in b]
        text.append(k)
    order = np.array(suffix_array(text), np.int64)
    size = np.array([len(b) for b in bodies], np.int64)
    start = np.cumsum(size + 1) - size - 1
    body = np.repeat(np.arange(len(bodies)), size + 1)
    offset = np.arange(len(text)) - start[body]
    order = order[offset[order] + length <= size[body[order]]]
    if not len(order):
        return []
    flat = np.array(text, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(flat, length)[order]
    new = np.r_[True, (windows[1:] != windows[:-1]).any(axis=1)]
    own = ids[body[order]]
    least = np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
    late = order[own > least]
    return list(zip(body[late].tolist(), offset[late].tolist()))


_DEALT, _REPLY = "shard int,slice_id long,blob binary", "slice_id long,shard int,dup binary,send binary,hot binary,n_hot long"
_FETCH = "shard int,gram long,id long,slice_id long,entry int,base int,gram_at int,hot boolean,body binary"
_MARKS = "slice_id long,entry int,first array<long>"


class ShardReplies:
    """The replies of one shard at a time to a stream of its packed entries; holds
    ``limit`` entries at most."""

    def __init__(self, limit: int):
        self.limit, self.rows, self.shard = limit, [], None
        self.start(None)

    def start(self, shard: int | None) -> None:
        self.shard, self.held, self.n = shard, [], 0
        self.hot_tags, self.all_hot = np.zeros(0, np.uint32), False

    def is_hot(self, tag: np.ndarray) -> np.ndarray:
        return np.ones(len(tag), bool) if self.all_hot else np.isin(tag, self.hot_tags)

    def say(self, slice_id: int, dup: np.ndarray, send: np.ndarray, hot: np.ndarray) -> None:
        bits = (np.packbits(x).tobytes() for x in (dup, send, hot))
        self.rows.append((slice_id, self.shard, *bits, int((send & hot).sum())))

    def add(self, slice_id: int, blob: bytes) -> None:
        tag, run, ids = unpack(blob)
        hot = self.is_hot(tag)
        if hot.all():
            self.say(slice_id, np.zeros(len(tag), bool), hot, hot)
            return
        self.held.append((slice_id, hot, tag[~hot], run[~hot], ids[~hot]))
        self.n += int((~hot).sum())
        if self.n > self.limit:
            self.shed()

    def shed(self) -> None:
        """Call the most frequent grams hot, so that half the limit is held at most."""
        tags, n = np.unique(np.concatenate([h[2] for h in self.held]), return_counts=True)
        order = np.argsort(-n, kind="stable")
        over = np.cumsum(n[order])
        most = int(np.searchsorted(over, self.n - self.limit // 2)) + 1
        self.hot_tags = np.sort(np.r_[self.hot_tags, tags[order[:most]]])
        self.all_hot = len(self.hot_tags) > self.limit  # so many that the list itself would grow
        held, self.held, self.n = self.held, [], 0
        for slice_id, hot, tag, run, ids in held:
            now, cold = hot.copy(), np.flatnonzero(~hot)
            more = self.is_hot(tag)
            now[cold[more]] = True
            if now.all():
                self.say(slice_id, np.zeros(len(now), bool), now, now)
            else:
                self.held.append((slice_id, now, tag[~more], run[~more], ids[~more]))
                self.n += int((~more).sum())

    def finish(self) -> None:
        if self.held:
            said = compare_entries(*(np.concatenate([h[k] for h in self.held]) for k in (2, 3, 4)))
            at = 0
            for slice_id, hot, tag, _, _ in self.held:
                dup, send, many = np.zeros(len(hot), bool), hot.copy(), hot.copy()
                for full, part in zip((dup, send, many), said):
                    full[~hot] = part[at : at + len(tag)]
                self.say(slice_id, dup, send, many)
                at += len(tag)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        schema = arrow_schema(_REPLY)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def shard_replies(batches, limit: int = 0):
    """Replies to rows (shard, slice_id, blob) sorted by shard."""
    out = ShardReplies(limit or SHARD_ENTRIES)
    for batch in batches:
        for shard, slice_id, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "slice_id", "blob"))):
            if shard != out.shard:
                out.finish()
                out.start(shard)
            out.add(slice_id, blob)
            if len(out.rows) >= 1000:
                yield out.taken()
    out.finish()
    yield out.taken()


def fetched_of(s: Slice, slice_id: int, replies: list, shards: int) -> pa.RecordBatch:
    """The runs of a slice that were asked for; those of hot grams as single windows."""
    _, send, hot = s.answers(replies)
    entry = np.flatnonzero(send & ~hot)
    n_cold = len(entry)
    start, stop, base = s.runs["start"][s.head[entry]], s.runs["stop"][s.head[entry]] + LENGTH, np.zeros(len(entry), np.int64)
    group = s.runs["gram_hash"][s.head[entry]]
    if (send & hot).any():
        parted = np.flatnonzero(send & hot)
        first = s.runs["start"][s.head[parted]]
        n = s.runs["stop"][s.head[parted]] - first + 1
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = np.repeat(first, n) + at
        entry, start, stop, base = np.r_[entry, np.repeat(parted, n)], np.r_[start, begin], np.r_[stop, begin + LENGTH], np.r_[base, at]
        group = np.r_[group, np.zeros(len(begin), np.uint64)]  # they meet by their bytes
    e = s.head[entry]
    cols = [
        (group % np.uint64(shards)).astype(np.int32), group.view(np.int64), s.key[e], np.full(len(e), slice_id, np.int64), entry.astype(np.int32), base.astype(np.int32),
        (s.runs["gram"][e] - start).astype(np.int32), np.arange(len(e)) >= n_cold, [s.data[x:y].tobytes() for x, y in zip(start.tolist(), stop.tolist())],
    ]
    schema = arrow_schema(_FETCH)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _shard_marks(table: pa.Table) -> pa.Table:
    schema = arrow_schema(_MARKS)
    table = table.sort_by([("gram", "ascending"), ("id", "ascending"), ("slice_id", "ascending"), ("entry", "ascending"), ("base", "ascending")])
    gram, ids, gram_at, base = (table.column(c).to_numpy() for c in ("gram", "id", "gram_at", "base"))
    bodies = table.column("body").to_pylist()
    low, high = trimmed(gram, bodies, gram_at.astype(np.int64))
    usable = np.flatnonzero(high - low >= LENGTH)
    marks: dict[int, list[int]] = {}
    at = 0
    while at < len(usable):
        end, symbols = at, 0
        while end < len(usable) and (symbols < BATCH_SYMBOLS or gram[usable[end]] == gram[usable[end - 1]]):  # whole grams
            symbols += int(high[usable[end]] - low[usable[end]]) + 1
            end += 1
        part = usable[at:end]
        for body, offset in repeated_windows([bodies[i][low[i] : high[i]] for i in part.tolist()], ids[part]):
            i = int(part[body])
            marks.setdefault(i, []).append(int(base[i]) + int(low[i]) + offset)
        at = end
    rows = sorted(marks)
    take = table.take(pa.array(rows, pa.int64()))
    return pa.Table.from_arrays([take.column("slice_id"), take.column("entry"), pa.array([sorted(marks[i]) for i in rows], schema.field("first").type)], schema=schema)


def window_marks(hot: DataFrame) -> DataFrame:
    """Marks of single windows: rows (id, slice_id, entry, base, body) whose body also has a
    smaller id."""
    low = hot.groupBy("body").agg(F.min("id").alias("low"))
    late = hot.join(low, "body").where("id > low")
    return late.groupBy("slice_id", "entry").agg(F.sort_array(F.collect_list(F.col("base").cast("long"))).alias("first"))  # windows of one run


def dedup(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (flat starts and ends) [,
    kept: the bytes that are left] of every document."""
    source = materialize(sliced(docs, text, SLICE), "slices")
    total = source.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = total // SHARD_BYTES + 1
    parts = min(shards, PARTITIONS)

    def opened(b, i: int) -> Slice:
        return Slice(b.column("doc_ids")[i].as_py(), b.column("lens")[i].as_py(), b.column("data")[i].as_py(), shards)

    def deal(batches):
        for b in batches:
            for i in range(b.num_rows):
                slice_id = b.column("slice_id")[i].as_py()
                for shard, blob in opened(b, i).deal():
                    yield pa.RecordBatch.from_pydict({"shard": [shard], "slice_id": [slice_id], "blob": [blob]}, schema=arrow_schema(_DEALT))

    dealt = source.mapInArrow(deal, _DEALT).repartitionById(parts, "shard").sortWithinPartitions("shard")
    limit = SHARD_ENTRIES

    def fetch(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield fetched_of(opened(b, i), b.column("slice_id")[i].as_py(), b.column("replies")[i].as_py(), 4 * shards)

    with temporary() as keep:
        replies = materialize(dealt.mapInArrow(lambda batches: shard_replies(batches, limit), _REPLY), "shard-replies")
        any_hot = replies.agg(F.sum("n_hot")).first()[0]
        by_slice = replies.groupBy("slice_id").agg(F.collect_list(F.struct("shard", "dup", "send", "hot")).alias("replies"))
        # hashed, as sorting would hold whole partitions of slices
        asked = keep(materialize(by_slice, "slice-replies")).hint("shuffle_hash")
        fetched = source.join(asked, "slice_id").mapInArrow(fetch, _FETCH)
        if any_hot:  # read twice
            fetched = materialize(fetched, "fetched-runs")
        marks = fetched.where("NOT hot").groupBy("shard").applyInArrow(_shard_marks, _MARKS)
        if any_hot:
            marks = marks.union(window_marks(fetched.where("hot").select("id", "slice_id", "entry", "base", "body")))
        marks = keep(materialize(marks, "window-marks"))
    noted = marks.groupBy("slice_id").agg(F.collect_list(F.struct("entry", "first")).alias("marks")).hint("shuffle_hash")
    schema = "doc_id long,n_bytes long,n_removed long,n_spans long,kept_sha256 string,removed array<long>" + ",kept binary" * keep_text
    arrow = arrow_schema(schema)

    def cut(batches):
        for b in batches:
            for i in range(b.num_rows):
                s = opened(b, i)
                dup, _, _ = s.answers(b.column("replies")[i].as_py())
                edge = np.zeros(len(s.data) + 1, np.int32)
                gone = dup[s.entry] | (s.key > s.key[s.head][s.entry]) if len(s.entry) else np.zeros(0, bool)
                np.add.at(edge, s.runs["start"][gone], 1)
                np.add.at(edge, s.runs["stop"][gone] + LENGTH, -1)
                ends = np.r_[s.head[1:], len(s.entry)]
                for mark in b.column("marks")[i].as_py() or []:  # of the entry's document, wherever it has the run
                    for r in range(s.head[mark["entry"]], ends[mark["entry"]]):
                        if not gone[r]:
                            at = s.runs["start"][r] + np.array(mark["first"], np.int64)
                            edge[at] += 1
                            edge[at + LENGTH] -= 1
                covered = np.cumsum(edge[:-1]) > 0
                out, at = [], 0
                for doc, size in zip(s.doc_ids, s.lens.tolist()):
                    own, data = covered[at : at + size], s.data[at : at + size]
                    removed = np.flatnonzero(np.diff(np.r_[0, own.astype(np.int8), 0]))
                    kept = (data[~own] if len(removed) else data).tobytes()
                    row = (doc, size, size - len(kept), len(removed) // 2, hashlib.sha256(kept).hexdigest(), removed.tolist())
                    out.append((*row, kept) if keep_text else row)
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

    return source.join(asked, "slice_id", "left").join(noted, "slice_id", "left").select("doc_ids", "lens", "data", "replies", "marks").mapInArrow(cut, schema)
