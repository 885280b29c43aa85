"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 64 bits (or a multiple) set by majority over the hashes of word
shingles.  Equal fingerprints (or equal sets of shingles) are first brought together by a
grouped minimum, so a group of exact copies is one node whatever its size.

The Hamming distances of every node's fingerprint to ``PIVOTS`` fixed reference
fingerprints are computed once and written beside it: the pivot distance table.  By the
triangle inequality two fingerprints can only be within ``max_bits`` if no coordinate of the
table differs by more.  Nodes that share a bucket meet; every pair's coordinates are
compared first, and only pairs that pass are verified bit by bit, at every bucket size
alike.  A bucket is walked breadth first over its rows not yet reached, so a group of
thousands of near copies costs about one sweep, not all pairs, and gives a spanning forest:
no more edges than rows, and no link between groups is lost.  A bucket of more than
``BUCKET`` nodes is dealt to cells, and each two cells meet in a task of their own, in the
same way.

* ``report`` links 64-bit fingerprints.  Buckets are bands: slices of the fingerprint,
  ``max_bits + 1`` of them, so two within ``max_bits`` agree on one whole slice.
* ``keep_one`` decides by the Jaccard similarity of shingle sets.  Buckets are keys of
  ``ROWS`` smallest hashes under ``BANDS`` x ``ROWS`` hash functions (a pair alike by 0.8
  shares none with a chance of (1 - 0.8^3)^24 = 3e-8); pairs that pass table and fingerprint
  form groups, and within a group the sets themselves decide, pair by pair.

Null or empty text: the fingerprint zero and the empty set, linked like any other.  Ties
(equal doc_ids of the smallest) fall to the row read first; a null doc_id comes last.
Repeated rows and repeated doc_ids are rows of their own.  Texts are read whole, however
long.  Further columns, whatever their names, are carried.  An empty table gives an empty
result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import temporary
from .common import Carried, arrow_schema, slices
from .common import written as materialize
from .graph import components

PIVOTS, SEED = 16, 42
#: Nodes that one task may meet in a bucket.
BUCKET = 50_000
#: Near-duplicates by similarity: 64-bit words of the fingerprint, keys of so many smallest
#: hashes, shingles that one task may compare.
WIDE_WORDS, BANDS, ROWS, COMPARE = 4, 24, 3, 1 << 18
_STEP = 0x9E3779B97F4A7C15
_FACTORS = np.random.default_rng(31).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of each n-word shingle, A-Z lower-cased; of the whole sequence if it is shorter."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(line, SEED)], np.uint64)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends]
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[n - 1 :])], np.uint64)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct shingles' hashes in ascending order."""
    return np.unique(shingle_hashes(text, n))


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def widen(h: np.ndarray, words: int) -> np.ndarray:
    """(len(h), words): each hash itself, then further hashes mixed from it."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for k in range(1, words):
        out[:, k] = mixed(h + np.uint64(_STEP * k % (1 << 64)))
    return out


def majority(h: np.ndarray, words: int = 1) -> bytes:
    """Big-endian fingerprint: a bit is 1 if it is set in over half the hashes."""
    if not len(h):
        return bytes(8 * words)
    count = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 1 << 15):
        wide = widen(h[at : at + (1 << 15)], words).astype(">u8")
        count += np.unpackbits(wide.view(np.uint8).reshape(len(wide), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(h)).tobytes()


def fingerprint(text: str | None, shingle: int, words: int = 1) -> bytes:
    """The fingerprint of a text; a shingle weighs as often as it stands there."""
    return majority(shingle_hashes(text, shingle), words)


def with_fingerprint(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp) of rows (doc_id, text); whole texts, one Arrow pass."""

    def run(batches):
        for part in slices(batches):
            made = pa.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), made], names=["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp binary")


# the pivot distance table


def references(words: int, pivots: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: the same at every place and time."""
    return np.random.default_rng(20).integers(0, 1 << 64, (pivots, words), dtype=np.uint64)


def distance_table(fps: np.ndarray) -> np.ndarray:
    """(rows, PIVOTS): the Hamming distances of fingerprints to the reference fingerprints."""
    return np.stack([np.bitwise_count(fps ^ p).sum(axis=1, dtype=np.int16) for p in references(fps.shape[1])], axis=1)


def numbers(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The rows of a binary column, each ``width`` numbers of the kind."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def with_table(nodes: DataFrame, words: int) -> DataFrame:
    """``nodes`` (with fp) and the row of the pivot distance table of each, as ``pivot``."""

    def run(batches):
        for b in batches:
            fps = numbers(b.column("fp"), ">u8", words).astype(np.uint64)
            made = [row.tobytes() for row in distance_table(fps).astype("<i2")] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*b.schema.names, "pivot"])

    return nodes.mapInArrow(run, nodes.withColumn("pivot", nodes["fp"]).schema)


def forest(fps: np.ndarray, max_bits: int, table: np.ndarray) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of the graph that links rows of ``fps`` within
    ``max_bits``; ``table`` has each row's distances to the reference fingerprints."""
    edges, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            near = rest
            for k in range(table.shape[1]):  # discard by one coordinate after another
                near = near[np.abs(table[near, k] - table[u, k]) <= max_bits]
                if not len(near):
                    break
            if not len(near):
                continue
            near = near[np.bitwise_count(fps[near] ^ fps[u]).sum(axis=1, dtype=np.int64) <= max_bits]  # verify
            if len(near):
                edges += [(u, int(v)) for v in near]
                queue += near.tolist()
                rest = rest[~np.isin(rest, near, assume_unique=True)]
    return edges


# buckets


def cell_of(cells: str | Column) -> Column:
    return F.pmod(F.xxhash64("node", "bucket"), cells)


def cell_pairs(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows (bucket, node, ...) of the buckets in ``hot`` (bucket, cells: two or more), dealt
    to cells by a hash of the node; each two cells of a bucket become a bucket of their own,
    so any two rows still meet, and no task holds more than two cells."""
    own = rows.join(hot, "bucket").withColumn("__c", cell_of("cells"))
    each = own.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).where("__o <> __c")
    return each.withColumn("bucket", F.xxhash64("bucket", F.least("__c", "__o"), F.greatest("__c", "__o"))).drop("cells", "__c", "__o")


def met_in_buckets(dealt: DataFrame, words: int, max_bits: int) -> DataFrame:
    """(a, b): a spanning forest, for each bucket of (bucket, node, fp, pivot) rows, of the
    links within ``max_bits``.  Buckets come in sorted streams; one is held at a time."""

    def meet(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def solve(key, node, fps, table):
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            a, b = [], []
            for g in np.flatnonzero(np.diff(cut) > 1):
                s = slice(cut[g], cut[g + 1])
                for i, j in forest(fps[s], max_bits, table[s]):
                    a.append(node[s][i])
                    b.append(node[s][j])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def join():
            return tuple(np.concatenate([h[k] for h in held]) for k in range(4))

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("bucket").to_numpy()
            now = (key, batch.column("node").to_numpy(), numbers(batch.column("fp"), ">u8", words).astype(np.uint64), numbers(batch.column("pivot"), "<i2", PIVOTS).astype(np.int16))
            last = int(np.searchsorted(key, key[-1]))  # where the batch's last, perhaps unfinished, bucket begins
            if last == 0 and held and held[-1][0][-1] == key[0]:
                held.append(now)
                continue
            held.append(tuple(x[:last] for x in now))
            yield solve(*join())
            held = [tuple(x[last:] for x in now)]
        if held:
            yield solve(*join())

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a long, b long")


def met(nodes: DataFrame, placed: DataFrame, words: int, max_bits: int, limit: int) -> DataFrame:
    """(a, b): links within ``max_bits`` between the (node, fp, pivot) rows that share a
    bucket of ``placed`` (bucket, node).  Buckets are counted first, by partial sums, and
    only what shares one is sent on; those above ``limit`` meet by pairs of cells."""
    counts = materialize(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    shared = placed.join(counts.hint("merge"), "bucket").select("bucket", "node", "n").join(nodes.select("node", "fp", "pivot"), "node")
    hot = counts.where(F.col("n") > limit).select("bucket", F.ceil(2 * F.col("n") / limit).alias("cells"))
    dealt = shared.drop("n")
    if not hot.isEmpty():
        dealt = shared.where(F.col("n") <= limit).drop("n").unionByName(cell_pairs(shared.drop("n"), hot))
    return met_in_buckets(dealt, words, max_bits).distinct()


def bands_of(fps: np.ndarray, bands: int) -> np.ndarray:
    """(rows, bands): the bits of each slice of the fingerprint as a number."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)
    cuts = np.linspace(0, bits.shape[1], bands + 1).astype(int)
    return np.stack([bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a, dtype=np.int64)) for a, b in zip(cuts, cuts[1:])], axis=1)


def links(nodes: DataFrame, max_bits: int, limit: int = BUCKET) -> DataFrame:
    """(a, b): edges within ``max_bits`` between (node, fp, pivot) rows of 64 bits whose
    fingerprints differ; ``max_bits + 1`` bands lose none."""
    bands = max_bits + 1

    def deal(batches):
        for b in batches:
            if b.num_rows:
                values = bands_of(numbers(b.column("fp"), ">u8", 1).astype(np.uint64), bands)
                bucket = (values * bands + np.arange(bands)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.repeat(b.column("node").to_numpy(), bands))], names=["bucket", "node"])

    return met(nodes, nodes.select("node", "fp").mapInArrow(deal, "bucket long, node long"), 1, max_bits, limit)


def report(docs: DataFrame, shingle: int = 3, max_bits: int = 2, text: str = "text", limit: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable over links
    of at most ``max_bits`` differing bits of 64."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = materialize(with_fingerprint(slim, shingle).withColumn("uid", F.monotonically_increasing_id()), "document-fingerprints")
    nodes = materialize(with_table(rows.groupBy("fp").agg(F.min("uid").alias("node"), F.min("doc_id").alias("low")), 1), "fingerprints")
    parts = components(links(nodes, max_bits, limit))
    placed = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = placed.join(low, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# near-duplicates by the similarity of sets


def bits_for(similarity: float, words: int, slack: float = 1.25, spread: float = 5.0) -> int:
    """Differing bits that a pair of a Jaccard similarity of shingle sets stays below: the
    share of bits is the angle between the shingle vectors over pi (a quarter more where
    sets are small), and ``spread`` standard deviations are left to chance."""
    bits, cosine = 64 * words, 2 * similarity / (1 + similarity)
    share = slack * np.arccos(cosine) / np.pi
    return int(bits * share + spread * np.sqrt(bits * share * (1 - share)))


def band_keys(h: np.ndarray) -> np.ndarray:
    """BANDS keys of a set, each of its ROWS smallest hashes under hash functions of its own;
    none of an empty set."""
    if not len(h):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 4096):
        low = np.minimum(low, (h[at : at + 4096, None] * _FACTORS).min(axis=0))
    key, low = np.arange(BANDS, dtype=np.uint64), low.reshape(BANDS, ROWS)
    for r in range(ROWS):
        key = mixed(key * np.uint64(_STEP) + low[:, r])
    return key.view(np.int64)


def with_set(rows: DataFrame, shingle: int, text: str) -> DataFrame:
    """``rows`` with ``set`` (a hash of the set of shingles), its size, keys and fingerprint."""
    extra = arrow_schema("set long,size long,keys array<long>,fp binary")
    schema = rows.withColumns({"set": F.lit(0).cast("long"), "size": F.lit(0).cast("long"), "keys": F.array().cast("array<long>"), "fp": F.lit(None).cast("binary")}).schema

    def run(batches):
        for part in slices(batches, text):
            sets = [shingle_set(t, shingle) for t in part.column(text).to_pylist()]
            name = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            made = (name, [len(s) for s in sets], [band_keys(s) for s in sets], [majority(s, WIDE_WORDS) for s in sets])
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, f.type) for v, f in zip(made, extra))], names=[*part.schema.names, *extra.names])

    return rows.mapInArrow(run, schema)


def candidates(nodes: DataFrame, similarity: float, limit: int = BUCKET) -> DataFrame:
    """(a, b): a forest over the sets that share a key and whose fingerprints are within
    ``bits_for``; every pair alike by ``similarity`` is connected in it."""
    return met(nodes, nodes.select(F.explode("keys").alias("bucket"), "node"), WIDE_WORDS, bits_for(similarity, WIDE_WORDS), limit)


def are_alike(both: np.ndarray, a, b, similarity: float) -> np.ndarray:
    """Whether sets of a and b elements that share ``both`` are alike by ``similarity``."""
    return both + 1e-9 >= similarity * (a + b - both)


def set_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of the graph that links the sets (none is empty)
    whose Jaccard similarity is ``similarity`` or more, each pair counted exactly."""
    size = np.array([len(s) for s in sets], np.int64)
    held, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    edges, rest = [], np.arange(len(sets))
    live, begin, rows = flat, start, rest  # the shingles of the sets not yet reached
    while len(rest) > 1:
        queue, todo = [int(rest[0])], rest[1:]
        while queue and len(todo):
            if 2 * len(todo) < len(rows):
                live = np.concatenate([flat[start[k] : start[k] + size[k]] for k in todo])
                begin, rows = np.cumsum(size[todo]) - size[todo], todo
            u = queue.pop()
            mark = np.zeros(len(held), np.int64)
            mark[flat[start[u] : start[u] + size[u]]] = 1
            near = rows[are_alike(np.add.reduceat(mark[live], begin), size[u], size[rows], similarity)]
            near = near[np.isin(near, todo, assume_unique=True)]
            edges += [(u, int(v)) for v in near]
            queue += near.tolist()
            todo = todo[~np.isin(todo, near, assume_unique=True)]
        rest = todo
    return edges


def met_sets(dealt: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links between the texts of each bucket of (bucket, node, text) rows."""

    def meet(batches):
        key, node, sets = None, [], []

        def solve():
            edges = set_forest(sets, similarity) if len(sets) > 1 else []
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([node[e[k]] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for k, u, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "node", "text"))):
                if k != key:
                    yield from solve()
                    key, node, sets = k, [], []
                node.append(u)
                sets.append(shingle_set(text, shingle))
        yield from solve()

    return dealt.select("bucket", "node", "text").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a long, b long")


def led(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(bucket, node, leader, linked) of (bucket, node, text) rows: whether a row is alike to
    the leader of its bucket, the row with the smallest node, or that row itself."""
    low = rows.groupBy("bucket").agg(F.min("node").alias("node"))
    first = rows.join(low, ["bucket", "node"]).select("bucket", F.col("node").alias("leader"), F.col("text").alias("of_leader"))

    def run(batches):
        leader, own = None, None
        for batch in batches:
            linked = []
            for node, text, u, lead in zip(*(batch.column(c).to_pylist() for c in ("node", "text", "leader", "of_leader"))):
                if u != leader:
                    leader, own = u, shingle_set(lead, shingle)
                s = shingle_set(text, shingle)
                linked.append(node == u or bool(are_alike(len(np.intersect1d(s, own, assume_unique=True)), len(s), len(own), similarity)))
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("node"), batch.column("leader"), pa.array(linked, pa.bool_())], names=["bucket", "node", "leader", "linked"])

    return rows.join(first, "bucket").mapInArrow(run, "bucket long, node long, leader long, linked boolean")


def met_by_cells(rows: DataFrame, limit: int, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links between the (bucket, node, size, text) rows of buckets of more than
    ``limit`` shingles.

    All rows of a bucket are compared with its leader first.  Those that it links need not
    meet each other any more; the rest meets itself and them by pairs of cells, so a group
    of n copies of one text costs about n rows, and any other group loses no pair."""
    said = materialize(led(rows, shingle, similarity), "led")
    cells = lambda side: F.ceil(2 * F.coalesce(F.sum(F.when(side, F.col("size"))), F.lit(0)) / limit)
    sides = rows.join(said, ["bucket", "node"])
    dealt = sides.groupBy("bucket").agg(cells(~F.col("linked")).alias("loose"), cells(F.col("linked")).alias("tied")).where("loose > 0")
    own = sides.join(materialize(dealt, "cells"), "bucket").withColumn("c", F.pmod(F.xxhash64("node", "bucket"), F.when(F.col("linked"), F.col("tied")).otherwise(F.col("loose"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    with_tied = lambda loose, tied: F.xxhash64("bucket", F.lit("tied"), loose, tied)
    c = F.col("c")
    of_loose = F.concat(
        F.transform(upto("loose"), lambda o: F.xxhash64("bucket", F.lit("loose"), F.least(c, o), F.greatest(c, o))),
        F.transform(upto("tied"), lambda o: with_tied(c, o)),
    )
    of_tied = F.transform(upto("loose"), lambda o: with_tied(o, c))
    each = own.withColumn("bucket", F.explode(F.when(F.col("linked"), of_tied).otherwise(of_loose)))
    straight = said.where("linked AND node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    return straight.union(met_sets(each, shingle, similarity))


def verified(tagged: DataFrame, nodes: DataFrame, parts: DataFrame, shingle: int, similarity: float, text: str, limit: int = COMPARE) -> DataFrame:
    """(a, b): links between the sets of each of ``parts`` (node, component), decided on the
    shingles themselves."""
    inside = materialize(nodes.join(parts, "node").select("node", "size", F.col("component").alias("bucket"), F.col("first.uid").alias("uid")), "near-sets")
    # hashed at every size: sorting would hold texts, and at scale neither side can be broadcast
    near = tagged.select("uid", F.col(text).alias("text")).join(inside.hint("shuffle_hash"), "uid")
    rows = materialize(near.select("bucket", "node", "size", "text"), "near-texts")
    hot = materialize(rows.groupBy("bucket").agg(F.sum("size").alias("n")).where(F.col("n") > limit).select("bucket"), "hot-parts")
    if hot.isEmpty():
        return met_sets(rows, shingle, similarity).distinct()
    straight = met_sets(rows.join(hot, "bucket", "left_anti"), shingle, similarity)
    return straight.union(met_by_cells(materialize(rows.join(hot, "bucket", "left_semi"), "hot-texts"), limit, shingle, similarity)).distinct()


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", bucket: int = BUCKET, compare: int = COMPARE) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) left of each group of near-duplicates
    whose sets of ``shingle``-word shingles are alike by ``similarity`` or more.  ``bucket``
    and ``compare`` bound what a task holds; they change no result."""
    own = Carried(docs)
    with temporary() as keep:
        tagged = keep(materialize(with_set(own.frame, shingle, own[text]).withColumn("uid", F.monotonically_increasing_id()), "shingled"))
        id = F.col(own["doc_id"]).cast("long")
        first = F.min(F.struct(id.isNull().alias("none"), id.alias("id"), "uid")).alias("first")
        sets = tagged.groupBy(F.col("set").alias("node")).agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"), first)
        nodes = materialize(with_table(sets, WIDE_WORDS), "shingle-sets")
        coarse = components(candidates(nodes, similarity, bucket))
        parts = components(verified(tagged, nodes, coarse, shingle, similarity, own[text], compare))
        placed = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        kept = placed.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.uid").alias("uid"))
        kept = keep(materialize(kept, "kept"))
    return own.back(tagged.join(kept.hint("shuffle_hash"), "uid", "left_semi"))
