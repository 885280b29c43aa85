"""The centroid/posting-list index: build, place, split, reassign, search.

The build is level-synchronous: lists above the size bound are divided from a bounded sample
of each, in groups of their own, and every vector of a divided list moves to the nearest of
its parts by an equality join on the list, so no task ever holds a whole list.  Vectors are
then replicated to the nearest heads that pass the diversity rule.

While all heads fit one block of ``HEAD_BLOCK_BYTES`` they are broadcast and every vector
meets all of them.  Beyond, heads are dealt to the ``BEAM`` nearest of a bounded number of
pivots among them and every vector to its nearest pivot, so a task meets the heads around
one pivot only; the vectors of a crowded pivot are salted over several tasks.

A search reads the probed lists alone: the posting files are laid out by ``part``, probes are
found first, vectors are scored where their list is, and only (query, id, version, distance)
rows travel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import distance, many_to_many, metric_of, one_to_many
from ..scratch import discard, materialize
from ..types import IndexConfig, Metric
from .exact import HELD, TILE_CELLS, TILE_ROWS, Nearest, collected, knn_batch, knn_block, matrix, nearest, query_blocks, rank_by_query
from .kmeans import divide

HEAD_BLOCK_BYTES, SAMPLE_ROWS, FAN_OUT = 32 << 20, 2048, 64
#: Pivots that a head is dealt to, pivots at most, vectors of a pivot that one task may take.
BEAM, PIVOTS, SALT_ROWS = 8, 4096, 1 << 20
#: Bytes of queries and probes sent to the executors at once; bytes of a part of the postings.
PROBE_BYTES, PART_BYTES, PARTS = 16 << 20, 64 << 20, 4096


def diverse(query: np.ndarray, heads: np.ndarray, dist: np.ndarray, factor: float, most: int, metric: str) -> list[int]:
    """Positions of the heads chosen greedily, nearest first: one is left out if a chosen
    head is closer to it than ``factor`` times its own distance to the vector."""
    chosen: list[int] = []
    for c in range(len(heads)):
        if len(chosen) == most:
            break
        if not chosen or not (one_to_many(metric, heads[c], heads[chosen]) < factor * dist[c]).any():
            chosen.append(c)
    return chosen


_PLACED = "vector_id long, version long, vector array<float>, heads array<long>"


def chosen_heads(batch, ids: np.ndarray, centers: np.ndarray, config: IndexConfig) -> pa.RecordBatch:
    """The batch's vectors with the heads, among (ids, centers), that each is placed in: of
    the 2 x replicas nearest those that pass the diversity rule."""
    metric, want = metric_of(config.metric), 2 * config.replica_count
    vectors, lists = matrix(batch.column("vector")), []
    each = max(1, TILE_CELLS // max(1, len(centers)))
    for a in range(0, len(vectors), each):
        approx = many_to_many(metric, vectors[a : a + each], centers)
        for v, row in zip(vectors[a : a + each], approx):
            at, dist = nearest(metric, v, row, ids, centers, want)
            lists.append(ids[at[diverse(v, centers[at], dist, config.rng_factor, config.replica_count, metric)]])
    carried = [batch.column(c) for c in ("vector_id", "version", "vector")]
    return pa.RecordBatch.from_arrays([*carried, pa.array(lists, pa.list_(pa.int64()))], names=["vector_id", "version", "vector", "heads"])


def place(rows: DataFrame, heads: DataFrame, config: IndexConfig, block_bytes: int = HEAD_BLOCK_BYTES) -> DataFrame:
    """(head_id, vector_id, version, vector) of (vector_id, version, vector) rows: of the
    2 x replicas nearest heads those that pass the diversity rule."""
    active = heads.where("active").select("head_id", F.col("centroid").cast("array<double>").alias("centroid"))
    n, dims = active.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    rows = rows.select("vector_id", "version", "vector")
    if not n:
        out = rows.withColumn("heads", F.array().cast("array<long>")).limit(0)
    elif n * dims * 8 <= block_bytes:
        sent = rows.sparkSession.sparkContext.broadcast(collected(active.orderBy("head_id"), dims))
        out = rows.mapInArrow(lambda batches: (chosen_heads(b, *sent.value, config) for b in batches if b.num_rows), _PLACED)
    else:
        out = routed(rows, active, config, int(min(PIVOTS, max(2, n**0.5), max(2, block_bytes // (8 * dims)))))
    return out.select(F.explode("heads").alias("head_id"), "vector_id", "version", "vector")


def routed(rows: DataFrame, active: DataFrame, config: IndexConfig, n_pivots: int) -> DataFrame:
    """``place`` for more heads than one broadcast: vectors meet the heads around a pivot."""
    spark, metric = rows.sparkSession, metric_of(config.metric)
    picked = active.orderBy(F.xxhash64("head_id"), "head_id").limit(n_pivots).collect()
    pivots = spark.sparkContext.broadcast(np.array([r.centroid for r in picked], np.float64))

    def near_pivots(vectors: np.ndarray, most: int) -> np.ndarray:
        """(rows, most): the nearest pivots."""
        most = min(most, len(pivots.value))
        parts = (many_to_many(metric, vectors[a : a + 1024], pivots.value) for a in range(0, len(vectors), 1024))
        at = [np.argpartition(d, most - 1, axis=1)[:, :most] for d in parts]
        return np.concatenate(at) if at else np.zeros((0, most), np.int64)

    def deal_heads(batches):
        for b in batches:
            if b.num_rows:
                groups = pa.array(list(near_pivots(matrix(b.column("centroid")), BEAM)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("head_id"), b.column("centroid"), groups], names=["head_id", "centroid", "groups"])

    def deal_vectors(batches):
        for b in batches:
            if b.num_rows:
                nearest_pivot = pa.array(near_pivots(matrix(b.column("vector")), 1)[:, 0])
                yield pa.RecordBatch.from_arrays([nearest_pivot, *b.columns], names=["pivot", *b.schema.names])

    dealt = materialize(rows.mapInArrow(deal_vectors, "pivot long, vector_id long, version long, vector array<float>"), "dealt-vectors")
    salts = dealt.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).alias("salts"))  # PIVOTS rows at most
    own = dealt.join(F.broadcast(salts), "pivot").withColumn("salt", F.pmod(F.xxhash64("vector_id"), F.col("salts")))
    around = active.mapInArrow(deal_heads, "head_id long, centroid array<double>, groups array<long>").withColumn("pivot", F.explode("groups"))
    around = around.join(F.broadcast(salts), "pivot").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    of_vectors = own.select("pivot", "salt", F.lit(1).alias("kind"), "vector_id", "version", "vector", none("array<double>").alias("centroid"))
    of_heads = around.select(
        "pivot", "salt", F.lit(0).alias("kind"), F.col("head_id").alias("vector_id"),
        none("long").alias("version"), none("array<float>").alias("vector"), "centroid",
    )
    mixed = of_vectors.unionByName(of_heads)

    def meet(batches):
        group, ids, centers, ready = None, [], [], None
        for batch in batches:
            keys = list(zip(batch.column("pivot").to_pylist(), batch.column("salt").to_pylist(), batch.column("kind").to_pylist()))
            cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                if keys[a][:2] != group:
                    group, ids, centers, ready = keys[a][:2], [], [], None
                part = batch.slice(a, b - a)
                if keys[a][2] == 0:  # heads come first
                    ids.append(part.column("vector_id").to_numpy())
                    centers.append(matrix(part.column("centroid")))
                    continue
                if ready is None:
                    flat = np.concatenate(ids)
                    order = np.argsort(flat)
                    ready = flat[order], np.concatenate(centers)[order]
                yield chosen_heads(part, *ready, config)

    return mixed.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "kind").mapInArrow(meet, _PLACED)


def split_plan(lists: DataFrame, config: IndexConfig, first_id: int) -> tuple[DataFrame, int]:
    """From rows (head_id, vector): for every list above the bound (old_id, new_id, centroid)
    of its parts, and the number of lists divided."""
    sizes = lists.groupBy("head_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > config.max_posting_size)
    sizes = materialize(sizes, "oversized")
    todo = sizes.count()
    span = 1 << 30
    key = F.pmod(F.hash("vector", "head_id"), F.lit(span))
    picked = lists.join(sizes, "head_id").where(key < F.lit(span) * F.least(F.lit(1.0), F.lit(SAMPLE_ROWS) / F.col("n")))
    sample = picked.select("head_id", "n", F.col("vector").cast("array<double>").alias("vector"))
    cosine, bound = config.metric == Metric.COSINE, config.max_posting_size

    def parts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.array(pdf["vector"].tolist(), np.float64)
        if cosine:  # by direction: two-means itself is Euclidean
            rows = rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), 1e-30)
        rows = rows[np.lexsort(rows.T[::-1])]
        want = int(min(FAN_OUT, max(2, -(-int(pdf["n"].iloc[0]) * 2 // bound))))
        return pd.DataFrame({"old_id": int(key[0]), "part": range(len(c := divide(rows, want))), "centroid": [x.tolist() for x in c]})

    made = sample.groupBy("head_id").applyInPandas(parts, "old_id long, part int, centroid array<double>")
    made = materialize(made.withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy("old_id"))).where("__k > 1").drop("__k"), "parts")
    return made.select("old_id", (F.lit(first_id) + F.monotonically_increasing_id()).alias("new_id"), "centroid"), todo


def build_heads(vectors: DataFrame, config: IndexConfig) -> DataFrame:
    """Heads over (vector_id, vector): from one head down, level by level, until no list is
    above the bound or the depth limit is reached."""
    rows = materialize(vectors.select("vector_id", "vector", F.lit(0).cast("long").alias("head_id")), "level")
    leaves, next_id = None, 1
    for _ in range(config.max_split_depth):
        plan, todo = split_plan(rows, config, next_id)
        if not todo:
            break
        plan = materialize(plan, "split")
        top = plan.agg(F.max("new_id")).first()[0]
        if top is None:
            break
        next_id = top + 1
        listed = plan.groupBy("old_id").agg(F.collect_list(F.struct("new_id", "centroid")).alias("parts")).withColumnRenamed("old_id", "head_id")
        nearest_part = _nearest_part("euclidean_squared" if config.metric != Metric.COSINE else config.metric).alias("head_id")
        moved = materialize(rows.join(listed, "head_id", "left").select("vector_id", "vector", nearest_part), "level")
        gone = plan.select(F.col("old_id").alias("head_id")).distinct()
        fresh = plan.select(F.col("new_id").alias("head_id"), "centroid")
        leaves = materialize(fresh if leaves is None else leaves.join(gone, "head_id", "left_anti").unionByName(fresh), "heads")
        discard(rows)
        rows = moved
    if leaves is None:
        first = rows.orderBy("vector_id").limit(1)
        leaves = first.select("head_id", F.col("vector").cast("array<double>").alias("centroid"))
    return leaves.withColumn("active", F.lit(True))


def _nearest_part(metric: str):
    """The new head nearest to ``vector`` among ``parts`` (null: the old one)."""
    scored = F.transform("parts", lambda p: F.struct(distance(metric, F.col("vector"), p["centroid"]).alias("d"), p["new_id"].alias("h")))
    return F.coalesce(F.array_min(scored)["h"], F.col("head_id"))


def head_search(queries: DataFrame, heads: DataFrame, n: int, metric: str) -> DataFrame:
    """(qid, head_id): the n nearest active heads of every (qid, vector) query."""
    active = heads.where("active").select(F.col("head_id").alias("id"), F.col("centroid").alias("vector"))
    return knn_batch(active, queries, n, metric).select("qid", F.col("id").alias("head_id"))


def live(postings: DataFrame, versions: DataFrame) -> DataFrame:
    """Entries at their vector's current version that are not deleted."""
    return postings.join(versions.where("NOT deleted").select("vector_id", "version"), ["vector_id", "version"])


def part_count(postings: DataFrame) -> int:
    """Parts that the posting files are laid out by, of about PART_BYTES each."""
    n, dims = postings.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    return int(min(PARTS, n * 4 * (dims or 0) // PART_BYTES + 1))


def ann_candidates(
    queries: DataFrame, heads: DataFrame, postings: DataFrame, versions: DataFrame, config: IndexConfig, metric: str | None = None, parts: int | None = None,
    k: int | None = None, without: DataFrame | None = None, allowed: DataFrame | None = None,
) -> DataFrame:
    """(qid, id, dist): every live vector in a probed list once, at its least distance; with
    ``k`` at least the k nearest of every query.  Ids of ``without`` and ids that ``allowed``
    lacks are no candidates.  Lists are chosen by the index's metric, distances may use another.

    For each block of queries the probes are found and broadcast beside them; entries that are
    dead are left out, and a task scores those of its probed lists and keeps k of each query,
    so tasks x queries x k small rows travel.  If there are no more heads than probes, every
    list is read and nothing is sent but the queries.  With ``parts``, postings have a
    partition column ``part`` (head_id modulo parts), and only the files of probed parts are
    listed and read."""
    spark, metric, out = queries.sparkSession, metric_of(metric or config.metric), None
    active = heads.where("active").select("head_id", "centroid")
    probes, every, held = config.num_search_heads, active.count() <= config.num_search_heads, {}
    alive = versions.where("NOT deleted").select("vector_id", "version")
    if without is not None:
        alive = alive.join(without.select(F.col("id").alias("vector_id")), "vector_id", "left_anti")
    if allowed is not None:
        alive = alive.join(allowed.select(F.col("id").alias("vector_id")), "vector_id", "left_semi")
    for qids, vectors in query_blocks(queries, PROBE_BYTES, extra=0 if every else 16 * probes) if k != 0 else ():
        near, right = postings.where(F.size("vector") == vectors.shape[1]), active.where(F.size("centroid") == vectors.shape[1])
        if every:
            near, which = near.join(right.select("head_id"), "head_id", "left_semi"), None
        else:
            asked = right.select(F.col("head_id").alias("id"), F.col("centroid").alias("vector"))
            found = rank_by_query(knn_block(asked, np.arange(len(qids)), vectors, probes, metric_of(config.metric)), probes).select("qid", "id").toArrow()
            query, head = (found.column(c).to_numpy() for c in ("qid", "id"))
            if not len(head):
                continue
            order = np.lexsort((query, head))
            head, query = head[order], query[order]
            lists, which = np.unique(head), None
            if parts is not None:
                which = tuple(sorted({int(h) % parts for h in lists}))
                near = near.where(F.col("part").isin(list(which)))
        if (key := (vectors.shape[1], which)) not in held:  # keys alone meet the versions; few are dead, so no vector travels
            held[key] = materialize(near.select("vector_id", "version").join(alive, ["vector_id", "version"], "left_anti").distinct(), "dead")
        near = near.join(held[key], ["vector_id", "version"], "left_anti")
        if every and k is not None:
            part = knn_block(near.select(F.col("vector_id").alias("id"), "vector"), qids, vectors, k, metric, distinct=True)
        else:
            if every:
                lists, query = np.sort(right.select("head_id").toArrow().column(0).to_numpy()), np.arange(len(qids))
                begin, end = np.zeros(len(lists), np.int64), np.full(len(lists), len(qids))
            else:
                begin, end = np.searchsorted(head, lists), np.searchsorted(head, lists, "right")
            part = _probed(near, qids, vectors, (lists, begin, end, query), metric, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "qid long, id long, dist double")
    return out.groupBy("qid", "id").agg(F.min("dist").alias("dist"))


def _probed(postings: DataFrame, qids: np.ndarray, vectors: np.ndarray, probes: tuple[np.ndarray, ...], metric: str, k: int | None) -> DataFrame:
    """(qid, id, dist) of a block's probed entries: all, or k of each query and task.  ``probes``:
    the lists in order, where the queries of each begin and end, and their positions."""
    sent = postings.sparkSession.sparkContext.broadcast((qids, vectors, *probes))
    names = ["qid", "id", "dist"]

    def segments(batches):
        """(ids, rows, queries) of at most TILE_ROWS entries of a list."""
        _, _, lists, begin, end, query = sent.value
        for b in batches:
            head = b.column("head_id").to_numpy()
            at = np.minimum(np.searchsorted(lists, head), max(len(lists) - 1, 0))
            usable = np.flatnonzero(lists[at] == head) if len(lists) else np.zeros(0, np.int64)
            usable = usable[np.argsort(at[usable], kind="stable")]
            of, part = at[usable], b.take(pa.array(usable))
            cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else ()
            for x, y in zip(cut, cut[1:]):
                for a in range(x, y, TILE_ROWS):
                    rows = part.slice(a, min(TILE_ROWS, y - a))
                    yield rows.column("vector_id").to_numpy(), matrix(rows.column("vector")), query[begin[of[x]] : end[of[x]]]

    def score_all(batches):
        qids, vectors = sent.value[:2]
        made, n = [], 0
        for ids, rows, query in segments(batches):
            for q in query:  # the kernel of the exact path, so that equal vectors tie
                made.append((np.full(len(ids), qids[q]), ids, one_to_many(metric, vectors[q], rows)))
                n += len(ids)
                if n > TILE_CELLS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names=names)
                    made, n = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names=names)

    def score(batches):
        qids, vectors = sent.value[:2]
        best = Nearest(metric, vectors, k, distinct=True)
        for ids, rows, query in segments(batches):
            best.add(ids, rows, query)
            if len(best.at) > HELD:
                yield best.taken(qids)
        yield best.taken(qids)

    return postings.select("head_id", "vector_id", "vector").mapInArrow(score_all if k is None else score, "qid long, id long, dist double")


def ann_search(
    queries: DataFrame, heads: DataFrame, postings: DataFrame, versions: DataFrame, config: IndexConfig, k: int, metric: str | None = None
) -> DataFrame:
    return rank_by_query(ann_candidates(queries, heads, postings, versions, config, metric, k=max(k, 0)), k)


def reassign_candidates(entries: DataFrame, splits: DataFrame, metric: str) -> DataFrame:
    """vector_ids of (head_id, vector_id, vector, old_id) entries that are at least as close
    to one of the new centroids of ``splits`` (old_id, old_centroid, new_centroids) as to the old."""
    v = F.col("vector")
    closer = F.exists("new_centroids", lambda c: distance(metric, v, c) <= distance(metric, v, F.col("old_centroid")))
    return entries.join(splits, "old_id").where(closer).select("vector_id").distinct()


def split_oversized(heads: DataFrame, postings: DataFrame, versions: DataFrame, config: IndexConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round for every oversized list: drop stale entries, divide what is still too
    large, and move the vectors around it that a new centroid suits (with a new version)."""
    clean = materialize(live(postings, versions), "live")
    first = (heads.agg(F.max("head_id")).first()[0] or 0) + 1
    plan, todo = split_plan(clean, config, first)
    if not todo:
        return heads, clean, versions
    plan = materialize(plan, "split")
    old = heads.select(F.col("head_id").alias("old_id"), F.col("centroid").alias("old_centroid"))
    splits = materialize(plan.groupBy("old_id").agg(F.collect_list(F.struct("new_id", "centroid")).alias("parts")).join(old, "old_id"), "splits")
    listed = splits.select(F.col("old_id").alias("head_id"), "parts")
    metric = "euclidean_squared" if config.metric != Metric.COSINE else config.metric
    moved = clean.join(listed, "head_id", "left").select(_nearest_part(metric).alias("head_id"), "vector_id", "version", "vector").distinct()
    gone = splits.select(F.col("old_id").alias("head_id"))
    still = (F.col("active") & F.col("gone").isNull()).alias("active")
    marked = heads.join(gone.withColumn("gone", F.lit(True)), "head_id", "left").select("head_id", "centroid", still)
    heads = materialize(marked.unionByName(plan.select(F.col("new_id").alias("head_id"), "centroid", F.lit(True).alias("active"))), "heads")
    centers = splits.select(F.col("old_id").alias("qid"), F.col("old_centroid").alias("vector"))
    others = heads.join(plan.select(F.col("new_id").alias("head_id")), "head_id", "left_anti")
    around = head_search(centers, others, config.reassign_range, config.metric)
    moved = materialize(moved, "moved")
    entries = moved.join(around.withColumnRenamed("qid", "old_id"), "head_id")
    changed = splits.select("old_id", "old_centroid", F.transform("parts", lambda p: p["centroid"]).alias("new_centroids"))
    again = materialize(reassign_candidates(entries, changed, config.metric), "reassigned")
    raised = (F.col("version") + F.coalesce("up", F.lit(0))).alias("version")
    versions = materialize(versions.join(again.withColumn("up", F.lit(1)), "vector_id", "left").select("vector_id", raised, "deleted"), "versions")
    rows = moved.join(again, "vector_id").groupBy("vector_id").agg((F.max("version") + 1).alias("version"), F.first("vector").alias("vector"))
    postings = moved.join(again, "vector_id", "left_anti").select("head_id", "vector_id", "version", "vector").unionByName(place(rows, heads, config))
    return heads, materialize(postings, "postings"), versions


def invariants(heads: DataFrame, postings: DataFrame, versions: DataFrame, config: IndexConfig) -> dict[str, int]:
    """Violations of: every live vector has a current entry, no entry is newer than its
    vector, every entry's head is active, no live list is above the bound."""
    alive = versions.where("NOT deleted")
    now = live(postings, versions)
    return {
        "uncovered": alive.join(now.select("vector_id").distinct(), "vector_id", "left_anti").count(),
        "future": postings.join(versions.select("vector_id", F.col("version").alias("v")), "vector_id").where("version > v").count(),
        "headless": postings.join(heads.where("active").select("head_id"), "head_id", "left_anti").count(),
        "oversized": now.groupBy("head_id").count().where(F.col("count") > config.max_posting_size).count(),
    }
