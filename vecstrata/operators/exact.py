"""Exact nearest neighbours: one query, many queries, merging, and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distance import distance, many_to_many, metric_of, one_to_many, vector_literal
from ..scratch import materialize, temporary
from ..types import DEFAULT_TOP_K, Metric

#: Bytes of query vectors sent to the executors at once; more queries make more passes.
QUERY_BLOCK_BYTES = 16 << 20
#: Rows that meet queries at once, and (query, row) cells of such a tile; neighbours that a
#: task holds before it hands them on.
TILE_ROWS, TILE_CELLS, HELD = 1024, 1 << 18, 1 << 21
#: So many queries make a document dear enough to be dealt out evenly over all cores.
MANY_QUERIES = 256
#: Components that the form in expressions writes out one by one; the sum stays small enough for Java to compile.
UNROLLED = 96


def knn(docs: DataFrame, query, k: int = DEFAULT_TOP_K, metric: str = "euclidean_squared", vector: str = "vector") -> DataFrame:
    """``docs`` with ``dist``, the k nearest to one vector by (dist, id); rows without a
    vector, or of another length, are never scored.  One TakeOrderedAndProject."""
    near = docs.where(F.col(vector).isNotNull() & (F.size(vector) == len(query)))
    return near.withColumn("dist", distance(metric, F.col(vector), vector_literal(query))).orderBy("dist", "id").limit(max(k, 0))


def rank_by_query(scored: DataFrame, k: int) -> DataFrame:
    """The k rows of each qid by (dist, id), with ``rank`` from 1; Spark keeps k rows of a
    qid in each task before the shuffle."""
    w = Window.partitionBy("qid").orderBy("dist", "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 0))


def knn_batch_sql(docs: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """The batch form in expressions alone: each (qid, vector) row of ``queries``, broadcast in
    blocks, against every document.

    The k-th neighbour among some of the documents bounds every query's k-th among all: pairs
    beyond it are dropped where they are made, so few are sorted.  Up to UNROLLED components
    are columns and a distance is one sum that Spark compiles; the session that runs it is one
    apart, with room for so many columns."""
    metric, spark, out = metric_of(metric), docs.sparkSession, None
    doubles = F.transform("vector", lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))).alias("vector")
    with temporary() as keep:
        rows = materialize(docs.where("vector IS NOT NULL").select("id", doubles), "documents")
        asked = materialize(queries.where("vector IS NOT NULL").select("qid", doubles), "queries")
        sizes = dict(tuple(r) for r in rows.groupBy(F.size("vector")).count().collect())
        rows, asked = (_apart(spark).read.schema(df.schema).parquet(df._scratch_path) for df in (rows, asked))
        for dims, n in sorted(tuple(r) for r in asked.groupBy(F.size("vector")).count().collect()) if k > 0 else ():
            near = rows.where(F.size("vector") == dims)
            share = int((sizes.get(dims, 0) / (9 * k)) ** 0.5)
            for b in range(blocks := n * max(dims, 1) * 8 // QUERY_BLOCK_BYTES + 1):
                own = asked.where((F.size("vector") == dims) & (F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b))
                if share > 1:
                    some = rank_by_query(_pairs(near.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0), own, dims, metric), k)
                    bound = materialize(some.where(F.col("rank") == k).select("qid", F.col("dist").alias("most"), F.col("id").alias("last")), "bounds")
                    own = own.join(bound, "qid", "left")
                part = _pairs(near, own, dims, metric)
                out = part if out is None else out.unionByName(part)
        if out is None:
            return spark.createDataFrame([], "qid long, id long, dist double, rank int")
        made = materialize(rank_by_query(out, k), "neighbours")
        return keep(spark.read.schema(made.schema).parquet(keep(made)._scratch_path))


def _apart(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one, which may compile operators of many columns."""
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            other.conf.set(key, value)
    other.conf.set("spark.sql.codegen.maxFields", str(4 * UNROLLED))
    other.conf.set("spark.sql.subexpressionElimination.enabled", "false")  # it would keep every difference in a field of its own
    return other


def _pairs(docs: DataFrame, asked: DataFrame, dims: int, metric: str) -> DataFrame:
    """(qid, id, dist) of every document and query, up to the query's bound (most, last), if it has one."""
    flat = 0 < dims <= UNROLLED
    root = lambda a: F.sqrt(-distance(Metric.DOT, a, a))
    columns = lambda name: [F.get("vector", F.lit(i)).alias(f"{name}{i}") for i in range(dims)] if flat else [F.col("vector").alias(name)]
    filled = lambda df: df.select(*(F.coalesce(c, F.lit(float("nan"))).alias(c) if flat and c[1:].isdigit() else c for c in df.columns))
    norm = lambda name: [root(F.col("vector")).alias(f"{name}_norm")] if flat and metric == Metric.COSINE else []
    bounds = [c for c in ("most", "last") if c in asked.columns]
    a = filled(docs.select("id", *columns("a"), *norm("a"))).repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
    b = filled(asked.select("qid", *columns("b"), *norm("b"), *bounds))
    if bounds:
        b = b.withColumn("most", F.coalesce("most", F.lit(float("nan")))).withColumn("last", F.coalesce("last", F.lit((1 << 63) - 1)))
    if flat:
        total = F.lit(0.0)
        for i in range(dims):
            x, y = F.col(f"a{i}"), F.col(f"b{i}")
            total = total + ((x - y) * (x - y) if metric == Metric.L2 else x * y)
        norms = F.col("a_norm") * F.col("b_norm") if norm("a") else None
        dist = total if metric == Metric.L2 else -total if norms is None else F.when(norms == 0, F.lit(1.0)).otherwise(1 - total / norms)
    else:
        dist = distance(metric, F.col("a"), F.col("b"))
    # the number keeps the distance apart from the condition on it: Spark would write it out in both, too long to be compiled
    scored = a.crossJoin(F.broadcast(b)).select("qid", "id", dist.alias("dist"), *bounds, F.monotonically_increasing_id().alias("n"))
    if bounds:
        scored = scored.where("n >= 0 AND dist <= most AND (dist < most OR id <= last)")
    return scored.select("qid", "id", "dist")


def query_blocks(queries: DataFrame, limit: int = QUERY_BLOCK_BYTES, *, extra: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Collected (qids, matrix) blocks of about ``limit`` bytes, vectors of one length each;
    ``extra``: bytes of a query besides its vector."""
    usable = queries.where("vector IS NOT NULL").select("qid", F.col("vector").cast("array<double>").alias("vector"))
    for dims, n in sorted(tuple(r) for r in usable.groupBy(F.size("vector")).count().collect()):
        blocks = n * (max(dims, 1) * 8 + extra) // limit + 1
        part = usable.where(F.size("vector") == dims)
        for b in range(blocks):
            qids, vectors = collected(part if blocks == 1 else part.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b), dims)
            if len(qids):
                yield qids, vectors


def collected(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The (id, vector of doubles) rows of a frame, as Arrow's buffers: no object a number."""
    table = rows.toArrow()
    ids, vectors = (table.column(i).combine_chunks() for i in (0, 1))
    return ids.to_numpy(zero_copy_only=False).astype(np.int64), matrix(vectors).reshape(len(ids), dims)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(metric: str, query: np.ndarray, approx: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, distances) of the k nearest rows by (dist, id): matrix products choose
    all rows within rounding of the k-th, which are then scored exactly."""
    if len(ids) > k:
        cut = np.partition(approx, k - 1)[k - 1]
        at = np.flatnonzero(~(approx > cut + 1e-9 * (1 + abs(cut) + float(query @ query))))  # NaN stays, and sorts last
    else:
        at = np.arange(len(ids))
    dist = one_to_many(metric, query, rows[at])
    order = np.lexsort((ids[at], dist))[:k]
    return at[order], dist[order]


class Nearest:
    """The k nearest rows so far, by (dist, id), of each of many queries.

    Queries meet rows in tiles of at most TILE_CELLS: matrix products leave what lies within
    rounding of the k-th known, and that is scored exactly, TILE_ROWS pairs at a time.  So
    memory follows neither the queries nor the rows, but for k rows a query.  With
    ``distinct`` an id counts once, at its least distance."""

    def __init__(self, metric: str, vectors: np.ndarray, k: int, distinct: bool = False):
        self.metric, self.vectors, self.k, self.distinct = metric, vectors, k, distinct
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.bound = np.full(len(vectors), np.inf)  # distance of the k-th
        self.full = np.zeros(len(vectors), bool)
        self.at, self.ids, self.dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Rows of at most TILE_ROWS for the queries at these positions (all)."""
        if not len(ids):
            return
        copies = int(np.unique(ids, return_counts=True)[1].max()) if self.distinct else 1
        norm, each = np.sqrt((rows * rows).sum(axis=1)), max(1, TILE_CELLS // len(ids))
        longest = norm[np.isfinite(norm)].max(initial=0.0)
        n, new = len(self.vectors) if queries is None else len(queries), []
        for a in range(0, n, each):
            own = np.arange(a, min(a + each, n)) if queries is None else queries[a : a + each]
            new.append(self._near(own, ids, rows, longest, self.k * copies))
        self._merge(*(np.concatenate(c) for c in zip(*new)))

    def _near(self, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, longest: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, dist) of all rows that may be among the k nearest of their query."""
        approx = many_to_many(self.metric, self.vectors[own], rows)
        slack = lambda cut: cut + 1e-9 * (1 + np.abs(cut) + self.norms[own] ** 2) + 1e-12 * self.norms[own] * longest
        cut = self.bound[own]
        close = ~(approx > slack(cut)[:, None]) if self.full[own].all() else None  # NaN stays, and sorts last
        if len(ids) > most and (close is None or close.sum() > 4 * most * len(own)):
            cut = np.fmin(cut, np.partition(approx, most - 1, axis=1)[:, most - 1])
            close = ~(approx > slack(cut)[:, None])
        q, r = np.nonzero(close if close is not None else np.ones(approx.shape, bool))
        dist = np.empty(len(q))
        for a in range(0, len(q), TILE_ROWS):
            x, y = own[q[a : a + TILE_ROWS]], r[a : a + TILE_ROWS]
            dist[a : a + TILE_ROWS] = one_to_many(self.metric, self.vectors[x], rows[y])
        if len(q) <= 4 * most * len(own):
            return own[q], ids[r], dist
        return self._least(own[q], ids[r], dist)[:3]  # ties by the thousand

    def _least(self, at: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The k least of each query in order, and their ranks from 0."""
        if self.distinct:
            order = np.lexsort((dist, ids, at))
            order = order[np.r_[True, (np.diff(at[order]) != 0) | (np.diff(ids[order]) != 0)]]
            at, ids, dist = at[order], ids[order], dist[order]
        order = np.lexsort((ids, dist, at))
        at, ids, dist = at[order], ids[order], dist[order]
        begin = np.flatnonzero(np.r_[True, np.diff(at) != 0])
        rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
        keep = rank < self.k
        return at[keep], ids[keep], dist[keep], rank[keep]

    def _merge(self, at: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        if not len(at):
            return
        met = np.zeros(len(self.vectors), bool)
        met[at] = True
        stay = ~met[self.at]
        at, ids, dist, rank = self._least(*(np.r_[held[~stay], new] for held, new in ((self.at, at), (self.ids, ids), (self.dist, dist))))
        last = rank == self.k - 1
        self.full[at[last]], self.bound[at[last]] = True, np.fmin(self.bound[at[last]], dist[last])
        self.at, self.ids, self.dist = (np.r_[held[stay], new] for held, new in ((self.at, at), (self.ids, ids), (self.dist, dist)))

    def taken(self, qids: np.ndarray) -> pa.RecordBatch:
        """What is held, which is forgotten but for the bounds; so a task may hand on early."""
        out = pa.RecordBatch.from_arrays([pa.array(qids[self.at]), pa.array(self.ids), pa.array(self.dist)], names=["qid", "id", "dist"])
        self.at, self.ids, self.dist = self.at[:0], self.ids[:0], self.dist[:0]
        return out


def knn_block(docs: DataFrame, qids: np.ndarray, vectors: np.ndarray, k: int, metric: str, distinct: bool = False) -> DataFrame:
    """(qid, id, dist): of each task's documents the k nearest to every query of a block."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((qids, vectors))

    def score(batches):
        qids, vectors = sent.value
        best = Nearest(metric, vectors, k, distinct)
        for batch in batches:
            for a in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(a, TILE_ROWS)
                best.add(part.column("id").to_numpy(), matrix(part.column("vector")))
                if len(best.at) > HELD:
                    yield best.taken(qids)
        yield best.taken(qids)

    near = docs.where(F.size("vector") == vectors.shape[1]).select("id", "vector")
    if len(qids) >= MANY_QUERIES:
        near = near.repartition(2 * spark.sparkContext.defaultParallelism)
    return near.mapInArrow(score, "qid long, id long, dist double")


def knn_batch(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, metric: str = "euclidean_squared") -> DataFrame:
    """(qid, id, dist, rank) of the k nearest documents of every query.

    Each block of queries is broadcast; a task scores its rows in numpy, tile by tile,
    and keeps k of each query, so tasks x queries x k small rows are shuffled, once."""
    metric, out = metric_of(metric), None
    for qids, vectors in query_blocks(queries) if k > 0 else ():
        part = knn_block(docs, qids, vectors, k, metric)
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "qid long, id long, dist double, rank int")
    return rank_by_query(out, k)


def merge_top_k(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Bag union of two (id, dist) lists, the k nearest of it."""
    return a.unionByName(b).orderBy("dist", "id").limit(max(k, 0))


def recall_at_k(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row ``recall``: the mean over queries of the share of true neighbours found."""
    truth = materialize(truth.select("qid", "id"), "truth")  # read twice, made once
    hits = truth.join(found.select("qid", "id").distinct(), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    return truth.select("qid").distinct().join(hits, "qid", "left").agg((F.avg(F.coalesce("hits", F.lit(0))) / k).alias("recall"))
