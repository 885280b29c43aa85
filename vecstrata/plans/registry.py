"""Every named query of the vector engine, with equivalent SQL where SQL can say it.

All run over the whole ``embeddings`` or ``events`` table.  Distances are in double on both
sides and rounded to six places; ties go to the smaller id.  A search's queries are the rows
whose id is divisible by 20.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import attributes as attr
from ..functions.distance import distance, register_sql, vector_literal
from ..operators import exact, hybrid, index, kmeans, replay
from ..scratch import materialize, scratch_path
from ..sources.synthetic import synthetic_documents
from ..streaming.ingest import ingest
from ..types import ATTRIBUTES, DimensionMismatch, IndexConfig, WriteConflict

DELETES, UPDATES = 1_000_000, 1_000_001
L2, COS, DOT = "euclidean_squared", "cosine_distance", "dot_product"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# inputs


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _one(spark: SparkSession, sf_dir: str, id: int = 0) -> list[float]:
    return _vectors(spark, sf_dir).where(F.col("id") == id).first().vector


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    entry = lambda df, seq, op, vec: df.select(seq.cast("long").alias("sequence"), F.lit(0).alias("op_idx"), F.col("id").alias("doc_idx"), F.lit(op).alias("op"), F.lit(0).cast("long").alias("ts_ms"), "id", vec.alias("vector"))
    base = entry(v, F.floor(F.col("id") / 100) + 1, "upsert", F.col("vector"))
    gone = entry(v.where("id % 17 = 0"), F.lit(DELETES), "delete", F.lit(None).cast("array<float>"))
    after = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("next"))
    new = entry(v.where("id % 11 = 0").join(after, "id"), F.lit(UPDATES), "upsert", F.col("next"))
    return base.unionByName(gone).unionByName(new)


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = kmeans.centroid_mean(_vectors(spark, sf_dir), "label")
    return materialize(means.select(F.col("label").cast("long").alias("head_id"), "centroid", F.lit(True).alias("active")), "label-heads")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, (F.round("dist", 6) + 0.0).alias("dist"))


# pieces of SQL


def _d(metric: str, a: str, b: str) -> str:
    a, b = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1] * p[2]))"
    if metric == L2:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    if metric == DOT:
        return f"-{dot(a, b)}"
    norms = f"(sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
    return f"CASE WHEN {norms} = 0 THEN 1.0 ELSE 1 - {dot(a, b)} / {norms} END"


_V = "v AS (SELECT vec_id AS id, embedding AS vector, label FROM embeddings)"
_Q = "q AS (SELECT id AS qid, vector AS qv FROM v WHERE id % 20 = 0)"
_LAST = f"""{_V}, log AS (
  SELECT id // 100 + 1 AS seq, 0 AS op_idx, id AS doc_idx, 'upsert' AS op, id, vector FROM v
  UNION ALL SELECT {DELETES}, 0, id, 'delete', id, NULL FROM v WHERE id % 17 = 0
  UNION ALL SELECT {UPDATES}, 0, a.id, 'upsert', a.id, b.vector FROM v a JOIN v b ON b.id = a.id + 1 WHERE a.id % 11 = 0
), last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, op_idx DESC, doc_idx DESC) AS rn FROM log) WHERE rn = 1
), alive AS (SELECT id, vector, seq FROM last WHERE op = 'upsert')"""
_H = """h AS (
  SELECT label AS head_id, list(m ORDER BY pos) AS centroid FROM (
    SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM v) GROUP BY label, pos) GROUP BY label)"""


def _knn_sql(metric: str, rows: str = "v", k: int = 10, ctes: str = _V) -> str:
    d = _d(metric, "vector", "(SELECT vector FROM v WHERE id = 0)")
    return f"WITH {ctes} SELECT id, round(d, 6) + 0.0 AS dist FROM (SELECT id, {d} AS d FROM {rows} WHERE vector IS NOT NULL) ORDER BY d, id LIMIT {k}"


def _ranked(scored: str, k: int = 10) -> str:
    return f"SELECT qid, id, round(d, 6) + 0.0 AS dist, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rn FROM ({scored})) WHERE rn <= {k}"


def _batch_sql(metric: str, rows: str = "v", k: int = 10, ctes: str = f"{_V}, {_Q}") -> str:
    return f"WITH {ctes} " + _ranked(f"SELECT qid, id, {_d(metric, 'vector', 'qv')} AS d FROM {rows} CROSS JOIN q", k)


# exact search


@query(_knn_sql(L2))
def knn_l2(spark, sf_dir):
    return _rounded(exact.knn(_vectors(spark, sf_dir), _one(spark, sf_dir), 10, L2), "id")


@query(_knn_sql(COS))
def knn_cosine(spark, sf_dir):
    return _rounded(exact.knn(_vectors(spark, sf_dir), _one(spark, sf_dir), 10, COS), "id")


@query(_knn_sql(DOT))
def knn_dot(spark, sf_dir):
    return _rounded(exact.knn(_vectors(spark, sf_dir), _one(spark, sf_dir), 10, DOT), "id")


@query(_batch_sql(L2))
def knn_batch_l2(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _rounded(exact.knn_batch(v, _asked(v), 10, L2), "qid", "id", "rank")


@query(_batch_sql(COS))
def knn_batch_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _rounded(exact.knn_batch(v, _asked(v), 10, COS), "qid", "id", "rank")


@query(_batch_sql(DOT))
def knn_batch_dot(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _rounded(exact.knn_batch(v, _asked(v), 10, DOT), "qid", "id", "rank")


@query(_batch_sql(L2))
def knn_batch_expressions(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _rounded(exact.knn_batch_sql(v, _asked(v), 10, L2), "qid", "id", "rank")


@query(_knn_sql(COS))
def knn_default_k(spark, sf_dir):
    return _rounded(exact.knn(_vectors(spark, sf_dir), _one(spark, sf_dir), metric=COS), "id")


@query(f"WITH {_V} SELECT id FROM v WHERE false")
def knn_zero_k(spark, sf_dir):
    return exact.knn(_vectors(spark, sf_dir), _one(spark, sf_dir), 0).select("id")


@query(f"WITH {_V} SELECT id, {_d(COS, 'vector', 'list_transform(vector, lambda x: 0.0)')} AS dist FROM v")
def zero_norm_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select("id", distance(COS, F.col("vector"), F.transform("vector", lambda x: F.lit(0.0))).alias("dist"))


@query(f"WITH {_V} SELECT id, round({_d(L2, 'vector', '(SELECT vector FROM v WHERE id = 0)')}, 6) AS l2, round({_d(COS, 'vector', '(SELECT vector FROM v WHERE id = 0)')}, 6) + 0.0 AS cosine, round({_d(DOT, 'vector', '(SELECT vector FROM v WHERE id = 0)')}, 6) AS dot FROM v")
def distance_functions(spark, sf_dir):
    register_sql(spark)
    v, q = _vectors(spark, sf_dir), vector_literal(_one(spark, sf_dir))
    rows = v.select("id", F.col("vector").cast("array<double>").alias("a"), q.alias("b"))
    return rows.select("id", F.expr(f"round({L2}(a, b), 6)").alias("l2"), F.expr(f"round({COS}(a, b), 6) + 0.0D").alias("cosine"), F.expr(f"round({DOT}(a, b), 6)").alias("dot"))


@query(f"WITH {_V} SELECT id, round(d, 6) + 0.0 AS dist FROM (SELECT id, d FROM (SELECT id, {_d(L2, 'vector', '(SELECT vector FROM v WHERE id = 0)')} AS d FROM v) ORDER BY d, id LIMIT 10)")
def merge_top_k(spark, sf_dir):
    v, q = _vectors(spark, sf_dir), _one(spark, sf_dir)
    part = lambda r: exact.knn(v.where(f"id % 2 = {r}"), q, 10, L2).select("id", "dist")
    return _rounded(exact.merge_top_k(part(0), part(1), 10), "id")


@query(f"WITH {_V} SELECT id, round(d, 6) + 0.0 AS dist, len(vector) AS dims FROM (SELECT id, vector, {_d(L2, 'vector', '(SELECT vector FROM v WHERE id = 0)')} AS d FROM v) ORDER BY d, id LIMIT 10")
def include_vectors(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    hits = exact.knn(v, _one(spark, sf_dir), 10, L2).select("id", "dist")
    docs = v.withColumn("attributes", F.expr("map()"))
    return hybrid.hydrate(hits, docs, True).select("id", (F.round("dist", 6) + 0.0).alias("dist"), F.size("vector").cast("long").alias("dims"))


# log


@query(f"WITH {_LAST} SELECT id, CAST(seq AS BIGINT) AS last_seq, round(CAST(vector[1] AS DOUBLE), 6) AS first FROM alive")
def log_replay_latest(spark, sf_dir):
    rows = replay.latest_documents(_log(spark, sf_dir))
    return rows.select("id", "last_seq", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


@query(f"WITH {_LAST} SELECT count(*) AS doc_count FROM alive")
def doc_count(spark, sf_dir):
    return replay.latest_documents(_log(spark, sf_dir)).agg(F.count(F.lit(1)).alias("doc_count"))


@query(_knn_sql(L2, "(SELECT id, vector FROM alive WHERE seq >= 1000000)", ctes=_LAST))
def tail_knn(spark, sf_dir):
    ops = replay.latest_ops(replay.tail(_log(spark, sf_dir), DELETES - 1)).where("op = 'upsert'")
    return _rounded(exact.knn(ops, _one(spark, sf_dir), 10, L2), "id")


@query(_knn_sql(L2, "alive", ctes=_LAST))
def delete_excluded(spark, sf_dir):
    return _rounded(exact.knn(replay.latest_documents(_log(spark, sf_dir)), _one(spark, sf_dir), 10, L2), "id")


@query(f"WITH {_V} SELECT id, round(d, 6) + 0.0 AS dist FROM (SELECT id, {_d(L2, 'vector', '(SELECT vector FROM v WHERE id = 0)')} AS d FROM v WHERE id % 3 <> 0) ORDER BY d, id LIMIT 10")
def vectorless_excluded(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("vector", F.when(F.col("id") % 3 != 0, F.col("vector")))
    return _rounded(exact.knn(v, _one(spark, sf_dir), 10, L2), "id")


@query(f"WITH {_LAST}, tail AS (SELECT DISTINCT id FROM log WHERE seq >= {DELETES}) SELECT id FROM v WHERE id NOT IN (SELECT id FROM tail)")
def tail_shadow(spark, sf_dir):
    return _vectors(spark, sf_dir).join(replay.tail(_log(spark, sf_dir), DELETES - 1).select("id"), "id", "left_anti").select("id")


# index operators


@query(f"WITH {_V}, {_H} SELECT head_id AS label, CAST(pos AS INTEGER) AS pos, round(x, 6) AS mean FROM (SELECT head_id, unnest(centroid) AS x, unnest(range(0, len(centroid))) AS pos FROM h)")
def centroid_mean(spark, sf_dir):
    rows = kmeans.centroid_mean(_vectors(spark, sf_dir), "label").select("label", F.posexplode("centroid").alias("pos", "x"))
    return rows.select("label", "pos", F.round("x", 6).alias("mean"))


_HEAD3 = f"""{_V}, {_Q}, {_H}, hs AS (
  SELECT qid, head_id FROM (SELECT qid, head_id, row_number() OVER (PARTITION BY qid ORDER BY {_d(L2, 'centroid', 'qv')}, head_id) AS rn FROM q CROSS JOIN h) WHERE rn <= 3)"""


@query(f"WITH {_HEAD3} SELECT qid, CAST(head_id AS BIGINT) AS head_id FROM hs")
def head_search(spark, sf_dir):
    return index.head_search(_asked(_vectors(spark, sf_dir)), _heads(spark, sf_dir), 3, L2)


_RNG = f"""near AS (
  SELECT id, vector, head_id, centroid, d, row_number() OVER (PARTITION BY id ORDER BY d, head_id) AS rn FROM (
    SELECT id, vector, head_id, centroid, {_d(L2, 'vector', 'centroid')} AS d FROM v CROSS JOIN h)
), second AS (
  SELECT b.id, b.head_id, row_number() OVER (PARTITION BY b.id ORDER BY b.rn) AS k FROM near b JOIN near a ON a.id = b.id AND a.rn = 1
  WHERE b.rn BETWEEN 2 AND 4 AND NOT ({_d(L2, 'a.centroid', 'b.centroid')} < 0.5 * b.d)
), post AS (SELECT head_id, id FROM near WHERE rn = 1 UNION ALL SELECT head_id, id FROM second WHERE k = 1)"""
_TWO = IndexConfig(replica_count=2, rng_factor=0.5, num_search_heads=3)


def _postings(spark, sf_dir, heads):
    rows = _vectors(spark, sf_dir).select(F.col("id").alias("vector_id"), F.lit(1).cast("long").alias("version"), "vector")
    return index.place(rows, heads, _TWO)


@query(f"WITH {_V}, {_H}, {_RNG} SELECT CAST(head_id AS BIGINT) AS head_id, id AS vector_id FROM post")
def rng_filter(spark, sf_dir):
    return _postings(spark, sf_dir, _heads(spark, sf_dir)).select("head_id", "vector_id")


@query(f"WITH {_V}, {_H}, {_RNG} SELECT CAST(head_id AS BIGINT) AS head_id, count(*) AS size FROM post GROUP BY head_id")
def posting_sizes(spark, sf_dir):
    return kmeans.posting_sizes(_postings(spark, sf_dir, _heads(spark, sf_dir)))


_IVF = f"WITH {_HEAD3}, {_RNG} " + _ranked(f"SELECT qid, id, min(d) AS d FROM (SELECT hs.qid, v.id, {_d(L2, 'v.vector', 'qv')} AS d FROM hs JOIN post ON hs.head_id = post.head_id JOIN v ON v.id = post.id JOIN q ON q.qid = hs.qid) GROUP BY qid, id")


def _ann(spark, sf_dir):
    v, heads = _vectors(spark, sf_dir), _heads(spark, sf_dir)
    versions = v.select(F.col("id").alias("vector_id"), F.lit(1).cast("long").alias("version"), F.lit(False).alias("deleted"))
    return index.ann_search(_asked(v), heads, _postings(spark, sf_dir, heads), versions, _TWO, 10)


@query(_IVF)
def ivf_probe_dedup(spark, sf_dir):
    return _rounded(_ann(spark, sf_dir), "qid", "id", "rank")


@query(f"""WITH t AS ({_batch_sql(L2)}), f AS ({_IVF})
SELECT round(CAST(count(f.id) AS DOUBLE) / (10 * (SELECT count(DISTINCT qid) FROM t)), 6) AS recall FROM t LEFT JOIN f ON t.qid = f.qid AND t.id = f.id""")
def recall_at_k(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return exact.recall_at_k(exact.knn_batch(v, _asked(v), 10, L2), _ann(spark, sf_dir), 10).select(F.round("recall", 6).alias("recall"))


@query(f"""WITH {_V}, p AS (SELECT label AS head_id, id, 1 AS version FROM v UNION ALL SELECT label, id, 2 FROM v WHERE id % 11 = 0)
SELECT CAST(head_id AS BIGINT) AS head_id, id AS vector_id, CAST(version AS BIGINT) AS version FROM p WHERE id % 17 <> 0 AND version = CASE WHEN id % 11 = 0 THEN 2 ELSE 1 END""")
def version_liveness(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    entry = lambda df, n: df.select(F.col("label").cast("long").alias("head_id"), F.col("id").alias("vector_id"), F.lit(n).cast("long").alias("version"), "vector")
    versions = v.select(F.col("id").alias("vector_id"), F.when(F.col("id") % 11 == 0, 2).otherwise(1).cast("long").alias("version"), (F.col("id") % 17 == 0).alias("deleted"))
    return index.live(entry(v, 1).unionByName(entry(v.where("id % 11 = 0"), 2)), versions).select("head_id", "vector_id", "version")


@query(f"""WITH {_V}, {_H}, own AS (
  SELECT id, vector, head_id FROM (SELECT id, vector, head_id, row_number() OVER (PARTITION BY id ORDER BY {_d(L2, 'vector', 'centroid')}, head_id) AS rn FROM v CROSS JOIN h) WHERE rn = 1
) SELECT CAST(head_id AS BIGINT) AS cluster, CAST(pos AS INTEGER) AS pos, count(*) AS n, round(avg(CAST(x AS DOUBLE)), 6) AS mean
FROM (SELECT head_id, unnest(vector) AS x, unnest(range(0, len(vector))) AS pos FROM own) GROUP BY head_id, pos""")
def kmeans_step(spark, sf_dir):
    centers = _heads(spark, sf_dir).select(F.col("head_id").alias("cluster"), "centroid")
    step = kmeans.kmeans_step(_vectors(spark, sf_dir).select("id", "vector"), centers)
    return step.select("cluster", "n", F.posexplode("centroid").alias("pos", "x")).select("cluster", "n", "pos", F.round("x", 6).alias("mean"))


@query(f"""WITH {_V}, n AS (SELECT label, count(*) AS n FROM v GROUP BY label)
SELECT CAST(label AS BIGINT) AS old_id, n AS n_vectors, n > 40 AS divided, true AS bounded FROM n""")
def split_oversized(spark, sf_dir):
    """One round over lists by label: what is above the bound is divided whole into smaller
    parts, the rest stays; reassignment is off, so every vector stays below its old list."""
    v = _vectors(spark, sf_dir)
    postings = v.select(F.col("label").cast("long").alias("head_id"), F.col("id").alias("vector_id"), F.lit(1).cast("long").alias("version"), "vector")
    versions = v.select(F.col("id").alias("vector_id"), F.lit(1).cast("long").alias("version"), F.lit(False).alias("deleted"))
    config = IndexConfig(max_posting_size=40, reassign_range=0)
    _, after, _ = index.split_oversized(_heads(spark, sf_dir), postings, versions, config)
    own = after.select("vector_id", F.col("head_id").alias("new_id")).join(v.select(F.col("id").alias("vector_id"), F.col("label").cast("long").alias("old_id")), "vector_id")
    parts = own.groupBy("old_id", "new_id").agg(F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("old_id").agg(F.sum("n").alias("n_vectors"), F.max("n").alias("most"), F.max(F.col("new_id") != F.col("old_id")).alias("divided"))
    return whole.select("old_id", "n_vectors", "divided", (~F.col("divided") | (F.col("most") < F.col("n_vectors"))).alias("bounded"))


_ENDS = f"""{_V}, {_H}, n AS (SELECT label, min(id) AS a, max(id) AS b FROM v GROUP BY label)"""


@query(f"""WITH {_ENDS}
SELECT DISTINCT v.id AS vector_id FROM v JOIN h ON h.head_id = v.label JOIN n ON n.label = v.label JOIN v va ON va.id = n.a JOIN v vb ON vb.id = n.b
WHERE {_d(L2, 'v.vector', 'va.vector')} <= {_d(L2, 'v.vector', 'h.centroid')} OR {_d(L2, 'v.vector', 'vb.vector')} <= {_d(L2, 'v.vector', 'h.centroid')}""")
def reassign_candidates(spark, sf_dir):
    """Members of each list that one of two new centroids (its first and last vector) suits
    as well as the old one, its mean."""
    v = _vectors(spark, sf_dir)
    ends = v.groupBy("label").agg(F.array(F.min_by("vector", "id"), F.max_by("vector", "id")).alias("new_centroids"))
    splits = _heads(spark, sf_dir).join(ends, F.col("head_id") == F.col("label")).select(F.col("head_id").alias("old_id"), F.col("centroid").alias("old_centroid"), "new_centroids")
    entries = v.select(F.col("id").alias("vector_id"), "vector", F.col("label").cast("long").alias("old_id"))
    return index.reassign_candidates(entries, splits, L2)


@query(f"WITH {_V}, {_H}, {_Q}, r AS (SELECT qid, head_id, row_number() OVER (PARTITION BY qid ORDER BY {_d(L2, 'centroid', 'qv')}, head_id) AS rn FROM q CROSS JOIN h WHERE head_id % 2 = 0) SELECT qid, CAST(head_id AS BIGINT) AS head_id FROM r WHERE rn <= 3")
def active_heads(spark, sf_dir):
    """Inactive heads (the odd ones) are never probed."""
    heads = _heads(spark, sf_dir).withColumn("active", F.col("head_id") % 2 == 0)
    return index.head_search(_asked(_vectors(spark, sf_dir)), heads, 3, L2)


@query("SELECT count(*) AS vectors, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS over_replicated, CAST(0 AS BIGINT) AS oversized_lists FROM embeddings")
def index_build(spark, sf_dir):
    """A bulk build: every vector is in a list, none in more than three, and no list of
    nearest heads is above the bound."""
    config = IndexConfig(max_posting_size=64, replica_count=3)
    rows = _vectors(spark, sf_dir).select(F.col("id").alias("vector_id"), "vector", F.lit(1).cast("long").alias("version"))
    heads = materialize(index.build_heads(rows, config), "heads")
    copies = index.place(rows, heads, config).groupBy("vector_id").agg(F.count(F.lit(1)).alias("n"))
    placed = rows.select("vector_id").join(copies, "vector_id", "left").agg(
        F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("n").isNull()).alias("uncovered"), F.count_if(F.col("n") > 3).alias("over_replicated")
    )
    sizes = kmeans.posting_sizes(materialize(index.place(rows, heads, IndexConfig(max_posting_size=64, replica_count=1)), "nearest"))
    return placed.crossJoin(sizes.agg(F.count_if(F.col("size") > 2 * 64).alias("oversized_lists")))  # a row each


# whole engine


@query(f"WITH {_LAST}, {_Q} " + _ranked(f"SELECT qid, id, {_d(L2, 'vector', 'qv')} AS d FROM alive CROSS JOIN q"))
def hybrid_merge(spark, sf_dir):
    """An index over the base entries, deletes and updates in the tail, every list probed."""
    v, log = _vectors(spark, sf_dir), _log(spark, sf_dir)
    config = IndexConfig(max_posting_size=64, replica_count=2, num_search_heads=1 << 20)
    rows = v.select(F.col("id").alias("vector_id"), "vector", F.lit(1).cast("long").alias("version"))
    heads = materialize(index.build_heads(rows, config), "heads")
    versions = rows.select("vector_id", "version", F.lit(False).alias("deleted"))
    parts = {"heads": heads, "postings": index.place(rows, heads, config), "versions": versions}
    hits = hybrid.hybrid_knn(_asked(v), 10, L2, index=parts, tail_ops=replay.latest_ops(replay.tail(log, DELETES - 1)), config=config)
    return _rounded(hits, "qid", "id", "rank")


def _filled(spark, sf_dir, metric=L2):
    v = _vectors(spark, sf_dir)
    ns = Engine(spark, scratch_path(spark, "engine")).create_namespace("docs", metric)
    ns.upsert(v.select("id", "vector", F.to_json(F.struct("label")).alias("attributes")))
    return v, ns


@query(f"WITH {_LAST}, {_Q}, r AS (" + _ranked(f"SELECT qid, id, {_d(L2, 'vector', 'qv')} AS d FROM alive CROSS JOIN q") + ") SELECT qid, id, dist, rank FROM r")
def engine_hybrid(spark, sf_dir):
    """Through namespaces: write, index, delete, write again, index part of it, query."""
    v, ns = _filled(spark, sf_dir)
    ns.build_index(IndexConfig(max_posting_size=64, replica_count=2, num_search_heads=1 << 20))
    ns.delete(v.where("id % 17 = 0").select("id"))
    ns.build_index()
    after = v.select((F.col("id") - 1).alias("id"), "vector")
    ns.upsert(v.where("id % 11 = 0").select("id").join(after, "id"))
    return _rounded(ns.query_batch(_asked(v), 10), "qid", "id", "rank")


@query("WITH v AS (SELECT vec_id AS id, embedding AS vector, label FROM embeddings) " + f"SELECT id, round(d, 6) + 0.0 AS dist, CAST(rn AS INTEGER) AS rank FROM (SELECT id, d, row_number() OVER (ORDER BY d, id) AS rn FROM (SELECT id, {_d(DOT, 'vector', '(SELECT vector FROM v WHERE id = 0)')} AS d FROM v)) WHERE rn <= 10")
def knn_metric_override(spark, sf_dir):
    _, ns = _filled(spark, sf_dir, COS)
    return _rounded(ns.query(_one(spark, sf_dir), distance_metric=DOT), "id", "rank")


@query("SELECT 'docs' AS name, CAST(max(len(embedding)) AS INTEGER) AS dimensions, 'cosine_distance' AS distance_metric, count(*) AS doc_count FROM embeddings")
def namespace_listing(spark, sf_dir):
    _filled(spark, sf_dir, COS)[1]
    _, ns = _filled(spark, sf_dir, COS)
    return ns.engine.list_namespaces()


def _three_entries(spark, sf_dir):
    """A namespace whose log has three entries: all vectors, deletes, updates."""
    v, ns = _filled(spark, sf_dir)
    ns.delete(v.where("id % 17 = 0").select("id"))
    ns.upsert(v.where("id % 11 = 0").select("id").join(v.select((F.col("id") - 1).alias("id"), "vector"), "id"))
    return v, ns


_STORED = """v AS (SELECT vec_id AS id, embedding AS vector FROM embeddings), log AS (
  SELECT 1 AS sequence, 'upsert' AS op, id, vector FROM v
  UNION ALL SELECT 2, 'delete', id, NULL FROM v WHERE id % 17 = 0
  UNION ALL SELECT 3, 'upsert', a.id, b.vector FROM v a JOIN v b ON b.id = a.id + 1 WHERE a.id % 11 = 0
), alive AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sequence DESC) AS rn FROM log) WHERE rn = 1 AND op = 'upsert')"""


@query(f"WITH {_STORED} SELECT CAST(sequence AS BIGINT) AS sequence, count(*) AS operations FROM log GROUP BY sequence")
def wal_sequences(spark, sf_dir):
    """The store's entries, each read by its number."""
    _, ns = _three_entries(spark, sf_dir)
    rows = None
    for s in ns.store.sequences(ns.name):
        part = ns.store.entry(ns.name, s).groupBy("sequence").agg(F.count(F.lit(1)).alias("operations"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(f"WITH {_STORED} SELECT CAST(max(sequence) AS BIGINT) AS sequence FROM log")
def wal_max_sequence(spark, sf_dir):
    _, ns = _three_entries(spark, sf_dir)
    return spark.createDataFrame([(ns.last_sequence(),)], "sequence long")


@query(f"WITH {_STORED} SELECT id, CAST(sequence AS BIGINT) AS sequence, op FROM log WHERE sequence > 1")
def tail_select(spark, sf_dir):
    """The log after an entry; the files of the entries before are not read."""
    return _three_entries(spark, sf_dir)[1].log(1).select("id", "sequence", "op")


@query(f"WITH {_STORED} SELECT id, CAST(sequence AS BIGINT) AS last_seq, round(CAST(vector[1] AS DOUBLE), 6) AS first FROM alive WHERE id = 22")
def point_get(spark, sf_dir):
    """One document through the engine, its newest version in the log's tail."""
    _, ns = _three_entries(spark, sf_dir)
    row = ns.get(22)
    return spark.createDataFrame([(row.id, row.sequence, round(float(row.vector[0]), 6))], "id long, last_seq long, first double")


@query(f"WITH {_STORED} SELECT id, CAST(sequence AS BIGINT) AS last_seq FROM alive")
def slow_writer(spark, sf_dir):
    """Two writers: one stages, the other publishes and the index is built, then the first
    publishes.  Nothing is lost."""
    v, ns = _filled(spark, sf_dir)
    late = v.where("id % 11 = 0").select("id").join(v.select((F.col("id") - 1).alias("id"), "vector"), "id")
    rows = late.select(F.lit(0).alias("op_idx"), F.col("id").alias("doc_idx"), F.lit("upsert").alias("op"), F.lit(0).cast("long").alias("ts_ms"), "id", "vector", F.expr(f"CAST(map() AS {ATTRIBUTES})").alias("attributes"))
    batch, _ = ns.store.stage(ns.name, rows)
    ns.delete(v.where("id % 17 = 0").select("id"))
    ns.build_index(IndexConfig(max_posting_size=64, replica_count=1))
    ns.store.publish(ns.name, batch)
    return ns.documents().select("id", "last_seq")


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT CAST(1 AS BIGINT) AS generation, CAST(1 AS BIGINT) AS wal_sequence, n AS num_vectors, true AS has_heads, true AS refused FROM n")
def manifest_commit(spark, sf_dir):
    """A generation's manifest, and a second writer of the same generation refused."""
    _, ns = _filled(spark, sf_dir)
    ns.build_index(IndexConfig(max_posting_size=64, replica_count=1))
    held = ns.store.manifest(ns.name)
    try:
        ns.store.commit_manifest(ns.name, held["gen"], {})
        refused = False
    except WriteConflict:
        refused = True
    row = (held["gen"], held["wal_sequence"], ns.indexed_count(), held["active_centroids"] > 0, refused)
    return spark.createDataFrame([row], "generation long, wal_sequence long, num_vectors long, has_heads boolean, refused boolean")


@query("SELECT 'kept' AS name")
def namespace_deleted(spark, sf_dir):
    """Namespaces that are left after one was deleted; its documents are gone with it."""
    _, ns = _filled(spark, sf_dir)
    ns.engine.create_namespace("kept")
    ns.engine.delete_namespace(ns.name)
    return ns.engine.list_namespaces().select("name")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS future, CAST(0 AS BIGINT) AS headless FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id % 17 <> 0 OR vec_id % 11 = 0)")
def index_increment(spark, sf_dir):
    """An index extended by deletes and updates: live vectors and violated invariants."""
    v, ns = _filled(spark, sf_dir)
    ns.build_index(IndexConfig(max_posting_size=64, replica_count=2))
    ns.delete(v.where("id % 17 = 0").select("id"))
    ns.upsert(v.where("id % 11 = 0").select("id", F.reverse("vector").alias("vector")))
    ns.build_index()
    found = ns.check_index()
    return spark.createDataFrame([(ns.indexed_count(), *(found[k] for k in ("uncovered", "future", "headless")))], "n long, uncovered long, future long, headless long")


@query("SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT') OR (json_type(props, '$.k') = 'BIGINT' AND CAST(json_extract(props, '$.k') AS BIGINT) >= 0) THEN 'u64' ELSE 'f64' END AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events")
def attribute_coercion(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", attr.from_json("props").alias("a"))
    return rows.select("event_id", F.expr("a['k'].kind").alias("kind"), F.expr("CAST(a['k'].u AS BIGINT)").alias("value"))


@query("SELECT event_id, props AS attributes FROM events")
def attribute_round_trip(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", attr.from_json("props").alias("a"))
    return rows.select("event_id", F.regexp_replace(attr.to_json("a"), '":', '": ').alias("attributes"))


@query("SELECT CAST(i AS BIGINT) AS id, CAST(64 AS INTEGER) AS dims, CAST(1.0 AS DOUBLE) AS norm, CAST(i // 100 AS BIGINT) AS batch FROM (SELECT unnest(range(0, (SELECT count(*) FROM embeddings))) AS i)")
def synthetic_source(spark, sf_dir):
    """As many made-up documents as there are embeddings: dimensions, norm and batch."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    rows = synthetic_documents(spark, n, 64)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select("id", F.size("vector").alias("dims"), F.round(norm, 4).alias("norm"), F.expr("CAST(attributes['batch'].u AS BIGINT)").alias("batch"))


@query("SELECT vec_id AS id, CAST(1 AS BIGINT) AS last_seq FROM embeddings")
def stream_ingest(spark, sf_dir):
    """The embeddings as a stream of files into a namespace's log."""
    ns = Engine(spark, scratch_path(spark, "engine")).create_namespace("docs", L2)
    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parquet*").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    ingest(stream, ns, scratch_path(spark, "checkpoint"), once=True).awaitTermination()
    return ns.documents().select("id", "last_seq")


@query("SELECT vec_id AS id, CAST(1 AS BIGINT) AS last_seq FROM embeddings")
def stream_replay(spark, sf_dir):
    """The same stream twice, the second time without its checkpoint: written once."""
    ns = Engine(spark, scratch_path(spark, "engine")).create_namespace("docs", L2)
    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parquet*").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        ingest(stream, ns, scratch_path(spark, "checkpoint"), once=True).awaitTermination()
    return ns.documents().select("id", "last_seq")


@query(f"""WITH {_V}, s AS (SELECT id, label, {_d(L2, 'vector', '(SELECT vector FROM v WHERE id = 0)')} AS d FROM v WHERE label % 2 = 0)
SELECT id, round(d, 6) + 0.0 AS dist, CAST(label AS BIGINT) AS label FROM s ORDER BY d, id LIMIT 10""")
def filtered_knn(spark, sf_dir):
    """Through an index, all lists probed: the nearest among those whose attribute is even,
    with that attribute."""
    v, ns = _filled(spark, sf_dir)
    ns.build_index(IndexConfig(max_posting_size=64, replica_count=1, num_search_heads=1 << 20))
    hits = ns.query(_one(spark, sf_dir), where="attributes['label'].u % 2 = 0")
    return _rounded(hits.withColumn("label", F.expr("CAST(attributes['label'].u AS BIGINT)")), "id", "label")


@query("SELECT true AS write_refused, true AS query_refused, count(*) AS documents FROM embeddings")
def dimension_check(spark, sf_dir):
    """Vectors of another length are refused, written or asked for, and change nothing."""
    _, ns = _filled(spark, sf_dir)
    refused = []
    for call in (lambda: ns.upsert(spark.createDataFrame([(1, [1.0])], "id long, vector array<float>")), lambda: ns.query([1.0])):
        try:
            call()
            refused.append(False)
        except DimensionMismatch:
            refused.append(True)
    return spark.createDataFrame([(*refused, ns.doc_count())], "write_refused boolean, query_refused boolean, documents long")
