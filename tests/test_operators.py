import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrata.engine import Engine
from vecstrata.functions.distance import one_to_many
from vecstrata.operators import exact, hybrid, index, kmeans, replay
from vecstrata.sources.synthetic import synthetic_documents
from vecstrata.types import IndexConfig


def frame(spark, rows, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vector array<float>")


def brute(rows, query, k, metric):
    dist = one_to_many(metric, np.asarray(query, float), np.asarray(rows, np.float32).astype(float))
    return [int(i) for i in np.lexsort((np.arange(len(rows)), dist))[:k]]


@pytest.mark.parametrize("metric", ["euclidean_squared", "cosine_distance", "dot_product"])
def test_knn_forms_agree_with_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(200, 12))
    rows[50] = rows[40]  # a tie
    docs, queries = frame(spark, rows), frame(spark, rows[:7] + 0.01).withColumnRenamed("id", "qid")
    asked = np.asarray(rows[:7] + 0.01, np.float32)
    for form in (exact.knn_batch, exact.knn_batch_sql):
        got = form(docs, queries, 5, metric).orderBy("qid", "rank").collect()
        for q in range(7):
            assert [r.id for r in got if r.qid == q] == brute(rows, asked[q], 5, metric)
    assert [r.id for r in exact.knn(docs, asked[0].tolist(), 5, metric).collect()] == brute(rows, asked[0], 5, metric)


def test_knn_edges(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0])], "id long, vector array<float>")
    assert [r.id for r in exact.knn(docs, [1.0, 0.0], 10).collect()] == [1, 3]
    assert exact.knn(docs, [1.0, 0.0], 0).count() == 0
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "qid long, vector array<double>")
    assert [(r.qid, r.id) for r in exact.knn_batch(docs, q, 10).orderBy("rank").collect()] == [(0, 1), (0, 3)]
    assert exact.knn_batch(docs, q, 0).count() == 0 and exact.knn_batch(docs.limit(0), q, 3).count() == 0
    nan = spark.createDataFrame([(1, [float("nan")]), (2, [5.0])], "id long, vector array<float>")
    assert [r.id for r in exact.knn(nan, [0.0], 2).collect()] == [2, 1]
    q = spark.createDataFrame([(0, [0.0])], "qid long, vector array<double>")
    assert [r.id for r in exact.knn_batch(nan, q, 1).collect()] == [2]
    many = spark.createDataFrame([(i, [float("nan")]) for i in range(5)] + [(9, [1.0])], "id long, vector array<float>").coalesce(1)
    assert [r.id for r in exact.knn_batch(many, q, 3).orderBy("rank").collect()] == [9, 0, 1]


def test_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(50, 4))
    monkeypatch.setattr(exact.query_blocks, "__defaults__", (64,))
    got = exact.knn_batch(frame(spark, rows), frame(spark, rows[:20]).withColumnRenamed("id", "qid"), 1).collect()
    assert sorted((r.qid, r.id) for r in got) == [(i, i) for i in range(20)]


def test_plans(spark, sf):
    docs = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    plan = exact.knn(docs.select("id", "vector"), [0.0] * 64, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "label" not in plan.split("ReadSchema")[1]
    plan = exact.knn_batch(docs, docs.limit(3).withColumnRenamed("id", "qid"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan


def test_replay(spark):
    rows = [(1, 0, 0, "upsert", 1, "a"), (1, 0, 1, "upsert", 1, "b"), (2, 0, 0, "delete", 1, None), (2, 1, 0, "upsert", 1, "c"), (1, 0, 2, "upsert", 2, "d"), (3, 0, 0, "delete", 2, None), (3, 0, 1, "delete", 9, None)]
    log = spark.createDataFrame(rows, "sequence long, op_idx int, doc_idx long, op string, id long, x string")
    assert [tuple(r) for r in replay.latest_documents(log).collect()] == [(1, "c", 2)]
    assert {(r.id, r.op) for r in replay.latest_ops(replay.tail(log, 2)).collect()} == {(2, "delete"), (9, "delete")}
    base = replay.latest_documents(log.where("sequence < 3"))
    assert [r.id for r in replay.overlay(base, replay.latest_ops(replay.tail(log, 2))).collect()] == [1]


def test_two_means():
    a, b, ca, cb = kmeans.two_means(np.array([[0, 0], [0.1, 0.1], [10, 10], [10.1, 10.1]]))
    assert (a.tolist(), b.tolist()) == ([0, 1], [2, 3]) and np.allclose(ca, 0.05) and np.allclose(cb, 10.05)
    a, b, _, _ = kmeans.two_means(np.ones((4, 2)))
    assert len(a) + len(b) == 4 and len(a) and len(b)
    assert [len(x) for x in kmeans.two_means(np.ones((1, 2)))[:2]] == [1, 0]
    assert [len(x) for x in kmeans.two_means(np.zeros((0, 2)))[:2]] == [0, 0]
    rng = np.random.default_rng(0)
    a, b, _, _ = kmeans.two_means(np.r_[rng.normal(0, 1, (10, 3)), rng.normal(9, 1, (10, 3))])
    assert min(len(a), len(b)) >= 2


def test_head_order_and_inactive_heads(spark):
    heads = spark.createDataFrame([(0, [0.0, 0.0], True), (1, [10.0, 10.0], True), (2, [5.0, 5.0], True), (3, [0.1, 0.1], False)], "head_id long, centroid array<double>, active boolean")
    q = spark.createDataFrame([(0, [0.1, 0.1])], "qid long, vector array<double>")
    assert {r.head_id for r in index.head_search(q, heads, 2, "euclidean_squared").collect()} == {0, 2}
    assert index.head_search(q, heads, 100, "euclidean_squared").count() == 3


def test_diversity_rule(spark):
    heads = np.array([[0.0, 0], [0.1, 0], [5, 0], [0, 6]])
    query = np.array([0.01, 0])
    dist = one_to_many("euclidean_squared", query, heads)
    assert index.diverse(query, heads, dist, 2.0, 4, "euclidean_squared") == [0]
    assert index.diverse(query, heads, dist, 0.0, 3, "euclidean_squared") == [0, 1, 2]
    assert index.diverse(query, heads, dist, 0.9, 4, "euclidean_squared") == [0, 1, 2, 3]


def test_placement_beyond_one_block(spark, monkeypatch):
    rng = np.random.default_rng(6)
    heads = spark.createDataFrame([(i, v.tolist(), True) for i, v in enumerate(rng.normal(size=(30, 4)))], "head_id long, centroid array<double>, active boolean")
    rows = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 4)))], "vector_id long, version long, vector array<float>")
    config = IndexConfig(replica_count=3, rng_factor=0.0)
    whole = sorted(map(str, index.place(rows, heads, config).collect()))
    monkeypatch.setattr(index, "SALT_ROWS", 3)
    assert sorted(map(str, index.place(rows, heads, config, 200).collect())) == whole and len(whole) == 120  # five pivots: every head is near each


def test_recall_of_routed_placement(spark, built, monkeypatch):
    docs, config, heads, post, versions = built
    monkeypatch.setattr(index, "SALT_ROWS", 200)
    rows = docs.select(F.col("id").alias("vector_id"), F.lit(1).cast("long").alias("version"), "vector")
    other = index.place(rows, heads, config, 4000)
    assert other.select("vector_id").distinct().count() == 3000
    queries = synthetic_documents(spark, 40, 32, seed=5).select(F.col("id").alias("qid"), "vector")
    found = index.ann_search(queries, heads, other, versions, config, 10)
    assert exact.recall_at_k(exact.knn_batch(docs, queries, 10), found, 10).first().recall > 0.9


def test_search_reads_probed_parts_only(spark, tmp_path, monkeypatch):
    rows = synthetic_documents(spark, 400, 8, seed=3)
    ns = Engine(spark, str(tmp_path / "s")).create_namespace("n", "euclidean_squared")
    ns.upsert(rows)
    monkeypatch.setattr(index, "PART_BYTES", 1000)
    ns.build_index(IndexConfig(max_posting_size=20, replica_count=1, num_search_heads=2))
    held = ns._index()
    assert held["parts"] > 5
    query = rows.limit(1).select(F.col("id").alias("qid"), "vector")
    probed = {r.head_id % held["parts"] for r in index.head_search(query, held["heads"], 2, "euclidean_squared").collect()}
    got = index.ann_candidates(query, held["heads"], held["postings"], held["versions"], IndexConfig(num_search_heads=2), parts=held["parts"])
    want = held["postings"].where(F.col("part").isin(list(probed))).join(index.head_search(query, held["heads"], 2, "euclidean_squared"), "head_id")
    assert {r.id for r in got.collect()} == {r.vector_id for r in want.collect()}
    plan = held["postings"].where(F.col("part").isin(list(probed)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan


def test_liveness_and_dedup(spark):
    post = spark.createDataFrame([(0, 1, 1, [0.0, 0.0]), (1, 1, 1, [0.0, 0.0]), (0, 2, 1, [1.0, 0.0]), (0, 3, 1, [0.5, 0.0]), (0, 4, 1, [0.2, 0.0])], "head_id long, vector_id long, version long, vector array<float>")
    versions = spark.createDataFrame([(1, 1, False), (2, 1, False), (3, 2, False), (4, 1, True)], "vector_id long, version long, deleted boolean")
    heads = spark.createDataFrame([(0, [0.0, 0.0], True), (1, [1.0, 1.0], True)], "head_id long, centroid array<double>, active boolean")
    q = spark.createDataFrame([(7, [0.0, 0.0])], "qid long, vector array<double>")
    got = index.ann_search(q, heads, post, versions, IndexConfig(), 10).orderBy("rank").collect()
    assert [(r.id, r.dist) for r in got] == [(1, 0.0), (2, 1.0)]


@pytest.fixture(scope="module")
def built(spark):
    docs = synthetic_documents(spark, 3000, 32, seed=77).cache()
    config = IndexConfig(max_posting_size=64, replica_count=3, num_search_heads=64)
    rows = docs.select(F.col("id").alias("vector_id"), "vector", F.lit(1).cast("long").alias("version"))
    heads = index.build_heads(rows, config).cache()
    return docs, config, heads, index.place(rows, heads, config).cache(), rows.select("vector_id", "version", F.lit(False).alias("deleted"))


def test_recall(spark, built):
    docs, config, heads, post, versions = built
    queries = synthetic_documents(spark, 40, 32, seed=5).select(F.col("id").alias("qid"), "vector")
    truth = exact.knn_batch(docs, queries, 10)
    found = index.ann_search(queries, heads, post, versions, config, 10)
    assert heads.count() >= 3000 / 64
    assert exact.recall_at_k(truth, found, 10).first().recall > 0.9


def test_splitting_keeps_the_invariants(spark, built):
    _, config, heads, post, versions = built
    small = IndexConfig(max_posting_size=40, replica_count=3, reassign_range=8)
    before = index.invariants(heads, post, versions, small)
    assert before["uncovered"] == before["future"] == before["headless"] == 0 and before["oversized"] > 0
    heads, post, versions = index.split_oversized(heads, post, versions, small)
    after = index.invariants(heads, post, versions, small)
    assert after["uncovered"] == after["future"] == after["headless"] == 0 and after["oversized"] < before["oversized"]
    assert versions.where("version > 1").count() > 0


def test_stale_entries_go_before_a_split(spark):
    post = spark.createDataFrame([(0, i, 1, [float(i), 0.0]) for i in range(15)], "head_id long, vector_id long, version long, vector array<float>")
    versions = spark.createDataFrame([(i, 1, i >= 5) for i in range(15)], "vector_id long, version long, deleted boolean")
    heads = spark.createDataFrame([(0, [0.0, 0.0], True)], "head_id long, centroid array<double>, active boolean")
    h, p, _ = index.split_oversized(heads, post, versions, IndexConfig(max_posting_size=10))
    assert h.count() == 1 and p.count() == 5


def test_hybrid_equals_exact_when_all_lists_are_probed(spark, built):
    docs, config, heads, post, versions = built
    queries = docs.where("id % 300 = 0").select(F.col("id").alias("qid"), "vector")
    parts = {"heads": heads, "postings": post, "versions": versions}
    wide = IndexConfig(max_posting_size=64, replica_count=3, num_search_heads=10**6)
    for metric in ("euclidean_squared", "dot_product"):
        a = hybrid.hybrid_knn(queries, 5, metric, index=parts, config=wide)
        b = hybrid.hybrid_knn(queries, 5, metric, documents=docs)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
