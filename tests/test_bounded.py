"""What a search holds and sends: bounded, whatever the number of queries, rows and lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrata.functions.distance import one_to_many
from vecstrata.operators import exact, hybrid, index
from vecstrata.sources.synthetic import synthetic_documents
from vecstrata.types import IndexConfig


@pytest.fixture(scope="module")
def lists(spark):
    """600 documents in 40 lists, two each; every fifth is dead, every seventh of an old version."""
    docs = synthetic_documents(spark, 600, 8, seed=4).select("id", "vector").cache()
    heads = docs.where("id < 40").select(F.col("id").alias("head_id"), F.col("vector").cast("array<double>").alias("centroid"), F.lit(True).alias("active")).cache()
    rows = docs.select(F.col("id").alias("vector_id"), F.lit(1).cast("long").alias("version"), "vector")
    post = index.place(rows, heads, IndexConfig(replica_count=2, rng_factor=0.0)).cache()
    versions = rows.select("vector_id", F.when(F.col("vector_id") % 7 == 0, 2).otherwise(1).cast("long").alias("version"), (F.col("vector_id") % 5 == 0).alias("deleted")).cache()
    return docs, {"heads": heads, "postings": post, "versions": versions}


@pytest.mark.parametrize("probes", [1 << 20, 40, 39])
def test_the_driver_gets_no_probe_of_every_list(spark, lists, monkeypatch, probes):  # F1
    docs, parts = lists
    queries, got = docs.where("id % 6 = 0").select(F.col("id").alias("qid"), "vector"), []
    kind = type(docs)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: got.append(rows := collect(self)) or rows)
    tail = docs.where("id % 11 = 0").select("id", F.lit("delete").alias("op"), "vector")
    found = hybrid.hybrid_knn(queries, 4, index=parts, tail_ops=tail, config=IndexConfig(num_search_heads=probes))
    assert max(map(len, got), default=0) < 100 * 40
    monkeypatch.undo()
    live = docs.where("id % 5 <> 0 AND id % 7 <> 0 AND id % 11 <> 0")
    if probes >= 40:
        want = exact.knn_batch(live, queries, 4)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("probes", [1 << 20, 5])
def test_a_task_keeps_k_of_a_query(spark, lists, probes):  # F2, F6
    docs, parts = lists
    queries = docs.where("id % 6 = 0").select(F.col("id").alias("qid"), "vector")
    config = IndexConfig(num_search_heads=probes)
    one = parts | {"postings": parts["postings"].coalesce(1).cache()}
    found = index.ann_candidates(queries, one["heads"], one["postings"], one["versions"], config, k=3)
    assert found.count() == 100 * 3
    every = index.ann_candidates(queries, one["heads"], one["postings"], one["versions"], config)
    assert every.count() > 1000
    assert sorted(map(tuple, exact.rank_by_query(found, 3).collect())) == sorted(map(tuple, exact.rank_by_query(every, 3).collect()))


@pytest.mark.parametrize("metric", ["euclidean_squared", "cosine_distance", "dot_product"])
def test_tiles_are_bounded(monkeypatch, metric):  # F4, F5, F7, F8
    cells, product = [], exact.many_to_many
    monkeypatch.setattr(exact, "many_to_many", lambda m, a, b: cells.append(len(a) * len(b)) or product(m, a, b))
    rng = np.random.default_rng(2)
    rows, queries = rng.normal(size=(2500, 6)), rng.normal(size=(700, 6))
    rows[::3], rows[7], rows[8] = rows[0], np.nan, 0
    best = exact.Nearest(metric, queries, 4)
    for a in range(0, 2500, exact.TILE_ROWS):
        best.add(np.arange(a, min(2500, a + exact.TILE_ROWS)), rows[a : a + exact.TILE_ROWS])
    assert max(cells) <= exact.TILE_CELLS < 2500 * 700 and len(best.at) == 4 * 700
    got = best.taken(np.arange(700)).to_pandas().sort_values(["qid", "dist", "id"]).id.to_numpy().reshape(700, 4)
    want = [np.lexsort((np.arange(2500), one_to_many(metric, q, rows)))[:4] for q in queries]
    assert got.tolist() == [w.tolist() for w in want]


def test_placing_meets_heads_in_tiles(monkeypatch):  # the same step of the index build
    import pyarrow as pa

    cells, product = [], index.many_to_many
    monkeypatch.setattr(index, "many_to_many", lambda m, a, b: cells.append(len(a) * len(b)) or product(m, a, b))
    rng = np.random.default_rng(3)
    batch = pa.RecordBatch.from_pydict({"vector_id": range(900), "version": [1] * 900, "vector": rng.normal(size=(900, 3)).tolist()})
    assert index.chosen_heads(batch, np.arange(2000), rng.normal(size=(2000, 3)), IndexConfig()).num_rows == 900
    assert max(cells) <= exact.TILE_CELLS


def test_recall_makes_the_truth_once(spark):  # F5
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    truth = spark.range(20).selectExpr("id % 4 AS qid", "id").mapInArrow(rows, "qid long, id long")
    assert exact.recall_at_k(truth, truth.where("id < 10"), 5).first().recall == 0.5
    assert made.value <= 40  # once for the truth, once for what was found
