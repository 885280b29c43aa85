"""The batch search in expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrata.operators import exact


@pytest.mark.parametrize("unrolled", [96, 2])
def test_bounded_pairs_give_the_same_neighbours(spark, monkeypatch, unrolled):  # F3
    monkeypatch.setattr(exact, "UNROLLED", unrolled)
    rows = np.random.default_rng(8).normal(size=(900, 6))
    rows[::4], rows[5], rows[6] = rows[0], np.nan, 0
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vector array<float>")
    queries = docs.where("id % 60 = 0").select(F.col("id").alias("qid"), "vector")
    seen, pairs = [], exact._pairs
    monkeypatch.setattr(exact, "_pairs", lambda *a: seen.append(df := pairs(*a)) or df)
    before = spark.conf.getAll
    for metric in ("euclidean_squared", "cosine_distance", "dot_product"):
        got = exact.knn_batch_sql(docs, queries, 3, metric)
        want = exact.knn_batch(docs, queries, 3, metric)
        assert sorted((r.qid, r.rank, r.id) for r in got.collect()) == sorted((r.qid, r.rank, r.id) for r in want.collect())
    assert spark.conf.getAll == before and len(seen) == 6
