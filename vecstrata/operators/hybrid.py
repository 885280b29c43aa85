"""The hybrid query: an index's candidates and an exact scan of what it has not seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import DEFAULT_TOP_K, IndexConfig
from .exact import knn_batch, rank_by_query
from .index import ann_candidates


def hybrid_knn(
    queries: DataFrame, k: int = DEFAULT_TOP_K, metric: str = "euclidean_squared", *, documents: DataFrame | None = None, index: dict | None = None,
    tail_ops: DataFrame | None = None, config: IndexConfig | None = None, allowed: DataFrame | None = None,
) -> DataFrame:
    """(qid, id, dist, rank).

    Without an index: exact over ``documents``.  With one (``heads``, ``postings``,
    ``versions``): its live candidates; with a tail too (the latest operation of each id
    written since), candidates whose id the tail has are dropped before the top k, and the
    tail's own vectors are scored exactly.  The branch depends on what is passed alone.
    ``allowed`` (id) limits the answers, before the top k in every branch."""
    keep = (lambda df: df.join(allowed, "id", "left_semi")) if allowed is not None else lambda df: df
    if index is None:
        return knn_batch(keep(documents.where("vector IS NOT NULL")), queries, k, metric)
    gone = tail_ops.select("id") if tail_ops is not None else None
    found = ann_candidates(queries, index["heads"], index["postings"], index["versions"], config or IndexConfig(), metric, index.get("parts"), k=max(k, 0), without=gone, allowed=allowed)
    if tail_ops is None:
        return rank_by_query(found, k)
    fresh = knn_batch(keep(tail_ops.where("op = 'upsert' AND vector IS NOT NULL")), queries, k, metric).select("qid", "id", "dist")
    return rank_by_query(found.unionByName(fresh), k)


def hydrate(hits: DataFrame, documents: DataFrame, include_vectors: bool = False) -> DataFrame:
    """Hits with their attributes, and vectors if asked for."""
    cols = ["id", "attributes", *(["vector"] if include_vectors else [])]
    return hits.join(documents.select(*cols), "id")


def queries_of(spark, vectors: list) -> DataFrame:
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "qid long, vector array<double>").select("qid", F.col("vector"))
