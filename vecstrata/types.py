"""Schemas, settings and errors of the vector engine."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

#: A scalar attribute with its kind: null, bool, u64, f64 or string.
ATTRIBUTE = "STRUCT<kind: STRING, b: BOOLEAN, u: DECIMAL(20,0), f: DOUBLE, s: STRING>"
ATTRIBUTES = f"MAP<STRING, {ATTRIBUTE}>"
DOCUMENT_SCHEMA = f"id BIGINT, vector ARRAY<FLOAT>, attributes {ATTRIBUTES}"
WAL_SCHEMA = f"op_idx INT, doc_idx BIGINT, op STRING, ts_ms BIGINT, {DOCUMENT_SCHEMA}"
STATE_SCHEMA = f"{DOCUMENT_SCHEMA}, last_seq BIGINT"
HEADS_SCHEMA = "head_id BIGINT, centroid ARRAY<DOUBLE>, active BOOLEAN"
POSTINGS_SCHEMA = "head_id BIGINT, vector_id BIGINT, version BIGINT, vector ARRAY<FLOAT>"
VERSIONS_SCHEMA = "vector_id BIGINT, version BIGINT, deleted BOOLEAN"

DEFAULT_TOP_K = 10


class Metric(StrEnum):
    COSINE = "cosine_distance"
    L2 = "euclidean_squared"
    DOT = "dot_product"


@dataclass(frozen=True)
class IndexConfig:
    """Settings of the centroid/posting-list index; the metric default is squared L2."""

    max_posting_size: int = 256
    replica_count: int = 4
    rng_factor: float = 2.0
    num_search_heads: int = 64
    reassign_range: int = 64
    max_split_depth: int = 10
    metric: str = Metric.L2


class EngineError(Exception):
    status = 500

    def body(self) -> dict:
        return {"error": str(self)}


class NotFound(EngineError):
    status = 404


class AlreadyExists(EngineError):
    status = 409


class WriteConflict(EngineError):
    status = 500


class ValidationError(EngineError):
    status = 400


class DimensionMismatch(ValidationError):
    pass
