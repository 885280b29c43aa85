"""Connected components of a graph that may be larger than any one machine.

Alternating large-star and small-star steps: each is one grouped minimum (combined on the
map side, so a hub costs no task more than others) and one join that adaptive execution
can split.  Every step's edges are written to shared scratch, the step before is deleted,
and the loop ends when two steps, one of each, change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..scratch import discard
from .common import written as materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node u (only larger ones, or only smaller ones and u
    itself) to the smallest of u and its neighbours, for written ``edges`` (a < b).

    What needs two rows of an edge makes them in place: a union would repeat all that stands
    above it, and adaptive execution plans and reports the whole plan anew after each stage."""
    pair = lambda x, u, y, v: F.struct(F.col(u).alias(x), F.col(v).alias(y))
    own = pair("u", "b", "v", "a")
    both = edges.select(F.inline(F.array(own, pair("u", "a", "v", "b")) if large else F.array(own)))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(low.hint("merge"), "u")  # at no size by broadcast: a dozen rounds would leave theirs on the driver
    if large:
        out = joined.where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        out = joined.select(F.inline(F.array(pair("b", "v", "a", "m"), pair("b", "u", "a", "m"))))
    return out.where("a <> b").select("a", "b").distinct()


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, and their count and a sum of their hashes, taken as they are written."""
    seen = Observation()
    hashes = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    now = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), hashes.alias("hashes")), "edges")
    return now, (seen.get["n"], seen.get["hashes"])


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges`` (a, b).
    Nodes without an edge to another node are not listed."""
    now, state = _settled(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(most):
        if not state[0]:
            break
        half = materialize(_star(now, True), "edges")
        discard(now)
        after, then = _settled(_star(half, False))
        discard(half)
        before, now, state = state, after, then
        if state == before:
            break
    else:
        raise RuntimeError(f"components still change after {most} rounds")
    of_others = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return of_others.union(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
