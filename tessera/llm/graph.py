"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Ties every node's larger (or smaller) neighbours to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("_m"))
    tied = both.join(least, "a")
    if large:
        out = tied.filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) of every node of edges (a, b); root is the component's least id. Each round is written, so none is ever redone, and the one before goes.

    Rounds double what a path is shortened by; edges that still change after ``max_rounds`` are an error, never a half-joined answer.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    for _ in range(max_rounds):
        old, now = now, materialise(_star(_star(now, True), False), "components")
        discard(old)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
