"""Exact top-k by inner product with multi-resolution segment bounds.

Vectors become integers. For a split of the components into segments, Cauchy's inequality on segment means and
deviations bounds the inner product from above (so the distance from below):
x.y <= sum m (mean_x mean_y + dev_x dev_y). Bounds are taken coarse to fine; only pairs whose bound reaches the
k-th best exact score so far get their exact score.

Equal vectors form one class with the ids of its k + 1 least rows, which is enough for every answer, so a vector that many rows share
costs as much as one. Queries and classes are dealt into blocks of bounded size; each block pair is one task's work. All queries
meet one block first: their k + 1 best there set the threshold that every other block prunes by, so a block returns only what may still
be among the k + 1 best classes of a query.

Scores are exact integers. Components are 64-bit; where norms allow sums of 2**53 or more, survivors are scored by 64-bit integers, and where
they allow 2**63 or more by unbounded ones. A component or a score that 64 bits can't hold is an error, never a rounded answer.

Defined results: vectors null or holding null or non-finite components take no part; a missing component counts as 0; ties go to the smaller id; every row
is a candidate of its own, so rows that repeat an id answer as often as they occur, and a query leaves out only its own row; no
candidates give no rows for a query; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialise

LEVELS = (4, 16)


def quantise(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vec): floor(scale * x) as little-endian 64-bit integers, valid rows only."""
    xs = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            exact = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
            if np.abs(exact).max(initial=0) >= 2.0**63:
                raise OverflowError("a component times the scale does not fit 64 bits")
            flat = exact.astype("<i8")
            ends = np.cumsum(np.append(0, lists.value_lengths().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["vec_id", "vec"])

    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), xs.alias("_xs")).mapInArrow(run, "vec_id long, vec binary")


def _matrix(cells: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(c.ljust(8 * width, b"\0") for c in cells), "<i8").reshape(len(cells), width)


def exact_products(x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """Row-wise inner products of integer rows; reach: a bound of their size."""
    if reach < 2.0**53:
        return np.rint(np.einsum("pd,pd->p", x.astype(float), y.astype(float))).astype(np.int64)
    if reach < 2.0**63:
        return np.einsum("pd,pd->p", x, y)
    out = [sum(a * b for a, b in zip(p, q, strict=True)) for p, q in zip(x.tolist(), y.tolist(), strict=True)]
    if any(not -(1 << 63) <= v < 1 << 63 for v in out):
        raise OverflowError("an inner product does not fit 64 bits")
    return np.asarray(out, np.int64)


def _summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Segment means and deviations, scaled so that a plain product of two summaries is the bound."""
    pad = -x.shape[1] % segments
    parts = np.pad(x, ((0, 0), (0, pad))).reshape(len(x), segments, -1)
    return np.concatenate([parts.mean(2), parts.std(2)], axis=1) * np.sqrt(parts.shape[2])


def best_of_block(queries: np.ndarray, others: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best of a block for each query, ties to smaller ids; floor: scores below which a query needs none."""
    order = np.argsort(ids, kind="stable")
    others, ids = others[order], ids[order]
    k = min(k, len(ids))
    levels = [s for s in levels if s < queries.shape[1]] or [1]
    x, y = queries.astype(float), others.astype(float)
    size = float(np.linalg.norm(x, axis=1).max() * np.linalg.norm(y, axis=1).max()) * (1 + 1e-9)
    slack = 1e-9 * (size + 1)
    sums = [(_summary(x, s), _summary(y, s)) for s in levels]
    out: list[tuple] = []
    for at in range(0, len(x), 256):
        q = x[at : at + 256]
        bound = sums[0][0][at : at + 256] @ sums[0][1].T
        first = np.argpartition(-bound, k - 1, axis=1)[:, :k]
        reach = np.einsum("qd,qkd->qk", q, y[first]).min(axis=1)  # k scores: the k-th best is no less
        if floor is not None:
            reach = np.maximum(reach, floor[at : at + 256])
        rows, cols = np.nonzero(bound >= (reach - slack)[:, None])
        for finer_q, finer_x in sums[1:]:
            keep = np.einsum("pd,pd->p", finer_q[at + rows], finer_x[cols]) >= reach[rows] - slack if len(rows) < bound.size // 8 else (finer_q[at : at + 256] @ finer_x.T)[rows, cols] >= reach[rows] - slack
            rows, cols = rows[keep], cols[keep]
        if size < 2.0**53 and len(rows) >= bound.size // 8:
            score = np.rint((q @ y.T)[rows, cols]).astype(np.int64)
        else:
            score = exact_products(queries[at + rows], others[cols], size)
        if floor is not None:
            keep = score >= floor[at + rows] - slack
            rows, cols, score = rows[keep], cols[keep], score[keep]
        best = np.lexsort((cols, -score, rows))
        rows, cols, score = rows[best], cols[best], score[best]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        take = nth < k
        out.append((rows[take] + at, ids[cols[take]], score[take]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, query_block: int = 4096, class_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by ``every``."""
    rows = materialise(quantise(vectors, scale), "topk-vectors")
    least = W.partitionBy("vec").orderBy("vec_id")
    members = rows.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1)
    members = materialise(members.groupBy("vec").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "topk-classes")
    # a class is named by its least id and a number, as other vectors may stand under that id
    named = members.withColumn("class_key", F.struct("class_id", F.xxhash64("vec").alias("h")))
    copy = F.row_number().over(W.partitionBy("vec_id", "vec").orderBy(F.lit(0)))
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("copy", copy)
    asked = materialise(asked.join(named.select("vec", "class_key"), "vec").select(F.col("vec_id").alias("query_id"), "copy", F.col("class_key").alias("query_class"), "vec"), "topk-queries")
    queries = asked.groupBy("query_class").agg(F.first("vec").alias("vec"))
    n, m = members.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // class_block)), max(1, -(-m // query_block))
    key = "class_id long, h long"
    shape = f"query_class struct<{key.replace(' long', ':long')}>, class_key struct<{key.replace(' long', ':long')}>, score long"
    kind = pa.struct([("class_id", pa.int64()), ("h", pa.int64())])

    def run(a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_class": pa.array([], kind), "class_key": pa.array([], kind), "score": pa.array([], pa.int64())})
        left, right = a["vec"].to_pylist(), b["vec"].to_pylist()
        width = max(1, max(map(len, left + right)) // 8)
        order = np.lexsort((b["h"].to_numpy(), b["id"].to_numpy()))
        floor = a["floor"].to_numpy() if a["floor"].null_count == 0 else None
        found = best_of_block(_matrix(left, width), _matrix([right[i] for i in order], width), np.arange(len(order)), k + 1, floor)
        at = order[found[1]]
        keys = lambda ids, hs: pa.StructArray.from_arrays([pa.array(ids), pa.array(hs)], fields=list(kind))
        return pa.table({"query_class": keys(a["id"].to_numpy()[found[0]], a["h"].to_numpy()[found[0]]), "class_key": keys(b["id"].to_numpy()[at], b["h"].to_numpy()[at]), "score": found[2]})

    def meet(asking: DataFrame, first: int, last: int) -> DataFrame:
        """Queries (query_class, vec, floor) against the blocks from first to last."""
        left = asking.select(F.pmod(F.xxhash64("query_class"), F.lit(query_blocks)).alias("q"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("c"), F.col("query_class.class_id").alias("id"), F.col("query_class.h").alias("h"), "vec", "floor")
        right = named.withColumn("c", F.pmod(F.xxhash64("class_key"), F.lit(blocks)).cast("int")).filter(F.col("c").between(first, last))
        right = right.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("q"), "c", F.col("class_key.class_id").alias("id"), F.col("class_key.h").alias("h"), "vec")
        return left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(run, shape)

    near = materialise(meet(queries.withColumn("floor", F.lit(None).cast("double")), 0, 0), "topk-first")
    if blocks > 1:
        floors = near.groupBy("query_class").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("floor"))
        known = queries.join(floors, "query_class", "left").withColumn("floor", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))))
        near = near.unionByName(meet(known, 1, blocks - 1))
    # k + 1 classes are enough: each but the query's own has a row that beats those of any further class
    order = W.partitionBy("query_class").orderBy(F.desc("score"), "class_key")
    near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n")
    met = near.join(named.select("class_key", "ids"), "class_key").join(asked.select("query_id", "copy", "query_class"), "query_class")
    each = met.select("query_id", "copy", "query_class", "class_key", "score", F.array_position("ids", F.col("query_id")).alias("own"), F.posexplode("ids").alias("at", "vec_id"))
    # of a query's own class one row of its id is the query itself
    each = each.filter((F.col("class_key") != F.col("query_class")) | (F.col("own") != F.col("at") + 1))
    rank = F.row_number().over(W.partitionBy("query_id", "query_class", "copy").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
