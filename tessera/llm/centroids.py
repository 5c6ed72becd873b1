"""Centroid clustering by exact integer k-means with Ptolemaic pivots.

Vectors become integers. Pivots are some fixed vectors of the table; each vector's distances to them are computed once and stored with it. For
a pair of pivots p, s Ptolemy's inequality d(x,c) d(p,s) >= |d(x,p) d(c,s) - d(x,s) d(c,p)| bounds the distance of vector and centroid from
below, from the stored distances and those of the few centroids. A vector meets the centroid of the least bound first; only centroids whose bound reaches that
distance are met, exactly. Stored distances stand for intervals a little wider than rounding can make them, so that no nearest centroid is ever
left out and ties are seen.

Every round is one pass over the stored table: tasks sum what they assign (rows of components by cluster, a few hundred a task), Spark adds
up the sums, and the driver holds the centroids only (k vectors). A round that moves no centroid ends the rounds, as further ones would repeat it.

Defined results: vectors null, of another length, or holding null or non-finite components take no part; rows without an id take part, their id is hashed as an
empty text; rows that repeat an id are vectors of their own; ties of hashes go by the vector; fewer vectors than k make as many centroids, an empty table none and no
rows; equal vectors among the first centroids are allowed: the smaller number gets the vectors, the other stays empty and where it was; sums are exact (38 digits);
a squared distance of the result that 64 bits can't hold is an error. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise
from tessera.llm.vectors import EXACT_DOUBLE, EXACT_LONG, integers, lists, matrix, norms

K, ROUNDS, SCALE, WIDTH, PIVOTS = 8, 10, 1024, 64, 6
#: What a stored distance may be off by, as a share of the lengths of both vectors; far above what doubles round.
MARGIN = 1e-12


def exact_distances(x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """Squared distances of rows x to rows (or one row) y; reach: a bound of their size. Beyond 64 bits they are unbounded integers."""
    if reach < EXACT_DOUBLE:
        gap = x.astype(float) - y
        return np.einsum("pd,pd->p", gap, gap).astype(np.int64)
    gap = x - y if reach < EXACT_LONG else x.astype(object) - y.astype(object)
    return (gap * gap).sum(axis=1)


class Pivots:
    """Fixed pivots, their pairs, and bounds from distances to them."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.rows = pivots.astype(float)
        self.sizes = norms(pivots) if len(pivots) else np.zeros(0)
        gaps = self.distances(pivots) if len(pivots) else np.zeros((0, 0))
        pairs = [(i, j) for i in range(len(pivots)) for j in range(i) if gaps[i, j] > 0]
        self.first, self.second = np.asarray([p[0] for p in pairs], int), np.asarray([p[1] for p in pairs], int)
        slack = MARGIN * (self.sizes[self.first] + self.sizes[self.second])
        self.apart = gaps[self.first, self.second] + slack

    def distances(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.stack([norms(x - p) for p in self.rows], axis=1) if len(self.rows) else np.zeros((len(x), 0))

    def bounds(self, of_x: np.ndarray, size_x: np.ndarray, of_c: np.ndarray, size_c: np.ndarray) -> np.ndarray:
        """Lower bounds of d(x, c) for every row and centroid, from their distances to the pivots and their lengths."""
        off_x, off_c = MARGIN * (size_x[:, None] + self.sizes), MARGIN * (size_c[:, None] + self.sizes)
        low_x, high_x, low_c, high_c = np.maximum(of_x - off_x, 0), of_x + off_x, np.maximum(of_c - off_c, 0), of_c + off_c
        out = np.zeros((len(of_x), len(of_c)))
        for p, s, apart in zip(self.first, self.second, self.apart, strict=True):
            for a, b in ((p, s), (s, p)):
                np.maximum(out, (np.outer(low_x[:, a], low_c[:, b]) - np.outer(high_x[:, b], high_c[:, a])) / apart, out=out)
        return out * (1 - MARGIN)


def nearest(x: np.ndarray, of_x: np.ndarray, pivots: Pivots, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance, distances computed) of each row; ties go to the smaller number."""
    size_x, size_c = norms(x), norms(centroids)
    reach = float((size_x.max(initial=0) + size_c.max()) ** 2 * (1 + 1e-9))
    low = pivots.bounds(of_x, size_x, pivots.distances(centroids), size_c)
    cluster = low.argmin(axis=1)
    best, met = exact_distances(x, centroids[cluster], reach), len(x)
    first = cluster.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((first != c) & (low[:, c] <= np.sqrt(best.astype(float)) * (1 + MARGIN)))
        found = exact_distances(x[rows], centroids[c], reach)
        met += len(rows)
        closer = (found < best[rows]) | ((found == best[rows]) & (c < cluster[rows]))
        best[rows[closer]], cluster[rows[closer]] = found[closer], c
    return cluster, best, met


def _sums(rows: DataFrame, pivots: Pivots, centroids: np.ndarray) -> DataFrame:
    """(cluster, dim, n, total) of each task: how many vectors a centroid got and the sums of their components."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals = np.zeros(k, np.int64), np.zeros((k, width), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0), width)
            cluster, _, _ = nearest(x, matrix(batch.column(1), len(pivots.rows)), pivots, centroids)
            safe = float(np.abs(x.astype(float)).max()) * len(x) < 2.0**62
            for c in np.unique(cluster):
                own = x[cluster == c]
                held[c] += len(own)
                totals[c] += (own if safe else own.astype(object)).sum(axis=0).astype(object)
        got = np.flatnonzero(held)
        cells = [Decimal(int(v)) for c in got for v in totals[c]]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(got, width), pa.int32()), pa.array(np.tile(np.arange(width), len(got)), pa.int32()), pa.array(np.repeat(held[got], width)), pa.array(cells, pa.decimal128(38, 0))], ["cluster", "dim", "n", "total"])

    return rows.select("vec", "to_pivots").mapInArrow(run, "cluster int, dim int, n long, total decimal(38,0)")


def _assigned(rows: DataFrame, pivots: Pivots, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, best, _ = nearest(matrix(batch.column(1), centroids.shape[1]), matrix(batch.column(2), len(pivots.rows)), pivots, centroids)
            if best.dtype == object and max(best) >= 1 << 63:
                raise OverflowError("a squared distance does not fit 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(best.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "vec", "to_pivots").mapInArrow(run, "vec_id long, cluster int, distance long")


def _drawn(rows: DataFrame, prefix: str, n: int) -> np.ndarray:
    """The n vectors of the smallest hashes of their ids (n is small: they are kept on the driver)."""
    told = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(told.alias("h"), "vec").orderBy("h", "vec").limit(n).collect()
    return np.asarray([r.vec for r in sorted(found, key=lambda r: (r.h, r.vec))], np.int64)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of this width."""
    spark = vectors.sparkSession
    kept = materialise(integers(vectors.filter(F.size("embedding") == width), "embedding", scale, F.col("vec_id").cast("long").alias("vec_id")), "centroids-vectors")
    centroids = _drawn(kept, "3:", k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    fixed = Pivots(_drawn(kept, "pivot:", pivots))

    def cache(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(fixed.distances(matrix(batch.column(1), width)))], ["vec_id", "vec", "to_pivots"])

    rows = materialise(kept.mapInArrow(cache, "vec_id long, vec array<long>, to_pivots array<double>"), "centroids-rows")
    discard(kept)
    for _ in range(rounds):
        moved = centroids.copy()
        for r in _sums(rows, fixed, centroids).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # k * width rows
            moved[r.cluster, r.dim] = int(r.total) // r.n
        if (moved == centroids).all():
            break
        centroids = moved
    out = materialise(_assigned(rows, fixed, centroids), "centroids-assigned")
    discard(rows)
    sums = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    if sum(sums.values()) >= 1 << 63:
        raise OverflowError("the inertia does not fit 64 bits")
    told = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    named = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
