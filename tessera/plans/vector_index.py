"""A stored index for vector search: cells around centroids, probed from the nearest on, with exact scores.

Directions are dealt to cells by k-means. The centroids come from a sample of at most ``SAMPLE`` vectors, of the least hashes of their ids; every vector lies in the cell of its nearest centroid. How many cells a search probes is measured when
the index is built: at most ``ASKED`` vectors ask for their neighbours among all, and as many cells are probed as hold the share ``RECALL`` of these. The exact way reads further: all cells that may hold a better
neighbour by the triangle inequality (a cell's radius is the greatest distance in it).

Cells are buckets of ``versions``: an update rewrites the cells it touches, centroids stay. Vectors are of one length; null, zero and other vectors are not indexed and find nothing.

A vector may lie there with the groups that may read it (column ``allowed_groups``); a search with ``access`` sees no other. An index that was built without groups is closed to such a search.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators import access as acl
from tessera.operators.search import matrix, meet_in_blocks, usable, vector_top_k
from tessera.plans import store, versions

CELLS, SAMPLE, ASKED, RECALL, ROUNDS = 4096, 1 << 16, 256, 0.95, 12
#: The bucket of the centroids, and how much wider than told distances may be.
CENTROIDS, SLACK = -1, 1e-6


#: Rows that a task gives at once, and vectors that meet all centroids at once.
ROWS, STEP = 1 << 14, 1024


def _unit(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = matrix(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _gaps(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The distances of unit vectors from all centroids."""
    return np.sqrt(np.maximum(2 - 2 * (x @ centroids.T), 0))


def fit(x: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Centroids of unit vectors; empty cells take the vectors that lie worst."""
    draw = np.random.default_rng(seed)
    centroids = x[draw.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        cell, best = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), STEP):
            close = x[at : at + STEP] @ centroids.T
            cell[at : at + STEP], best[at : at + STEP] = close.argmax(axis=1), close.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        empty = np.flatnonzero(np.bincount(cell, minlength=len(centroids)) == 0)
        sums[empty] = x[np.argsort(best)[: len(empty)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centroids)
    return centroids


def _nearest(rows: DataFrame, name: str, centroids: np.ndarray) -> DataFrame:
    """(name, vec, groups, cell, gap) of each row's nearest cell."""
    sent, kind = rows.sparkSession.sparkContext.broadcast(centroids), rows.schema[name].dataType

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, STEP) for at in range(0, batch.num_rows, STEP)):
                gaps = _gaps(_unit(part.column(1)), sent.value)
                cell = gaps.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(gaps[np.arange(len(cell)), cell])], [name, "vec", "groups", "cell", "gap"])

    to_arrow_type(kind)  # ids that Arrow does not know fail here
    return rows.select(name, F.col("vec").cast("array<double>").alias("vec"), "groups").mapInArrow(run, f"{name} {kind.simpleString()}, vec array<double>, groups array<string>, cell int, gap double")


def _asking(asked: DataFrame, centroids: np.ndarray, bins: np.ndarray, probes: int, radius: np.ndarray | None = None) -> DataFrame:
    """(qid, vec, groups, bin, cells): what each query asks of which bin: its nearest cells, ``probes`` of them; or, with the cells' radius, of all others those that may hold a vector as near as its ``reach`` (null: any)."""
    sent, kind = asked.sparkSession.sparkContext.broadcast((centroids, bins, radius)), asked.schema["qid"].dataType
    step = max(1, min(STEP, ROWS // (1 + len(np.unique(bins)))))

    def run(batches):
        centroids, bins, radius = sent.value
        order = np.argsort(bins, kind="stable")
        for part in (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step)):
            gaps = _gaps(_unit(part.column(1)), centroids)
            wanted = np.zeros(gaps.shape, bool)
            np.put_along_axis(wanted, np.argsort(gaps, axis=1, kind="stable")[:, :probes], True, axis=1)
            if radius is not None:
                reach = part.column(3).fill_null(np.inf).to_numpy(zero_copy_only=False)
                wanted = ~wanted & (gaps - radius <= reach[:, None] + SLACK)
            row, at = np.nonzero((wanted & (bins >= 0))[:, order])  # cells without rows lie in no bin
            if not len(row):
                continue
            bin_of, cell = bins[order][at], order[at]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bin_of[1:] != bin_of[:-1])])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(cell, pa.int32()))
            own = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(own) for i in range(3)), pa.array(bin_of[first], pa.int32()), lists], ["qid", "vec", "groups", "bin", "cells"])

    return asked.select("qid", "vec", "groups", *([] if radius is None else ["reach"])).mapInArrow(run, f"qid {kind.simpleString()}, vec array<double>, groups array<string>, bin int, cells array<int>")


def _with_groups(rows: DataFrame, column: str, name: str, there: bool) -> DataFrame:
    """(name, vec, groups): the groups in the column without case, null where there are none."""
    return rows.select(name, "vec", (acl.folded(F.col(column)) if there else F.lit(None).cast("array<string>")).alias("groups"))


def _stored(rows: DataFrame, name: str = "id") -> DataFrame:
    return rows.select(F.col("cell").alias("bucket"), "cell", F.col(name).alias("id"), "vec", "gap", F.lit(0).alias("probes"), F.col("groups").alias("allowed"))


def build(spark: SparkSession, vectors: DataFrame, index: str, cells: int | None = None) -> int:
    """Indexes (id, vec) and, if there are any, allowed_groups, in place of what the index held, and gives the number of cells a search probes."""
    base = versions.version(spark, index)
    good = _with_groups(vectors.filter(usable("vec")), "allowed_groups", "id", "allowed_groups" in vectors.columns)
    dimension = good.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    good = good.filter(F.size("vec") == (dimension.d if dimension else 0))
    n = dimension.n if dimension else 0
    k = cells or max(1, min(CELLS, round(math.sqrt(n))))
    probes, centroids = 1, np.zeros((0, 0))
    if n:
        # by the hash of the id, of which an even share is taken: no task hands a whole sample to the driver
        wanted = min(SAMPLE, 64 * k)
        some = good.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(math.ceil((1 << 40) * min(1, wanted / n)))).orderBy(F.xxhash64("id"), "id")
        sample = some.select(F.col("vec").cast("array<double>").alias("vec")).limit(2 * wanted).toArrow()
        if not sample.num_rows:  # hardly any
            sample = good.select(F.col("vec").cast("array<double>").alias("vec")).limit(wanted).toArrow()
        centroids = fit(_unit(sample["vec"]), k)
        rows = store.materialise(_nearest(good, "id", centroids), "cells")
        asked = good.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(ASKED).select(F.col("id").alias("qid"), F.col("vec").cast("array<double>").alias("vec"), "groups")
        asked = store.materialise(asked, "cells-asked")
        # at most 20 rows for each of the few that ask
        true = vector_top_k(good, asked, 20).select("qid", "id").join(rows.select("id", "cell"), "id").select("qid", "cell").collect()
        known = asked.select("qid", "vec").toArrow()
        place = np.argsort(np.argsort(_gaps(_unit(known["vec"]), centroids), axis=1, kind="stable"), axis=1)
        at = {q: i for i, q in enumerate(known["qid"].to_pylist())}
        found = np.cumsum(np.bincount([place[at[r.qid], r.cell] for r in true], minlength=len(centroids))) if true else np.ones(1)
        probes = 1 + int(np.searchsorted(found / found[-1], RECALL))
    kind = good.schema["id"].dataType.simpleString()
    told = spark.createDataFrame([(CENTROIDS, i, [float(v) for v in c], 0.0, probes) for i, c in enumerate(centroids)], "bucket int, cell int, vec array<double>, gap double, probes int")
    told = told.select("bucket", "cell", F.lit(None).cast(kind).alias("id"), "vec", "gap", "probes", F.lit(None).cast("array<string>").alias("allowed"))
    whole = told.unionByName(_stored(rows)) if n else told
    changed = {CENTROIDS, *range(len(centroids))} | versions.folders(spark, index, base).keys()
    versions.commit(spark, index, base, len(centroids), changed, versions.write(whole, index))
    return probes


def _centroids(spark: SparkSession, index: str, at: versions.Version | None) -> tuple[np.ndarray, int]:
    shape = "cell int, vec array<double>, probes int"
    rows = sorted(versions.read(spark, index, shape, at, {CENTROIDS}).collect(), key=lambda r: r.cell)  # at most CELLS
    return np.asarray([r.vec for r in rows], float), rows[0].probes if rows else 1


def _cells(spark: SparkSession, index: str, at: versions.Version, cells: set[int], kind: str) -> DataFrame:
    return versions.read(spark, index, f"cell int, id {kind}, vec array<double>, gap double, probes int, allowed array<string>", at, cells - {CENTROIDS})


def update(spark: SparkSession, index: str, changed: DataFrame, removed: DataFrame | None = None) -> set[int]:
    """Puts (id, vec) and, if there are any, allowed_groups in, in place of older vectors of these ids, takes out the ids of ``removed``, and gives the cells that were written."""
    base = versions.version(spark, index)
    centroids, _ = _centroids(spark, index, base)
    if not len(centroids):
        raise ValueError("the index holds no vectors: build it")
    kind = changed.schema["id"].dataType.simpleString()
    fit_in = _with_groups(changed.filter(usable("vec") & (F.size("vec") == centroids.shape[1])), "allowed_groups", "id", "allowed_groups" in changed.columns)
    rows = store.materialise(_nearest(fit_in, "id", centroids), "cells-changed")
    gone = changed.select("id") if removed is None else changed.select("id").unionByName(removed.select("id"))
    gone = store.materialise(gone.distinct(), "cells-gone")
    held = _cells(spark, index, base, set(versions.folders(spark, index, base)), kind)
    old = held.select("cell", "id").join(gone, "id", "left_semi").select("cell").distinct()
    touched = {r.cell for r in old.unionByName(rows.select("cell").distinct()).distinct().collect()}  # at most CELLS
    stay = _cells(spark, index, base, touched, kind).join(gone, "id", "left_anti")
    data = versions.write(_stored(rows.unionByName(stay.select("id", "vec", F.col("allowed").alias("groups"), "cell", "gap"))), index)
    # another writer may have put an id into a cell that is not read here, so all cells count as read
    versions.commit(spark, index, base, base.buckets, touched, data)
    return touched


def search(spark: SparkSession, index: str, queries: DataFrame, k: int = 20, probes: int | None = None, exact: bool = False, own: bool = True, block: int = 8192, query_block: int = 2048, access: bool = False) -> DataFrame:
    """(qid, id, score, rank) by cosine for (qid, vec), as ``search.vector_top_k`` gives them: of the probed cells, or exactly. own: queries never find their own id.

    access: a query finds only vectors whose groups hold one of its ``groups``; this always takes the exact way, as the groups may hide what the probed cells hold.
    """
    exact = exact or access
    at = versions.version(spark, index)
    centroids, told = _centroids(spark, index, at)
    kind = queries.schema["qid"].dataType.simpleString()
    if not len(centroids):
        return queries.select("qid", F.lit(None).cast(kind).alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    asked = _with_groups(queries.filter(usable("vec") & (F.size("vec") == centroids.shape[1])), "groups", "qid", access)
    asked = store.materialise(asked.withColumn("vec", F.col("vec").cast("array<double>")), "cells-queries")
    sizes = {b: n for b, (_, n, _) in versions.folders(spark, index, at).items() if b != CENTROIDS}
    # cells that follow each other share a bin of at most ``block`` rows; a larger cell is a bin of its own, which is dealt into blocks
    bins, held = np.full(len(centroids), -1), []
    for cell, n in sorted(sizes.items()):
        if not held or held[-1] + n > block:
            held.append(0)
        bins[cell] = len(held) - 1
        held[-1] += n

    def numbers(of: dict[int, int], key: str) -> Column:
        return F.create_map(*(F.lit(x) for pair in of.items() for x in pair))[F.col(key)]

    def meet(pairs: DataFrame) -> DataFrame:
        """pairs: (qid, vec, groups, bin, cells). A bin's rows and queries are dealt into blocks."""
        asking = {r.bin: -(-r.n // query_block) for r in pairs.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CELLS
        cells = {r.cell for r in pairs.select(F.explode("cells").alias("cell")).distinct().collect()}  # at most CELLS
        if not cells:
            return asked.select("qid", F.lit(None).cast(kind).alias("id"), F.lit(0.0).alias("score")).limit(0)
        split = {b: -(-held[b] // block) for b in asking}
        rows = _cells(spark, index, at, cells, kind).withColumn("bin", numbers({c: int(bins[c]) for c in cells}, "cell"))
        left = pairs.select("bin", F.pmod(F.xxhash64("qid"), numbers(asking, "bin")).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), numbers(split, "bin") - 1)).alias("v"), "qid", "vec", "groups", "cells")
        right = rows.select("bin", F.explode(F.sequence(F.lit(0), numbers(asking, "bin") - 1)).alias("q"), F.pmod(F.xxhash64("id"), numbers(split, "bin")).cast("int").alias("v"), "id", "vec", "allowed", "cell")
        return meet_in_blocks(left, right, ["bin", "q", "v"], k, own, access, cells=True)

    best = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    near = store.materialise(_asking(asked, centroids, bins, probes or told), "cells-probed")
    found = store.materialise(meet(near), "cells-found")
    if exact:
        radius = np.zeros(len(centroids))
        for r in _cells(spark, index, at, set(sizes), kind).groupBy("cell").agg(F.max("gap").alias("radius")).collect():  # at most CELLS
            radius[r.cell] = r.radius
        kth = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("qid", F.sqrt(F.greatest(2 - 2 * (F.col("score") - SLACK), F.lit(0.0))).alias("reach"))
        # merged: a query's vector is wider than Spark takes it for
        more = store.materialise(_asking(asked.hint("merge").join(kth, "qid", "left"), centroids, bins, probes or told, radius), "cells-more")
        found = found.unionByName(meet(more))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
