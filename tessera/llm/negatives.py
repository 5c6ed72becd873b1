"""Hard-negative mining with rotated one-bit codes.

Vectors become integers. Each is rotated by a fixed random rotation (signs and Hadamard transforms, three times) and kept as the signs of its rotated components, one
bit each, with two numbers: its alignment with its code vector, and the length of what the code vector does not explain. An anchor's rotated components are rounded to a few bits, so
that its product with a code vector is a sum of popcounts. From that estimate, Cauchy's inequality on both remainders gives an interval that surely holds the inner
product. Rows whose interval misses all score windows of an anchor are dropped; the others are scored by integers.

Positives and negatives are the same search: the first k rows of the same (another) label whose score lies in a window, for each window of an anchor. Anchors and rows are dealt into
blocks of bounded size and each block pair is one task's work, which gives at most k rows a window. All anchors meet one block of rows first; where that fills a window, its k-th score raises the
window's lower end for all other blocks.

Defined results: rows with a null label, a null vector, or null or non-finite components take no part; a missing component counts as 0; ties go to the smaller id, rows
without one come last and are no anchors; rows that repeat an id are rows of their own, so an anchor leaves out only its own row; a negative positive score has no
negatives; an anchor without positives, or a positive whose window is empty, gives no rows; an empty table gives none; other columns are not looked at. Scores are exact; a component or a score
that 64 bits can't hold is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise
from tessera.llm.topk import exact_products
from tessera.llm.vectors import EXACT_DOUBLE, integers, matrix, norms

K, SCALE, PLANES, SEED = 5, 256, 4, 11
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Anchors that are scored together in a task: what a task holds besides its block of rows.
AT_ONCE = 128


def rotate(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows turned by a rotation that depends on the seed and the width only, padded to a power of two of at least 64."""
    width = max(64, 1 << max(0, x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    draw = np.random.default_rng(seed)
    for _ in range(3):
        out *= draw.integers(0, 2, width) * 2.0 - 1.0
        step = 1
        while step < width:
            pairs = out.reshape(len(out), -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), width)
            step *= 2
        out /= np.sqrt(width)
    return out


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, alignment, rest) of rows: signs of the rotated components, the product with the unit code vector, the length of the remainder."""
    turned = rotate(x)
    align = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    rest = np.sqrt(np.maximum(np.square(turned).sum(axis=1) - align**2, 0))
    return pack(turned > 0), align, rest


class Asked:
    """Anchors rounded to bit planes."""

    def __init__(self, x: np.ndarray, planes: int = PLANES) -> None:
        turned = rotate(x)
        self.width, self.size = turned.shape[1], norms(x)
        self.low = turned.min(axis=1)
        self.step = np.maximum(turned.max(axis=1) - self.low, 1e-300) / ((1 << planes) - 1)
        steps = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = [pack((steps >> j & 1).astype(np.uint8)) for j in range(planes)]
        rounded = self.low[:, None] + self.step[:, None] * steps
        self.total, self.off = rounded.sum(axis=1), norms(turned - rounded)

    def intervals(self, words: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) that hold the inner product of every anchor with every row."""
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        inside = np.zeros((len(self.size), len(words)))
        for j, plane in enumerate(self.planes):
            both = np.zeros(inside.shape, np.int64)
            for w in range(words.shape[1]):
                both += np.bitwise_count(plane[:, w, None] & words[None, :, w])
            inside += both * float(1 << j)
        # the rounded anchor times the unit code vector
        near = (2 * (self.low[:, None] * ones + self.step[:, None] * inside) - self.total[:, None]) / np.sqrt(self.width)
        least = np.maximum(np.abs(near) - self.off[:, None], 0)
        beside = np.sqrt(np.maximum(self.size[:, None] ** 2 - least**2, 0))  # of the anchor, off the code vector, at most
        half = align * self.off[:, None] + rest * beside
        slack = 1e-9 * (self.size[:, None] * np.hypot(align, rest) + 1)
        return align * near - half - slack, align * near + half + slack


def in_windows(x: np.ndarray, y: np.ndarray, codes: tuple, alike: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, window, row, score) of the first k rows in each window, rows in the order of ties, and how many pairs were scored.

    alike: the pairs that count; lows, highs: windows of each anchor, an empty one has low > high.
    """
    size = float(norms(x).max(initial=0) * norms(y).max(initial=0)) * (1 + 1e-9)
    low, high = Asked(x).intervals(*codes)
    middle = (low + high) / 2
    lows = lows.astype(float), lows.copy()
    ends = highs.astype(float)
    open_ = np.asarray(highs >= lows[1])
    n, k = len(y), min(k, len(y))
    slack = 1e-9 * (size + 1)
    alive = np.zeros(alike.shape, bool)
    for j in range(ends.shape[1]):
        # the k likeliest rows below the window's upper end: if all lie inside, rows below the least of them don't matter
        likely = np.argpartition(-np.where(alike & (middle <= ends[:, j, None]), middle, -np.inf), k - 1, axis=1)[:, :k]
        at = np.repeat(np.arange(len(x)), k)
        score = exact_products(x[at], y[likely.reshape(-1)], size).reshape(-1, k)
        full = np.take_along_axis(alike, likely, 1) & (score >= lows[1][:, j, None]) & (score <= highs[:, j, None])
        floor = np.where(full.all(axis=1), score.min(axis=1).astype(float), lows[0][:, j])
        alive |= (high >= floor[:, None] - slack) & (low <= ends[:, j, None] + slack) & open_[:, j, None]
    rows, cols = np.nonzero(alive & alike)
    if size < EXACT_DOUBLE and len(rows) >= alive.size // 8:
        score = np.rint((x.astype(float) @ y.astype(float).T)[rows, cols]).astype(np.int64)
    else:
        score = exact_products(x[rows], y[cols], size)
    order = np.lexsort((cols, -score.astype(float) if size < EXACT_DOUBLE else ~score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    out = []
    for j in range(ends.shape[1]):
        inside = np.flatnonzero((score >= lows[1][rows, j]) & (score <= highs[rows, j]))
        nth = np.arange(len(inside)) - np.searchsorted(rows[inside], rows[inside])
        inside = inside[nth < k]
        out.append((rows[inside], np.full(len(inside), j), cols[inside], score[inside]))
    return *(np.concatenate(z) for z in zip(*out, strict=True)), len(rows)


def coded(vectors: DataFrame, scale: int) -> tuple[DataFrame, int]:
    """(row, vec_id, label, vec, words, align, rest) as a stored table, and the width: the code words are stored with what they need."""
    kept = materialise(integers(vectors.filter("label is not null"), "embedding", scale, F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.monotonically_increasing_id().alias("row")), "negatives-vectors")
    width = max(1, kept.agg(F.max(F.size("vec"))).first()[0] or 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words, align, rest = code(matrix(batch.column(3), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([w.tobytes() for w in words], pa.binary()), pa.array(align), pa.array(rest)], ["vec_id", "label", "row", "vec", "words", "align", "rest"])

    rows = materialise(kept.mapInArrow(run, "vec_id long, label long, row long, vec array<long>, words binary, align double, rest double"), "negatives-codes")
    discard(kept)
    return rows, width


def search(rows: DataFrame, asked: DataFrame, width: int, same: bool, k: int, anchor_block: int, row_block: int, count: int) -> DataFrame:
    """(anchor_row, win, rank, vec_id, score): the first k rows of the same (another) label in each window. asked: (row, label, vec, lows, highs, anchor_block count n)."""
    m, blocks = max(1, -(-asked.count() // anchor_block)), max(1, -(-count // row_block))
    shape = "anchor_row long, win int, vec_id long, score long"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if a.num_rows and b.num_rows:
            ids = b["vec_id"]
            order = np.lexsort((b["row"].to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()))
            b = b.take(pa.array(order))
            x, y = matrix(a["vec"], width), matrix(b["vec"], width)
            words = np.frombuffer(b"".join(b["words"].to_pylist()), "<u8").reshape(b.num_rows, -1)
            codes = (words, b["align"].to_numpy(), b["rest"].to_numpy())
            windows = np.asarray(a["lows"].to_pylist(), np.int64), np.asarray(a["highs"].to_pylist(), np.int64)
            label, row = a["label"].to_numpy(), a["row"].to_numpy()
            for at in range(0, a.num_rows, AT_ONCE):
                part = slice(at, at + AT_ONCE)
                alike = ((label[part, None] == b["label"].to_numpy()[None, :]) == same) & (row[part, None] != b["row"].to_numpy()[None, :])
                one = in_windows(x[part], y, codes, alike, windows[0][part], windows[1][part], k)
                found.append((row[part][one[0]], one[1], one[2], one[3]))
        z = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table({"anchor_row": pa.array(z[0], pa.int64()), "win": pa.array(z[1], pa.int32()), "vec_id": b["vec_id"].combine_chunks().take(pa.array(z[2], pa.int64())) if found else pa.array([], pa.int64()), "score": pa.array(z[3], pa.int64())})

    def meet(asking: DataFrame, first: int, last: int) -> DataFrame:
        left = asking.select(F.pmod(F.xxhash64("row"), F.lit(m)).alias("q"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("c"), "row", "label", "vec", "lows", "highs")
        right = rows.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).filter(F.col("c").between(first, last))
        right = right.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
        return left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(run, shape)

    best = W.partitionBy("anchor_row", "win").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    near = materialise(meet(asked, 0, 0), "negatives-first")
    if blocks > 1:
        filled = near.groupBy("anchor_row", "win").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k)
        filled = filled.groupBy("anchor_row").agg(F.map_from_entries(F.collect_list(F.struct("win", "floor"))).alias("floors"))  # one entry a window
        known = asked.join(filled.withColumnRenamed("anchor_row", "row"), "row", "left")
        raised = F.transform("lows", lambda v, i: F.greatest(v, F.coalesce(F.try_element_at(F.col("floors"), i), v)))
        near = near.unionByName(meet(known.withColumn("lows", raised), 1, blocks - 1))
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, k: int = K, low_percent: int = 80, scale: int = SCALE, anchor_block: int = 2048, row_block: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors with ids divisible by ``every``: for each of their k best rows of the same label the k best of other labels that score at least ``low_percent`` of it and no more."""
    rows, width = coded(vectors, scale)
    count = rows.count()
    anchors = materialise(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "row", "label", "vec"), "negatives-asked")
    wide = anchors.withColumns({"lows": F.array(F.lit(LOWEST)), "highs": F.array(F.lit(HIGHEST))})
    best = materialise(search(rows, wide, width, True, k, anchor_block, row_block, count).select("anchor_row", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    top, rest = F.col("positive_score"), 100 - low_percent
    least = top - (F.expr("positive_score div 100") * rest + F.expr(f"positive_score % 100 * {rest} div 100"))  # the least whole number of at least low_percent; positive scores only
    # a window for each place of a positive: those that are not there, or negative, are empty
    each = best.filter(top >= 0).groupBy("anchor_row").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct(least.alias("low"), top.alias("high"))))).alias("told"))
    ends = lambda part, none: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.coalesce(F.try_element_at(F.col("told"), i)[part], F.lit(none).cast("long")))
    asked = anchors.join(each.withColumnRenamed("anchor_row", "row"), "row").withColumns({"lows": ends("low", HIGHEST), "highs": ends("high", LOWEST)}).drop("told")
    asked = materialise(asked, "negatives-anchors")
    found = search(rows, asked, width, False, k, anchor_block, row_block, count).select("anchor_row", (F.col("win") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best.withColumnRenamed("rank", "place").join(asked.select("anchor_id", F.col("row").alias("anchor_row")), "anchor_row")
    return named.join(found, ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
