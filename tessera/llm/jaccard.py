"""N-gram Jaccard join by MinHash banding.

Texts become sets of word n-grams. Texts with equal sets form one class, so exact copies cost as much as one text.
Bands and rows are chosen from the target recall at the threshold; classes are dealt by band hashes and the buckets they share tie
them into candidate groups (components, found by alternating stars, never in one task). Inside a group pairs are verified on
the full n-gram sets. Groups of few texts are dealt many to a task, by their size in n-grams. Larger groups are parted by size class first: sets whose sizes differ by more than
the threshold can't be linked, so a class meets itself and the next one only, as pairs of blocks bounded in rows and n-grams. A task returns for each class the
number of its links and its place in a spanning forest, never the pairs, so that pairs are neither shuffled nor stored, and no link between different texts is lost
inside a group. What a group costs beyond that: its texts are sent once for each block that theirs meets.

Defined results: words are runs of other characters than blank and the controls 9 to 13, A-Z lower-cased; a text of fewer words than n is one n-gram of all its
words; null, empty and blank texts have no n-grams and no links; repeated rows are copies of each other, every row has the links of its own text; a class
or group is named by its least id, by null if all its ids are null (``class_key`` tells such groups apart); an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, marked, materialise, maybe_in, slices
from tessera.llm.graph import components

N, THRESHOLD, RECALL = 5, 0.8, 0.999
SMALL, BLOCK = 64, 1024
#: n-grams (8 bytes each) of a block of a large group, and of the small groups that meet in one task.
BLOCK_GRAMS, TASK_GRAMS = 2 << 20, 4 << 20


def bands_for(threshold: float, recall: float, chance: float = 0.2) -> tuple[int, int]:
    """(bands, rows): the fewest rows with which a pair at half the threshold meets with at most this chance, and the bands that reach the recall at the threshold."""
    for rows in range(1, 64):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= chance:
            return bands, rows
    raise ValueError("no banding reaches the recall")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Grams:
    """Distinct n-gram hashes of texts; keeps the hashes of words it has met."""

    def __init__(self, n: int) -> None:
        self.n, self.known = n, {}
        self.powers = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(n)]

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 400_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(h) < self.n:
            return np.asarray([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
        m = len(h) - self.n + 1
        out = np.zeros(m, np.uint64)
        for k, power in enumerate(self.powers):
            out += h[k : k + m] * power
        return np.unique(_mix(out))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def signatures(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 7) -> DataFrame:
    """(doc_id, text_hash, s1, s2, grams, bands): the set's 128-bit digest, its size and its band hashes."""
    bands, rows = bands_for(threshold, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(seed)
        a = draw.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        b = draw.integers(0, 1 << 63, bands * rows, np.uint64)
        c = draw.integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
        grams = Grams(n)
        for part in slices(batches):
            digests, counts, found = [], [], []
            for text in part.column(2).to_pylist():
                g = grams(text)
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(g.tobytes()), "<i8"))
                counts.append(len(g))
                if not len(g):
                    found.append([])
                    continue
                least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(g), 2048):
                    least = np.minimum(least, (g[at : at + 2048, None] * a + b).min(axis=0))
                band = _mix((_mix(least).reshape(bands, rows) * c).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                found.append(band.view(np.int64))
            pair = np.asarray(digests)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_hash", "s1", "s2", "grams", "bands"])

    return keyed(docs).mapInArrow(run, "doc_id long, text_hash long, s1 long, s2 long, grams long, bands array<long>")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of incidence columns."""
    flat = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    name = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], name[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)  # a step adds up to 4,096, which 32 bits of a float hold, sums need more
    for at in range(0, int(shared.sum()), 4096):
        low, high = np.searchsorted(column, (at, at + 4096))
        cells = np.zeros((len(left) + len(right), min(4096, int(shared.sum()) - at)), np.float32)
        cells[owner[low:high], column[low:high] - at] = 1
        out += (cells[: len(left)] @ cells[len(left) :].T).astype(np.int64)
    return out


def _links(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    both = _overlaps(left, right).astype(float)
    a, b = np.asarray([len(x) for x in left], float), np.asarray([len(x) for x in right], float)
    return both >= threshold * (a[:, None] + b[None, :] - both) - 1e-9


def _forest(linked: np.ndarray, names: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a block of links connects."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    edges = []
    for i, row in enumerate(linked):
        for j in np.flatnonzero(row):
            x, y = top(int(names[i])), top(int(columns[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                edges.append((max(x, y), min(x, y)))
    return edges


def verify(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, links, other): links of a class found in one task, and spanning edges (id, other) with links 0.

    members: (deal, part, step, i, j, side, root, id, copies, text). Rows of a root in one task meet each other if all are on side 0, else side 0 meets side 1.
    """

    def found(names: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], same: bool) -> list[tuple[int, int, int | None]]:
        linked = _links([sets[i] for i in left], [sets[i] for i in right], threshold)
        linked &= names[left][:, None] != names[right][None, :]
        rows = [(int(names[i]), int(k), None) for i, k in zip(left, linked @ copies[right], strict=True) if k]
        if not same:
            rows += [(int(names[i]), int(k), None) for i, k in zip(right, copies[left] @ linked, strict=True) if k]
        return rows + [(x, 0, y) for x, y in _forest(linked, names[left], names[right])]

    def run(key, group):
        grams, rows = Grams(n), []
        roots, sides = group["root"].to_numpy(), group["side"].to_numpy()
        names, copies = group["id"].to_numpy(), group["copies"].to_numpy()
        sets = [grams(x) for x in group["text"].to_pylist()]
        order = np.lexsort((names, roots))
        for own in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            own = own[np.append(True, np.diff(names[own]) != 0)]  # rows that repeat an id bring a text twice
            left, right = own[sides[own] == 0], own[sides[own] == 1]
            if key[2].as_py() == 0 and key[3].as_py() == key[4].as_py():
                rows += found(names, copies, left, left, sets, True)
            elif len(left) and len(right):
                rows += found(names, copies, left, right, sets, False)
        return pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "links": pa.array([r[1] for r in rows], pa.int64()), "other": pa.array([r[2] for r in rows], pa.int64())})

    return members.groupBy("deal", "part", "step", "i", "j").applyInArrow(run, "id long, links long, other long")


def deal(named: DataFrame, threshold: float) -> DataFrame:
    """named (root, id, grams, ...) with the tasks of each class: (deal, part, step, i, j, side), one row a task it takes part in.

    part: the size class; step 0: blocks i and j of one size class meet, step 1: block i of a size class and block j of the next.
    """
    base = math.log(1 / (threshold * 0.999))  # a little wider than the threshold, against rounding
    named = named.withColumn("part", F.floor(F.log(F.col("grams").cast("double")) / base).cast("int"))
    whole = named.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("grams").alias("all_grams"))
    named = materialise(named.join(whole, "root"), "jaccard-groups")
    is_small = (F.col("size") <= SMALL) & (F.col("all_grams") <= BLOCK_GRAMS)
    total = named.filter(is_small).agg(F.sum("grams")).first()[0] or 0
    zero = F.lit(0)
    small = named.filter(is_small).select("*", F.pmod(F.xxhash64("root"), F.lit(1 + total // TASK_GRAMS)).alias("deal"), zero.alias("step"), zero.alias("i"), zero.alias("j"), zero.alias("side"))
    large = named.filter(~is_small)
    sizes = large.groupBy("root", "part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    for name, step in (("blocks", 0), ("above", 1), ("below", -1)):
        other = sizes.select("root", (F.col("part") - step).alias("part"), F.col("blocks").alias(name))
        large = large.join(other, ["root", "part"], "left")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    each = lambda n, f: F.when(F.col(n).isNull(), F.array()).otherwise(F.transform(F.sequence(zero, F.col(n) - 1), f))
    place = lambda part, step, i, j, side: F.struct(part.alias("at"), step.alias("step"), i.alias("i"), j.alias("j"), side.alias("side"))
    b, part = F.col("block"), F.col("part")
    tasks = F.concat(
        each("blocks", lambda o: place(part, zero, F.least(b, o), F.greatest(b, o), (b > o).cast("int"))),
        each("above", lambda o: place(part, F.lit(1), b, o, zero)),
        each("below", lambda o: place(part - 1, F.lit(1), o, b, F.lit(1))),
    )
    large = large.withColumn("block", block).withColumn("task", F.explode(tasks)).select(*named.columns, F.col("root").alias("deal"), "task.*").drop("part").withColumnRenamed("at", "part")
    return small.withColumn("part", zero).unionByName(large)


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_hash, class_id, class_key, copy_of, n_links) of every row: its group of texts linked at the threshold, its class of equal sets, and the number of other rows it is linked to."""
    signed = materialise(signatures(docs, n, threshold, recall), "jaccard-signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("rep")
    classes = signed.filter("grams > 0").groupBy("s1", "s2").agg(least, F.count(F.lit(1)).alias("copies"), F.min("bands").alias("bands"), F.min("grams").alias("grams"))
    classes = materialise(classes, "jaccard-classes")
    dealt = classes.select(F.col("s1").alias("id"), F.explode("bands").alias("band"))
    first = dealt.groupBy("band").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("held")).filter("held > 1").drop("held")
    ties = dealt.join(first, "band").select(F.col("id").alias("a"), F.col("first").alias("b"))
    groups = components(ties).join(classes.select(F.col("s1").alias("id"), "copies", "grams", "rep.doc_id", "rep.text_hash"), "id")
    tasks = materialise(deal(groups, threshold), "jaccard-tasks")
    rows, named = keyed(docs), tasks.filter("doc_id is not null")
    texts = maybe_in(rows, "doc_id", marked(named, "doc_id")).join(named, ["doc_id", "text_hash"])
    # rows without an id may be many: equal texts of theirs are one before they are shuffled
    lost = tasks.filter("doc_id is null").drop("doc_id")
    nameless = maybe_in(rows.filter("doc_id is null"), "text_hash", marked(lost, "text_hash")).groupBy("text_hash").agg(F.first("text").alias("text")).join(lost, "text_hash")
    members = texts.drop("doc_id", "text_hash").unionByName(nameless.drop("text_hash"))
    checked = materialise(verify(members, n, threshold), "jaccard-links")
    links = checked.filter("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(checked.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    table = classes.select("s1", "s2", "rep", "copies").join(links.withColumnRenamed("id", "s1"), "s1", "left").join(roots.withColumnRenamed("id", "s1"), "s1", "left")
    table = materialise(table.select("s1", "s2", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "s1").alias("class_key")), "jaccard-table")
    names = table.groupBy("class_key").agg(F.min("rep.doc_id").alias("class_id"))
    table = materialise(table.join(names, "class_key"), "jaccard-named")
    discard(tasks, checked)
    rows = signed.select("doc_id", "text_hash", "s2", F.when(F.col("grams") > 0, F.col("s1")).alias("s1"))
    out = rows.join(table, ["s1", "s2"], "left")
    lone = F.col("class_key").isNull()
    return out.select(
        "doc_id", "text_hash", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "class_key", F.when(lone, F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("copy_of"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
    )
