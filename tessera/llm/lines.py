"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of white space at both ends, A-Z lower-cased. Documents come in batches
of falling ids. Each batch's key hashes are merge-anti-joined with the runs. Keys that no run holds are fresh: this first
sighting names their keeper (the largest id, as later batches hold smaller ids). Keys that a run holds are old: they name
none and only add to the count. The batch is then written as a sorted run of its own; ``fanout`` runs of a level are compacted
into one of the next. When all batches are in, keys in at least ``min_docs`` documents lose their lines everywhere but in the keeper.

Only documents that may lose a line (told by a bitmap of at most 2 MB) are shuffled with their texts.

Defined results: null or empty text is one empty line; rows with the same id (null too) are one document; keys
shorter than ``min_chars`` code points always stay; an empty table gives an empty table; a line repeated inside the keeper stays as often as it is
there; other columns pass unchanged, whatever their names, but columns of the three results' names are replaced by them. Hashes have 128 bits.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, LOWER, UPPER, ascii_lower, discard, marked, materialise, maybe_in, private

_LOWER = str.maketrans(UPPER, LOWER)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """Distinct (doc_id, h) of the keys long enough."""
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.length(k) >= min_chars))
    found = docs.select("doc_id", F.explode(keys).alias("key"))
    return found.select("doc_id", _hash(F.col("key")).alias("h")).distinct()


class Runs:
    """Sorted runs (h, n_docs, keeper, fresh) by level in the shared folder; of all rows of a key one is fresh and names the keeper."""

    def __init__(self, fanout: int) -> None:
        self.fanout, self.levels = fanout, [[]]

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merge_anti(self, batch: DataFrame) -> DataFrame:
        """Tells the keys of a batch that no run holds (fresh) from the others."""
        if not self.all():
            return batch.withColumn("fresh", F.lit(True))
        known = reduce(DataFrame.unionByName, (r.filter("fresh").select("h") for r in self.all())).withColumn("known", F.lit(True))
        return batch.join(known, "h", "left").withColumn("fresh", F.col("known").isNull()).drop("known")

    def add(self, batch: DataFrame) -> None:
        told = self.merge_anti(batch)
        run = self._write(told.withColumn("keeper", F.when(F.col("fresh"), F.col("keeper"))))
        for i in range(64):
            if i == len(self.levels):
                self.levels.append([])
            self.levels[i].append(run)
            if len(self.levels[i]) < self.fanout:
                return
            merged = self.levels[i]
            run = self._write(compact(merged))
            discard(*merged)
            self.levels[i] = []

    @staticmethod
    def _write(run: DataFrame) -> DataFrame:
        return materialise(run.select("h", "n_docs", "keeper", "fresh").sortWithinPartitions("h"), "line-run")


def compact(runs: list[DataFrame]) -> DataFrame:
    """One row a key: its counts summed, its keeper taken from its one fresh row (two fresh rows would be an error of the anti-join)."""
    merged = reduce(DataFrame.unionByName, runs)
    one = F.when(F.count_if("fresh") <= 1, F.max("fresh")).otherwise(F.raise_error(F.lit("a line key was fresh twice")).cast("boolean"))
    return merged.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"), one.alias("fresh"))


def repeated_lines(hashes: DataFrame, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(h, n_docs, keeper) of the keys in at least min_docs documents."""
    cuts = hashes.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    runs, doc = Runs(fanout), F.col("doc_id")
    for upper, lower in zip([None, *cuts], [*cuts, None], strict=True):
        part = hashes
        if upper is not None:
            part = part.filter((doc <= upper) if lower is not None else (doc <= upper) | doc.isNull())
        if lower is not None:
            part = part.filter(doc > lower)
        runs.add(part.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")))
    whole = compact(runs.all())
    return whole.filter((F.col("n_docs") >= min_docs) & F.col("fresh")).select("h", "n_docs", "keeper")


def _keep(min_chars: int):
    """(text, hashes that go, null if none) to what stays and how many lines went; lines meet the hashes by a set, however long a text is."""

    @F.arrow_udf("kept string, dropped long")
    def kept(texts: pa.Array, gone: pa.Array) -> pa.Array:
        stays, dropped = [], []
        for text, hashes in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
            said, drop = (text or "").split("\n"), set(hashes or ())
            if drop:
                keys = ((line, line.strip(BLANKS).translate(_LOWER)) for line in said)
                rest = [line for line, key in keys if len(key) < min_chars or hashlib.md5(key.encode()).digest() not in drop]
            else:
                rest = said
            stays.append("\n".join(rest))
            dropped.append(len(said) - len(rest))
        return pa.StructArray.from_arrays([pa.array(stays, pa.string()), pa.array(dropped, pa.int64())], ["kept", "dropped"])

    return kept


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, names: tuple[str, str, str] = ("_kept_text", "_n_lines", "_n_dropped")) -> DataFrame:
    """docs with the kept text, the number of lines before and of lines dropped, under these names."""
    hashes = materialise(line_hashes(docs, min_chars), "line-hashes")
    repeated = materialise(repeated_lines(hashes, min_docs, batches, fanout), "line-repeated")
    losing = hashes.join(repeated, "h").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    doc, drops, made = private([*docs.columns, *names], "_doc", "_drops", "_made")
    losers = materialise(losing.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list("h").alias(drops)), "line-drops")
    discard(hashes, repeated)
    bitmap, text = marked(losers, doc), F.coalesce("text", F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    maybe = maybe_in(docs, "doc_id", bitmap)
    maybe = maybe.join(losers, maybe["doc_id"].eqNullSafe(losers[doc]), "left").withColumn(made, _keep(min_chars)("text", drops))
    touched = maybe.select(*others, F.col(f"{made}.kept").alias(names[0]), n_lines.alias(names[1]), F.col(f"{made}.dropped").alias(names[2]))
    # texts that surely lose nothing are neither shuffled nor seen by Python
    whole = maybe_in(docs, "doc_id", bitmap, keep=False).select(*others, text.alias(names[0]), n_lines.alias(names[1]), F.lit(0).cast("long").alias(names[2]))
    return whole.unionByName(touched)
