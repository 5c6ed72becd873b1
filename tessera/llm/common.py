"""What the training-data operators share: reading tables, the shared work folder, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.store import discard, materialise, work_dir

#: White space of the word and line rules: blank and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private(columns: Iterable[str], *names: str) -> list[str]:
    """Names like those given that no column has (case does not count)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)


def release() -> None:
    """Gives memory that a task no longer needs back to the system: Python workers live on and serve later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that what Python holds at once is bounded by bytes (a single row may be larger)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def fold(doc_id: int | None) -> int:
    """crc32 of the id as text, by which held-out rows are told."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


#: Bits of the table of marked ids: 2 MB, whatever the input. Beyond some ten million ids it marks nearly all rows, and joins shuffle as without it.
MARK_BITS = 24


def marked(ids: DataFrame, column: str) -> DataFrame:
    """One row: a bitmap of the hashes of ids (null included)."""
    spark = ids.sparkSession
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(1 << MARK_BITS))
    words = ids.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = [0] * (1 << (MARK_BITS - 6))
    for row in words.collect():  # at most 2**18 words
        table[row.w] = row.b
    return spark.createDataFrame([(table,)], "bits array<long>")


def maybe_in(docs: DataFrame, column: str, bitmap: DataFrame, keep: bool = True) -> DataFrame:
    """The rows whose id may be (keep) or is surely not among the marked: spares the others the shuffle of a join."""
    (bits,) = private(docs.columns, "_bits")
    place = F.pmod(F.xxhash64(docs[column].cast("long")), F.lit(1 << MARK_BITS))
    bit = F.call_function("shiftright", F.get(F.col(bits), F.shiftright(place, 6).cast("int")), (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return docs.join(F.broadcast(bitmap.toDF(bits)), bit, "left_semi" if keep else "left_anti")


__all__ = ["BLANKS", "LOWER", "MARK_BITS", "UPPER", "WORD", "ascii_lower", "discard", "fold", "marked", "materialise", "maybe_in", "private", "release", "slices", "table", "work_dir"]
