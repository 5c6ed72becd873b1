"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it. Equal fingerprints form one class. Classes are indexed by both halves of their fingerprint. Of two
fingerprints with at most 3 differing bits one half differs in at most one bit, so each fingerprint looks up, for each half, that half and its Hamming ball of radius 1; as the
partner looks too, only bits that are 0 are turned. What is found is verified on all 64 bits inside the join; only links leave it.

A half that very many fingerprints hold would make a long bucket. Such buckets are split by what is left of the fingerprint: it differs in at most 3 bits,
so of four parts of it one is equal, and the bucket becomes four times as many, each narrower by a quarter of the bits that were open; again, until buckets are short or so few bits
are open that a bucket can hold two thousand fingerprints at most. So no link is lost, no bucket is cut, and a look-up meets a bounded number of fingerprints at any size. Keys that many
fingerprints look up are left to Spark's splitting of skewed partitions.

Components are found by alternating stars over links of classes; copies are never expanded into pairs.

Defined results: words are runs of other characters than blank and the controls 9 to 13, A-Z lower-cased; a text of fewer than three words is one shingle of all its words; null, empty and
blank texts have fingerprint zero and are linked like any other; texts of any length are read whole, in pieces; repeated rows are rows of their own; a component is named by its least id, by null if it has none;
rows without an id get their component's name; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, discard, materialise, slices
from tessera.llm.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a bucket before it is split; bits that stay open in buckets that can't be split further.
BUCKET, OPEN_BITS = 512, 11
PIECE = 1 << 20
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about this size that end before white space."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + size) if at + size < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def fingerprint(text: str | None, size: int = PIECE) -> int:
    """The 64-bit fingerprint; bit i is bit i of the hashes."""
    counts, n, before, shingled = np.zeros(64, np.int64), 0, [], False
    for piece in _pieces((text or "").encode(), size):
        words = before + piece.translate(_LOWER).split()
        held = len(words) - SHINGLE + 1
        if held > 0:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(islice(words, k, None) for k in range(SHINGLE)), strict=False)), repeat(SEED)), "<u8", held)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(held, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n, shingled = n + held, True
        before = words[-(SHINGLE - 1) :]
    if not shingled:
        return xxhash.xxh64_intdigest(b" ".join(before), SEED) if before else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.asarray([fingerprint(t.as_py()) for t in part.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


def _halves(prints: DataFrame) -> DataFrame:
    """(print, half, v, open, bits): each half v, and the other one, whose 32 bits are open."""
    low, high = F.expr("print & 4294967295L"), F.expr("shiftrightunsigned(print, 32)")
    sides = F.array(F.struct(F.lit(0).cast("long").alias("half"), low.alias("v"), high.alias("open")), F.struct(F.lit(1).cast("long").alias("half"), high.alias("v"), low.alias("open")))
    return prints.select("print", F.inline(sides)).withColumn("bits", F.lit(32))


_KEY = "shiftleft(half, 32) | {}"


def stored(prints: DataFrame) -> DataFrame:
    return _halves(prints).select("print", F.expr(_KEY.format("v")).alias("key"), "open", "bits")


def asked(prints: DataFrame) -> DataFrame:
    """Look-ups: each half itself, and with one of its zero bits set."""
    ball = F.expr("concat(array(v), transform(filter(sequence(0, 31), i -> shiftright(v, i) & 1L = 0), i -> v | shiftleft(1L, i)))")
    return _halves(prints).withColumn("v", F.explode(ball)).select("print", F.expr(_KEY.format("v")).alias("key"), "open", "bits")


def narrowed(rows: DataFrame) -> DataFrame:
    """Each row under four keys: the old one with one of four parts of its open bits, which are open no more."""
    part = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(RADIUS))))
    part = part.withColumns({"wide": F.expr("bits div 4 + if(t < bits % 4, 1, 0)").cast("int"), "at": F.expr("t * (bits div 4) + least(t, bits % 4)").cast("int")})
    value = F.expr("shiftright(open, at) & (shiftleft(1L, wide) - 1)")
    # a part number and its bits go below the key; no key of one level needs more than 64 bits
    key = F.expr("shiftleft(key, 2 + wide) | shiftleft(CAST(t AS LONG), wide)").bitwiseOR(value)
    left = F.expr("(open & (shiftleft(1L, at) - 1)) | shiftleft(shiftright(open, at + wide), at)")
    return part.select("print", key.alias("key"), left.alias("open"), (F.col("bits") - F.col("wide")).alias("bits"))


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of fingerprints that differ in at most 3 bits; prints: (print), each once."""
    near = (F.col("s.print") != F.col("q.print")) & (F.bit_count(F.col("s.print").bitwiseXOR(F.col("q.print"))) <= RADIUS)
    index, looked, found, bits = stored(prints), asked(prints), [], 32
    while True:
        # in the deepest level open bits differ by part, so these are of the key
        on = (F.col("s.key") == F.col("q.key")) & (F.col("s.bits") == F.col("q.bits"))
        hot = materialise(index.groupBy("key", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).drop("n"), "simhash-hot") if bits > OPEN_BITS else None
        some = hot is not None and not hot.isEmpty()
        cold = [x.join(hot, ["key", "bits"], "left_anti") if some else x for x in (index, looked)]
        # Spark takes the look-ups for as few as the fingerprints they come from; told to merge, it sends neither side whole
        found.append(cold[0].alias("s").hint("merge").join(cold[1].alias("q").hint("merge"), on & near).select(F.col("s.print").alias("a"), F.col("q.print").alias("b")))
        if not some:
            break
        index, looked = (materialise(narrowed(x.join(hot, ["key", "bits"], "left_semi")), "simhash-narrowed") for x in (index, looked))
        bits -= bits // 4
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: its fingerprint in hexadecimal and the least id of all rows it is linked to, over any number of links."""
    rows = materialise(fingerprints(docs), "simhash-prints")
    classes = materialise(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-classes")
    pairs = materialise(links(classes.select("print"), bucket), "simhash-links")
    roots = components(pairs)
    discard(pairs)
    tied = classes.join(roots.withColumnRenamed("id", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    tied = materialise(tied, "simhash-roots")
    names = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(tied.join(names, "root").select("print", "component_id"), "simhash-named")
    discard(tied, classes)
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
