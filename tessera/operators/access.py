"""Access before ranking: which rows the caller of a question may read.

Rows carry the groups that may read them, questions the groups of their caller. Where many questions meet many rows, the groups of a block's callers are numbered and both sides become bit sets of them; a row is open
to a question if the two share a bit. Closed by default: a row or a caller without groups (null or none) meets nobody. Case does not count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import fold


def folded(groups: Column) -> Column:
    """The groups without case, each once; none for null."""
    known = F.filter(F.transform(groups, fold), lambda g: g.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(known)), F.array().cast("array<string>"))


def numbered(groups: pa.Array | pa.ChunkedArray) -> dict[str, int]:
    """A number for each group in lists of groups."""
    flat = groups.combine_chunks() if isinstance(groups, pa.ChunkedArray) else groups
    return {g: i for i, g in enumerate(sorted(flat.flatten().unique().drop_null().to_pylist()))}


def bit_sets(groups: pa.Array | pa.ChunkedArray, known: dict[str, int]) -> np.ndarray:
    """A row of 64-bit words for each list of groups: the known ones among them."""
    flat = groups.combine_chunks() if isinstance(groups, pa.ChunkedArray) else groups
    sets = np.zeros((len(flat), max(1, -(-len(known) // 64))), np.uint64)
    lengths = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    said = flat.flatten().dictionary_encode()
    number = np.asarray([known.get(g, -1) for g in said.dictionary.to_pylist()], np.int64)[said.indices.to_numpy(zero_copy_only=False)]
    row, hit = np.repeat(np.arange(len(flat)), lengths), number >= 0
    np.bitwise_or.at(sets, (row[hit], number[hit] // 64), np.uint64(1) << (number[hit] % 64).astype(np.uint64))
    return sets


def share(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether bit sets share a bit, row by row; one of the sides may be a single row."""
    return (left & right).any(axis=1)
