"""What rows carry on from earlier rows of the same key, for keys of any length: a segmented prefix scan.

Rows have a whole number as their place. Places fall into ranges of ``SPAN``; a range tells the last value in it and how often a mark was met (partial sums, one row a range, stored), the ranges of a key carry these on
by the same rule, in ranges of ranges, and inside a range a window ends the work. So a task holds one range of at most ``SPAN`` places at a time, however many rows a sheet or a document has, and rows are shuffled once, by key and range.

Defined results: null keys are one key, as in a window; rows of one place see each other in no defined order, so places should be single; rows without a place come before all others of their key; an empty table
gives an empty table; a key without a value carries null and counts 0. Columns of the user are kept, whatever their names; columns of the results' names are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.names import private
from tessera.plans import store

#: Places of a range; with so many levels the last window has a row for each 67 million places of a key.
SPAN, LEVELS = 8192, 2


def carry(rows: DataFrame, keys: list[str], place: str, last: dict[str, Column] | None = None, count: dict[str, Column] | None = None, span: int = SPAN, levels: int = LEVELS) -> DataFrame:
    """rows with, up to and with each row of its key, the last value of each of ``last`` that is not null and how often each of ``count`` was true."""
    if span < 2 or levels < 0:
        raise ValueError("ranges need span >= 2 and levels >= 0")
    last, count = last or {}, count or {}
    names = [*last, *count]
    made = dict(zip(names, private(rows.columns, *names), strict=True))
    marked = rows.withColumns({made[n]: v for n, v in last.items()} | {made[n]: F.coalesce(v.cast("boolean"), F.lit(False)).cast("long") for n, v in count.items()})
    done = _carried(marked, keys, place, [made[n] for n in last], [made[n] for n in count], span, span, levels, 0)
    held = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in {n.lower() for n in names}]
    return done.select(*held, *(F.col(made[n]).alias(n) for n in names))


def _carried(rows: DataFrame, keys: list[str], place: str, last: list[str], count: list[str], width: int, span: int, levels: int, ahead: int) -> DataFrame:
    """rows with the columns ``last`` and ``count`` carried on, up to ``ahead`` rows after each row: each range of ``width`` places starts from what the ranges before it have come to."""

    def scanned(df: DataFrame, within: list[str]) -> DataFrame:
        window = W.partitionBy(*(f"`{c}`" for c in within)).orderBy(f"`{place}`").rowsBetween(W.unboundedPreceding, ahead)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in last} | {c: F.coalesce(F.sum(c).over(window), F.lit(0)) for c in count})

    if not levels:
        return scanned(rows, keys)
    part, *told = private([*rows.columns], "part", *(f"before_{i}" for i in range(len(last) + len(count))))
    at = F.coalesce(F.col(f"`{place}`").cast("long"), F.lit(-(2**62)))
    dealt = rows.withColumn(part, at - F.pmod(at, F.lit(width)))
    sums = dealt.groupBy(*(f"`{k}`" for k in keys), part).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in last), *(F.sum(c).alias(c) for c in count))
    starts = _carried(store.materialise(sums, "range-sums"), keys, part, last, count, width * span, span, levels - 1, -1)
    begin = dict(zip((*last, *count), told, strict=True))
    on = [*keys, part]
    twins = private([*rows.columns, part, *told], *(f"at_{i}" for i in range(len(on))))
    starts = starts.select(*(F.col(f"`{k}`").alias(t) for k, t in zip(on, twins, strict=True)), *(F.col(c).alias(t) for c, t in begin.items()))
    same = reduce(Column.__and__, (F.col(f"`{k}`").eqNullSafe(F.col(t)) for k, t in zip(on, twins, strict=True)))
    met = scanned(dealt, on).join(starts, same, "left")
    return met.withColumns({c: F.coalesce(c, begin[c]) for c in last} | {c: F.col(c) + F.coalesce(begin[c], F.lit(0)) for c in count}).drop(part, *twins, *told)
