"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets: sources share a volume by weight, none above ``most`` times its own size; the excess is shared
anew by weight (``water_fill``). Inside a source a document's expected copies grow with the bit length of
its size and are at most ``most``; they are fitted by the same filling over the at most 64 bit lengths. The
whole part is certain. For the fraction f each document draws u and gets the rank
(u / (1 - u)) / (f / (1 - f)); a source takes documents by rising rank while its words stay within what
is left of its target, and last the one whose size is nearest to the rest, so that the sample's size is fixed and inclusion is unequal.
The last one departs from the order of ranks: it is one document a source, whose inclusion hangs on its size and not on its draw; all others are as ranked.

No sort over a source: ranks fall into ``buckets`` whose words are summed first, and only the bucket in which a
source's boundary lies is ordered row by row: a source's task holds at most ``buckets`` sums, or one bucket's rows, a small share of the source.

Defined results: null text has size 0; documents of size 0 take 0; an empty table gives an empty table;
source null is a source of its own, last in order; rows that repeat an id draw the same number; ties of rank go by id, then size; a run
gives the same rows again, as u is a hash of the id and the seed. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialise

BUCKETS = 4096


def water_fill(parts: DataFrame, keys: list[str], weight: str, cap: str, volume: str) -> DataFrame:
    """Adds ``share``: volume split by weight within ``keys``, none above its cap, the excess reshared.

    Capped are the parts with the least cap to weight ratio: the shortest prefix in that order whose rest needs no cap.
    From there on the level only falls, so it is the highest of those that need no cap.
    """
    ratio = F.col(cap) / F.col(weight)
    order = W.partitionBy(*keys).orderBy(ratio, cap)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    level = (F.col(volume) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0.0)))
    out = parts.withColumn("_level", level).withColumn("_free", F.when(F.col("_level") <= ratio, F.col("_level")))
    return out.withColumn("_at", F.max("_free").over(whole)).withColumn("share", F.least(F.col(cap).cast("double"), F.coalesce(F.col("_at") * F.col(weight), F.col(cap).cast("double")))).drop("_level", "_free", "_at")


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each whole text."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def in_order(sources: DataFrame) -> DataFrame:
    """place: each source's number from 0 in the order of code points, null last; sorted in ranges, no task sees all."""
    spread = materialise(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "mix-sources")
    before = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = before.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    return spread.withColumn("_inner", inner).join(before, "_part").withColumn("place", F.col("_inner") + F.col("_before")).drop("_part", "_inner", "_before")


def targets(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), volume: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target); one row for each source, after partial sums.

    Each round shares what the capped sources leave by weight and caps those above their size, until none is; rounds are sums over
    sources, of which there may be any number.
    """
    placed = in_order(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    live = materialise(placed.select("source", "source_size", weight.alias("_weight"), (F.col("source_size") * F.lit(float(most))).alias("_cap")), "mix-shares")
    level, capped = 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_weight")
        now = live.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))).alias("open"), F.count_if(full).alias("capped")).first()
        if not now["open"] or now["capped"] == capped:
            break
        level, capped = (volume * now["all"] - now["taken"]) / now["open"], now["capped"]
    return live.select("source", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_weight")).alias("target"))


def mix(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), volume: float = 1.5, most: int = 2, seed: int = 20_24, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for (doc_id, source, size); read more than once, so stored before."""
    goal = targets(sized, weights, volume, most)
    named = sized.withColumn("_class", F.length(F.bin("size")).cast("int"))
    classes = named.groupBy("source", "_class").agg(F.sum("size").alias("_words")).filter("_words > 0")
    classes = classes.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.source", "_class", "_words", "source_size", "target")
    classes = classes.withColumn("_weight", F.col("_class") * F.col("_words").cast("double")).withColumn("_cap", F.col("_words") * F.lit(float(most)))
    filled = water_fill(classes, ["source"], "_weight", "_cap", "target").withColumn("_each", F.least(F.col("share") / F.col("_words"), F.lit(float(most))))
    filled = filled.withColumn("_whole", F.floor("_each")).withColumn("_odds", F.col("_each") - F.col("_whole"))
    filled = filled.withColumn("_left", F.col("target") - F.sum(F.col("_whole") * F.col("_words")).over(W.partitionBy("source")))
    filled = filled.select(F.col("source").alias("_source"), F.col("_class").alias("_bits"), "source_size", "target", "_whole", "_odds", "_left")
    plan = materialise(filled, "mix-plan")
    ranked = named.join(plan, named.source.eqNullSafe(plan._source) & (named._class == plan._bits), "left").drop("_bits", "_source")
    u = uniform(seed, "doc_id")
    odds = (u / (1 - u)) / (F.col("_odds") / (1 - F.col("_odds")))
    ranked = ranked.withColumn("_rank", F.when(F.col("_odds") > 0, odds)).withColumn("_bucket", F.floor(F.col("_rank") / (1 + F.col("_rank")) * buckets))
    sums = ranked.filter("_rank is not null").groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"), F.first("_left").alias("_goal"))
    below = F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = sums.withColumn("_below", below).filter("_below < _goal").groupBy(F.col("source").alias("_source")).agg(F.max_by(F.struct(F.col("_bucket").alias("_edge"), F.col("_goal") - F.col("_below")), "_bucket").alias("_e"))
    edges = materialise(edges.select("_source", F.col("_e._edge").alias("_edge"), F.col("_e.col2").alias("_need")), "mix-edges")
    ranked = ranked.join(edges, ranked.source.eqNullSafe(edges._source), "left").drop("_source")
    running = F.sum("size").over(W.partitionBy("source").orderBy("_rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    on_edge = F.col("_rank").isNotNull() & (F.col("_bucket") == F.col("_edge"))
    edge = ranked.filter(on_edge).withColumn("_more", (running <= F.col("_need")).cast("int"))
    rest = ranked.filter(~F.coalesce(on_edge, F.lit(False))).withColumn("_more", F.coalesce((F.col("_bucket") < F.col("_edge")).cast("int"), F.lit(0)))
    edge = materialise(edge, "mix-edge")
    both = edge.unionByName(rest).drop("source_size", "target")
    # the last document of a source: of those not drawn the one whose size is nearest to what is still missing
    short = edge.groupBy("source").agg((F.first("_need") - F.sum(F.col("size") * F.col("_more"))).alias("_short"))
    short = short.select(F.col("source").alias("_source"), "_short")
    open_rows = both.filter("_rank is not null and _more = 0 and size > 0").join(short, F.col("source").eqNullSafe(F.col("_source")))
    miss = F.abs(F.col("size") - F.col("_short"))
    last = open_rows.groupBy("_source").agg(F.min(F.struct(miss.alias("miss"), "_rank", "doc_id", "size")).alias("_l"), F.first("_short").alias("_short"))
    last = materialise(last.filter("_l.miss < _short").select("_source", F.col("_l._rank").alias("_lr"), F.col("_l.doc_id").alias("_ld"), F.col("_l.size").alias("_ls")), "mix-last")
    joined = both.join(last, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    is_last = (F.col("_rank") == F.col("_lr")) & F.col("doc_id").eqNullSafe(F.col("_ld")) & (F.col("size") == F.col("_ls")) & (F.col("_more") == 0)
    both = joined.withColumn("_more", F.when(F.coalesce(is_last, F.lit(False)), 1).otherwise(F.col("_more"))).drop("_lr", "_ld", "_ls")
    both = both.withColumn("copies", F.when(F.col("size") > 0, F.coalesce("_whole", F.lit(0)) + F.col("_more")).otherwise(0).cast("int"))
    named_goal = goal.select(F.col("source").alias("_source"), "source_size", "target")
    out = both.join(named_goal, both.source.eqNullSafe(named_goal._source), "left")
    return out.select("doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``mix`` over whole texts: the sizes are written once, as several passes read them."""
    return mix(materialise(sizes(docs), "mix-sizes"), **options)
