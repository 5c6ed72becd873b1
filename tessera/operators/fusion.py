"""Fusion of the hit lists of a question's sub-questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.identity import fusion_family
from tessera.functions.text import fold, squeeze

MOST, LISTS = 20, 3


def content_identity() -> Column:
    """Hits are the same evidence if path (without case) and content agree."""
    return F.concat_ws("|", fold(F.col("source_path")), F.coalesce(F.nullif(F.col("content_hash"), F.lit("")), squeeze(fold(F.col("content")))))


def fuse(hits: DataFrame, comparison: bool = False, limit: int = MOST) -> DataFrame:
    """(qid, rank, id, coverage, best_rank, best_score, first_subquery) from hits (qid, subquery, rank from 0, score, chunk columns).

    Lists are numbered 0 to 2; a hit of any other list is an error. More lists rank first, then the better score, rank and list. The payload is folded list by list: a hit replaces the one
    held if its score is higher than any so far, or equal and its rank lower than any so far. In a comparison each version family puts
    its best member, those of a single list first, before the rest.
    """
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be between 1 and {MOST}")
    named = hits.withColumn("_same", content_identity()).withColumn("score", F.coalesce("score", F.lit(0.0)))
    named = named.withColumn("_family", fusion_family(F.col("department"), F.col("document_type"), F.col("version"), F.col("source_path")))
    one = W.partitionBy("qid", "_same", "subquery").orderBy("rank", "id")
    # a list beyond the bound is refused, never left out
    named = named.withColumn("subquery", F.when(F.col("subquery").between(0, LISTS - 1), F.col("subquery")).otherwise(F.raise_error(F.lit(f"at most {LISTS} lists, numbered from 0")).cast(named.schema["subquery"].dataType)))
    first = named.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    held = F.struct("subquery", "rank", "score", "id", "_family")
    groups = first.groupBy("qid", "_same").agg(F.count(F.lit(1)).alias("coverage"), F.min("rank").alias("best_rank"), F.max("score").alias("best_score"), F.min("subquery").alias("first_subquery"), F.sort_array(F.collect_list(held)).alias("_list"))
    state = lambda x, r, s: F.struct(r.alias("rank"), s.alias("score"), x["id"].alias("id"), x["_family"].alias("_family"))

    def step(a: Column, x: Column) -> Column:
        wins = (x["score"] > a["score"]) | ((x["score"] == a["score"]) & (x["rank"] < a["rank"]))
        low, high = F.least(a["rank"], x["rank"]), F.greatest(a["score"], x["score"])
        return F.when(wins, state(x, low, high)).otherwise(state(a, low, high))

    head = F.col("_list")[0]
    folded = groups.withColumn("_won", F.aggregate(F.slice("_list", 2, LISTS), state(head, head["rank"], head["score"]), step))
    flat = folded.select("qid", "coverage", "best_rank", "best_score", "first_subquery", F.col("_won.id").alias("id"), F.col("_won._family").alias("_family"), F.col("_list")[0]["rank"].alias("_came"))
    usual = [F.desc("coverage"), F.desc("best_score"), "best_rank", "first_subquery", "_came", "id"]
    if comparison:
        special = [F.when(F.col("coverage") == 1, 0).otherwise(1), F.desc("best_score"), F.col("best_rank"), F.col("first_subquery")]
        flat = flat.withColumn("_order", F.row_number().over(W.partitionBy("qid").orderBy(*usual)))
        flat = flat.withColumn("_lead", F.row_number().over(W.partitionBy("qid", "_family").orderBy(*special, "_order")) == 1)
        order = [F.desc("_lead"), *(F.when(F.col("_lead"), c) for c in (special[0], -F.col("best_score"), special[2], special[3])), "_order"]
    else:
        order = usual
    ranked = flat.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order))).filter(F.col("rank") <= limit)
    return ranked.select("qid", "rank", "id", "coverage", "best_rank", "best_score", "first_subquery")
