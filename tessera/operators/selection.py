"""Selection of a small evidence pack: dedup, version rules, rank score, reservations. Columns whose names begin with ``_tessera_`` are its own; all others pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.identity import selection_family, source_key
from tessera.functions.text import CURRENCY, NUMERIC, PRICE, RANK_STOP, fold, has_any, historical_intent, join_present, literals, rank_tokens, squeeze

CANDIDATES, CONTEXT = 20, 6
# Facets of grouped sheet rows in the order in which they reserve.
FACETS = {
    "volume": ["seat", "seats", "volume", "tier", "quantity"],
    "term": ["term", "annual", "prepaid", "monthly", "yearly", "billing"],
    "approval": ["approval", "approvals", "approve", "approver", "authorize"],
    "program": ["startup", "program", "eligibility", "eligible", "stack", "stacking"],
    "calculation": ["calculate", "calculation", "combined", "final", "price", "cost"],
}
_IN_SHEET = {"volume": "volume", "term": "term", "approval": "approval", "program": "special"}


def dedup_identity() -> Column:
    content = F.coalesce(F.nullif(F.col("content_hash"), F.lit("")), F.nullif(squeeze(fold(F.col("content"))), F.lit("")), F.col("id"))
    return F.concat_ws("|", source_key(F.col("source_path")), content)


def dedup_keep_first(candidates: DataFrame, by: str = "qid") -> DataFrame:
    """The first by rank of each source and content."""
    order = W.partitionBy(by, dedup_identity()).orderBy("rank", "id")
    return candidates.withColumn("_tessera_n", F.row_number().over(order)).filter("_tessera_n = 1").drop("_tessera_n")


def narrow_rate_cards(rows: DataFrame, by: str = "qid") -> DataFrame:
    """Questions about rate cards keep rate cards only, if there are any."""
    card = F.coalesce(F.col("document_type").endswith("rate_card"), F.lit(False))
    asked = F.col("question").rlike(r"(?i)\brate\s+cards?\b")
    marked = rows.withColumn("_tessera_any", F.max(card).over(W.partitionBy(by)))
    return marked.filter(~asked | ~F.col("_tessera_any") | card).drop("_tessera_any")


def suppress_stale(rows: DataFrame, by: str = "qid") -> DataFrame:
    """Rows known to be stale go where their family has a current row; unknown is neither."""
    family = selection_family(F.col("department"), F.col("document_type"), F.col("source_path"))
    marked = rows.withColumn("_tessera_family", family).withColumn("_tessera_fresh", F.max(F.col("is_current").eqNullSafe(F.lit(True))).over(W.partitionBy(by, "_tessera_family")))
    stale = F.col("is_current").eqNullSafe(F.lit(False)) & F.col("_tessera_fresh") & ~F.col("historical")
    return marked.filter(~stale).drop("_tessera_family", "_tessera_fresh")


def rank_scores(rows: DataFrame, by: str = "qid") -> DataFrame:
    """Adds query and chunk tokens, rank_score and place (from 1): the candidates' order after lexical, version, price and neighbour bonuses."""
    per = W.partitionBy(by)
    chunk = rank_tokens(join_present(*(F.col(c) for c in ("title", "source_path", "section", "sheet_name", "content"))))
    out = rows.withColumn("_tessera_q", F.array_except(rank_tokens(F.col("question")), literals(RANK_STOP))).withColumn("_tessera_c", chunk)
    out = out.withColumn("_tessera_r", F.row_number().over(per.orderBy("rank", "id")) - 1).withColumn("_tessera_n", F.count(F.lit(1)).over(per))
    hits = F.array_intersect("_tessera_q", "_tessera_c")
    sheet = F.coalesce(F.col("file_type") == "xlsx", F.lit(False))
    out = out.withColumn("_tessera_hits", F.size(hits)).withColumn("_tessera_numbers", F.size(F.filter(hits, lambda t: t.rlike("^[0-9]+$"))))
    out = out.withColumn("_tessera_related", sheet & (F.col("_tessera_hits") > 0) & F.col("row_number").isNotNull())
    # neighbours among at most 20 rows of a question: numbers of related rows by sheet and table
    place = W.partitionBy(by, source_key(F.col("source_path")), "sheet_name", "table_number")
    near = F.collect_list(F.when(F.col("_tessera_related"), F.struct("id", "row_number"))).over(place)
    out = out.withColumn("_tessera_near", sheet & F.col("row_number").isNotNull() & F.exists(near, lambda o: (o["id"] != F.col("id")) & (F.abs(o["row_number"] - F.col("row_number")) == 1)))
    bonus = lambda when, value: F.when(F.coalesce(when, F.lit(False)), value).otherwise(0.0)
    price, money = has_any(F.col("_tessera_q"), PRICE), F.col("content").rlike(CURRENCY)
    score = (
        (F.col("_tessera_n") - F.col("_tessera_r")) / F.greatest(F.col("_tessera_n"), F.lit(1)) + F.col("_tessera_hits") + 2.0 * F.col("_tessera_numbers")
        + bonus(~F.col("historical") & F.col("is_current").eqNullSafe(F.lit(True)), 1.5) + bonus(sheet & (F.col("_tessera_hits") > 0), 0.75)
        + bonus(price & money, 1.5) + bonus(price & money & F.col("document_type").endswith("rate_card"), 1.0)
        + bonus(has_any(F.col("_tessera_q"), NUMERIC) & F.col("content").rlike("[0-9]"), 2.0) + bonus(F.col("_tessera_near"), 0.5)
    )
    out = out.withColumn("rank_score", F.round(score, 6))
    return out.withColumn("place", F.row_number().over(per.orderBy(F.desc("rank_score"), "_tessera_r")))


def requirement_rows(by: str = "qid") -> Column:
    """Whether a ranked row is a table row that a question for requirements should show first."""
    wanted = literals(["requirement", "requirements"])
    subject = F.array_except("_tessera_q", literals(["company", "requirement", "requirements"]))
    named = rank_tokens(join_present(F.col("title"), F.col("section")))
    return F.arrays_overlap("_tessera_q", wanted) & F.arrays_overlap(subject, named) & F.col("table_number").isNotNull() & F.col("row_number").isNotNull() & ~fold(F.col("content")).startswith("table headers:")


def matches_facet(name: str) -> Column:
    where = fold(F.coalesce("section", F.lit(""))).contains("calculation") if name == "calculation" else fold(F.coalesce("sheet_name", F.lit(""))).contains(_IN_SHEET[name])
    return has_any(F.col("_tessera_c"), FACETS[name]) | where


def facet_reservations(ranked: DataFrame, limit: int, by: str = "qid") -> DataFrame:
    """reserved: the place (from 1) of grouped sheet rows that stand for a requested facet, null for others.

    Each requested facet in turn takes its best match not yet taken, up to min(3, limit); this is a fold over five facets of the at most
    20 candidates of a question, so it runs inside the row.
    """
    grouped = F.coalesce((F.col("file_type") == "xlsx") & fold(F.col("section")).contains("grouped rows"), F.lit(False))
    flags = F.struct("place", F.array(*(F.when(grouped & matches_facet(f), True).otherwise(False) for f in FACETS)).alias("m"))
    per = W.partitionBy(by)
    rows = ranked.withColumn("_tessera_list", F.sort_array(F.collect_list(flags).over(per)))
    asked = F.array(*(has_any(F.col("_tessera_q"), v) for v in FACETS.values()))
    rows = rows.withColumn("_tessera_asked", asked)
    wanted = F.filter(F.transform("_tessera_asked", lambda a, i: F.when(a, i)), lambda i: i.isNotNull())

    def take(held: Column, facet: Column) -> Column:
        found = F.filter("_tessera_list", lambda x: F.get(x["m"], facet) & ~F.array_contains(held, x["place"]))
        return F.when((F.size(held) < min(3, limit)) & (F.size(found) > 0), F.concat(held, F.array(F.get(found, F.lit(0))["place"]))).otherwise(held)

    held = F.aggregate(wanted, F.array().cast("array<int>"), take)
    held = F.when((F.size(wanted) >= 2) & ~historical_intent(F.col("question")), held)
    return rows.withColumn("reserved", F.nullif(F.array_position(held, F.col("place")), F.lit(0))).drop("_tessera_list", "_tessera_asked")


def select_context(candidates: DataFrame, limit: int = CONTEXT, by: str = "qid") -> DataFrame:
    """(candidate columns, rank_score, position) of the evidence pack; candidates: (qid, question, historical, rank, chunk columns), at most 20 each."""
    if not 1 <= limit <= CONTEXT:
        raise ValueError(f"limit must be between 1 and {CONTEXT}")
    bounded = candidates.withColumn("_tessera_all", F.count(F.lit(1)).over(W.partitionBy(by)))
    bounded = bounded.withColumn("rank", F.when(F.col("_tessera_all") <= CANDIDATES, F.col("rank")).otherwise(F.raise_error(F.lit(f"at most {CANDIDATES} candidates")).cast("int"))).drop("_tessera_all")
    rows = suppress_stale(narrow_rate_cards(dedup_keep_first(bounded, by), by), by)
    ranked = rank_scores(rows, by)
    ranked = ranked.withColumn("_tessera_row", requirement_rows(by)).withColumn("_tessera_rows", F.max("_tessera_row").over(W.partitionBy(by)))
    ranked = facet_reservations(ranked, limit, by)
    first = F.when(F.col("_tessera_rows"), F.when(F.col("_tessera_row"), F.col("place"))).otherwise(F.col("reserved"))
    out = ranked.withColumn("position", F.row_number().over(W.partitionBy(by).orderBy(first.asc_nulls_last(), "place"))).filter(F.col("position") <= limit)
    return out.drop("_tessera_q", "_tessera_c", "_tessera_r", "_tessera_n", "_tessera_hits", "_tessera_numbers", "_tessera_related", "_tessera_near", "_tessera_row", "_tessera_rows", "place", "reserved")
