"""Question analysis without a model: follow-ups, ambiguity, time intent, sub-questions, routing, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.names import private
from tessera.functions.text import YEAR, fold, historical_intent, squeeze, year_matches

MAX_LENGTH, MAX_TURNS, MAX_SUBQUERIES = 2000, 6, 3
CLARIFICATION = "Which document, plan, policy, or subject do you mean?"
GREETING_ANSWER = "Hi! Ask me a question about the company knowledge base."
REFUSAL = "I could not find enough supporting information in the knowledge base to answer that."

# The patterns that route questions.
FOLLOW_UP = r"(?i)^(?:what about|and what about|how about|and|does that|is there|are there|what if)\b"
GENERIC = r"(?i)^(?:what(?:'s| is)|tell me about)\s+(?:the\s+)?(?:limit|policy|price|cost|rate|exception|requirement)\??$"
COMPARISON = r"(?i)\b(?:compare|comparison|versus|vs\.?|difference between)\b"
GREETING = r"(?i)^(?:hi|hello|hey|good\s+(?:morning|afternoon|evening))(?:\s+there)?[!.,?\s]*$"
DOCUMENTS = r"(?i)\b(?:documents?|files?)\b"
INVENTORY = r"(?i)\b(?:available|indexed|index|list|inventory|total|how\s+many|what\s+all)\b|\bin\s+(?:the\s+)?(?:rag|knowledge\s+base|index)\b"
COUNTING = r"(?i)\b(?:how\s+many|total(?:\s+number)?|number\s+of)\b"


def last_user_turn(turns: DataFrame) -> DataFrame:
    """prior: the user's last text among the six legal turns before each."""
    legal = turns.filter(F.col("role").isin("user", "assistant"))
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-MAX_TURNS, -1)
    return legal.withColumn("prior", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before))


def subject(query: Column) -> Column:
    """A comparison's subject: years, scaffolding and dangling prepositions taken off."""
    out = F.regexp_replace(query, YEAR, " ")
    out = F.regexp_replace(out, r"(?i)\b(?:difference\s+between|compare(?:d)?|comparison|versus|vs\.?)\b", " ")
    out = F.regexp_replace(out, r"(?i)\b(?:and|or)\b", " ")
    out = F.regexp_replace(out, r"(?i)\b(?:in|for|from|between|to)\s*(?=[,.!?;:]|$)", " ")
    out = F.btrim(squeeze(F.regexp_replace(out, r"\s+([,.!?;:])", "$1")), F.lit(" ,.!?;:"))
    return F.regexp_replace(out, r"(?i)^(?:the|a|an)\s+", "")


def distinct_queries(queries: Column) -> Column:
    """The first of those that are equal without case and white space, at most three."""
    plain = F.filter(F.transform(queries, squeeze), lambda q: q != "")
    kept = F.aggregate(plain, F.array().cast("array<string>"), lambda held, q: F.when(F.exists(held, lambda h: fold(h) == fold(q)), held).otherwise(F.concat(held, F.array(q))))
    return F.slice(kept, 1, MAX_SUBQUERIES)


def analyze(questions: DataFrame) -> DataFrame:
    """Adds standalone_query, ambiguous, clarification, temporal_intent, subqueries and resolved_from_context to (question, prior)."""
    text, prior = squeeze(F.col("question")), squeeze(F.col("prior"))
    resolved = F.coalesce((F.col("prior") != "") & text.rlike(FOLLOW_UP), F.lit(False))
    out = questions.withColumn("resolved_from_context", resolved).withColumn("standalone_query", F.when(F.col("resolved_from_context"), F.concat_ws(" ", prior, text)).otherwise(text))
    out = out.withColumn("ambiguous", text.rlike(GENERIC) & ~F.col("resolved_from_context")).withColumn("clarification", F.when(F.col("ambiguous"), CLARIFICATION))
    full = F.col("standalone_query")
    intent = F.when(F.col("ambiguous"), "unspecified").when(full.rlike(COMPARISON), "comparison").when(historical_intent(full), "historical").otherwise("unspecified")
    (years,) = private(out.columns, "years")
    out = out.withColumn("temporal_intent", intent).withColumn(years, F.array_distinct(F.concat(year_matches(full), year_matches(F.col("question")))))
    sides = F.transform(F.slice(years, 1, MAX_SUBQUERIES - 1), lambda y: F.when(year_matches(full) == F.array(y), full).when(subject(full) != "", F.concat(subject(full), F.lit(" in "), y)).otherwise(y))
    several = (F.col("temporal_intent") == "comparison") & (F.size(years) >= 2)
    return out.withColumn("subqueries", F.when(several, distinct_queries(F.concat(F.array(full), sides))).otherwise(F.array(full))).drop(years)


def searches(analyzed: DataFrame) -> DataFrame:
    """One row (qid, subquery, query) for each search: the broad question is left out where there are specific ones."""
    broad = (F.size("subqueries") > 1) & (F.element_at("subqueries", 1) == F.col("standalone_query"))
    run = F.when(broad, F.slice("subqueries", F.lit(2), F.size("subqueries"))).otherwise(F.col("subqueries"))
    return analyzed.select("qid", F.posexplode(run).alias("subquery", "query"))


def route(question: Column, ambiguous: Column) -> Column:
    text = F.btrim(question)
    return F.when(ambiguous, "clarify").when(text.rlike(GREETING), "greeting").when(question.rlike(DOCUMENTS) & question.rlike(INVENTORY), "inventory").otherwise("retrieve")


def rejected(question: Column, top_k: Column, turns: Column) -> Column:
    """Why a request is not valid; null if it is."""
    length = F.length(F.btrim(question))
    return F.when(question.isNull() | (length == 0), "empty_question").when(length > MAX_LENGTH, "question_too_long").when(~top_k.between(1, 20), "top_k_out_of_range").when(turns > MAX_TURNS, "too_many_turns")
