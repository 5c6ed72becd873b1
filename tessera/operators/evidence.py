"""Evidence gate, citation checks and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import GATE_STOP, join_present, literals, stems

# How conflicts are asked for and how facts are stated.
CONFLICT = r"(?i)\b(?:conflict|conflicting|contradict|contradictory|discrepanc|correct|disagree|inconsistent)"
FACT = r"(?i)\b(?:is|are|was|were|costs?|priced at)\s+([^.;\n]+)"
BLOCK = r"\[([^\[\]]*)\]"
ANNOTATION = r"(?i)^([^,\s]+),?\s+(rows?|pages?)\s+([0-9,\s]+)$"


def signatures(content: Column) -> Column:
    """The first eight stems of what each stated fact says."""
    return F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit(FACT), F.lit(1)), lambda m: F.array_join(F.slice(stems(m), 1, 8), " ")))


def evidence_gate(questions: DataFrame, context: DataFrame, min_hits: int = 2) -> DataFrame:
    """(qid, sufficient, reason, query_terms, matched_terms); context: (qid, content, title, section, sheet_name)."""
    if min_hits < 1:
        raise ValueError("min_hits must be positive")
    terms = F.array_sort(F.array_except(F.array_distinct(stems(F.col("question"))), literals(GATE_STOP)))
    asked = questions.select("qid", "question", terms.alias("query_terms"))
    own = stems(join_present(*(F.col(c) for c in ("content", "title", "section", "sheet_name"))))
    chunks = context.select("qid", own.alias("_own"), signatures(F.col("content")).alias("_facts"))
    # at most a few chunks a question, so its evidence fits a row
    joined = asked.join(chunks, "qid", "left").withColumn("_hit", F.array_intersect("query_terms", "_own"))
    facts = F.when(F.size("_hit") > 0, F.col("_facts"))
    grouped = joined.groupBy("qid", "question", "query_terms").agg(F.count("_own").alias("_n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hit")))).alias("matched_terms"), F.size(F.array_distinct(F.flatten(F.collect_list(facts)))).alias("_said"))
    needed = F.least(F.lit(min_hits), F.when(F.size("query_terms") <= 2, 1).otherwise(2))
    reason = F.when(F.col("_n") == 0, "no_retrieved_evidence").when(F.col("question").rlike(CONFLICT) & (F.col("_said") > 1), "conflicting_evidence").when(F.size("matched_terms") < needed, "insufficient_query_overlap").otherwise("supported_evidence")
    return grouped.select("qid", (reason == "supported_evidence").alias("sufficient"), reason.alias("reason"), "query_terms", "matched_terms")


def verify_citations(answers: DataFrame, context: DataFrame, annotated: bool = True) -> DataFrame:
    """(qid, ok, citations, normalized) for (qid, answer) and (qid, id, title, source_path, page_number, section, sheet_name, table_number, row_number, file_type, content).

    Every bracketed block must cite: a known id, a list of known ids, or an id with a row or page that the chunk has (annotated). One bad block, no
    block, or an id with two provenances refuses the whole answer. citations: distinct, in order of first mention. normalized: the answer with each block written as
    plain marks, one for each id it cites; null where it is refused.
    """
    text = F.regexp_replace("answer", r"\[\s*\[([^\[\]]+)\]\s*\]", "[$1]") if annotated else F.col("answer")
    blocks = answers.select("qid", F.posexplode(F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1)), lambda b: F.btrim(b))).alias("at", "block"))
    origin = F.struct("title", "source_path", "page_number", "section", "sheet_name", "table_number", "row_number")
    known = context.groupBy("qid", "id").agg((F.count_distinct(F.xxhash64(origin)) > 1).alias("torn"), F.first(F.struct("source_path", "page_number", "section", "file_type", "content")).alias("c"))
    torn = known.groupBy("qid").agg(F.max("torn").alias("torn"))
    ids = known.select(F.col("qid").alias("_q"), F.col("id").alias("_id"), "c")
    whole = blocks.join(ids, (F.col("qid") == F.col("_q")) & (F.col("block") == F.col("_id")), "left").select("qid", "at", "block", F.col("_id").alias("whole"))
    parts = F.when(F.col("whole").isNotNull(), F.array("block"))
    if annotated:
        note = F.regexp_extract("block", ANNOTATION, 1)
        parts = F.when(F.col("whole").isNotNull(), F.array("block")).when(note != "", F.array(note)).otherwise(F.transform(F.split("block", ","), lambda x: F.btrim(x)))
    else:
        parts = F.array("block")
    each = whole.withColumn("label", F.lower(F.regexp_extract("block", ANNOTATION, 2))).withColumn("_values", F.transform(F.regexp_extract_all(F.regexp_extract("block", ANNOTATION, 3), F.lit("[0-9]+"), F.lit(0)), lambda v: F.regexp_replace(v, "^0+(?=.)", "")))
    each = each.select("qid", "at", "whole", "label", "_values", F.posexplode(parts).alias("nth", "cited"))
    found = each.join(ids, (F.col("qid") == F.col("_q")) & (F.col("cited") == F.col("_id")), "left").drop("_q")
    plain = F.col("whole").isNotNull() | (F.col("label") == "")
    lines = F.transform(F.regexp_extract_all(F.col("c.content"), F.lit(r"(?im)^Row:[^\S\n]*([0-9]+)\s*$"), F.lit(1)), lambda v: F.regexp_replace(v, "^0+(?=.)", ""))
    rows_there = (F.col("c.file_type") == "xlsx") & (F.size("_values") > 0) & (F.size(F.array_except("_values", lines)) == 0)
    page_there = (F.size("_values") == 1) & (F.element_at("_values", 1) == F.col("c.page_number").cast("string"))
    good = F.col("_id").isNotNull() & F.coalesce(plain | F.when(F.col("label").startswith("page"), page_there).otherwise(rows_there), F.lit(False))
    checked = found.withColumn("good", good)
    ordered = F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("at", "nth", F.col("cited").alias("chunk_id"), F.col("c.source_path").alias("source"), F.col("c.page_number").alias("page"), F.col("c.section").alias("section")))))
    summed = checked.groupBy("qid").agg(F.every("good").alias("_all"), ordered.alias("_cites"))
    out = answers.select("qid", text.alias("_text")).join(summed, "qid", "left").join(torn, "qid", "left")
    ok = F.coalesce(F.col("_all") & ~F.coalesce("torn", F.lit(False)), F.lit(False))
    cites = F.array_distinct(F.transform("_cites", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["source"].alias("source"), x["page"].alias("page"), x["section"].alias("section"))))
    marks = lambda i: F.array_join(F.transform(F.filter("_cites", lambda x: x["at"] == i), lambda x: F.concat(F.lit("["), x["chunk_id"], F.lit("]"))), " ")
    between = F.split("_text", r"\[[^\[\]]*\]", -1)
    plain_marks = F.array_join(F.transform(between, lambda piece, i: F.when(i == 0, piece).otherwise(F.concat(marks(i - 1), piece))), "")
    return out.select("qid", ok.alias("ok"), F.when(ok, cites).alias("citations"), F.when(ok, plain_marks).alias("normalized"))


def display_answer(answer: Column, ids: Column) -> Column:
    """Chunk ids become their number among the citations; each cluster of marks loses its repeats."""
    numbered = F.aggregate(F.transform(ids, lambda x, i: F.struct(x.alias("id"), (i + 1).cast("string").alias("n"))), answer, lambda text, x: F.replace(text, F.concat(F.lit("["), x["id"], F.lit("]")), F.concat(F.lit("["), x["n"], F.lit("]"))))
    # clusters are split off by a mark that texts do not hold, then rebuilt one by one
    parts = F.split(F.regexp_replace(numbered, r"((?:\s*\[\d+\])+)", "\u0001\u0002$1\u0001"), "\u0001")
    marks = lambda p: F.array_join(F.array_distinct(F.regexp_extract_all(p, F.lit(r"\[\d+\]"), F.lit(0))), " ")
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("\u0002"), F.concat(F.lit(" "), marks(p))).otherwise(p)), "")


def prompt(context: DataFrame, by: str = "qid") -> DataFrame:
    """The evidence blocks of each question in rank order."""
    block = F.struct("position", F.concat(F.lit("["), F.col("id"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.col("content")).alias("b"))
    return context.groupBy(by).agg(F.array_join(F.sort_array(F.collect_list(block))["b"], "\n\n").alias("prompt"))


def trace(context: DataFrame, by: str = "qid") -> DataFrame:
    """One JSON document for each question: its selected chunks in order."""
    row = F.struct(F.row_number().over(W.partitionBy(by).orderBy("position")).alias("rank"), "id", "source_path", "rank_score")
    rows = context.withColumn("_row", row)
    return rows.groupBy(by).agg(F.to_json(F.sort_array(F.collect_list("_row")), {"ignoreNullFields": "false"}).alias("trace"))
