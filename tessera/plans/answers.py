"""Whole questions in batches: analyse, route, search, fuse, select, gate, answer, verify; and the evaluation of such answers.

Every step is a table of questions; what several steps read is stored once. Searches, generator and reranker are plugged in (``plugins``).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.identity import parent_of
from tessera.functions.names import private
from tessera.operators import access as acl
from tessera.operators import analysis, corpus, evidence, fusion, selection
from tessera.plans import plugins, store

Search = Callable[[DataFrame], DataFrame]
Generator = Callable[[DataFrame, DataFrame], DataFrame]


def retrieve(runs: DataFrame, search: Search, chunks: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """Hits of each search of each question as chunk rows (qid, subquery, rank from 0, score, ...). search: (qid, text) to (qid, id, score, rank), ids of chunks.

    callers: (qid, groups). The search gets the groups of each query, to rank only what they may read; whatever it gives, a chunk that they may not read is no hit.
    """
    asked = runs.select("qid", (F.col("qid") * fusion.LISTS + F.col("subquery")).alias("key"), F.col("query").alias("text"))
    asked = asked.select(F.col("key").alias("qid"), "text") if callers is None else asked.join(callers, "qid").select(F.col("key").alias("qid"), "text", "groups")
    (hit,) = private(chunks.columns, "hit")
    found = search(asked).select(F.floor(F.col("qid") / fusion.LISTS).alias("qid"), F.pmod("qid", F.lit(fusion.LISTS)).alias("subquery"), (F.col("rank") - 1).alias("rank"), "score", F.col("id").alias(hit))
    hits = found.join(chunks.withColumnRenamed("key", hit), hit).drop(hit)
    if callers is None:
        return hits
    (own,) = private(hits.columns, "caller")
    seen = F.arrays_overlap(acl.folded(F.col("allowed_groups")), F.col(own))
    return hits.join(callers.select("qid", acl.folded(F.col("groups")).alias(own)), "qid").filter(F.coalesce(seen, F.lit(False))).drop(own)


def readable_sources(chunks: DataFrame, arrival: str) -> DataFrame:
    """(source_path, title, allowed_groups): the documents with the groups that may read any of their chunks."""
    path = lambda: text.fold(F.replace(F.col("source_path"), F.lit("\\"), F.lit("/")))
    groups = chunks.select(path().alias("k"), F.explode(acl.folded(F.col("allowed_groups"))).alias("g")).groupBy("k").agg(F.collect_set("g").alias("allowed_groups"))  # a document's groups
    return corpus.distinct_sources(chunks, arrival).withColumn("k", path()).join(groups, "k", "left").drop("k")


def fused_candidates(hits: DataFrame, told: DataFrame) -> DataFrame:
    """At most 20 candidates a question in fused order; comparisons put each version family's best first. told: (qid, standalone_query, temporal_intent)."""
    said = told.select("qid", F.col("standalone_query").alias("question"), "temporal_intent", F.col("temporal_intent").isin("historical", "comparison").alias("historical"))
    named = hits.join(said.select("qid", "temporal_intent"), "qid")
    compared = F.col("temporal_intent") == "comparison"
    ranked = fusion.fuse(named.filter(~compared)).unionByName(fusion.fuse(named.filter(compared), comparison=True)).select("qid", "rank", "id")
    (nth,) = private(hits.columns, "nth")
    once = hits.withColumn(nth, F.row_number().over(W.partitionBy("qid", "id").orderBy("subquery", "rank"))).filter(F.col(nth) == 1).drop(nth, "rank", "subquery")
    return ranked.join(once, ["qid", "id"]).join(said.drop("temporal_intent"), "qid")


def inventory(asked: DataFrame, sources: DataFrame, access: bool = False) -> DataFrame:
    """(qid, answer): the documents of the department that the question names, or all, by path; only their number if it is asked for. sources: (source_path, title).

    Without documents it says so. A department is spelled as its paths do (the first spelling). A list is one text and must fit a row; counts and lists are made once for each scope that is asked for, and lists for those only.
    access: of the documents whose ``allowed_groups`` hold one of the ``groups`` of the question (see ``access``); callers of the same groups share their counts and lists. A department that the caller can't read has no documents.
    """
    nobody = F.array().cast("array<string>")
    path = F.replace(F.col("source_path"), F.lit("\\"), F.lit("/"))
    parent = parent_of(path)
    named = sources.select(parent.alias("spelled"), text.fold(parent).alias("scope"), F.struct(text.fold(F.col("source_path")).alias("k"), "source_path", F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(" - "), F.col("source_path")).alias("line")).alias("entry"), (acl.folded(F.col("allowed_groups")) if access else nobody).alias("allowed"))
    callers = asked.select("qid", (acl.folded(F.col("groups")) if access else nobody).alias("caller"))
    told = asked.join(corpus.department_in_question(asked, sources), "qid", "left")
    told = told.select("qid", F.coalesce("department", F.lit("")).alias("scope"), F.col("question").rlike(analysis.COUNTING).alias("counting")).join(callers, "qid")
    if access:  # a document and a caller meet at the groups they share, once
        groups = callers.select("caller").distinct().select("caller", F.explode("caller").alias("group"))
        named = named.withColumn("group", F.explode("allowed")).join(groups, "group").select("caller", "spelled", "scope", "entry").distinct()
    else:
        named = named.withColumn("caller", nobody)
    at = ["caller", "scope"]
    in_scopes = named.withColumn("scope", F.explode(F.array_distinct(F.array(F.lit(""), "scope"))))
    counts = in_scopes.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("scope") != "", F.col("spelled"))).alias("spelled"))
    lists = in_scopes.join(told.filter(~F.col("counting")).select(*at).distinct(), at, "left_semi").groupBy(*at).agg(F.array_join(F.sort_array(F.collect_list("entry"))["line"], "\n").alias("entries"))
    one = F.col("n") == 1
    summary = F.concat(F.concat_ws(" ", F.col("n").cast("string"), F.nullif("spelled", F.lit("")), F.when(one, "document is indexed").otherwise("documents are indexed")))
    full = F.when(F.col("n").isNull(), "No documents are currently indexed.").when(F.col("counting"), F.concat(summary, F.lit("."))).otherwise(F.concat(summary, F.lit(":\n"), F.col("entries")))
    return told.join(counts, at, "left").join(lists, at, "left").select("qid", full.alias("answer"))


def answer(questions: DataFrame, search: Search, chunks: DataFrame, arrival: str, generate: Generator = plugins.first_words, analyse: Callable[[DataFrame], DataFrame] = analysis.analyze, rerank: Callable[[DataFrame], DataFrame] | None = None, stages: dict[str, float] | None = None, access: bool = False) -> DataFrame:
    """(qid, question, route, status, answer, citations, retrieved_chunks, standalone_query, temporal_intent, subqueries, ambiguous, clarification, resolved_from_context, searched, generation_output, context_tokens) for (qid, question, prior).

    Ambiguous questions are answered by a clarification, greetings by a greeting, questions for the inventory by lists or counts, all others by retrieval: no
    evidence, a shut gate or a citation that does not hold refuse. Citations are written as plain marks. searched: the queries that were run; generation_output: what the generator said, null where it was not called.
    chunks: chunk rows with the search's ``key``; arrival orders first titles. stages: gets the batch's times in milliseconds.
    access: questions carry the ``groups`` of their caller; searches, context and inventory keep to what these may read (see ``access``), and without groups nothing is found.
    """
    began, times = time.perf_counter(), {} if stages is None else stages

    def lap(name: str) -> None:
        nonlocal began
        now = time.perf_counter()
        times[name], began = round((now - began) * 1000, 2), now

    told = store.materialise(analyse(questions).withColumn("route", analysis.route(F.col("question"), F.col("ambiguous"))), "analysed")
    lap("analysis_ms")
    asked = told.filter("route = 'retrieve'")
    runs = analysis.searches(asked)
    callers = questions.select("qid", "groups") if access else None
    hits = store.materialise(plugins.rerank(retrieve(runs, search, chunks, callers), rerank), "hits")
    pack = store.materialise(selection.select_context(fused_candidates(hits, asked)), "packs")
    lap("retrieval_ms")
    plain = asked.select("qid", F.col("standalone_query").alias("question"))
    gate = store.materialise(evidence.evidence_gate(plain, pack), "gates")
    open_gates = gate.filter("sufficient").select("qid")
    open_packs = pack.join(open_gates, "qid", "left_semi")
    made = store.materialise(generate(plain.join(open_gates, "qid", "left_semi"), open_packs).select("qid", F.col("answer").alias("generation_output")), "generated")
    lap("generation_ms")
    checked = evidence.verify_citations(made.withColumnRenamed("generation_output", "answer"), open_packs)
    counts = pack.groupBy("qid").agg(F.count(F.lit(1)).alias("retrieved_chunks"), F.sum(text.token_estimate(F.coalesce("content", F.lit("")))).alias("context_tokens"))
    searched = runs.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("subquery", "query")))["query"].alias("searched"))  # a few a question
    listing = told.filter("route = 'inventory'").select("qid", "question")
    counted = inventory(listing.join(callers, "qid"), readable_sources(chunks, arrival), True) if access else inventory(listing, corpus.distinct_sources(chunks, arrival))
    counted = counted.withColumnRenamed("answer", "counted")
    kept = ["qid", "question", "route", "standalone_query", "temporal_intent", "subqueries", "ambiguous", "clarification", "resolved_from_context"]
    said = told.select(*kept)
    for part in (made, checked, counts, searched, counted):
        said = said.join(part, "qid", "left")
    ok = F.coalesce("ok", F.lit(False)) & F.coalesce(F.size("citations") > 0, F.lit(False))
    words = F.when(F.col("route") == "clarify", F.col("clarification")).when(F.col("route") == "greeting", analysis.GREETING_ANSWER).when(F.col("route") == "inventory", F.col("counted")).when(ok, F.col("normalized")).otherwise(analysis.REFUSAL)
    status = F.when(F.col("route") == "clarify", "clarification").when((F.col("route") != "retrieve") | ok, "answered").otherwise("insufficient_evidence")
    none = F.array().cast("array<string>")
    return said.select("qid", "question", "route", status.alias("status"), words.alias("answer"), F.when(ok, F.col("citations")).alias("citations"), F.coalesce("retrieved_chunks", F.lit(0)).alias("retrieved_chunks"), *kept[3:], F.coalesce("searched", none).alias("searched"), "generation_output", F.coalesce("context_tokens", F.lit(0)).cast("long").alias("context_tokens"))


def usage(answers: DataFrame) -> DataFrame:
    """(qid, embedding_tokens, chat_input_tokens, chat_output_tokens) of the calls that were made: embeddings of the queries searched for, and question, chunks and raw output where an answer was generated."""
    estimate = lambda c: text.token_estimate(F.coalesce(c, F.lit("")))
    made, zero = F.col("generation_output").isNotNull(), F.lit(0).cast("long")
    embedded = F.aggregate("searched", zero, lambda n, x: n + estimate(x))
    return answers.select("qid", embedded.alias("embedding_tokens"), F.when(made, estimate(F.col("standalone_query")) + F.col("context_tokens")).otherwise(zero).alias("chat_input_tokens"), F.when(made, estimate(F.col("generation_output"))).otherwise(zero).alias("chat_output_tokens"))


def baseline(questions: DataFrame, hits: DataFrame, chunks: DataFrame, generate: Generator = plugins.first_words) -> DataFrame:
    """(qid, status, answer, citations, retrieved_chunks, generation_output) of the plain path for (qid, question) and their vector hits (qid, id, rank): all hits are the context, marks must be plain ids, nothing found or cited refuses."""
    (hit,) = private(chunks.columns, "hit")
    found = hits.select("qid", F.col("id").alias(hit), F.col("rank").alias("position")).join(chunks.withColumnRenamed("key", hit), hit).drop(hit)
    found = store.materialise(found.withColumn("position", F.row_number().over(W.partitionBy("qid").orderBy("position", "id"))), "baseline-hits")
    asked = questions.join(found.select("qid").distinct(), "qid", "left_semi")
    made = store.materialise(generate(asked, found).select("qid", F.col("answer").alias("generation_output")), "baseline-generated")
    checked = evidence.verify_citations(made.withColumnRenamed("generation_output", "answer"), found, annotated=False)
    counts = found.groupBy("qid").agg(F.count(F.lit(1)).alias("retrieved_chunks"))
    ok = F.coalesce("ok", F.lit(False)) & F.coalesce(F.size("citations") > 0, F.lit(False))
    said = questions.select("qid").join(made, "qid", "left").join(checked, "qid", "left").join(counts, "qid", "left")
    return said.select("qid", F.when(ok, "answered").otherwise("insufficient_evidence").alias("status"), F.when(ok, F.col("generation_output")).otherwise(analysis.REFUSAL).alias("answer"), F.when(ok, F.col("citations")).alias("citations"), F.coalesce("retrieved_chunks", F.lit(0)).alias("retrieved_chunks"), "generation_output")


def trace(answers: DataFrame, candidates: DataFrame, context: DataFrame, prices: dict[str, str], stages: dict[str, float] | None = None, deployments: dict[str, str] | None = None) -> DataFrame:
    """(qid, trace): one JSON document a question: what was asked and how it was understood, deployments (``unknown`` if not told), the candidates and the selected context as ranked snapshots (dates in ISO form),
    what the generator said (null where it was not called), stage times, tokens and cost of the calls made. answers: as ``answer`` gives them."""

    def snapshots(rows: DataFrame, order: str, name: str) -> DataFrame:
        days = {n: F.date_format(n, "yyyy-MM-dd") for n, t in rows.dtypes if t == "date"}
        ranked = rows.withColumns(days).withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(order, "id")))
        return ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", *(c for c in rows.columns if c not in ("qid", "rank", "id", "question"))))).alias(name))  # at most 20 rows

    used = answers.join(usage(answers), "qid").join(snapshots(candidates, "rank", "candidates"), "qid", "left").join(snapshots(context, "position", "selected_context"), "qid", "left")
    kinds = ["embedding", "chat_input", "chat_output"]
    costs = [(F.col(f"{n}_tokens").cast("decimal(18,0)") * F.lit(prices[n]).cast("decimal(9,6)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(36,12)") for n in kinds]
    spent = F.struct(*(f"{n}_tokens" for n in kinds), (costs[0] + costs[1] + costs[2]).cast("string").alias("estimated_usd"))
    latency = F.struct(*(F.lit(float(v)).alias(n) for n, v in (stages or {"total_ms": 0.0}).items()))
    understood = F.struct("standalone_query", "ambiguous", "clarification", "temporal_intent", "subqueries", "resolved_from_context")
    named = [F.lit((deployments or {}).get(n) or "unknown").alias(f"{n}_deployment") for n in ("embedding", "generation")]
    empty = lambda n: F.coalesce(n, F.from_json(F.lit("[]"), used.schema[n].dataType)).alias(n)
    parts = F.struct("question", *named, "route", "status", empty("candidates"), "generation_output", latency.alias("stage_latency"), spent.alias("usage_cost"), empty("selected_context"), understood.alias("analysis"))
    return used.select("qid", F.to_json(parts, {"ignoreNullFields": "false"}).alias("trace"))


#: The dimensions of the blank judgment form.
FORM = ["correctness_0_to_4", "completeness_0_to_4", "grounding_0_to_4", "citation_quality_0_to_4", "total_0_to_16"]


def evaluate(cases: DataFrame, pipelines: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(pipeline, case_id, question, answer, citations, retrieved_chunks, latency_ms, error, judgment) of each case (id, question, qid) by each pipeline.

    A case set is frozen and small. Each case runs alone, as a request would, so that its latency is its own and an error stays in its row.
    """
    spark = cases.sparkSession
    shape = "qid long, answer string, citations array<struct<chunk_id:string,source:string,page:int,section:string>>, retrieved_chunks long, latency_ms double, error string"
    cites = F.transform("citations", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["source"].alias("source"), c["page"].cast("int").alias("page"), c["section"].alias("section")))

    def run(pipeline: Callable[[DataFrame], DataFrame], qid: int) -> tuple:
        began = time.perf_counter()
        made, error = None, None
        try:
            made = pipeline(cases.filter(F.col("qid") == qid)).select("answer", cites.alias("citations"), F.col("retrieved_chunks").cast("long").alias("retrieved_chunks")).first()
        except (PySparkException, ValueError, TypeError, KeyError, RuntimeError, OSError) as e:
            error = f"{type(e).__name__}: {str(e)[:500]}"
        return qid, *(made or (None, None, None)), round((time.perf_counter() - began) * 1000, 2), error

    qids = [r.qid for r in cases.select("qid").orderBy("qid").collect()]
    rows = [(name, *run(pipeline, qid)) for name, pipeline in pipelines.items() for qid in qids]
    blank = F.struct(*(F.lit(None).cast("int").alias(n) for n in FORM), F.lit(None).cast("string").alias("judge_notes"))
    named = cases.select("qid", F.col("id").alias("case_id"), "question").join(spark.createDataFrame(rows, f"pipeline string, {shape}"), "qid")
    return named.select("pipeline", "case_id", "question", "answer", "citations", "retrieved_chunks", "latency_ms", "error", blank.alias("judgment"))
