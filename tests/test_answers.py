"""Model analysis, answers, traces and the evaluation loop, and the searches against plain versions."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import corpus, fusion, search
from tessera.plans import answers, plugins, registry

GOOD = {"standalone_query": "rates of 2024", "ambiguous": False, "clarification": None, "temporal_intent": "historical", "subqueries": ["rates of 2024"], "resolved_from_context": True}


def test_model_analysis_is_strict(spark):
    bad = [{"more": 1}, {"temporal_intent": "never"}, {"subqueries": []}, {"subqueries": ["a", "b", "c", "d"]}, {"subqueries": [" "]}, {"subqueries": "a"}, {"ambiguous": "no"}, {"standalone_query": " "}, {"standalone_query": 3}, {"ambiguous": True}]
    said = [json.dumps(GOOD)] + [json.dumps(GOOD | b) for b in bad] + [json.dumps({k: v for k, v in GOOD.items() if k != "ambiguous"}), "[]", "no json", None]
    questions = spark.createDataFrame([(i, f"What about number {i}", "earlier") for i in range(len(said))], "qid long, question string, prior string").coalesce(1)
    by = {f"What about number {i}": s for i, s in enumerate(said)}
    rows = {r.qid: r for r in plugins.analyse_with(lambda asked, _: [by[q] for q in asked], questions).collect()}
    assert rows[0].standalone_query == "rates of 2024" and rows[0].temporal_intent == "historical"
    assert all(rows[i].standalone_query == f"earlier What about number {i}" for i in range(1, len(said)))

    def broken(asked, said):
        raise OSError("away")

    for model in (broken, lambda asked, said: []):
        assert {r.standalone_query for r in plugins.analyse_with(model, questions).collect()} == {f"earlier What about number {i}" for i in range(len(said))}


def test_generator_plugs_in(spark):
    context = spark.createDataFrame([(1, 1, "c1", "t", "Some text")], "qid long, position int, id string, title string, content string")
    questions = spark.createDataFrame([(1, "q"), (2, "other")], "qid long, question string")
    made = plugins.generate_with(lambda asked, prompts: [f"{q}: {p}" for q, p in zip(asked, prompts, strict=True)], questions, context).collect()
    assert [(r.qid, r.answer) for r in made] == [(1, "q: [c1] t\nSome text")]


def test_evaluation_keeps_errors_in_their_rows(spark):
    cases = spark.createDataFrame([(i, f"CORE-{i:03d}", f"q{i}") for i in range(1, 8)], "qid long, id string, question string")

    def pipeline(rows):
        wrong = F.when(F.col("qid") == 5, F.raise_error(F.lit("case five"))).otherwise(F.concat(F.lit("answer "), "question"))
        cite = F.array(F.struct(F.lit("c").alias("chunk_id"), F.lit("s").alias("source"), F.lit(1).alias("page"), F.lit("x").alias("section")))
        return rows.select("qid", wrong.alias("answer"), cite.alias("citations"), F.lit(2).alias("retrieved_chunks"))

    rows = answers.evaluate(cases, {"one": pipeline, "none": lambda r: 1 / 0 if False else pipeline(r.filter("qid < 0"))}).collect()
    one = {r.case_id: r for r in rows if r.pipeline == "one"}
    assert len(one) == 7 and "case five" in one["CORE-005"].error and one["CORE-005"].answer is None
    assert all(r.error is None and r.answer == f"answer {r.question}" and r.latency_ms >= 0 for k, r in one.items() if k != "CORE-005")
    assert len({r.latency_ms for r in one.values()}) > 1  # each case has its own
    assert set(one["CORE-001"].judgment.asDict()) == {*answers.FORM, "judge_notes"} and not any(one["CORE-001"].judgment)


def test_trace_holds_the_whole_request(spark, small):
    pack = registry.context(spark, small)
    qids = [r.qid for r in pack.select("qid").distinct().orderBy("qid").limit(2).collect()]
    known = dict(standalone_query="q", temporal_intent="unspecified", subqueries=["full", "four"], ambiguous=False, clarification=None, resolved_from_context=False)
    rows = [
        dict(known, qid=qids[0], question="q?", route="retrieve", status="answered", searched=["four"], generation_output="eight by"),
        dict(known, qid=qids[1], question="q?", route="retrieve", status="insufficient_evidence", searched=["four"], generation_output=None),
        dict(known, qid=-1, question="Hi", route="greeting", status="answered", searched=[], generation_output=None),
    ]
    told = spark.createDataFrame(rows, "qid long, question string, route string, status string, standalone_query string, temporal_intent string, subqueries array<string>, ambiguous boolean, clarification string, resolved_from_context boolean, searched array<string>, generation_output string")
    read = pack.groupBy("qid").agg(F.sum(text.token_estimate(F.col("content"))).alias("context_tokens"))
    told = told.join(read, "qid", "left").na.fill(0, ["context_tokens"])
    prices = {"embedding": "0.02", "chat_input": "0.40", "chat_output": "1.60"}
    got = {r.qid: json.loads(r.trace) for r in answers.trace(told, pack.withColumn("rank", F.col("position")), pack, prices, {"retrieval_ms": 3.5}, {"embedding": "small"}).collect()}
    whole = got[qids[0]]
    assert [c["rank"] for c in whole["selected_context"]] == list(range(1, len(whole["selected_context"]) + 1)) and re.fullmatch(r"\d{4}-\d\d-\d\d", whole["candidates"][0]["effective_from"])
    tokens = 1 + sum(math.ceil(len(c["content"].encode()) / 4) for c in whole["selected_context"])
    assert whole["usage_cost"] == {"embedding_tokens": 1, "chat_input_tokens": tokens, "chat_output_tokens": 2, "estimated_usd": f"{(0.02 + 0.4 * tokens + 1.6 * 2) / 1e6:.12f}"} and whole["stage_latency"] == {"retrieval_ms": 3.5}
    assert whole["question"] == "q?" and whole["generation_output"] == "eight by" and whole["embedding_deployment"] == "small" and whole["generation_deployment"] == "unknown"
    assert whole["analysis"] == known
    # the model saw no refused question: nothing was generated, only the search was embedded
    refused, greeting = got[qids[1]], got[-1]
    assert refused["selected_context"] and refused["generation_output"] is None and refused["usage_cost"] == {"embedding_tokens": 1, "chat_input_tokens": 0, "chat_output_tokens": 0, "estimated_usd": "0.000000020000"}
    assert greeting["candidates"] == greeting["selected_context"] == [] and greeting["usage_cost"]["estimated_usd"] == "0.000000000000"


def request(spark, question, generate=plugins.first_words, sources=(("KB/Sales/b.pdf", "B"), ("KB/Sales/A.pdf", "A"), ("KB/it/c.docx", "C")), stages=None, groups=None, allowed="array('staff')"):
    """A question over three documents, all found by every search."""
    kind = ", ".join(f"{n} string" for n in ("key", "id", "content", "title", "source_path", "section", "document_id", "content_hash", "file_type", "department", "document_type", "version", "sheet_name"))
    rows = [(f"k{i}", f"c{i}", f"The travel allowance is {i}0.\nRow: {i}", title, path, "s", f"d{i}", f"h{i}", "xlsx", path.split("/")[-2], "policy", "1", "Sheet") for i, (path, title) in enumerate(sources, 1)]
    known = spark.createDataFrame(rows, kind).selectExpr("*", "cast(null as date) as effective_from", "cast(null as date) as effective_to", "cast(null as boolean) as is_current", "4 as page_number", "cast(null as int) as table_number", "cast(null as int) as row_number", f"{allowed} as allowed_groups")
    search_all = lambda q: q.crossJoin(known.select(F.col("key").alias("id"))).selectExpr("qid", "id", "1.0D as score", "cast(substr(id, 2) as int) as rank")
    asked = spark.createDataFrame([(1, question, None, groups or [])], "qid long, question string, prior string, groups array<string>")
    return answers.answer(asked if groups is not None else asked.drop("groups"), search_all, known, "key", generate, stages=stages, access=groups is not None).first()


def test_whole_answers_keep_to_what_the_caller_may_read(spark):
    # the search gives all chunks to everybody; those of Sales are for sales only, the other for the staff
    allowed = "case when department = 'Sales' then array('Sales team') else array('Staff', cast(null as string)) end"
    ask = lambda question, groups: request(spark, question, speaking("See [c3]."), groups=groups, allowed=allowed)
    staff, sales, nobody = (ask("What is the travel allowance?", g) for g in (["STAFF"], ["sales team"], []))
    assert staff.status == "answered" and staff.retrieved_chunks == 1 and staff.answer == "See [c3]."
    assert sales.status == "insufficient_evidence" and sales.retrieved_chunks == 2  # what it may not read can't be cited
    assert nobody.status == "insufficient_evidence" and nobody.retrieved_chunks == 0 and nobody.generation_output is None
    told = {g: ask("Which documents are available?", list(g)).answer for g in (("staff",), ("Sales Team", "x"), ())}
    assert told == {("staff",): "1 document is indexed:\n- C - KB/it/c.docx", ("Sales Team", "x"): "2 documents are indexed:\n- A - KB/Sales/A.pdf\n- B - KB/Sales/b.pdf", (): "No documents are currently indexed."}


def test_inventory_lists_counts_and_says_none(spark):
    said = {
        "Which documents are available?": "3 documents are indexed:\n- C - KB/it/c.docx\n- A - KB/Sales/A.pdf\n- B - KB/Sales/b.pdf", "how many documents are indexed": "3 documents are indexed.", "How many files are in Sales?": "2 Sales documents are indexed.",
        "list the files of SALES": "2 Sales documents are indexed:\n- A - KB/Sales/A.pdf\n- B - KB/Sales/b.pdf", "total number of documents in it": "1 it document is indexed.", "list documents in it": "1 it document is indexed:\n- C - KB/it/c.docx",
    }
    sources = spark.createDataFrame([("KB/Sales/b.pdf", "B"), ("KB/Sales/A.pdf", "A"), ("KB/it/c.docx", "C")], "source_path string, title string")
    asked = spark.createDataFrame(list(enumerate(said)), "qid long, question string")
    assert {list(said)[r.qid]: r.answer for r in answers.inventory(asked, sources).collect()} == said
    assert {r.answer for r in answers.inventory(asked, sources.limit(0)).collect()} == {"No documents are currently indexed."}


def speaking(text):
    return lambda questions, context: questions.select("qid", F.lit(text).alias("answer"))


def test_answers_carry_plain_marks(spark):
    stages = {}
    got = request(spark, "What is the travel allowance?", speaking("Both [c1, c2], rows [c1 rows 1], page [c2, page 4] and [[c1]]."), stages=stages)
    assert got.status == "answered" and got.answer == "Both [c1] [c2], rows [c1], page [c2] and [c1]." and [c.chunk_id for c in got.citations] == ["c1", "c2"]
    assert got.searched == ["What is the travel allowance?"] and set(stages) == {"analysis_ms", "retrieval_ms", "generation_ms"} and min(stages.values()) > 0
    bad = request(spark, "What is the travel allowance?", speaking("Made up [c9]."))
    assert bad.status == "insufficient_evidence" and bad.answer == registry.analysis.REFUSAL and bad.generation_output == "Made up [c9]." and bad.citations is None
    shut = request(spark, "Unrelated zebra crossing?", speaking("[c1]"))
    assert shut.status == "insufficient_evidence" and shut.generation_output is None and shut.retrieved_chunks > 0


def test_baseline_takes_plain_marks_only(spark):
    kind = "key string, id string, content string, title string, source_path string, section string, file_type string, sheet_name string, page_number int, table_number int, row_number int"
    known = spark.createDataFrame([(f"k{i}", f"c{i}", f"text {i}", "t", "p", "s", "pdf", None, 4, None, None) for i in (1, 2)], kind)
    hits = spark.createDataFrame([(q, f"k{i}", i) for q in (1, 2, 3) for i in (1, 2)], "qid long, id string, rank int")
    asked = spark.createDataFrame([(q, "q") for q in (1, 2, 3, 4)], "qid long, question string")
    said = {1: "See [c2] and [c1].", 2: "See [c1, page 4].", 3: "No mark."}
    got = {r.qid: r for r in answers.baseline(asked, hits, known, lambda q, c: q.filter("qid < 4").withColumn("answer", F.element_at(F.create_map(*(F.lit(x) for kv in said.items() for x in kv)), F.col("qid").cast("int")))).collect()}
    assert got[1].answer == said[1] and [c.chunk_id for c in got[1].citations] == ["c2", "c1"] and got[1].status == "answered"
    assert {got[q].answer for q in (2, 3, 4)} == {registry.analysis.REFUSAL} and got[2].generation_output == said[2] and got[4].generation_output is None
    assert [got[q].retrieved_chunks for q in (1, 2, 3, 4)] == [2, 2, 2, 0]


def test_fusion_refuses_a_fourth_list(spark):
    hit = dict(rank=0, score=1.0, source_path="a.pdf", content="c", content_hash="h", department="d", document_type="t", version="1")
    rows = [dict(hit, qid=1, subquery=i, id=f"id{i}") for i in range(4)]
    assert fusion.fuse(spark.createDataFrame(rows[:3])).count() == 1
    for part in (rows, [dict(hit, qid=1, subquery=-1, id="x")]):
        with pytest.raises(PySparkException):
            fusion.fuse(spark.createDataFrame(part)).collect()


def test_folding_is_case_folding(spark):
    letters = "ßẞſŉǰẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ" + "ÄÖÜABCéĲ"
    rows = spark.createDataFrame([(c,) for c in [*letters, letters, "", None]], "t string").select("t", text.fold(F.col("t")).alias("f")).collect()
    assert all(r.f == (None if r.t is None else r.t.casefold()) for r in rows)


def test_bm25_in_blocks_and_with_titles(spark):
    draw = random.Random(2)
    docs = [(i, draw.choice(["red fox", "blue hen", None]), " ".join(draw.choice("a b c d e f g".split()) for _ in range(draw.randint(0, 30))) if i % 9 else None) for i in range(120)]
    asked = [(i, " ".join(draw.choice("a b c d e red hen zzz".split()) for _ in range(4))) for i in range(15)] + [(99, ""), (98, None)]
    said = {i: re.findall("[a-z0-9]+", f"{t or ''}\n{x or ''}") for i, t, x in docs}
    n, mean = len(said), sum(map(len, said.values())) / len(said)
    want = Counter()
    for q, t in asked:
        scores = []
        for i, words in said.items():
            s = [math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean)) for w in set((t or "").split()) if (tf := words.count(w)) for df in [sum(w in x for x in said.values())]]
            if s:
                scores.append((-round(sum(s), 6), i))
        want.update((q, i, k, -s) for k, (s, i) in enumerate(sorted(scores)[:5], 1))
    d, q = spark.createDataFrame(docs, "doc_id long, title string, text string").repartition(4), spark.createDataFrame(asked, "qid long, text string")
    for block in (4096, 4):
        got = search.bm25_top_k(d, q, 5, columns=("title", "text"), block=block).collect()
        assert Counter((r.qid, r.doc_id, r["rank"], r.score) for r in got) == want
    assert search.bm25_top_k(d.limit(0), q).count() == 0 and search.bm25_top_k(d, q.limit(0)).count() == 0


def test_containing_passages(spark):
    docs = [(1, "one two three"), (2, "two"), (3, None), (4, ""), (5, "x two three y")]
    wanted = [(1, "two"), (2, "two three"), (3, ""), (4, None), (5, "absent"), (6, "two")]
    for size in (32 << 20, 4):
        got = search.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(wanted, "qid long, text string"), size).collect()
        assert Counter((r.doc_id, r.qid) for r in got) == Counter((i, q) for i, t in docs for q, p in wanted if t is not None and p is not None and p in t)


def test_percentiles_are_exact(spark):
    draw = random.Random(6)
    rows = [(draw.choice("abc"), draw.choice([1.0, 1.0, draw.random(), -draw.random() * 50])) for _ in range(4000)] + [("d", 4.0), (None, 1.0), (None, 2.0), ("e", None)]
    got = {r.k: r for r in corpus.percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for key in ("a", "b", "c", "d", None):
        own = sorted(v for k, v in rows if k == key)
        for name, share in (("p50", 0.5), ("p95", 0.95)):
            spot = share * (len(own) - 1)
            low = own[math.floor(spot)]
            assert got[key][name] == pytest.approx(low + (spot - math.floor(spot)) * (own[math.ceil(spot)] - low))
