import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import identity, text
from tessera.operators import analysis, corpus, evidence, fusion, selection, structure
from tessera.plans import registry

CHUNK = "id string, content string, title string, source_path string, section string, score double, content_hash string, file_type string, department string, document_type string, version string, is_current boolean, sheet_name string, table_number int, row_number int, page_number int"


def chunk(id, content="text", **more):
    base = dict(id=id, content=content, title="t", source_path=f"kb/{id}.pdf", section=None, score=None, content_hash=None, file_type="pdf", department="d", document_type=None, version=None, is_current=None, sheet_name=None, table_number=None, row_number=None, page_number=None)
    return base | more


def frame(spark, question, rows, historical=None):
    df = spark.createDataFrame([dict(r, qid=1, rank=i + 1, question=question) for i, r in enumerate(rows)], f"qid int, rank int, question string, {CHUNK}")
    return df.withColumn("historical", text.historical_intent(F.col("question")) if historical is None else F.lit(historical))


def chosen(spark, question, rows, limit=6, historical=None):
    out = selection.select_context(frame(spark, question, rows, historical), limit)
    return [r.id for r in out.orderBy("position").collect()]


@given(n=st.integers(0, 400), size=st.integers(1, 60), share=st.floats(0, 0.99))
@settings(max_examples=300)
def test_window_count_rule(n, size, share):
    overlap = int(share * size)
    starts, at = [], 0
    while n and (not starts or starts[-1] + size < n):
        starts.append(at)
        at += size - overlap
    k = 0 if n == 0 else 1 if n <= size else -(-(n - size) // (size - overlap)) + 1
    assert k == len(starts)


def test_word_windows(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(205)))), (2, ""), (3, " one ")], "k int, t string")
    rows = structure.word_windows(df, "t", 100, 20).orderBy("k", "chunk_number").collect()
    assert [(r.k, r.word_start, r.word_end) for r in rows] == [(1, 0, 100), (1, 80, 180), (1, 160, 205), (3, 0, 1)]
    for bad in ((0, 0), (10, -1), (10, 10), (10, 11)):
        with pytest.raises(ValueError):
            structure.word_windows(df, "t", *bad)
    with pytest.raises(ValueError):
        structure.row_windows(df, ["k"], "k", "t", 1, 0)


def test_row_windows(spark):
    rows = spark.createDataFrame([(1, n, str(n)) for n in range(1, 12)], "s int, n int, t string")
    got = structure.row_windows(rows, ["s"], "n", "t", 5, 2).orderBy("group_number").collect()
    assert [(r.first_row, r.last_row) for r in got] == [(1, 5), (4, 8), (7, 11)]
    assert got[0].text == "1\n\n2\n\n3\n\n4\n\n5"


def test_sheet_rows(spark):
    lines = [(1, ["Prices", None], False, True), (2, [None, None], False, False), (3, ["plan", "price"], True, False), (4, ["basic", None], False, False), (5, [None, None], False, False), (6, ["note", "x"], False, False), (7, ["Effective: now", None], False, True)]
    rows = spark.createDataFrame([("f", *x) for x in lines], "f string, n int, cells array<string>, bold boolean, merged boolean")
    got = structure.classify_rows(rows, ["f"], "n").withColumn("t", structure.render_row(F.lit("w"), F.lit("s"), F.col("n"))).orderBy("n").collect()
    assert [r.kind for r in got] == ["title", "blank", "header", "data", "blank", "key_value", "metadata"]
    assert [r.table_number for r in got] == [None, None, 1, 1, None, None, None]
    assert got[3].t.endswith("Table: 1\nValues: plan=basic; price=[blank]")
    assert got[5].t.endswith("Values: A=note; B=x")


def test_column_letters(spark):
    got = spark.createDataFrame([(i,) for i in (1, 26, 27, 52, 702, 703, 18278)], "i int").select(structure.column_letter(F.col("i"))).collect()
    assert [r[0] for r in got] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "ZZZ"]


def test_text_functions(spark):
    df = spark.createDataFrame([("Straße  Price  2025", "a\r\nb\x7fc \t d\n\n\x01e", "policies pricing prices used ties")], "a string, b string, c string")
    r = df.select(text.raw_tokens(F.col("a")).alias("t"), text.squeeze(F.col("a")).alias("s"), text.page_text(F.col("b")).alias("p"), text.stems(F.col("c")).alias("m"), text.token_estimate(F.lit("€")).alias("one"), text.token_estimate(F.lit("€€")).alias("two"), text.token_estimate(F.lit("")).alias("none")).first()
    assert r.t == ["strasse", "price", "2025"] and r.s == "Straße Price 2025" and r.p == "a\nb- c d\ne"
    assert r.m == ["policy", "pric", "pric", "used", "ties"] and (r.none, r.one, r.two) == (0, 1, 2)


def test_families(spark):
    df = spark.createDataFrame([("kb/pricing-2025.pdf",), ("kb/Pricing2025.pdf",)], "p string")
    none = F.lit(None).cast("string")
    assert [r[0] for r in df.select(identity.selection_family(none, none, F.col("p"))).collect()] == ["pricing", "pricing2025"]
    typed = df.select(identity.fusion_family(F.lit("D"), F.lit("Rate"), none, F.col("p"))).collect()
    assert typed[0][0] == "d|rate|2025"


def test_stale_versions(spark):
    pair = [chunk("old", "plan price", document_type="rate", is_current=False), chunk("new", "plan price now", document_type="rate", is_current=True)]
    assert chosen(spark, "plan price", pair) == ["new"]
    assert set(chosen(spark, "compare 2024 versus 2025 plan price", pair)) == {"old", "new"}
    assert "old" in chosen(spark, "plan price in 2024", pair)
    unknown = [chunk("a", "x", document_type="rate", is_current=None), chunk("b", "y", document_type="rate", is_current=True)]
    assert set(chosen(spark, "plan", unknown)) == {"a", "b"}


def test_dedup_and_bounds(spark):
    rows = [chunk("first", content_hash="h", source_path="KB\\x.pdf"), chunk("other", content_hash="h2"), chunk("again", content_hash="h", source_path="kb/X.pdf"), chunk("else", content_hash="h", source_path="kb/z.pdf")]
    got = chosen(spark, "nothing", rows)
    assert "again" not in got and {"first", "other", "else"} == set(got)
    with pytest.raises(ValueError):
        selection.select_context(frame(spark, "q", rows), 7)
    with pytest.raises(PySparkException):
        chosen(spark, "q", [chunk(str(i)) for i in range(21)])


def test_ties_keep_order_and_neighbours(spark):
    rows = [chunk(f"r{i}", "nothing", file_type="xlsx", source_path="kb/s.xlsx", content_hash=f"h{i}", sheet_name="S", table_number=1, row_number=i) for i in (1, 5, 6)]
    rows[1]["content"] = "seat total"
    assert chosen(spark, "seat", rows)[:2] == ["r5", "r1"] or chosen(spark, "seat", rows)[0] == "r5"
    scored = {r.id: r.rank_score for r in selection.rank_scores(frame(spark, "seat", rows)).collect()}
    assert abs(scored["r6"] - (1 / 3 + 0.5)) < 1e-6 and abs(scored["r1"] - 1) < 1e-6


def test_requirement_rows_first(spark):
    rows = [chunk("p1", "laptop requirements text"), chunk("p2", "more laptop requirements")] + [chunk(f"t{i}", f"row {i}", title="Laptop standard", table_number=1, row_number=i) for i in (2, 3)]
    assert chosen(spark, "company laptop requirements", rows)[:2] == ["t2", "t3"]


def test_facets_reserve(spark):
    groups = [chunk(f"g{n}", n, file_type="xlsx", section="Grouped rows", sheet_name=n, content_hash=n) for n in ("Volume", "Term", "Approval")]
    rows = [chunk("a", "seat annual approver"), chunk("b", "seat annual approver two", content_hash="b")] + groups
    assert chosen(spark, "seat annual approval", rows, limit=3) == ["gVolume", "gTerm", "gApproval"]
    assert chosen(spark, "seat only", rows, limit=2)[0] in ("a", "b")


def hits(spark, lists):
    rows = [dict(chunk(c.pop("id"), **c), qid=1, subquery=s, rank=i) for s, found in enumerate(lists) for i, c in enumerate([dict(x) for x in found])]
    return spark.createDataFrame(rows, f"qid int, subquery int, rank int, {CHUNK}")


def fold_loop(lists):
    """The payload rule as a plain loop."""
    best = {}
    for s, found in enumerate(lists):
        for rank, c in enumerate(found):
            key, score = c["content_hash"], c["score"]
            if key not in best:
                best[key] = [c["id"], 1, rank, score, s]
                continue
            b = best[key]
            if score > b[3] or score == b[3] and rank < b[2]:
                b[0] = c["id"]
            b[1:4] = b[1] + 1, min(b[2], rank), max(b[3], score)
    return {(b[0], b[1], b[2], b[3], b[4]) for b in best.values()}


def test_fusion_payload_fold(spark):
    import random

    draw = random.Random(5)
    for _ in range(6):
        lists = []
        for s in range(3):
            names = draw.sample("abcdef", 4)
            lists.append([dict(id=f"{n}{s}", content_hash=n, source_path="kb/x.pdf", score=float(draw.randint(0, 2))) for n in names])
        got = {(r.id, r.coverage, r.best_rank, r.best_score, r.first_subquery) for r in fusion.fuse(hits(spark, lists)).collect()}
        assert got == fold_loop(lists)


def test_fusion_orders(spark):
    shared = dict(id="s", content_hash="s", score=1.0)
    got = fusion.fuse(hits(spark, [[dict(id="x", content_hash="x", score=9.0), shared], [shared]])).orderBy("rank").collect()
    assert [r.id for r in got] == ["s", "x"] and got[0].coverage == 2
    sides = [[dict(id="g", content_hash="g", document_type="o", score=9.0), dict(id="a", content_hash="a", document_type="r", version="2024", score=1.0)], [dict(id="g", content_hash="g", document_type="o", score=9.0), dict(id="b", content_hash="b", document_type="r", version="2025", score=2.0)]]
    got = fusion.fuse(hits(spark, sides), comparison=True, limit=2).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a"]
    with pytest.raises(ValueError):
        fusion.fuse(hits(spark, sides), limit=21)


def test_analysis(spark):
    cases = [("What is the policy?", None), ("What about contractors?", "travel rules"), ("price in 2024", None), ("compare the rate card 2024 versus 2025 for", None), ("", None)]
    df = spark.createDataFrame([(i, q, p) for i, (q, p) in enumerate(cases[:4])], "qid int, question string, prior string")
    got = analysis.analyze(df).orderBy("qid").collect()
    assert got[0].ambiguous and got[0].clarification and got[0].subqueries == ["What is the policy?"]
    assert got[1].resolved_from_context and got[1].standalone_query == "travel rules What about contractors?"
    assert got[2].temporal_intent == "historical"
    assert got[3].subqueries[1:] == ["rate card in 2024", "rate card in 2025"] and got[3].temporal_intent == "comparison"
    assert [r.query for r in analysis.searches(analysis.analyze(df)).filter("qid = 3").orderBy("subquery").collect()] == ["rate card in 2024", "rate card in 2025"]
    ways = spark.createDataFrame([("hello there!",), ("list all documents",), ("price?",)], "q string").select(analysis.route(F.col("q"), F.lit(False))).collect()
    assert [r[0] for r in ways] == ["greeting", "inventory", "retrieve"]


def gate(spark, question, contents):
    q = spark.createDataFrame([(1, question)], "qid int, question string")
    c = spark.createDataFrame([(1, x, None, None, None) for x in contents], "qid int, content string, title string, section string, sheet_name string")
    return evidence.evidence_gate(q, c).first()


def test_gate(spark):
    assert gate(spark, "travel allowance limit", ["The travel allowance is 50."]).reason == "supported_evidence"
    assert gate(spark, "travel allowance limit", ["Unrelated words."]).reason == "insufficient_query_overlap"
    assert gate(spark, "travel allowance", []).reason == "no_retrieved_evidence"
    assert gate(spark, "is the travel allowance correctly told", ["travel allowance is 50.", "travel allowance is 60."]).reason == "conflicting_evidence"
    assert gate(spark, "what is the", ["what is the"]).reason == "supported_evidence" or not gate(spark, "what is the", ["x"]).sufficient


def verified(spark, answer, annotated=True, extra=()):
    rows = [chunk("c1", page_number=3), chunk("c2", "Row: 7\nx", file_type="xlsx"), *extra]
    context = spark.createDataFrame([dict(r, qid=1) for r in rows], f"qid int, {CHUNK}")
    r = evidence.verify_citations(spark.createDataFrame([(1, answer)], "qid int, answer string"), context, annotated).first()
    return [c.chunk_id for c in r.citations] if r.ok else None


def test_citations(spark):
    assert verified(spark, "x [c2] y [c1] z [c2]") == ["c2", "c1"]
    assert verified(spark, "[[c1]]") == ["c1"] and verified(spark, "[c1, c2]") == ["c1", "c2"]
    assert verified(spark, "[c1, page 3]") == ["c1"] and verified(spark, "[c1, page 4]") is None
    assert verified(spark, "[c2 row 7]") == ["c2"] and verified(spark, "[c2 rows 7, 8]") is None and verified(spark, "[c1 row 7]") is None
    assert verified(spark, "[c1] [made-up]") is None and verified(spark, "none") is None and verified(spark, "[c1] [blank]") is None
    assert verified(spark, "[c1, page 3]", annotated=False) is None
    assert verified(spark, "[c1]", extra=[chunk("c1", page_number=9)]) is None


def test_display(spark):
    r = spark.createDataFrame([("a [x] [y] [x]. b [y]",)], "a string").select(evidence.display_answer(F.col("a"), F.array(F.lit("x"), F.lit("y")))).first()
    assert r[0] == "a [1] [2]. b [2]"


def test_reconcile(spark):
    shape = "id string, section string, is_current boolean"
    want = spark.createDataFrame([("a", "s", None), ("b", "t", True), ("c", None, None)], shape)
    have = spark.createDataFrame([("a", "s", None), ("b", "u", True), ("d", None, None)], shape)
    got = {r.id: r.action for r in corpus.reconcile(want, have, ["section", "is_current"]).collect()}
    assert got == {"a": "unchanged", "b": "update", "c": "insert", "d": "delete"}
    with pytest.raises(PySparkException):
        corpus.reconcile(want.union(want), have, ["section", "is_current"]).collect()


def test_costs(spark):
    tokens = spark.createDataFrame([("e", 25), ("i", 10), ("o", 5)], "model string, tokens long")
    prices = spark.createDataFrame([("e", "0.02"), ("i", "0.40"), ("o", "1.60")], "model string, p string").select("model", F.col("p").cast("decimal(9,6)").alias("usd_per_million"))
    assert {r.model: r.cost for r in corpus.cost(tokens, prices).collect()} == {"e": "0.000000500000", "i": "0.000004000000", "o": "0.000008000000"}
    with pytest.raises(PySparkException):
        corpus.cost(tokens.withColumn("model", F.lit("unknown")), prices).collect()


def test_acl(spark):
    rows = spark.createDataFrame([(1, ["Staff"]), (2, ["hr"]), (3, [])], "id int, allowed_groups array<string>")
    assert [r.id for r in corpus.allowed(rows, ["staff"]).collect()] == [1]


def test_fingerprints(spark):
    rows = [(("a", "a", None, "b")[i % 4], hashlib.sha256(str(i % 2900).encode()).hexdigest()) for i in range(3000)]
    want = {}
    for k, h in rows:
        want.setdefault(k, []).append([int(h[15 * i : 15 * i + 15], 16) for i in range(4)])
    want = {(k, len(v), hashlib.sha256("-".join(str(sum(x)) for x in zip(*v, strict=True)).encode()).hexdigest()) for k, v in want.items()}
    frame = spark.createDataFrame(rows, "path string, h string")
    for parts in (1, 7):
        assert {tuple(r) for r in corpus.fingerprints(frame.repartition(parts), "path").collect()} == want


def test_corpus_fingerprint_gathers_no_source(spark, small):
    plan = registry.QUERIES["corpus_fingerprint"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
