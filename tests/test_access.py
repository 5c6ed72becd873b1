"""Access before ranking, against a plain filter of all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import access, search
from tessera.plans import answers, vector_index


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_bit_sets_meet_as_sets_do():
    draw = np.random.default_rng(1)
    names = [f"g{i}" for i in range(150)]
    left, right = ([[names[j] for j in draw.choice(150, draw.integers(0, 6), replace=False)] for _ in range(80)] for _ in range(2))
    kind = pa.list_(pa.string())
    known = access.numbered(pa.array(left, kind))
    a, b = access.bit_sets(pa.array(left, kind), known), access.bit_sets(pa.chunked_array([pa.array(right[:30], kind), pa.array([*right[30:79], None], kind)]), known)
    for i, own in enumerate(left):
        assert access.share(b, a[i]).tolist() == [bool(set(own) & set(r)) for r in right[:79]] + [False]
    assert not access.share(access.bit_sets(pa.array([["x"], None], kind), {}), a[0]).any()


@pytest.fixture(scope="module")
def corpus_of(spark):
    # the best hits of every question are those that nobody of its caller's groups may read
    docs = [(f"d{i:03d}", "apple " * (40 - i) + "pear " * i, ["Secret"] if i < 25 else ["Team A", None] if i % 2 else ["team b"] if i % 3 else None) for i in range(40)]
    asked = [("a", "apple", ["TEAM A"]), ("b", "apple pear", ["team B", "nobody"]), ("s", "apple", ["secret", "team a"]), ("none", "apple", None), ("empty", "pear", []), ("stranger", "pear", ["nobody"])]
    return (spark.createDataFrame(docs, "doc_id string, text string, allowed_groups array<string>"), docs, spark.createDataFrame(asked, "qid string, text string, groups array<string>"), asked)


def readable(allowed, groups):
    return bool({g.lower() for g in allowed or [] if g} & {g.lower() for g in groups or []})


def test_keyword_search_ranks_what_may_be_read(spark, corpus_of):
    docs, rows, asked, questions = corpus_of
    every = search.bm25_top_k(docs, asked, 100).collect()  # all hits with their scores, whoever may read them
    open_to, of = {d: g for d, _, g in rows}, {q: g for q, _, g in questions}
    wanted = []
    for q in of:
        hits = sorted((-r.score, r.doc_id) for r in every if r.qid == q and readable(open_to[r.doc_id], of[q]))
        wanted += [(q, d, -s, n) for n, (s, d) in enumerate(hits[:5], 1)]
    found = rows_of(search.bm25_top_k(docs, asked, 5, access=True))
    assert found == sorted(wanted) and {r[0] for r in found} == {"a", "b", "s"}
    assert sum(r[0] == "a" for r in found) == 5  # full, though the 25 best are hidden
    assert rows_of(search.bm25_top_k(docs, asked, 5, access=True, block=1)) == found
    assert search.bm25_top_k(docs.limit(0), asked, 5, access=True).count() == 0
    assert search.bm25_top_k(docs, asked.limit(0), 5, access=True).count() == 0


def test_vector_search_ranks_what_may_be_read(spark, tmp_path):
    draw = np.random.default_rng(7)
    rows = [(i, [float(x) for x in draw.normal(size=8)], ["x"] if i % 4 else ["Y", "z"] if i % 8 else None) for i in range(200)]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>, allowed_groups array<string>")
    asked = [(i, rows[i][1], g) for i, g in ((0, ["y"]), (1, ["X", "y"]), (2, None), (3, ["q"]), (4, ["Z"]))]
    queries = spark.createDataFrame(asked, "qid long, vec array<double>, groups array<string>")
    every = search.vector_top_k(vectors, queries, 200).collect()
    wanted = []
    for q, _, groups in asked:
        hits = sorted((-r.score, r.id) for r in every if r.qid == q and readable(rows[r.id][2], groups))
        wanted += [(q, d, -s, n) for n, (s, d) in enumerate(hits[:6], 1)]
    order = ["qid", "id", "score", "rank"]
    assert rows_of(search.vector_top_k(vectors, queries, 6, block=32, query_block=2, access=True).select(*order)) == sorted(wanted)
    index = f"file:{tmp_path}/cells"
    vector_index.build(spark, vectors, index, cells=9)
    assert rows_of(vector_index.search(spark, index, queries, 6, access=True).select(*order)) == sorted(wanted)
    # groups follow an update; vectors without any are closed
    vector_index.update(spark, index, vectors.filter("id % 4 > 0").withColumn("allowed_groups", F.lit(None).cast("array<string>")))
    left = rows_of(vector_index.search(spark, index, queries, 6, access=True).select("qid"))
    assert {r[0] for r in left} == {0, 1, 4}
    vector_index.build(spark, vectors.drop("allowed_groups"), index, cells=9)
    assert vector_index.search(spark, index, queries, 6, access=True).count() == 0
    assert vector_index.search(spark, index, queries, 6, exact=True).count() == 30


def test_inventory_of_what_may_be_read(spark):
    sources = spark.createDataFrame([("Sales/a.pdf", "A", ["s", "all"]), ("Sales/b.pdf", "B", ["S"]), ("Legal/c.pdf", "C", ["l"]), ("Legal/d.pdf", "D", None)], "source_path string, title string, allowed_groups array<string>")
    asked = [(1, "Which documents are available?", ["all", "s"]), (2, "How many documents are there?", ["L", "all"]), (3, "How many documents are in Legal?", ["s"]), (4, "Which documents are available?", None), (5, "How many documents are in sales?", ["S"]), (6, "Which documents are available?", ["S", "ALL"])]
    told = {r.qid: r.answer for r in answers.inventory(spark.createDataFrame(asked, "qid int, question string, groups array<string>"), sources, access=True).collect()}
    both = "2 documents are indexed:\n- A - Sales/a.pdf\n- B - Sales/b.pdf"
    none = "No documents are currently indexed."
    assert told == {1: both, 2: "2 documents are indexed.", 3: none, 4: none, 5: "2 Sales documents are indexed.", 6: both}
