"""The stored inverted index against the search that reads all documents."""

import random

import pytest

from tessera.operators import search
from tessera.plans import ingest, keyword_index, plugins, versions

EMBEDDER = plugins.HashEmbedder(2)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def corpus_rows(spark, docs):
    made = [{"id": f"c{i}", "content": text, "title": title, "source_path": f"KB/{i}", "document_id": f"d{i}", "content_hash": f"{title}|{text}", "allowed_groups": []} for i, title, text in docs]
    return spark.createDataFrame(made, ingest.CHUNK)


@pytest.fixture
def place(tmp_path):
    return f"file:{tmp_path}/corpus", f"file:{tmp_path}/index"


def drawn(draw, n):
    words = ["the"] * 30 + ["of"] * 15 + [f"w{int(draw.paretovariate(0.7))}" for _ in range(400)]
    return [(i, draw.choice(["Red Fox", "blue hen", ""]), " ".join(draw.choice(words) for _ in range(draw.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize(("block", "filtered"), [(4, 2)])
def test_index_gives_the_same_rows(spark, place, monkeypatch, block, filtered):
    monkeypatch.setattr(keyword_index, "BLOCK", block)
    monkeypatch.setattr(keyword_index, "FILTERED", filtered)
    draw = random.Random(block)
    docs = spark.createDataFrame([*drawn(draw, 300), (900, None, None), (901, "the of", None), (902, "STRASSE", "straße Straße ﬁne")], "doc_id long, title string, text string")
    asked = spark.createDataFrame([(i, " ".join(draw.choice(["the", "of", "hen", f"w{draw.randint(1, 60)}"]) for _ in range(5))) for i in range(12)] + [(50, ""), (51, None), (52, "absent"), (53, "Straße fine")], "qid long, text string")
    keyword_index.build(spark, docs, place[1], ("title", "text"), rows_a_bucket=80)
    for k in (3, 500):
        found = rows_of(keyword_index.search(spark, place[1], asked, k))
        assert found == rows_of(search.bm25_top_k(docs, asked, k, columns=("title", "text"))) and found
    keyword_index.build(spark, docs.limit(0), place[1], ("title", "text"))
    assert keyword_index.search(spark, place[1], asked).count() == 0 == keyword_index.search(spark, f"{place[1]}-none", asked).count()


def test_blocks_are_skipped(spark, place, monkeypatch):
    """A frequent word beside a rare one: most of its postings are never scored."""
    monkeypatch.setattr(keyword_index, "BLOCK", 16)
    draw = random.Random(3)
    docs = [(i, "", " ".join(["the"] * draw.randint(1, 3) + [f"x{draw.randint(1, 500)}" for _ in range(draw.randint(5, 40))] + ["rare"] * (i % 40 == 0))) for i in range(2000)]
    table = spark.createDataFrame(docs, "doc_id long, title string, text string")
    asked = spark.createDataFrame([(1, "the rare")], "qid long, text string")
    keyword_index.build(spark, table, place[1])
    _, needs = keyword_index.scored(spark, place[1], asked, 5)
    read = {r.term: r.s for r in needs.groupBy("term").agg({"n": "sum"}).withColumnRenamed("sum(n)", "s").collect()}
    assert read["rare"] == 50 and read["the"] < 1000  # of 2,000 postings
    assert rows_of(keyword_index.search(spark, place[1], asked, 5)) == rows_of(search.bm25_top_k(table, asked, 5))


def test_index_follows_the_corpus(spark, place, monkeypatch):
    monkeypatch.setattr(versions, "BUCKETS", 8)
    draw, (corpus, index) = random.Random(5), place
    docs = {i: (i, t, x) for i, t, x in drawn(draw, 60)}
    asked = spark.createDataFrame([(1, "the w1 hen"), (2, "of w2 w3"), (3, "new zebra")], "qid long, text string")

    def check():
        found = rows_of(keyword_index.search(spark, index, asked, 10))
        plain = search.bm25_top_k(ingest.current(spark, corpus), asked, 10, id_col="id", columns=("title", "content"))
        assert found == rows_of(plain) and found

    ingest.upsert(spark, corpus_rows(spark, docs.values()), corpus, EMBEDDER)
    assert keyword_index.refresh(spark, corpus, index) == set(range(8)) and keyword_index.refresh(spark, corpus, index) == set()
    check()
    ingest.replace_documents(spark, corpus_rows(spark, [(3, "new", "zebra zebra w1")]), corpus, EMBEDDER)
    before = versions.folders(spark, index, versions.version(spark, index))
    changed = keyword_index.refresh(spark, corpus, index)
    after = versions.folders(spark, index, versions.version(spark, index))
    assert len(changed) == 1 and {b for b in after if after[b] != before[b]} == changed
    check()
    ingest.upsert(spark, corpus_rows(spark, [d for i, d in docs.items() if i < 5]), corpus, EMBEDDER)
    keyword_index.refresh(spark, corpus, index)
    check()
    monkeypatch.setattr(versions, "BUCKET_ROWS", 2)
    ingest.upsert(spark, corpus_rows(spark, docs.values()), corpus, EMBEDDER)
    assert versions.version(spark, corpus).buckets == 32 and len(keyword_index.refresh(spark, corpus, index)) > 8
    check()


def test_a_build_splits_each_text_once(spark, place, monkeypatch):
    """Postings, their numbers and the sums of a bucket came from three readings of the texts."""
    docs = spark.createDataFrame(drawn(random.Random(7), 50), "doc_id long, title string, text string")
    plans, write = [], versions.write
    monkeypatch.setattr(versions, "write", lambda rows, *a, **k: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(rows, *a, **k))[1])
    keyword_index.build(spark, docs, place[1], ("title", "text"))
    assert len(plans) == 1 and sum(name in line for line in plans[0].splitlines() for name in ("MapInArrow", "FlatMapGroupsInArrow")) == 1


def test_only_the_best_of_a_shard_leave_it(spark, place, monkeypatch):
    """Documents of one score all were candidates, which met in a join with every other word of their question."""
    monkeypatch.setattr(keyword_index, "SHARD_ROWS", 150)
    docs = spark.createDataFrame([(i, f"common word{i % 2} x{i}") for i in range(600)], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "common"), ("b", "common word1"), ("c", "x17 common"), ("d", None)], "qid string, text string")
    keyword_index.build(spark, docs, place[1])
    hits, read = keyword_index.scored(spark, place[1], asked, 3)
    assert read.select("shard").distinct().count() == 4 and hits.count() <= 3 * 3 * 4
    assert rows_of(keyword_index.search(spark, place[1], asked, 3)) == rows_of(search.bm25_top_k(docs, asked, 3))
    monkeypatch.setattr(keyword_index, "QUESTIONS", 1)
    assert rows_of(keyword_index.search(spark, place[1], asked, 3)) == rows_of(search.bm25_top_k(docs, asked, 3))
    monkeypatch.setattr(keyword_index, "FILTERED", 1)
    assert rows_of(keyword_index.search(spark, place[1], asked, 3)) == rows_of(search.bm25_top_k(docs, asked, 3))


def test_rare_letters_are_folded():
    assert search.tokens_of("Straße STRAẞE ﬁne ſo ẖ1 ŉ ﬅ") == ["strasse", "strasse", "fine", "so", "h", "1", "n", "st"]
