"""Tables that Spark sizes too low, as after an explode or when read back compressed, are not sent whole through the driver; blocks meet in bounded memory."""

import tracemalloc
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.llm import simhash
from tessera.operators import corpus, search
from tessera.plans import store, vector_index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_look_ups_of_fingerprints_are_merged(spark):
    prints = store.materialise(spark.createDataFrame([(0b1011,), (0b0011,), (0b1111 << 40,), (-1,)], "print long"), "prints")  # a small table on disk, as the operator has it
    out = simhash.links(prints)
    assert "Broadcast" not in plan(out) and "SortMergeJoin" in plan(out)
    assert {frozenset((r.a, r.b)) for r in out.collect()} == {frozenset((0b1011, 0b0011))}


def test_words_of_questions_are_merged_and_carry_no_text(spark):
    long = " ".join(f"w{i}" for i in range(2000))
    asked = spark.createDataFrame([(1, f"{long} in Sales please"), (2, f"sales team or legal, {long}"), (3, long), (4, None)], "qid long, question string")
    sources = spark.createDataFrame([("KB/Sales/a.pdf",), ("KB/Sales Team/b.pdf",), ("KB/legal/c.pdf",), ("top.pdf",)], "source_path string")
    out = corpus.department_in_question(asked, sources)
    assert "BroadcastExchange" not in plan(out)
    exploded = [line for line in plan(out).splitlines() if "Generate explode" in line]
    assert exploded and all("_text" not in line.split("), ")[-1] and "[qid" in line for line in exploded)
    assert {(r.qid, r.department) for r in out.collect()} == {(1, "sales"), (2, "sales team")}
    assert corpus.department_in_question(asked, sources.filter(F.lit(False))).count() == 0


def test_no_table_is_sent_whole_by_the_vector_index(spark, tmp_path, monkeypatch):
    draw = np.random.default_rng(1)
    rows = [(i, [float(v) for v in draw.normal(size=8)], ["a", "b"][i % 3 :]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>, allowed_groups array<string>")
    vector_index.build(spark, vectors, f"file:{tmp_path}/cells")
    plans, write = [], store.materialise
    monkeypatch.setattr(store, "materialise", lambda df, name: (plans.append(plan(df)), write(df, name))[1])
    asked = vectors.filter("id % 4 = 0").select(F.col("id").alias("qid"), "vec", F.array(F.lit("B")).alias("groups"))
    order = ["qid", "id", "score", "rank"]
    for access in (False, True):
        out = vector_index.search(spark, f"file:{tmp_path}/cells", asked, 7, exact=True, block=64, query_block=16, access=access)
        assert sorted(map(tuple, out.select(*order).collect())) == sorted(map(tuple, search.vector_top_k(vectors, asked, 7, access=access).select(*order).collect()))
        plans.append(plan(out))
    assert len(plans) > 6 and not [p for p in plans if "BroadcastExchange" in p]


def test_a_block_pair_is_scored_in_bounded_memory():
    """The largest pair of blocks: all its scores at once would be 134 MB, several times over."""
    caught = {}
    side = MagicMock(schema={c: MagicMock(dataType=LongType()) for c in ("qid", "id")})
    side.groupBy().cogroup().applyInArrow = lambda run, schema: caught.update(run=run)
    search.meet_in_blocks(side, side, ["q"], 3, True)
    draw = np.random.default_rng(2)
    x, y = draw.normal(size=(2048, 16)), draw.normal(size=(8192, 16))
    table = lambda name, n, z: pa.table({name: pa.array(range(n)), "vec": pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), 16).cast(pa.list_(pa.float64()))})
    a, b = table("qid", 2048, x), table("id", 8192, y)
    tracemalloc.start()
    out = caught["run"](a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    some = x[5] @ y.T / (np.linalg.norm(x[5]) * np.linalg.norm(y, axis=1))
    some[5] = -2
    assert sorted(r["id"] for r in out.to_pylist() if r["qid"] == 5) == sorted(np.argsort(-some)[:3].tolist()) and out.num_rows == 3 * 2048


def test_counts_of_words_are_made_in_bounded_memory():
    """A whole Arrow batch of documents with many asked words: 40 MB when its lists were made at once."""
    terms = [f"w{i}" for i in range(400)]
    words = MagicMock(schema={"id": MagicMock(dataType=LongType())})
    words.sparkSession.sparkContext.broadcast = lambda x: MagicMock(value=x)
    words.mapInArrow = lambda run, schema: run
    run = search.term_counts(words, terms)
    texts = [" ".join(terms[i % 7 :]) for i in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(texts), pa.array([[]] * 6000, pa.list_(pa.string()))], ["id", "said", "allowed"])
    tracemalloc.start()
    rows = n = total = 0
    for out in run(iter([batch])):
        rows += out.num_rows - 1
        n, total = n + out["n"][-1].as_py(), total + out["total"][-1].as_py()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (rows, n, total) == (6000, 6000, sum(400 - i % 7 for i in range(6000)))
    assert peak < 20e6
