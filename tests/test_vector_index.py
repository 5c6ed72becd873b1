"""The stored vector index: its exact way against the search over all vectors, recall of its probes, updates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.plans import vector_index, versions


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id string, vec array<double>")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def clustered():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    return [(f"v{i:03d}", centres[i % 12] + 0.35 * draw.normal(size=16)) for i in range(400)]


def test_exact_way_and_recall(spark, tmp_path, clustered):
    index = f"file:{tmp_path}/cells"
    rows = [*clustered, ("none", None), ("zero", [0.0] * 16), ("short", [1.0] * 3), ("twin", clustered[0][1])]
    vectors = table(spark, rows)
    probes = vector_index.build(spark, vectors, index)
    now = versions.version(spark, index)
    assert 1 <= probes < 20 == now.buckets and now.rows == 401 + 20  # every vector lies in a cell
    asked = vectors.filter(F.substring("id", -1, 1) == "0").withColumnRenamed("id", "qid")
    true = rows_of(search.vector_top_k(vectors.filter("id <> 'short'"), asked, 10))
    assert rows_of(vector_index.search(spark, index, asked, 10, exact=True, block=16, query_block=4)) == true
    found = rows_of(vector_index.search(spark, index, asked, 10))
    assert len({r[:2] for r in found} & {r[:2] for r in true}) >= 0.9 * len(true)
    every = vectors.filter("id in ('none', 'zero', 'short')").withColumnRenamed("id", "qid")
    assert vector_index.search(spark, index, every, 10, exact=True).count() == 0


def test_updates_touch_their_cells(spark, tmp_path, clustered):
    index = f"file:{tmp_path}/cells"
    with pytest.raises(ValueError):
        vector_index.update(spark, index, table(spark, clustered[:1]))
    vector_index.build(spark, table(spark, clustered[:200]), index)
    before = versions.folders(spark, index, versions.version(spark, index))
    changed = [("v000", clustered[1][1]), ("new", clustered[2][1])]
    touched = vector_index.update(spark, index, table(spark, changed), table(spark, [("v005", None)]))
    after = versions.folders(spark, index, versions.version(spark, index))
    assert len(touched) <= 4 and {b for b in before | after if before.get(b) != after.get(b)} == touched
    now = dict(clustered[:200]) | dict(changed)
    del now["v005"]
    vectors = table(spark, now.items())
    asked = vectors.filter("id in ('v000', 'v001', 'v002', 'new')").withColumnRenamed("id", "qid")
    assert rows_of(vector_index.search(spark, index, asked, 5, exact=True)) == rows_of(search.vector_top_k(vectors, asked, 5))
    vector_index.build(spark, vectors.limit(0), index)
    assert vector_index.search(spark, index, asked).count() == 0


def test_ids_and_lengths_of_any_kind(spark):
    vectors = table(spark, [("b", [1, 0]), ("a", [2, 0]), ("c", [0, 1, 0]), ("d", None), ("e", [0, 0])])
    got = rows_of(search.vector_top_k(vectors, vectors.withColumnRenamed("id", "qid"), 5))
    assert got == [("a", "b", 1.0, 1), ("b", "a", 1.0, 1)]
    passages = spark.createDataFrame([("p", "x y")], "qid string, text string")
    held = search.containing(spark.createDataFrame([("d1", "a x y b"), ("d2", "xy")], "id string, text string"), passages)
    assert [(r.id, r.qid) for r in held.collect()] == [("d1", "p")]
    docs = spark.createDataFrame([("d2", "red fox"), ("d1", "red fox"), ("d3", "hen")], "doc_id string, text string")
    assert [(r.qid, r.doc_id, r["rank"]) for r in search.bm25_top_k(docs, spark.createDataFrame([("q", "fox")], "qid string, text string")).orderBy("rank").collect()] == [("q", "d1", 1), ("q", "d2", 2)]
