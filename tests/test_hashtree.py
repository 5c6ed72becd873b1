"""Trees of hashes against plain hashing, comparison of corpora, and columns of the user that operators must leave alone."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import analysis, hashtree, structure
from tessera.plans import registry, store


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    return [(draw.choice("abc") + ".pdf", f"id{i}", draw.choice(["x", "y|z", "", None]), i) for i in range(200)] + [("a.pdf", "id1", "x", 1)] * 2 + [(None, None, "n", 0)]


SHAPE = "path string, id string, content string, at long"


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_tree(spark, rows, depth):
    got = {(r.level, r.name): (r.n, r.hash) for r in hashtree.tree(spark.createDataFrame(rows, SHAPE).repartition(4), ["at"], depth).collect()}
    leaves = {}
    for p, i, c, at in sorted(rows, key=lambda r: (r[0] or "", r[3], r[1] or "", r[2] or "")):
        leaves.setdefault(sha(f"{p or ''}|{i or ''}")[:depth], []).append(f"{p or ''}|{i or ''}|{c or ''}")
    level = {name: (len(lines), sha("\n".join(lines))) for name, lines in leaves.items()}
    want = {(depth, k): v for k, v in level.items()}
    for d in reversed(range(depth)):
        up = {}
        for name, (n, h) in sorted(level.items()):
            up.setdefault(name[:d], []).append((n, f"{name}:{h}"))
        level = {k: (sum(n for n, _ in v), sha("\n".join(x for _, x in v))) for k, v in up.items()}
        want |= {(d, k): v for k, v in level.items()}
    assert got == want
    if not depth:  # one leaf is the fingerprint of the whole
        assert got[0, ""][1] == sha("\n".join(leaves[""]))
    assert hashtree.tree(spark.createDataFrame([], SHAPE), ["at"], depth).count() == 0


def test_differences(spark, rows):
    left = {(p or "", i or ""): (p, i, c, at) for p, i, c, at in rows}
    right = dict(left)
    for k in list(left)[::17]:
        right[k] = (*left[k][:2], "other", left[k][3])
    for k in list(left)[5::23]:
        del right[k]
    right["n.pdf", "new"] = ("n.pdf", "new", "x", 9)
    a, b = (spark.createDataFrame(list(x.values()), SHAPE) for x in (left, right))
    trees = [store.materialise(hashtree.tree(x, ["at"], 3), "tree") for x in (a, b)]
    got = {(r.path, r.id): r.difference for r in hashtree.differences(a, b, *trees, 3).collect()}
    want = {k: "right" if k not in left else "left" if k not in right else "changed" for k in left.keys() | right.keys() if (left.get(k) or (0,) * 4)[2] != (right.get(k) or (0,) * 4)[2] or (k in left) != (k in right)}
    assert got == want and set(want.values()) == {"left", "right", "changed"}
    touched = {sha("|".join(k))[:3] for k in want}
    assert {r.name for r in hashtree.differing_leaves(*trees, 3).collect()} == touched and len(touched) < 40
    assert hashtree.differing_leaves(trees[0], trees[0], 3).count() == 0
    empty = hashtree.tree(a.limit(0), ["at"], 3)
    assert hashtree.differences(a, a.limit(0), trees[0], empty, 3).count() == len(left)


def test_depth_grows_with_the_corpus():
    assert [hashtree.depth_for(n) for n in (0, 1 << 30, 1 << 33, 10**14)] == [2, 2, 3, 6]


def test_columns_of_the_user_stay(spark):
    """The names that operators once took for themselves, and those they take now."""
    names = ["_i", "_k", "_words", "words", "k", "i", "_years", "years", "own", "_kind", "_heads", "_stretch", "stretch", "heads", "Low", "high", "later"]
    kept = {n: f"mine {n}" for n in names}
    with_names = lambda df: df.withColumns({n: F.lit(v) for n, v in kept.items()})
    windows = structure.word_windows(with_names(spark.createDataFrame([(1, "a b c d e")], "d long, t string")), "t", 2, 1).collect()
    assert len(windows) == 4 and all(r[n] == v for r in windows for n, v in kept.items())
    asked = analysis.analyze(with_names(spark.createDataFrame([(1, "compare 2024 versus 2025", None)], "qid long, question string, prior string"))).first()
    assert all(asked[n] == v for n, v in kept.items()) and len(asked.subqueries) == 3
    sheet = spark.createDataFrame([("s", 1, ["a", "b"], True, False), ("s", 2, ["1", "2"], False, False)], "s string, row_number int, cells array<string>, bold boolean, merged boolean")
    rows = structure.classify_rows(with_names(sheet), ["s"], "row_number").collect()
    assert [r.kind for r in rows] == ["header", "data"] and all(r[n] == v for r in rows for n, v in kept.items())
    grouped = structure.row_windows(spark.createDataFrame([("low", i, f"t{i}") for i in range(1, 6)], "group_number string, n int, t string"), ["group_number"], "n", "t", 3, 1).drop("group_number").collect()
    assert sorted((r.first_row, r.last_row, r.text) for r in grouped) == [(1, 3, "t1\n\nt2\n\nt3"), (3, 5, "t3\n\nt4\n\nt5")]
    pairs = structure.adjacent_rows(spark.createDataFrame([(1, 1, "a", 0), (1, 2, "b", 0)], "at int, n int, id string, other_id int"), ["at"], "n", "id")
    assert sorted((r.id, r.other_id) for r in pairs.collect()) == [("a", "b"), ("b", "a")]


def test_contents_are_hashed_before_rows_meet(spark, rows):
    """Contents went through a shuffle with the leaves, to be hashed after it."""
    a = spark.createDataFrame(rows, SHAPE)
    made = store.materialise(hashtree.tree(a, ["at"], 3), "tree")
    out = hashtree.differences(a, a.filter("at % 2 = 0"), made, made, 3)
    nodes = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted").split("\n\n")
    inputs = [line for node in nodes if ") Exchange" in node for line in node.splitlines() if line.startswith("Input")]
    assert len(inputs) > 3 and not [line for line in inputs if "content" in line]


def test_windows_of_a_comparison_are_made_once(spark, small, monkeypatch):
    """Each text was split four times for each of two trees and both sides of the comparison."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    windows = structure.word_windows(spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "d long, t string"), "t", 2, 1)
    assert plan(windows).count("regexp_replace") == 1 and [r.d for r in windows.collect()] == [1]
    plans, write = [], store.materialise
    monkeypatch.setattr(store, "materialise", lambda df, name: (plans.append(plan(df)), write(df, name))[1])
    plans.append(plan(registry.corpus_differences(spark, small)))
    assert sum(p.count("regexp_replace") for p in plans) == 1
