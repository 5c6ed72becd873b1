"""The segmented scan against plain loops over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import carry, structure


def test_equal_to_a_loop(spark):
    draw = random.Random(4)
    rows = []
    for key in ("a", None, "b", "one"):
        places = draw.sample(range(-40, 5000), 1 if key == "one" else 300)
        rows += [(key, p, draw.choice([None, None, f"v{p}"]), draw.random() < 0.3 if draw.random() < 0.9 else None, p * 2) for p in places]
    rows.append(("a", None, "first", True, 7))
    wanted, state = [], {}
    for key, place, value, mark, part in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        last, n = state.get(key, (None, 0))
        state[key] = (value or last, n + bool(mark))
        wanted.append((key, place, part, *state[key]))
    table = spark.createDataFrame(rows, "key string, place int, own string, mark boolean, part int").repartition(5)
    # names of the operator's own columns and of the results clash with the user's
    table = table.withColumns({"before_0": F.lit(1), "at_0": F.lit(2), "Value": F.lit("old")})
    for span, levels in ((2, 3), (16, 2), (100, 1), (carry.SPAN, carry.LEVELS), (16, 0)):
        found = carry.carry(table, ["key"], "place", {"value": F.col("own")}, {"n": F.col("mark")}, span, levels)
        assert found.columns == ["key", "place", "own", "mark", "part", "before_0", "at_0", "value", "n"]
        assert sorted(map(str, (tuple(r) for r in found.select("key", "place", "part", "value", "n").collect()))) == sorted(map(str, wanted))
    assert carry.carry(table.limit(0), ["key"], "place", {"value": F.col("own")}, {"n": F.col("mark")}).count() == 0
    with pytest.raises(ValueError):
        carry.carry(table, ["key"], "place", span=1)


def test_ranges_and_windows_agree(spark):
    draw = random.Random(9)
    cells = [[None, None, None], ["x", "y", None], ["x", None, "z"], ["a", "b", "c"], ["Effective: now", None, None]]
    rows = spark.createDataFrame([(s, n, draw.choice(cells), draw.random() < 0.4, draw.random() < 0.2) for s in (1, 2, None) for n in range(1, 400)], "sheet int, row_number int, cells array<string>, bold boolean, merged boolean")
    plain, ranged = (structure.classify_rows(rows, ["sheet"], "row_number", r).collect() for r in (False, True))
    assert sorted(map(str, plain)) == sorted(map(str, ranged)) and {r.kind for r in plain} >= {"blank", "header", "data", "key_value", "note"}
    blocks = spark.createDataFrame([(d, n, draw.choice(["title", "heading", "paragraph"]) if n % 5 == 0 else "paragraph", f"t{n}") for d in (1, 2) for n in range(300)], "doc int, line int, kind string, text string")
    plain, ranged = (structure.carry_sections(blocks, ["doc"], "line", r).collect() for r in (False, True))
    assert sorted(map(str, plain)) == sorted(map(str, ranged))


def test_no_window_holds_a_key(spark):
    """Whatever the window over rows is partitioned by, the range is part of it, and rows are shuffled once by it."""
    rows = spark.range(100).select((F.col("id") % 2).alias("key"), F.col("id").alias("place"), F.lit("x").alias("v"))
    plan = carry.carry(rows, ["key"], "place", {"value": F.col("v")}, levels=1)._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan and plan.count("Exchange hashpartitioning(key") <= 3
