"""A corpus' fingerprint as a tree of hashes, and comparing two corpora by their trees.

Rows are dealt to leaves by a hash of path and id, so no path makes a leaf long. Inside a leaf the rule is that of one fingerprint over a whole corpus: SHA-256 over the lines path|id|content in order; with depth 0 the only leaf is that
fingerprint. A node's hash is over the names and hashes of its children, at most sixteen. Two corpora are compared from the root down, only below nodes that differ, and rows are read of the leaves that differ.

Defined results: null paths, ids and contents count as empty texts; rows that repeat are entries of their own; a corpus without rows has no nodes, and differs from another in all that has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans import store

FAN, LEAF_BYTES, LEAST = 16, 16 << 20, 2


def depth_for(size: int, leaf_bytes: int = LEAF_BYTES, least: int = LEAST) -> int:
    """The levels of a tree over so many bytes whose leaves hold some megabytes each."""
    depth = least
    while size > leaf_bytes * FAN**depth:
        depth += 1
    return depth


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def leaf_of(depth: int, path: str = "path", row_id: str = "id") -> Column:
    """The name of a row's leaf: so many hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws("|", _text(path), _text(row_id)), 256), 1, depth)


def tree(rows: DataFrame, order: list[str], depth: int) -> DataFrame:
    """(level, name, n, hash) of all nodes that hold rows (path, id, content, order...): level 0 is the root, named by an empty text."""
    entry = F.concat_ws("|", _text("path"), _text("id"), _text("content"))
    each = rows.select(leaf_of(depth).alias("name"), F.struct(_text("path").alias("p"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), _text("id").alias("i"), entry.alias("entry")).alias("e"))
    # a leaf's rows are bounded by the depth
    level = each.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("e"))["entry"], "\n"), 256).alias("hash"))
    level = store.materialise(level, "leaves")  # all levels follow from it
    out = level.select(F.lit(depth).alias("level"), "name", "n", "hash")
    for d in reversed(range(depth)):
        children = F.sort_array(F.collect_list(F.concat_ws(":", "name", "hash")))
        level = level.groupBy(F.substring("name", 1, d).alias("parent")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(children, "\n"), 256).alias("hash")).withColumnRenamed("parent", "name")
        out = out.unionByName(level.select(F.lit(d).alias("level"), "name", "n", "hash"))
    return out


def differing_leaves(left: DataFrame, right: DataFrame, depth: int) -> DataFrame:
    """(name) of the leaves that two trees of one depth don't share; only children of nodes that differ are looked at."""

    def level(d: int, among: DataFrame | None) -> DataFrame:
        sides = []
        for nodes, hash_name in ((left, "l"), (right, "r")):
            own = nodes.filter(F.col("level") == d).select("name", F.col("hash").alias(hash_name))
            sides.append(own if among is None else own.join(among, F.substring("name", 1, d - 1) == among["parent"], "left_semi"))
        return sides[0].join(sides[1], "name", "full_outer").filter(~F.col("l").eqNullSafe(F.col("r"))).select("name")

    names = level(0, None)
    for d in range(1, depth + 1):
        names = level(d, names.withColumnRenamed("name", "parent"))
    return names


def differences(left: DataFrame, right: DataFrame, left_tree: DataFrame, right_tree: DataFrame, depth: int) -> DataFrame:
    """(path, id, difference): rows (path, id, content) that only one side has or that differ (``left``, ``right``, ``changed``); path and id name a row. Rows of equal leaves are not compared."""
    leaves = differing_leaves(left_tree, right_tree, depth)

    def side(rows: DataFrame, name: str) -> DataFrame:
        # contents are hashed before rows meet the leaves, so that none is shuffled
        each = rows.select(leaf_of(depth).alias("leaf"), _text("path").alias("path"), _text("id").alias("id"), F.sha2(_text("content"), 256).alias(name))
        return each.join(leaves.withColumnRenamed("name", "leaf"), "leaf", "left_semi").drop("leaf")

    met = side(left, "l").join(side(right, "r"), ["path", "id"], "full_outer")
    what = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("changed")
    return met.filter(~F.col("l").eqNullSafe(F.col("r"))).select("path", "id", what.alias("difference"))
