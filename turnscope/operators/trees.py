"""Message trees as rows: the order of their nodes along first children, for trees of any size.

A tree is not held in one row: every node is one, linked to the node that follows it. Places on the walk from the root come from pointer
doubling. Round k knows the first 2^k nodes of every walk and, for every node, the one 2^k steps on; an equi-join of the two gives the next 2^k nodes, another
the links of 2^(k+1) steps. Keys are single nodes, so joins are even however long one walk is, and a walk of n nodes takes log2(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.sources.stored import discard, stored

#: Fixed value: a parent that some exports name although it is no message.
SENTINEL = "root"


def tree_nodes(convs: DataFrame, *keys, mapping: str = "mapping") -> DataFrame:
    """(tree, keys, idx, node, parent, child, value): a row for every node of the maps. Stored, so that the number of a tree stays.

    idx is the node's place in its map, child the first of its children.
    """
    numbered = convs.select(F.monotonically_increasing_id().alias("tree"), *keys, mapping)
    rows = numbered.select("tree", *[c for c in numbered.columns if c not in ("tree", mapping)], F.posexplode(mapping).alias("idx", "node", "value"))
    return stored(rows.withColumn("parent", F.col("value")["parent"]).withColumn("child", F.try_element_at(F.col("value")["children"], F.lit(1))), "tree-nodes")


def _at(name: str):
    return F.struct(F.col("tree").alias("tree"), F.col(name).alias("node"))


def walk_links(nodes: DataFrame, by_parent: bool) -> DataFrame:
    """(at, next): the node after each, where there is one: its first child if the tree has it, or, for nodes without children and by_parent, the first node that names it."""
    ids = nodes.select(_at("node").alias("at"))
    given = nodes.filter("child is not null").select(_at("node").alias("at"), _at("child").alias("next"))
    links = given.join(ids.select(F.col("at").alias("next")), "next", "left_semi").select("at", "next")
    if by_parent:
        named = nodes.filter("parent is not null").groupBy(_at("parent").alias("at")).agg(F.min_by(_at("node"), "idx").alias("next"))
        bare = nodes.filter("child is null").select(_at("node").alias("at"))
        links = links.unionByName(named.join(bare, "at", "left_semi"))
    return links


def walk_roots(nodes: DataFrame, last: bool) -> DataFrame:
    """(at): the root of each tree: the last or first of its nodes without a known parent; with `first`, the sentinel is unknown, too."""
    ids = nodes.select(_at("node").alias("up"))
    loose = F.col("parent").isNull() if last else F.col("parent").isNull() | (F.col("parent") == SENTINEL)
    sure = nodes.filter(loose).select("tree", "node", "idx")
    rest = nodes.filter(F.col("parent").isNotNull() if last else F.col("parent").isNotNull() & (F.col("parent") != SENTINEL))
    lost = rest.withColumn("up", _at("parent")).join(ids, "up", "left_anti").select("tree", "node", "idx")
    pick = (F.max_by if last else F.min_by)("node", "idx")
    return sure.unionByName(lost).groupBy("tree").agg(pick.alias("node")).select(_at("node").alias("at"))


def walk_order(nodes: DataFrame, root: str, by_parent: bool) -> DataFrame:
    """(tree, node, place): the nodes on the walk from each tree's root along first children. Reads stored tables: discard() it when read.

    nodes: tree, idx, node, parent, child, one row per node, stored. root: 'last' or 'first' among nodes without a known parent. by_parent: a node without
    children is followed by the first one that names it as parent. A child that the tree lacks ends the walk, and so does one it has been to.
    """
    links = stored(walk_links(nodes, by_parent), "tree-links")
    found = [stored(walk_roots(nodes, root == "last").select("at", F.lit(0).cast("long").alias("place")), "tree-found")]
    most, step, spent = nodes.count(), 1, [links]
    while step <= most:  # a walk is no longer than all nodes; one that goes round is cut below
        known = found[0]
        for f in found[1:]:
            known = known.unionByName(f)
        more = stored(known.join(links, "at").select(F.col("next").alias("at"), (F.col("place") + step).alias("place")), "tree-found")
        found.append(more)
        if more.isEmpty():
            break
        further = links.select(F.col("at").alias("next"), F.col("next").alias("far"))
        links = stored(links.join(further, "next").select("at", F.col("far").alias("next")), "tree-links")
        spent.append(links)
        step *= 2
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    out = stored(rows.groupBy("at").agg(F.min("place").alias("place")).select("at.tree", "at.node", "place"), "tree-order")
    discard(*found, *spent)
    return out
