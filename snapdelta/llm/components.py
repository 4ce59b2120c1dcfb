"""Connected components of a graph given as nodes and links, by hooking and contraction.

Every node with a smaller neighbour is hooked to its least one, which gives trees; jumps from parent to parent name each tree's
root. Then the links are those between different roots, and all others are gone: a link is read once or twice, and not in
every round. Each step is written to the shared folder, so the plan stays short and lost executors cost one step.
A step costs a shuffle, however few rows it has, so a round has as few of them as it can: one aggregation hooks all nodes, those
without a link among them, and links are made distinct where they are contracted and not before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.session import settled


def _between(links: DataFrame) -> DataFrame:
    """Links between different nodes, the greater end first."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")


def _hooked(links: DataFrame, alone: DataFrame | None) -> DataFrame:
    """``node`` and its least smaller neighbour as ``component``, itself without one, for all ends of links and the nodes ``alone``."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")))
    if alone is not None:
        ends = ends.unionByName(alone.select("node", F.col("node").alias("component")))
    return ends.groupBy("node").agg(F.min("component").alias("component"))


def _rooted(tree: DataFrame) -> DataFrame:
    """``node`` and the root of its tree, from ``node`` and its parent ``component``; a root is its own parent."""
    while True:
        via = tree.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = tree.join(via, "component").select("node", F.col("further").alias("component"), (F.col("component") != F.col("further")).alias("moved"))
        jumped = settled(jumped, "labels")
        tree = jumped.select("node", "component")
        if jumped.where("moved").isEmpty():
            return tree


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable. ``links`` has ``a`` and ``b``, in either order; both may repeat rows."""
    links = settled(_between(links), "links")
    labels = None
    while not links.isEmpty():
        tree = _rooted(settled(_hooked(links, nodes if labels is None else None), "labels"))
        to = [tree.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")) for end in "ab"]
        links = links.join(to[0], "a").join(to[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        links = settled(_between(links).distinct(), "links")
        if labels is None:
            labels = tree
        else:
            of_root = tree.select(F.col("node").alias("component"), F.col("component").alias("further"))
            labels = labels.join(of_root, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
            labels = settled(labels, "labels")
    return settled(nodes.select("node", F.col("node").alias("component")).distinct(), "components") if labels is None else labels


def sharing(members: DataFrame, group: list[str]) -> DataFrame:
    """``node`` and ``component`` of nodes that are linked by a group they share; ``members`` has one row per node and group.

    Each node is joined to the least node of one of its groups first. Only what is still apart in a group is linked then: a
    node of a large cluster shares many groups, whose least nodes differ, and would have a link in each.
    """
    nodes = members.select("node").distinct()

    def stars(state: DataFrame) -> DataFrame:
        least = state.groupBy(*group).agg(F.min("component").alias("b"), F.max("component").alias("high")).where("b < high")
        return state.join(least.drop("high"), group).where("component <> b").select(F.col("component").alias("a"), "b")

    first = stars(members.withColumn("component", F.col("node"))).groupBy("a").agg(F.min("b").alias("b"))
    labels = components(nodes, first)
    open_ = stars(members.join(labels, "node"))
    roots = components(labels.select(F.col("component").alias("node")).distinct(), open_.distinct())
    roots = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return labels.join(roots, "component").select("node", F.col("root").alias("component"))
