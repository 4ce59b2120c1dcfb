"""Digest trees that are kept: two tables are compared from the root down, and only the leaves that differ are read.

The tree is that of ``functions.digest.tree_digest``: hashes of rows fold into leaves, leaves into nodes, nodes into the root, so its
root equals the digest computed in one go. Rows and leaf digests lie in one folder per node, sorted by hash. A note names these folders
and the nodes' digests; moving a tree on by a delta writes the touched nodes under new folders and a new note, and the old
tree stays whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.functions.digest import WIDTHS, folded
from snapdelta.plans.files import Files

# Leaves that are named in a filter on the files; more are joined.
_NAMED_LEAVES = 1_000


@dataclass(frozen=True)
class Tree:
    """A stored tree. ``nodes`` has the digest, the number of rows and the folders of each node."""

    spark: SparkSession
    path: str
    widths: tuple[int, int]
    schema: str
    nodes: dict[str, dict]

    @property
    def root(self) -> str:
        items = sorted(f"{name}:{node['digest']}" for name, node in self.nodes.items())
        return hashlib.sha256(",".join(items).encode()).hexdigest()

    @property
    def count(self) -> int:
        return sum(node["rows"] for node in self.nodes.values())

    def _read(self, kind: str, schema: str, names) -> DataFrame:
        paths = [self.nodes[name][kind] for name in sorted(names) if name in self.nodes]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def leaves(self, names) -> DataFrame:
        """``leaf, digest`` under some nodes."""
        return self._read("leaves", "leaf string, digest string", names)

    def rows(self, names) -> DataFrame:
        """The rows under some nodes with their hash ``h`` and ``leaf``."""
        return self._read("data", f"{self.schema}, h string, leaf string", names)


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _hashed(df: DataFrame, line: Column, widths: tuple[int, int]) -> DataFrame:
    named = df.withColumn("h", F.sha2(line, 256)).withColumn("leaf", F.left("h", F.lit(widths[0])))
    return named.withColumn("node", F.left("h", F.lit(widths[1])))


def _written(rows: DataFrame, path: str) -> dict[str, dict]:
    """Write rows (with ``h``, ``leaf``, ``node``) and their leaves in folders of their nodes; what the note says of each node."""
    spark, files = rows.sparkSession, Files(rows.sparkSession)
    version = uuid.uuid4().hex
    data, leaves = f"{path}/data-{version}", f"{path}/leaves-{version}"
    rows.repartition("node").sortWithinPartitions("node", "h").write.partitionBy("node").parquet(data)
    names = [name.removeprefix("node=") for name in files.names(data) if name.startswith("node=")]
    if not names:
        return {}
    # The node's name may look like a number, so it is given as text.
    held = spark.read.schema("h string, leaf string, node string").parquet(data)
    counted = held.groupBy("node", "leaf", "h").agg(F.count(F.lit(1)).alias("n"))
    items = counted.select("node", "leaf", F.concat_ws(":", "h", F.col("n").cast("string")).alias("item"), "n")
    found = items.groupBy("node", "leaf").agg(*folded())
    found.repartition("node").sortWithinPartitions("node", "leaf").write.partitionBy("node").parquet(leaves)
    held = spark.read.schema("leaf string, digest string, rows bigint, node string").parquet(leaves)
    items = held.select("node", F.concat_ws(":", "leaf", "digest").alias("item"), F.col("rows").alias("n"))
    above = {row["node"]: row for row in items.groupBy("node").agg(*folded()).collect()}
    return {
        name: {"digest": above[name]["digest"], "rows": above[name]["rows"], "data": f"{data}/node={name}", "leaves": f"{leaves}/node={name}"}
        for name in names
    }


def _noted(tree: Tree) -> Tree:
    text = json.dumps({"widths": tree.widths, "schema": tree.schema, "nodes": tree.nodes})
    Files(tree.spark).write(tree.path, text)
    return tree


def grown(df: DataFrame, line: Column, path: str, widths: tuple[int, int] = WIDTHS) -> Tree:
    """Store the rows and their tree under a folder; the note is ``tree.json`` in it."""
    return _noted(Tree(df.sparkSession, f"{path}/tree.json", widths, _fields(df), _written(_hashed(df, line, widths), path)))


def stored(spark: SparkSession, path: str) -> Tree:
    """A tree by its note."""
    raw = json.loads(Files(spark).read(path))
    return Tree(spark, path, tuple(raw["widths"]), raw["schema"], raw["nodes"])


def moved_on(tree: Tree, line: Column, come: DataFrame, gone: DataFrame, note: str) -> Tree:
    """The tree after some rows have come and others, copy by copy, have gone. Nodes without a change keep their folders."""
    names = come.columns
    path = tree.path.rsplit("/", 1)[0]
    signed = _hashed(come, line, tree.widths).withColumn("_n", F.lit(1)).unionByName(_hashed(gone, line, tree.widths).withColumn("_n", F.lit(-1)))
    touched = sorted(row["node"] for row in signed.select("node").distinct().collect())
    before = tree.rows(touched).withColumn("node", F.left("h", F.lit(tree.widths[1]))).withColumn("_n", F.lit(1))
    copies = before.unionByName(signed).groupBy("node", "leaf", "h").agg(F.sum("_n").alias("n"), *[F.any_value(name).alias(name) for name in names])
    left = copies.where("n > 0").withColumn("_copy", F.explode(F.expr("sequence(1, n)"))).select(*names, "h", "leaf", "node")
    nodes = {name: node for name, node in tree.nodes.items() if name not in set(touched)} | _written(left, path)
    return _noted(Tree(tree.spark, note, tree.widths, tree.schema, nodes))


def differing_nodes(a: Tree, b: Tree) -> list[str]:
    """Names of the nodes whose digests differ; nothing is read for it."""
    digest = lambda tree, name: tree.nodes.get(name, {}).get("digest")
    return sorted(name for name in a.nodes.keys() | b.nodes.keys() if digest(a, name) != digest(b, name))


def differing_leaves(a: Tree, b: Tree) -> DataFrame:
    """The leaves whose digests differ, looked for under differing nodes only."""
    names = differing_nodes(a, b)
    left, right = a.leaves(names), b.leaves(names).withColumnRenamed("digest", "other")
    return left.join(right, "leaf", "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select("leaf")


def differing_rows(a: Tree, b: Tree) -> tuple[DataFrame, DataFrame]:
    """The rows of either tree that lie in leaves which differ; all others are equal."""
    names, leaves = differing_nodes(a, b), differing_leaves(a, b)
    named = [row["leaf"] for row in leaves.limit(_NAMED_LEAVES + 1).collect()]
    if len(named) <= _NAMED_LEAVES:
        sides = [tree.rows(names).where(F.col("leaf").isin(named)) for tree in (a, b)]
    else:
        sides = [tree.rows(names).join(leaves, "leaf", "left_semi") for tree in (a, b)]
    return tuple(side.drop("h", "leaf") for side in sides)
