"""Digests over whole DataFrames that do not depend on row order, partitioning or the number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hex digits that name a leaf and the nodes above it. They are part of the digest's definition: 16 million leaves under 4 096
# nodes, so a leaf holds some thousand hashes of 10^11 rows, and no node has more than 4 096 children.
WIDTHS = (6, 3)


def tree_digest(df: DataFrame, line: Column, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``digest`` and ``rows``: the digest of digests of the lines, of one form at every size.

    Lines are hashed and equal ones counted. Sorted ``hash:count`` items with one prefix make a leaf, sorted ``prefix:digest``
    items a node, and the nodes the root. Copies collapse before the first shuffle and hashes spread evenly.
    """
    hashed = df.select(F.sha2(line, 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    nodes = hashed.select(
        F.left("h", F.lit(widths[0])).alias("prefix"),
        F.concat_ws(":", "h", F.col("n").cast("string")).alias("item"),
        "n",
    )
    for above in [*widths[1:], 0]:
        nodes = nodes.groupBy("prefix").agg(*folded()).select(
            F.left("prefix", F.lit(above)).alias("prefix"),
            F.concat_ws(":", "prefix", "digest").alias("item"),
            F.col("rows").alias("n"),
        )
    return nodes.agg(*folded()).select("digest", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"))


def folded() -> list[Column]:
    """Aggregates of one level: the digest of the children's sorted items, and the rows below."""
    children = F.array_join(F.array_sort(F.collect_list("item")), ",")
    return [F.sha2(children, 256).alias("digest"), F.sum("n").alias("rows")]
