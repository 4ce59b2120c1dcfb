"""Mixing sources to target weights over a domain, language, source tree.

Weights split a token budget from the root down. A node cannot take more than its leaves hold times ``max_epochs``; what a
short node leaves over goes to its siblings in proportion to their weights, and only when a whole subtree is exhausted does
its parent's level share the rest. A leaf then draws whole epochs and the prefix of one further epoch: its documents in an
order seeded by seed, epoch and id, while the tokens before a document are fewer than the leaf's remainder.

Tokens are words. The tree is what the data hold; nodes that the weights do not name get ``default_weight``. The split per
level is a window over the children of one parent; prefix sums run over 4,096 slices of the seeded order, so that a source
with a third of all rows is spread over as many groups, and only sums per slice meet per leaf.

Defined results: null languages and sources form a leaf named by the empty text, null ids are ordered as the text ``null``,
null and empty texts have no tokens and are drawn as their place in the order says. Rows with equal ids are ordered by
token count and text hash, so equal rows are interchangeable. A weight of 0 excludes a node. Extra columns are carried by
``mixed``; helper columns have a prefix of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapdelta.llm.common import words_of
from snapdelta.session import settled

LEVELS = ("domain", "lang", "source")
SLICE_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Weights per node name and level, and how much to draw.

    ``budget_tokens`` wins over ``budget_share``, a share of all tokens present.
    """

    domains: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "core": tuple(f"src{i}" for i in range(8)),
            "wide": tuple(f"src{i}" for i in range(8, 20)),
        }
    )
    weights: dict[str, dict[str, float]] = field(
        default_factory=lambda: {
            "domain": {"core": 3.0, "wide": 2.0, "other": 1.0},
            "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
            "source": {"src0": 2.0},
        }
    )
    default_weight: float = 1.0
    budget_tokens: int | None = None
    budget_share: float = 0.8
    max_epochs: int = 2
    seed: int = 17


def _leaf(mix: Mix, source_col: str, lang_col: str) -> dict[str, Column]:
    source = F.coalesce(F.col(source_col), F.lit(""))
    domain = F.lit("other")
    for name, sources in reversed(mix.domains.items()):
        domain = F.when(source.isin(*sources), F.lit(name)).otherwise(domain)
    return {"domain": domain, "lang": F.coalesce(F.col(lang_col), F.lit("")), "source": source}


def _rows(docs: DataFrame, mix: Mix, keep: list[Column]) -> DataFrame:
    leaf = _leaf(mix, "source", "lang")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        *keep,
        *[leaf[level].alias(f"__{level}") for level in LEVELS],
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"),
        F.size(words_of(text)).cast("bigint").alias("__tokens"),
        F.xxhash64(text).alias("__tie"),
    )


def _weight(mix: Mix, level: str) -> Column:
    weight = F.lit(float(mix.default_weight))
    for name, value in mix.weights.get(level, {}).items():
        weight = F.when(F.col(f"__{level}") == name, F.lit(float(value))).otherwise(weight)
    return weight


def _split(nodes: DataFrame, parent: list[str], mix: Mix, level: str) -> DataFrame:
    """Give each child its part of ``given``: full children in order of capacity per weight, the rest by weight."""
    nodes = nodes.withColumn("w", _weight(mix, level)).where("w > 0")
    nodes = nodes.withColumn("ratio", F.col("capacity") / F.col("w"))
    order = [F.col("ratio"), F.col(f"__{level}")]
    group = Window.partitionBy(*parent)
    so_far = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    from_here = group.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumns(
        {"below": F.coalesce(F.sum("capacity").over(so_far), F.lit(0)), "weights": F.sum("w").over(from_here)}
    )
    nodes = nodes.withColumn("full", F.col("below") + F.col("ratio") * F.col("weights") <= F.col("given"))
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(group)
    part = F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(
        (F.col("given") - taken) * F.col("w") / open_weight
    )
    return nodes.select(*parent, f"__{level}", "capacity", part.alias("part"))


def budgets(rows: DataFrame, mix: Mix) -> DataFrame:
    """Whole-token budget, supply, whole epochs and remainder of every leaf."""
    keys = [f"__{level}" for level in LEVELS]
    leaves = rows.groupBy(*keys).agg(F.sum("__tokens").alias("supply"))
    leaves = settled(leaves.withColumn("capacity", F.col("supply") * F.lit(mix.max_epochs)), "mix-leaves")
    asked = F.lit(float(mix.budget_tokens)) if mix.budget_tokens is not None else F.sum("supply") * F.lit(mix.budget_share)
    root = leaves.agg(F.least(asked.cast("double"), F.sum("capacity").cast("double")).alias("given"), F.lit(0).alias("__root"))
    upper, parent = root, ["__root"]
    for depth, level in enumerate(LEVELS):
        path = keys[: depth + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("__root", F.lit(0))
        shared = _split(nodes.join(upper, parent), parent, mix, level)
        upper = shared.select("__root", *path, F.col("part").alias("given"))
        parent = ["__root", *path]
    budget = F.floor(F.col("given") + F.lit(1e-6))
    epochs = F.when(F.col("supply") > 0, F.floor(budget / F.col("supply"))).otherwise(F.lit(0))
    found = upper.join(leaves, keys).withColumns({"budget": budget, "epochs": epochs.cast("bigint")})
    return found.select(*keys, "supply", "budget", "epochs", (F.col("budget") - F.col("epochs") * F.col("supply")).alias("rest"))


def _place(mix: Mix) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epochs").cast("string"), F.col("__id")))


def _drawn(rows: DataFrame, docs: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` with ``budget`` and ``times``; ``docs`` are the narrow rows that the sums are taken from."""
    keys = [f"__{level}" for level in LEVELS]
    leaves = settled(budgets(docs, mix), "mix-budgets")
    slice_of = F.substring("place", 1, SLICE_DIGITS)
    sums = docs.join(leaves, keys).withColumn("place", _place(mix)).groupBy(*keys, "epochs", "budget", "rest", slice_of.alias("slice"))
    sums = sums.agg(F.sum("__tokens").alias("in_slice"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("in_slice").over(before), F.lit(0))).drop("in_slice")
    starts = settled(starts, "mix-slices")
    placed = rows.join(leaves.select(*keys, "epochs"), keys).withColumn("place", _place(mix)).withColumn("slice", slice_of)
    found = placed.drop("epochs").join(starts, [*keys, "slice"])
    inside = Window.partitionBy(*keys, "slice").orderBy("place", "__tokens", "__tie")
    earlier = F.sum("__tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.col("base") + F.coalesce(earlier, F.lit(0))
    return found.withColumn("times", F.col("epochs") + F.when(ahead < F.col("rest"), F.lit(1)).otherwise(F.lit(0)))


def drawn(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Every document with its leaf, tokens, the leaf's budget and how often it is drawn, 0 included.

    Documents of a leaf whose weight is 0 are in no result row's budget and come with budget and times 0.
    """
    rows = settled(_rows(docs, mix, [F.col("doc_id").alias("doc_id")]), "mix-rows")
    out = _drawn(rows, rows, mix).select("doc_id", *[F.col(f"__{x}").alias(x) for x in LEVELS], F.col("__tokens").alias("n_tokens"), "budget", "times")
    weighed = _positive(mix)
    unweighed = rows.where(~weighed).select(
        "doc_id", *[F.col(f"__{x}").alias(x) for x in LEVELS], F.col("__tokens").alias("n_tokens"),
        F.lit(0).cast("bigint").alias("budget"), F.lit(0).cast("bigint").alias("times"),
    )
    return out.unionByName(unweighed)


def _positive(mix: Mix) -> Column:
    ok = F.lit(True)
    for level in LEVELS:
        ok = ok & (_weight(mix, level) > 0)
    return ok


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The drawn rows with all their columns, each as often as it is drawn."""
    narrow = settled(_rows(docs, mix, []), "mix-rows")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = _rows(docs, mix, [F.struct(*columns).alias("__row")])
    out = _drawn(whole, narrow, mix).where("times > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("__row.*")
