"""Percentiles of whole numbers for groups of any size: exact ones, and mergeable sketches with a bound on their error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_percentile(
    df: DataFrame, keys: list[str], value: str, share: float, name: str, mean: str, span: int = 3_600
) -> DataFrame:
    """``keys``, ``rows``, the mean and the interpolated percentile ``name`` of a whole-number column.

    Equal values are counted before any shuffle. Cumulated counts over stretches of ``span`` values
    tell which stretch holds the two ranks in question; only those stretches are looked at value by
    value. No task sees more than the stretches of one group, or the values of one stretch.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("bigint").alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = counts.withColumn("stretch", F.floor(F.col("v") / span))
    weighted = F.sum(F.col("v") * F.col("n")).alias("weight")
    stretches = counts.groupBy(*keys, "stretch").agg(F.sum("n").alias("n"), weighted)
    upward, whole = Window.partitionBy(*keys).orderBy("stretch"), Window.partitionBy(*keys)
    totals = stretches.select(
        *keys,
        "stretch",
        (F.sum("n").over(upward) - F.col("n")).alias("before"),
        F.sum("n").over(upward).alias("upto"),
        F.sum("n").over(whole).alias("rows"),
        F.sum("weight").over(whole).alias("weight"),
    )
    place = F.lit(share) * (F.col("rows") - 1)
    wanted = totals.withColumn("low", F.floor(place)).withColumn("high", F.ceil(place)).withColumn("part", place - F.floor(place))

    def within(rank: str, first: Column, end: Column) -> Column:
        return (F.col(rank) >= first) & (F.col(rank) < end)

    wanted = wanted.where(
        within("low", F.col("before"), F.col("upto")) | within("high", F.col("before"), F.col("upto"))
    )
    fine = counts.join(wanted, [*keys, "stretch"])
    inner = Window.partitionBy(*keys, "stretch").orderBy("v")
    ranked = fine.withColumn("end", F.col("before") + F.sum("n").over(inner)).withColumn("first", F.col("end") - F.col("n"))
    picked = ranked.groupBy(*keys).agg(
        F.max("rows").alias("rows"),
        F.max("weight").alias("weight"),
        F.max("part").alias("part"),
        F.max(F.when(within("low", F.col("first"), F.col("end")), F.col("v"))).alias("lo"),
        F.max(F.when(within("high", F.col("first"), F.col("end")), F.col("v"))).alias("hi"),
    )
    middle = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    average = F.col("weight") / F.col("rows")
    return picked.select(*keys, "rows", average.alias(mean), middle.cast("double").alias(name))


# Size of a sketch. Larger ones are more exact; sketches of one size merge without losing their bound.
SKETCH_SIZE = 800


def rank_error(size: int = SKETCH_SIZE) -> float:
    """How far the rank of a sketched percentile may be off, as a share of the rows, in 99 of 100 cases."""
    return 2.296 / size**0.9723


def sketches(df: DataFrame, keys: list[str | Column], value: str, size: int = SKETCH_SIZE) -> DataFrame:
    """``keys``, ``rows`` and a ``sketch`` of the values of each group: a few KB, however many rows it stands for."""
    held = df.where(F.col(value).isNotNull())
    sketch = F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(size))
    return held.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), sketch.alias("sketch"))


def merged_sketches(found: DataFrame, keys: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of finer groups as one per coarser group, of the same form."""
    sketch = F.kll_merge_agg_bigint("sketch", F.lit(size))
    return found.groupBy(*keys).agg(F.sum("rows").alias("rows"), sketch.alias("sketch"))


def sketched_percentile(found: DataFrame, share: float, name: str, size: int = SKETCH_SIZE) -> DataFrame:
    """Adds the percentile ``name`` of each sketch, and ``<name>_least`` and ``<name>_most``, between which the true one lies.

    A percentile between two values counts as either, so the bounds reach a row further.
    """
    error = rank_error(size)

    def at(where: float) -> Column:
        return F.kll_sketch_get_quantile_bigint("sketch", F.lit(min(1.0, max(0.0, where))))

    def bound(side: int) -> Column:
        # The function takes fixed shares only, so a row's share is rounded up to a power of two.
        steps = [2**j for j in range(10, -1, -1)]
        return F.coalesce(*[F.when(F.col("rows") >= n, at(share + side * (error + 1 / n))) for n in steps])

    return found.withColumns({name: at(share), f"{name}_least": bound(-1), f"{name}_most": bound(1)})
