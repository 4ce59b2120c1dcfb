"""Numbering and paging of ordered rows by range partitions: no window over all rows, and no task that holds them all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.session import settled

# Rows below this bit are counted inside of a partition, partitions above it (``monotonically_increasing_id``).
_PARTITION_BIT = 33


def placed(df: DataFrame, order: list[Column], name: str = "place") -> tuple[DataFrame, dict[int, int]]:
    """The rows in range partitions, sorted and written once, and the number of rows before each partition.

    ``name`` is the column that tells partition and row. The order must be total for the result to be the same each time.
    """
    ordered = settled(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "ranges")
    part = F.shiftright(name, _PARTITION_BIT).cast("int")
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, starts = 0, {}
    for row in sorted(sizes):
        starts[row["part"]] = before
        before += row["n"]
    return ordered, starts


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """The rows with their position in the order, from 0."""
    ordered, starts = placed(df, order, name)
    if not starts:
        return ordered
    offsets = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])
    part = F.shiftright(name, _PARTITION_BIT).cast("int")
    row = F.col(name).bitwiseAND(F.lit((1 << _PARTITION_BIT) - 1))
    return ordered.withColumn(name, F.element_at(offsets, part).cast("bigint") + row)


# Rows of one range at most by design, ranges at most, and sampled rows from which their bounds are taken.
RANGE_ROWS = 1 << 20
MOST_RANGES = 64
SAMPLED = 8_192


@dataclass(frozen=True)
class Order:
    """A column to order by, and whether it falls."""

    column: str
    falls: bool = False

    @property
    def sort(self) -> Column:
        return F.desc_nulls_last(self.column) if self.falls else F.asc_nulls_first(self.column)


def _before(orders: list[Order], bound: tuple) -> Column:
    """Whether a row comes before a bound in the order; nulls are the least values."""
    found = F.lit(False)
    for order, value in reversed(list(zip(orders, bound))):
        column = F.col(order.column)
        least, most = (F.lit(False), column.isNotNull()) if value is None else (column.isNull() | (column < F.lit(value)), column > F.lit(value))
        same = column.isNull() if value is None else column.eqNullSafe(F.lit(value))
        found = F.coalesce(most if order.falls else least, F.lit(False)) | (same & found)
    return found


def _bounds(df: DataFrame, orders: list[Order], total: int, ranges: int) -> list[tuple]:
    """Bounds between ranges of about equal size, from a bounded sample; counts are exact whatever the bounds."""
    names = [order.column for order in orders]
    share = min(1.0, 2 * SAMPLED / total)
    sample = df.select(*names).sample(share, seed=1).orderBy(F.rand(2)).limit(SAMPLED)
    rows = [tuple(row) for row in sample.orderBy(*[order.sort for order in orders]).collect()]
    places = [len(rows) * k // ranges for k in range(1, ranges)]
    return list(dict.fromkeys(rows[place] for place in places if rows))


def page(df: DataFrame, orders: list[Order], offset: int, limit: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows ``offset`` to ``offset + limit`` in the order, which must be total.

    A page near the begin is the head of a partial sort. For a deep one the rows are counted by ranges of the order, and only
    the ranges that the page lies in are read again and sorted.
    """
    sort = [order.sort for order in orders]
    if offset + limit <= range_rows:
        return df.orderBy(*sort).offset(offset).limit(limit)
    total = df.count()
    ranges = min(MOST_RANGES, max(2, -(-total // range_rows)))
    bounds = _bounds(df, orders, max(1, total), ranges)
    tests = [_before(orders, bound) for bound in bounds]
    number = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        number = F.when(tests[k], k).otherwise(number)
    counts = {row["range"]: row["n"] for row in df.groupBy(number.alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()}
    start, first, last, skipped = 0, None, None, 0
    for k in range(len(bounds) + 1):
        end = start + counts.get(k, 0)
        if end > offset and start < offset + limit and end > start:
            if first is None:
                first, skipped = k, start
            last = k
        start = end
    if first is None:
        return df.where("false")
    chosen = df
    if first > 0:
        chosen = chosen.where(~tests[first - 1])
    if last < len(bounds):
        chosen = chosen.where(tests[last])
    if first < last or range_rows >= counts[first] or counts[first] == total:
        return chosen.orderBy(*sort).offset(offset - skipped).limit(limit)
    return page(chosen, orders, offset - skipped, limit, range_rows)
