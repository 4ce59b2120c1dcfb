"""Stored JSON pages: flattening to items, following the chain of pages, and finding holes in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.functions.once import once
from snapdelta.functions.text import instant
from snapdelta.operators.normalize import FACTS
from snapdelta.session import settled


def kind_of(value: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``VOID`` and so on; null where there is no value."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def variant_at(value: Column, dotted_path: str) -> Column:
    """The variant at a dotted path; null when a step is not an object or has no such key."""
    steps = "".join(f"['{part}']" for part in dotted_path.split("."))
    return F.try_variant_get(value, f"${steps}", "variant")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Each file under the path is one page: ``page`` (its path) and ``body``."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("page"), F.col("value").alias("body"))


def _page_problem(parsed: Column) -> Column:
    """Why a parsed page cannot be flattened; null for a sound page. A missing ``items`` is an empty page."""
    top, inner = kind_of(parsed), variant_at(parsed, "items")
    return (
        F.when(~F.coalesce(top.isin("ARRAY", "OBJECT"), F.lit(False)), "expected a list or an object with 'items'")
        .when((top == "OBJECT") & (kind_of(inner) != "ARRAY"), "'items' must be a list")
    )


def page_errors(pages: DataFrame) -> DataFrame:
    """Pages that cannot be flattened, with the reason."""
    return pages.select("page", once(F.try_parse_json("body"), _page_problem).alias("reason")).where("reason is not null")


def json_pages(pages: DataFrame) -> DataFrame:
    """Object items of all pages: ``page``, ``pos``, ``item`` (variant).

    Items that are not objects are left out. A page of another form fails the query when it is
    reached; ``page_errors`` lists such pages. Each page is parsed once.
    """
    none = F.array().cast("array<variant>")

    def elements(parsed: Column) -> Column:
        listed = F.when(kind_of(parsed) == "ARRAY", parsed).otherwise(variant_at(parsed, "items"))
        problem = F.concat("page", F.lit(": "), _page_problem(parsed))
        found = F.coalesce(F.try_variant_get(listed, "$", "array<variant>"), none)
        return F.when(problem.isNull(), found).otherwise(F.raise_error(problem).cast("array<variant>"))

    items = pages.select("page", F.posexplode(once(F.try_parse_json("body"), elements)).alias("pos", "item"))
    return items.where(kind_of(F.col("item")) == "OBJECT")


def project_items(items: DataFrame, fields: dict[str, str], item: str = "item", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns out of variant items; a missing key and a JSON null both give null.

    ``fields`` maps a top-level key to a Spark type. A present value that does not fit its type
    fails the query.
    """
    value = F.col(item)
    columns = []
    for name, kind in fields.items():
        if kind == "timestamp":
            columns.append(instant(F.variant_get(value, f"$['{name}']", "string")).alias(name))
        else:
            columns.append(F.variant_get(value, f"$['{name}']", kind).alias(name))
    return items.select(*keep, *columns)


def _item_text(value: Column) -> Column:
    """Text of a JSON scalar as templates print it; nested values stay JSON text."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind_of(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def _item_names(value: Column) -> Column:
    listed = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda item: ~F.is_variant_null(item))
    one = F.when(value.isNotNull() & ~F.is_variant_null(value), F.array(_item_text(value)))
    return F.when(kind_of(value) == "ARRAY", F.transform(listed, _item_text)).otherwise(one)


def item_rows(
    items: DataFrame,
    scalars: list[str],
    lists: list[str] = (),
    required: list[str] = (),
    item: str = "item",
    facts: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of text columns, and of name lists, out of variant items for ``normalize``.

    An item without a required key fails the query that uses the column. ``facts`` name the keys whose values are kept
    as the JSON they are, in the map column ``FACTS``; a key that an item lacks is not in its map.
    """

    def scalar(name: str) -> Column:
        value = variant_at(F.col(item), name)
        if name not in required:
            return _item_text(value)
        return F.when(value.isNull(), F.raise_error(F.lit(f"item without {name}"))).otherwise(_item_text(value))

    columns = {name: scalar(name) for name in scalars}
    columns |= {name: _item_names(variant_at(F.col(item), name)) for name in lists}
    if facts:
        pairs = [F.struct(F.lit(name).alias("k"), F.to_json(variant_at(F.col(item), name)).alias("v")) for name in facts]
        columns[FACTS] = F.map_from_entries(F.filter(F.array(*pairs), lambda pair: pair["v"].isNotNull()))
    return items.select(*[column.alias(name) for name, column in columns.items()])


def missing_fields(items: DataFrame, fields: list[str], item: str = "item") -> DataFrame:
    """How many items lack each of the keys: ``field``, ``missing``; only keys that are lacking."""
    counts = items.agg(*[F.count_if(variant_at(F.col(item), name).isNull()).alias(name) for name in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").alias("missing")) for n in fields]))
    return counts.select(pairs.alias("p")).select("p.*").where("missing > 0")


def page_links(pages: DataFrame, cursor_path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``cursor`` of each page and ``next_cursor``, the one its body names; null, empty, zero and false end the chain.

    ``pages`` has ``cursor`` and ``body``; ``keep`` names further columns of it.
    """

    def following(value: Column) -> Column:
        text, kind = F.try_variant_get(value, "$", "string"), kind_of(value)
        ends = (
            value.isNull()
            | (kind == "VOID")
            | (text == "")
            | ((kind == "BOOLEAN") & (text == "false"))
            | (kind.isin("BIGINT", "DECIMAL", "DOUBLE") & (F.try_variant_get(value, "$", "double") == 0))
            | ((kind == "ARRAY") & (text == "[]"))
            | ((kind == "OBJECT") & (text == "{}"))
        )
        return F.when(~F.coalesce(ends, F.lit(False)), text)

    next_cursor = once(variant_at(F.try_parse_json("body"), cursor_path), following)
    return pages.select(*keep, "cursor", next_cursor.alias("next_cursor"))


def link_gaps(links: DataFrame) -> DataFrame:
    """Links whose next cursor names no stored page."""
    stored = links.select(F.col("cursor").alias("next_cursor"))
    return links.where("next_cursor is not null").join(stored, "next_cursor", "left_anti").select("cursor", "next_cursor")


def page_gaps(pages: DataFrame, cursor_path: str) -> DataFrame:
    """Pages whose next cursor names no stored page: ``cursor``, ``next_cursor``.

    ``pages`` has ``cursor`` (null or empty for the first page) and ``body``.
    """
    return link_gaps(page_links(pages, cursor_path))


class PageChainError(ValueError):
    """The pages are no chain: two have one cursor, none is the first, or the chain comes back to itself."""


def page_chain(links: DataFrame, first: str) -> DataFrame:
    """The pages that are reached from the first one: ``cursor`` and ``place``, 0 for the first.

    Pointer doubling: round k knows the pages in the first 2^k places and, for every page, the page 2^k steps on. Each round
    doubles both, so a chain of a million pages takes twenty rounds of narrow joins. Fails on a cursor that two pages have, and
    on a chain that comes back to a page it has passed.
    """
    spark = links.sparkSession
    twice = links.groupBy("cursor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("cursor").limit(1).collect()
    if twice:
        raise PageChainError(f"{twice[0]['n']} pages have the cursor {twice[0]['cursor']}")
    stored = links.select(F.col("cursor").alias("ahead"))
    jumps = links.select("cursor", F.col("next_cursor").alias("ahead")).join(stored, "ahead", "left_semi")
    jumps = settled(jumps.select("cursor", "ahead"), "page-jumps")
    kind = links.schema["cursor"].dataType.simpleString()
    reached = spark.createDataFrame([(first, 0)], f"cursor {kind}, place bigint").join(links.select("cursor"), "cursor", "left_semi")
    reached = settled(reached, "page-reached")
    if reached.isEmpty():
        raise PageChainError(f"there is no page {first}")
    step = 1
    while True:
        fresh = reached.join(jumps, "cursor").select(F.col("ahead").alias("cursor"), (F.col("place") + step).alias("place"))
        fresh = settled(fresh, "page-reached")
        if fresh.isEmpty():
            return reached
        again = fresh.join(reached.select("cursor"), "cursor", "left_semi").orderBy("place").limit(1).collect()
        if again:
            raise PageChainError(f"the pages form a cycle: {again[0]['cursor']} comes again as page {again[0]['place']}")
        reached = settled(reached.unionByName(fresh), "page-reached")
        on = jumps.select(F.col("cursor").alias("ahead"), F.col("ahead").alias("further"))
        jumps = settled(jumps.join(on, "ahead").select("cursor", F.col("further").alias("ahead")), "page-jumps")
        step *= 2
