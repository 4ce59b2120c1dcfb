"""Push requests: one row per request body, parsed to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.once import once
from snapdelta.sources.pages import kind_of

# Line ends at which newline-delimited bodies are cut.
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def body_hash(body: Column) -> Column:
    """The hash by which a repeated request is recognised."""
    return F.sha2(body, 256)


def _outcome(events: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), events).alias("events"), error.alias("error"))


def _from_lines(body: Column) -> Column:
    stripped = F.transform(F.split(body, _LINE_END), lambda line: F.regexp_replace(line, _EDGE_SPACE, ""))
    values = F.transform(F.filter(stripped, lambda line: line != ""), F.try_parse_json)

    def outcome(found: Column) -> Column:
        return _outcome(found, F.when(F.exists(found, lambda value: value.isNull()), "malformed line"))

    return once(values, outcome)


def _from_json(body: Column) -> Column:
    def outcome(whole: Column) -> Column:
        top = kind_of(whole)
        objects = F.filter(F.try_variant_get(whole, "$", "array<variant>"), lambda value: kind_of(value) == "OBJECT")
        error = F.when(whole.isNull(), "malformed json").when(
            ~top.isin("OBJECT", "ARRAY"), "body must be a JSON object, a JSON array or NDJSON"
        )
        return _outcome(F.when(top == "OBJECT", F.array(whole)).otherwise(objects), error)

    return once(F.try_parse_json(body), outcome)


def _parsed(body: Column, content_type: Column) -> Column:
    """Struct of a body's ``events`` (array of variants) and the ``error`` for which it is refused."""
    is_lines = F.coalesce(F.contains(content_type, F.lit("application/x-ndjson")), F.lit(False))
    nothing = _outcome(F.array().cast("array<variant>"), F.lit(None).cast("string"))
    empty = F.coalesce(body == "", F.lit(True))
    return F.when(empty, nothing).when(is_lines, _from_lines(body)).otherwise(_from_json(body))


def parse_requests(requests: DataFrame) -> DataFrame:
    """Adds ``request_hash``, ``events`` (array of variants) and ``body_error`` to the requests.

    An array body keeps its objects only. Lines of a newline-delimited body stay whatever they
    are, to be refused one by one later; a line that is not JSON refuses the whole request.
    """
    parsed = requests.select(
        "*", body_hash(F.col("body")).alias("request_hash"), _parsed(F.col("body"), F.col("content_type")).alias("_parsed")
    )
    return parsed.select(
        *requests.columns, "request_hash", F.col("_parsed.events").alias("events"), F.col("_parsed.error").alias("body_error")
    )


def push_events(parsed: DataFrame, keep: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """One row per event: the kept request columns, ``pos`` and ``raw`` (variant)."""
    return parsed.select(*keep, F.posexplode("events").alias("pos", "raw"))
