"""Checks over documents: markers, contracts, duplicates, literals and thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.operators.normalize import DOC_COLUMNS
from snapdelta.sources.pages import kind_of

# Text that must not occur in a document's title or content.
UNSAFE_MARKERS = (
    "ignore previous instructions",
    "disregard all prior instructions",
    "reveal system prompt",
    "system prompt",
    "developer message",
    "<script",
    "javascript:",
)

# Service-level and canary limits, and pass rates of check suites.
MIN_SUCCESS_RATE = 99.0
MAX_FRESHNESS_LAG = 10_800
MAX_MTTR = 1_800
MAX_BUDGET_BURN = 0.20
MAX_FAILED_RATE_DELTA = 0.0


class GateError(ValueError):
    """A gate that stops the run has found something."""


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _shared_part(a: str, b: str) -> str:
    """The longest text that occurs in both."""
    for size in range(min(len(a), len(b)), 0, -1):
        for start in range(len(a) - size + 1):
            if a[start : start + size] in b:
                return a[start : start + size]
    return ""


def needles(markers: tuple[str, ...], least: int = 5) -> list[str]:
    """Fewer, shorter texts of which every marker contains one; a text without them has no marker."""
    found = list(dict.fromkeys(markers))
    while len(found) > 1:
        pairs = [(a, b) for i, a in enumerate(found) for b in found[i + 1 :]]
        part, pair = max(((_shared_part(a, b), (a, b)) for a, b in pairs), key=lambda x: len(x[0]))
        if len(part) < least:
            break
        found = [part] + [text for text in found if text not in pair]
    return found


def flag_unsafe(df: DataFrame, columns: tuple[str, ...] = ("title", "content"), markers=UNSAFE_MARKERS) -> DataFrame:
    """Adds ``unsafe``: any marker inside any of the columns, whatever the case.

    Texts are lowered once. Most are cleared by the few needles; only the others are searched for
    every marker.
    """
    texts = F.array(*[F.lower(F.coalesce(F.col(name), F.lit(""))) for name in columns])

    def holds(text: Column, parts) -> Column:
        return _any([F.contains(text, F.lit(part)) for part in parts])

    return df.withColumn("unsafe", F.exists(texts, lambda text: holds(text, needles(markers)) & holds(text, markers)))


def require_clean(df: DataFrame, columns: tuple[str, ...] = ("title", "content"), markers=UNSAFE_MARKERS) -> None:
    """Stop the run when a document is unsafe. One pass that ends at the first hit."""
    hit = flag_unsafe(df, columns, markers).where("unsafe").limit(1).count()
    if hit:
        raise GateError("unsafe marker detected in document content")


def duplicate_ids(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that occur more than once, with their counts. Counts combine before the shuffle."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def require_unique(df: DataFrame, key: str = "doc_id", report: str | None = None, named: int = 20) -> None:
    """Stop the run when keys repeat.

    All of them, with their counts, are written under ``report`` as JSON lines where that is given; the message names the
    path, how many they are, and the first in order.
    """
    found = duplicate_ids(df, key)
    many = found.count()
    if many:
        if report:
            found.write.mode("overwrite").json(report)
            found = found.sparkSession.read.schema(found.schema).json(report)
        names = ", ".join(row[key] for row in found.orderBy(key).limit(named).collect())
        more = "" if many <= named else f" and {many - named} more"
        raise GateError(f"duplicate document ids: {names}{more}" + (f"; all {many} are listed in {report}" if report else ""))


def split_ops(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upserts and deletes."""
    return docs.where("op <> 'DELETE'"), docs.where("op = 'DELETE'")


# Fixed pattern: dates and times that the document contract takes for updated_at.
_TIME_TEXT = r"^\d{4}-\d{2}-\d{2}([Tt _]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s?([zZ]|[+-]\d{2}:?\d{2})?)?$"
_NUMBER_TEXT = r"^[+-]?\d+(\.\d+)?$"
# Epoch numbers above this size count milliseconds.
_SECONDS_END = 20_000_000_000


def _time_of(value: Column, kind: Column) -> Column:
    """The time that a variant holds, as text or as an epoch number; null for anything else."""
    text = F.btrim(F.try_variant_get(value, "$", "string"))
    clock = F.regexp_replace(F.regexp_replace(text, r"^(.{10})[t_]", "$1T"), ",", ".")
    number = F.when(
        kind.isin("BIGINT", "DECIMAL", "DOUBLE") | ((kind == "STRING") & text.rlike(_NUMBER_TEXT)),
        text.try_cast("double"),
    )
    seconds = F.when(F.abs(number) > _SECONDS_END, number / 1000).otherwise(number)
    from_number = F.timestamp_micros(F.round(seconds * 1_000_000).try_cast("bigint"))
    return F.when(number.isNotNull(), from_number).when(
        (kind == "STRING") & text.rlike(_TIME_TEXT), F.upper(clock).try_cast("timestamp")
    )


_TEXTS = ("doc_id", "title", "content", "checksum", "uri", "mime_type", "op")
_LISTS = ("acl_users", "acl_groups")


def validate_documents(events: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds the document columns and ``reason`` to variant events; a null reason means valid.

    Text fields must be JSON strings, names must be lists of strings, ``metadata`` an object, ``op``
    one of the two operations and ``updated_at`` a time. Optional fields take their defaults. An event is walked once, for
    its fields; kinds and values are then taken from each field by itself.
    """
    parts = (*_TEXTS, *_LISTS, "metadata", "updated_at")
    cut = events.withColumns({"_top": kind_of(F.col(raw)), "_all": F.try_variant_get(raw, "$", "map<string,variant>")})
    cut = cut.withColumn("_at", F.struct(*[F.element_at("_all", name).alias(name) for name in parts]))
    at = F.col("_at")
    kinds = F.struct(*[kind_of(at[name]).alias(name) for name in parts if name not in _LISTS], *[F.schema_of_variant(at[name]).alias(name) for name in _LISTS])
    values = F.struct(
        *[F.try_variant_get(at[name], "$", "string").alias(name) for name in _TEXTS],
        *[F.try_variant_get(at[name], "$", "array<string>").alias(name) for name in _LISTS],
        _time_of(at["updated_at"], kind_of(at["updated_at"])).alias("updated_at"),
    )
    cut = cut.withColumns({"_kind": kinds, "_value": values})
    kind, value = F.col("_kind"), F.col("_value")

    def is_names(name: str) -> Column:
        whole = kind[name].isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(value[name], lambda item: item.isNull())
        return at[name].isNull() | whole

    checks = [(F.col("_top") == "OBJECT", "not an object")]
    for name in ("doc_id", "title", "content", "checksum"):
        checks += [(at[name].isNotNull(), f"{name} missing"), (kind[name] == "STRING", f"{name} not text")]
    checks += [
        (at["uri"].isNull() | kind["uri"].isin("STRING", "VOID"), "uri not text"),
        (at["mime_type"].isNull() | (kind["mime_type"] == "STRING"), "mime_type not text"),
        (at["updated_at"].isNotNull(), "updated_at missing"),
        (value["updated_at"].isNotNull(), "updated_at not a time"),
        *[(is_names(name), f"{name} not a list of text") for name in _LISTS],
        (at["metadata"].isNull() | (kind["metadata"] == "OBJECT"), "metadata not an object"),
        (at["op"].isNotNull(), "op missing"),
        ((kind["op"] == "STRING") & value["op"].isin("UPSERT", "DELETE"), "op not UPSERT or DELETE"),
    ]
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), why) for ok, why in checks])
    none = F.array().cast("array<string>")
    columns = {name: value[name] for name in (*_TEXTS, "updated_at")}
    columns["mime_type"] = F.coalesce(value["mime_type"], F.lit("text/plain"))
    columns |= {name: F.coalesce(value[name], none) for name in _LISTS}
    columns["metadata"] = F.coalesce(F.to_json(at["metadata"]), F.lit("{}"))
    return cut.select(*events.columns, *[columns[name].alias(name) for name in DOC_COLUMNS], reason.alias("reason"))


def flag_rejects(validated: DataFrame) -> DataFrame:
    """Adds ``accepted``; an unsafe document of valid form gets a reason too."""
    flagged = flag_unsafe(validated)
    reason = F.coalesce(F.col("reason"), F.when(F.col("unsafe"), "unsafe marker"))
    return flagged.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("unsafe")


def split_accept_reject(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted documents and rejected events; give a written table, since both halves read it."""
    return flagged.where("accepted"), flagged.where("not accepted")


def pattern_scan(docs: DataFrame, patterns: list[str], text: str = "content", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The first listed literal that occurs in each text; texts without any are left out.

    Binary content is decoded as UTF-8 first, and undecodable items are skipped.
    """
    column = F.col(text)
    if docs.schema[text].dataType.typeName() == "binary":
        column = F.when(F.is_valid_utf8(column.cast("string")), column.cast("string"))
    first = F.coalesce(*[F.when(F.contains(column, F.lit(p)), F.lit(p)) for p in patterns])
    return docs.select(*keep, first.alias("pattern")).where("pattern is not null")


# Fixed texts: what the gates say, with the limit filled in first and the value second.
_SAYS = {
    "rate": "success_rate_percent below threshold (%.2f < {:.2f})",
    "lag": "freshness_lag_seconds_max above threshold (%d > {})",
    "mttr": "mttr_seconds above threshold (%d > {})",
    "burn": "error_budget_burn exceeded threshold (%.4f >= {:.4f})",
    "delta": "failed_run_rate_delta exceeded threshold (%.4f > {:.4f})",
    "stale": "freshness lag breach detected",
}


def _verdict(metrics: DataFrame, problems: list[Column]) -> DataFrame:
    errors = F.filter(F.array(*problems), lambda item: item.isNotNull())
    return metrics.withColumn("errors", errors).withColumn("passed", F.size("errors") == 0)


def slo_gate(
    metrics: DataFrame,
    min_success_rate: float = MIN_SUCCESS_RATE,
    max_freshness_lag: int = MAX_FRESHNESS_LAG,
    max_mttr: int = MAX_MTTR,
) -> DataFrame:
    """Adds ``errors`` and ``passed`` to rows of service-level metrics."""
    rate = F.coalesce(F.col("success_rate_percent"), F.lit(0.0))
    lag = F.coalesce(F.col("freshness_lag_seconds_max"), F.lit(0))
    mttr = F.coalesce(F.col("mttr_seconds"), F.lit(0))
    low = F.format_string(_SAYS["rate"].format(min_success_rate), rate)
    stale = F.format_string(_SAYS["lag"].format(max_freshness_lag), lag)
    slow = F.format_string(_SAYS["mttr"].format(max_mttr), mttr)
    return _verdict(
        metrics,
        [
            F.when(rate < min_success_rate, low),
            F.when(lag > max_freshness_lag, stale),
            F.when(mttr > max_mttr, slow),
        ],
    )


def canary_gate(
    metrics: DataFrame,
    max_burn: float = MAX_BUDGET_BURN,
    max_delta: float = MAX_FAILED_RATE_DELTA,
    allow_stale: bool = False,
) -> DataFrame:
    """Adds ``errors`` and ``passed`` to rows of canary metrics; reaching the burn limit fails."""
    burn = F.coalesce(F.col("error_budget_burn"), F.lit(0.0))
    delta = F.coalesce(F.col("failed_run_rate_delta"), F.lit(0.0))
    stale = F.coalesce(F.col("freshness_lag_breach"), F.lit(False)) & F.lit(not allow_stale)
    burnt = F.format_string(_SAYS["burn"].format(max_burn), burn)
    worse = F.format_string(_SAYS["delta"].format(max_delta), delta)
    return _verdict(
        metrics,
        [F.when(burn >= max_burn, burnt), F.when(delta > max_delta, worse), F.when(stale, _SAYS["stale"])],
    )
