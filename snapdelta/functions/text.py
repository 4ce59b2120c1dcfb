"""Text forms of typed columns.

Documents, marks and CSV cells carry values as text. Spark's own casts print some types in
another way than the connector contract asks for (``true`` for ``True``, ``1.0E20`` for ``1e+20``),
so the text of a column is built from its data type here. All of it stays inside the JVM.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Any character that is not white space, with the four ASCII separators counted as white space.
_INK = r"(?U)[^\s\x1c-\x1f]"


class UnsupportedText(TypeError):
    """The data type has no text form."""


def field_type(df: DataFrame, name: str) -> T.DataType:
    """Data type of a column, or of a nested struct field given by a dotted path."""
    found: T.DataType = df.schema
    for part in name.split("."):
        if not isinstance(found, T.StructType) or part not in found.fieldNames():
            raise KeyError(name)
        found = found[part].dataType
    return found


def has_field(df: DataFrame, name: str) -> bool:
    try:
        field_type(df, name)
    except KeyError:
        return False
    return True


def ref(name: str) -> Column:
    """Column reference that is safe for names with spaces; dots step into structs."""
    return F.col(".".join(f"`{part}`" for part in name.split(".")))


def utc(moment: datetime | str) -> Column:
    """A fixed moment as a timestamp literal; a naive moment counts as UTC."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment.replace("Z", "+00:00"))
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return F.lit(moment.astimezone(timezone.utc).isoformat()).cast("timestamp")


# Fixed pattern: ISO 8601 as date, week date or basic date, with an optional time and offset after one character.
_ISO_TIME = (
    r"^(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2})|-?[Ww](\d{2})(?:-?([1-7]))?)"
    r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(?:[Zz]|([+-])(\d{2}):?(\d{2})(?::?(\d{2}))?)?)?$"
)


def iso_instant(column: Column) -> Column:
    """The instant of an ISO 8601 text, UTC where it names no offset; null for any other text.

    A date is required, so a time alone is none; zones go by offset, not by name.
    """

    def part(i: int, default: str = "") -> Column:
        found = F.regexp_extract(column, _ISO_TIME, i)
        return F.when(found == "", F.lit(default)).otherwise(found) if default else found

    year, week = part(1), part(6)
    day = F.concat_ws("-", year, F.concat(part(2), part(4)), F.concat(part(3), part(5))).try_cast("date")
    monday = F.date_trunc("week", F.concat(year, F.lit("-01-04")).try_cast("date")).cast("date")
    in_week = F.date_add(monday, (week.try_cast("int") - 1) * 7 + part(7, "1").try_cast("int") - 1)
    last_week = F.weekofyear(F.concat(year, F.lit("-12-28")).try_cast("date"))
    of_week = F.when(week.try_cast("int").between(1, last_week), in_week)
    date = F.when(week == "", day).otherwise(of_week)
    clock = F.concat(part(8, "00"), F.lit(":"), part(9, "00"), F.lit(":"), part(10, "00"), F.lit("."), F.left(F.rpad(part(11, "0"), 6, "0"), F.lit(6)))
    zone = F.when(part(12) == "", "+00:00").otherwise(F.concat(part(12), part(13), F.lit(":"), part(14)))
    seconds = F.concat(part(12), part(15, "00")).try_cast("int")
    moment = F.concat(date.cast("string"), F.lit("T"), clock, zone).try_cast("timestamp")
    return F.when(column.rlike(_ISO_TIME), moment - F.make_dt_interval(secs=F.coalesce(seconds, F.lit(0)).cast("decimal(18,6)")))


def instant(column: Column) -> Column:
    """Timestamps with and without zone as ``TIMESTAMP`` (the session zone is UTC)."""
    return column.cast("timestamp")


def whole_seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps, the fraction dropped toward zero."""
    micros = F.unix_micros(instant(later)) - F.unix_micros(instant(earlier))
    return F.call_function("div", micros, F.lit(1_000_000).cast("bigint"))


def double_text(column: Column) -> Column:
    """Shortest decimal text of a double: plain from 1e-4 up to 1e16, ``1e+16`` style outside."""
    x = column.cast("double")
    text = x.cast("string")
    size = F.abs(x)
    wide = text.cast(T.DecimalType(38, 20)).cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(wide, r"0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1)
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    digits = F.ltrim(power, F.lit("-"))
    scientific = F.concat(mantissa, F.lit("e"), sign, F.when(F.length(digits) < 2, "0").otherwise(""), digits)
    return (
        F.when(F.isnan(x), "nan")
        .when(x == float("inf"), "inf")
        .when(x == float("-inf"), "-inf")
        .when((size >= 1e16) | ((size < 1e-4) & (size > 0)), scientific)
        .when(text.contains("E"), trimmed)
        .otherwise(text)
    )


def _clock_text(column: Column, divider: str, offset: str) -> Column:
    ts = instant(column)
    whole = F.date_format(ts, f"yyyy-MM-dd'{divider}'HH:mm:ss")
    fine = F.date_format(ts, f"yyyy-MM-dd'{divider}'HH:mm:ss.SSSSSS")
    has_fraction = F.pmod(F.unix_micros(ts), F.lit(1_000_000)) != 0
    return F.concat(F.when(has_fraction, fine).otherwise(whole), F.lit(offset))


def iso_text(column: Column) -> Column:
    """ISO text of a timestamp with ``+00:00``; the fraction is printed only when it is not zero."""
    return _clock_text(column, "T", "+00:00")


def zulu_text(column: Column) -> Column:
    """ISO text of a timestamp with ``Z``, the form used in canonical documents."""
    return _clock_text(column, "T", "Z")


def plain_text(column: Column, kind: T.DataType) -> Column:
    """Text of one value, null staying null."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return column
    if isinstance(kind, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(column.isNotNull(), double_text(column))
    if isinstance(kind, T.TimestampType):
        return _clock_text(column, " ", "+00:00")
    if isinstance(kind, T.TimestampNTZType):
        return _clock_text(column, " ", "")
    if isinstance(kind, (T.IntegralType, T.DecimalType, T.DateType)):
        return column.cast("string")
    raise UnsupportedText(f"no text form for {kind.simpleString()}")


def shown_text(column: Column, kind: T.DataType) -> Column:
    """Text of one value with null shown as ``None``, as ids, titles and templates print it."""
    return F.coalesce(plain_text(column, kind), F.lit("None"))


def mark_text(column: Column, kind: T.DataType) -> Column:
    """Text by which high-water marks compare: ISO for timestamps, plain text for the rest."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(column)
    return plain_text(column, kind)


def csv_cell(column: Column, kind: T.DataType) -> Column:
    """Text of an exported CSV cell: null is empty, nested values are JSON."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        text = F.to_json(column, {"ignoreNullFields": "false"})
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        zone = "" if isinstance(kind, T.TimestampNTZType) else "+00:00"
        text = _clock_text(column, "T", zone)
    else:
        text = plain_text(column, kind)
    return F.coalesce(text, F.lit(""))


def has_ink(column: Column) -> Column:
    """True where the text is neither null nor blank."""
    return F.coalesce(column.rlike(_INK), F.lit(False))


def base64_line(column: Column) -> Column:
    """Base64 of the UTF-8 bytes on one line."""
    return F.replace(F.base64(F.encode(column, "UTF-8")), F.lit("\r\n"), F.lit(""))


def index_id(column: Column) -> Column:
    """An id of letters, digits, ``_`` and ``-``; a changed id gets eight hash digits appended."""
    cleaned = F.btrim(F.regexp_replace(column, "[^a-zA-Z0-9_-]", "_"), F.lit("_"))
    named = F.when(cleaned == "", "doc").otherwise(cleaned)
    marked = F.concat(named, F.lit("_"), F.left(F.sha1(column), F.lit(8)))
    return F.when(named == column, column).otherwise(marked)


def without_error_mark(column: Column) -> Column:
    """Cells that hold a failed formula become empty text."""
    return F.when(column.rlike(r"^#ERROR\b"), "").otherwise(column)


def sha256_text(column: Column) -> Column:
    """``sha256:`` followed by the hex digest of the text."""
    return F.concat(F.lit("sha256:"), F.sha2(column, 256))
