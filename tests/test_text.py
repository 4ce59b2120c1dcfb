from __future__ import annotations

import base64
import hashlib
import random
import struct
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.functions.template import TemplateError, compile_template
from snapdelta.functions.text import (
    UnsupportedText,
    base64_line,
    csv_cell,
    double_text,
    has_ink,
    index_id,
    iso_text,
    mark_text,
    shown_text,
    utc,
    whole_seconds,
    without_error_mark,
    zulu_text,
)


def column(spark, items, kind="string"):
    """A frame of the items with their places."""
    return spark.createDataFrame(list(enumerate(items)), f"i int, v {kind}")


def values(df, expression):
    return [row[1] for row in sorted(df.select("i", expression.alias("x")).collect())]


def test_double_text_prints_as_python_does(spark):
    rng = random.Random(5)
    numbers = [0.0, -0.0, 1.0, 1e7, 12345678.9, 1e15, 1e16, 1.5e16, 1e20, 1e-3, 1e-4, 1.5e-5, -2.5e-7, 1e100, 123456789012345.6]
    numbers += [rng.uniform(-1e9, 1e9) for _ in range(200)] + [rng.uniform(0, 1) * 10 ** rng.randint(-12, 25) for _ in range(200)]
    same = 0
    for shown, number in zip(values(column(spark, numbers, "double"), double_text(F.col("v"))), numbers):
        assert struct.pack("d", float(shown)) == struct.pack("d", number)
        same += shown == repr(number)
    # A few doubles have two shortest forms in older Java releases; all read back to the same value.
    assert same >= len(numbers) * 0.97
    fixed = [1e20, 12345678.9, 1e-5, 0.0001, 3.0, float("nan"), float("inf"), float("-inf")]
    assert values(column(spark, fixed, "double"), double_text(F.col("v"))) == [
        "1e+20", "12345678.9", "1e-05", "0.0001", "3.0", "nan", "inf", "-inf"
    ]


def test_shown_text_by_type(spark):
    df = spark.sql(
        "select 1 i, true b, false f, cast(null as string) n, date'2024-01-02' d, cast(1.10 as decimal(5,2)) c, "
        "timestamp'2024-01-02 03:04:05' t, timestamp_ntz'2024-01-02 03:04:05.5' z"
    )
    row = df.select(*[shown_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert row.asDict() == {
        "i": "1",
        "b": "True",
        "f": "False",
        "n": "None",
        "d": "2024-01-02",
        "c": "1.10",
        "t": "2024-01-02 03:04:05+00:00",
        "z": "2024-01-02 03:04:05.500000",
    }
    with pytest.raises(UnsupportedText):
        shown_text(F.lit(None), T.ArrayType(T.StringType()))


def test_iso_forms(spark):
    moments = [datetime(2026, 2, 16, 8, 30, tzinfo=timezone.utc), datetime(2026, 2, 16, 8, 30, 1, 250, tzinfo=timezone.utc)]
    df = column(spark, [m.isoformat() for m in moments]).select("i", F.col("v").cast("timestamp").alias("t"))
    assert values(df, iso_text(F.col("t"))) == [m.isoformat() for m in moments]
    assert values(df, zulu_text(F.col("t"))) == [m.isoformat().replace("+00:00", "Z") for m in moments]
    assert values(df, mark_text(F.col("t"), T.TimestampType())) == [m.isoformat() for m in moments]


def test_whole_seconds_drop_the_fraction_toward_zero(spark):
    df = spark.range(1)
    early, late = utc("2024-01-01T00:00:00.900000+00:00"), utc("2024-01-01T00:00:02.100000+00:00")
    assert df.select(whole_seconds(late, early), whole_seconds(early, late)).first()[:] == (1, -1)


def test_utc_takes_naive_and_zoned_moments(spark):
    row = spark.range(1).select(
        F.unix_seconds(utc(datetime(2024, 1, 1))), F.unix_seconds(utc("2024-01-01T01:00:00+01:00"))
    ).first()
    assert row[0] == row[1] == 1704067200


def test_index_id(spark):
    ids = ["hr-employees-1001", "hr-employees:1001", ":::", "_a_", "ä"]

    def digest(text):
        return hashlib.sha1(text.encode()).hexdigest()[:8]

    assert values(column(spark, ids), index_id(F.col("v"))) == [
        "hr-employees-1001",
        "hr-employees_1001_" + digest("hr-employees:1001"),
        "doc_" + digest(":::"),
        "a_" + digest("_a_"),
        "doc_" + digest("ä"),
    ]


def test_ink_base64_errors_and_cells(spark):
    texts = ["a", " \t", "\xa0", "\x1c", "", None]
    assert values(column(spark, texts), has_ink(F.col("v"))) == [True, False, False, False, False, False]
    long = "é" * 200
    encoded = values(column(spark, [long]), base64_line(F.col("v")))
    assert encoded == [base64.b64encode(long.encode()).decode()]
    cells = ["#ERROR ('name')", "#ERROR", "#ERRORS", "x #ERROR", None]
    assert values(column(spark, cells), without_error_mark(F.col("v"))) == ["", "", "#ERRORS", "x #ERROR", None]
    nested = spark.sql("select array(1, null) a, named_struct('x', cast(null as int)) s, cast(null as int) n")
    row = nested.select(*[csv_cell(F.col(f.name), f.dataType) for f in nested.schema.fields]).first()
    assert tuple(row) == ("[1,null]", '{"x":null}', "")


def test_template(spark):
    df = spark.sql("select 1 id, 'x' name, cast(null as string) gone, true ok, named_struct('name', 'o') owner, 'q' `odd name`")

    def render(text):
        return df.select(compile_template(text, df)).first()[0]

    assert render("{{ name }}-{{id}} {{ gone }} {{ ok }}\n") == "x-1 None True"
    assert render("{{ owner.name }}\n\n") == "o\n"
    assert render("") == ""
    assert render("plain 100%") == "plain 100%"
    for bad in ("{{ absent }}", "{{ owner.absent }}", "{{ name | upper }}", "{% if x %}", "{# note #}", "{{ name"):
        with pytest.raises(TemplateError):
            compile_template(bad, df)
