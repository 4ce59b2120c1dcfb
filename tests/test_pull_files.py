"""The files that pull queries write first are bounded, however many orders there are."""

from __future__ import annotations

import csv
from collections import Counter

import pytest

from registry import pulls
from snapdelta.sources import csvfiles
from snapdelta.sources.csvfiles import CsvOptions

KEYS = [*range(1, 300), None, 7, 7]


@pytest.fixture
def orders(spark, folder):
    def write(keys):
        rows = [(key, "F", f"{(key or 0) % 3}-URGENT") for key in keys]
        spark.createDataFrame(rows, "o_orderkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
        return folder

    return write


def sizes(spark, base, glob):
    lines = spark.read.text(f"{base}/{glob}").selectExpr("_metadata.file_path AS path")
    return [r["count"] for r in lines.groupBy("path").count().collect()]


@pytest.mark.parametrize("name", ["csv_ranges", "csv_ranges_no_header"])
def test_lines_are_dealt_over_files_and_rows_are_the_same(spark, orders, monkeypatch, name):
    d = orders(KEYS)
    whole = Counter(map(tuple, pulls.QUERIES[name](spark, d).collect()))
    monkeypatch.setattr(pulls._orders_as_lines, "__defaults__", (50,))
    assert Counter(map(tuple, pulls.QUERIES[name](spark, d).collect())) == whole
    found = sizes(spark, pulls._orders_as_lines(spark, d, name == "csv_ranges"), "*.txt")
    assert len(found) > 3 and max(found) < 300


def test_a_header_alone_without_orders(spark, orders):
    assert pulls.csv_ranges(spark, orders([])).collect() == []


def test_files_in_file_mode_are_more_as_orders_are_more(spark, orders, monkeypatch):
    d = orders(KEYS)
    whole = Counter(map(tuple, pulls.csv_pull_file(spark, d).collect()))
    monkeypatch.setattr(pulls, "_FILE_ORDERS", 15)
    kept = []
    monkeypatch.setattr(pulls, "csv_pull", lambda spark, base, *rest: kept.append(base) or csvfiles.csv_pull(spark, base, *rest))
    assert Counter(map(tuple, pulls.csv_pull_file(spark, d).collect())) == whole
    assert len(sizes(spark, kept[0], "*/*.csv")) > 12


def test_a_file_is_one_batch_of_file_mode(spark, folder, monkeypatch):
    for k in range(4):
        with open(f"{folder}/{k}.csv", "w", newline="") as out:
            csv.writer(out).writerows([["a", "b"], [k, 'x"\n'], ["", "é"]])
    got = []

    class Files:
        def mapInPandas(self, parse, schema):
            import pandas as pd

            frame = pd.DataFrame({"file_name": ["0", "1"], "content": [b"a\n1\n", b"a\n\n2\n"]})
            got.extend(parse([frame]))
            return self.frame.mapInPandas(parse, schema)

    files = Files()
    files.frame = spark.read.format("binaryFile").load(folder).select(*csvfiles._lineage(), "content")
    monkeypatch.setattr(csvfiles, "_lineage", lambda: [])

    class Reader:
        def __getattr__(self, _):
            return lambda *a, **k: files if _ == "select" else self

    class Session:
        read = Reader()

    out = csvfiles._by_file(Session(), [folder], CsvOptions()).collect()
    assert [len(frame) for frame in got] == [1, 1] and got[1]["file_rows_json"].tolist() == ['[{"a":"2"}]']
    assert sorted(r.file_rows_json for r in out)[1] == '[{"a":"1","b":"x\\"\\n"},{"a":"","b":"\\u00e9"}]'
