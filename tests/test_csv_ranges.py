"""CSV files in small byte ranges, against the plain reader of the standard library."""

from __future__ import annotations

import csv
import io
import random

import pytest

from snapdelta.session import setting
from snapdelta.sources.csvfiles import CsvOptions, csv_pull
from snapdelta.sources.csvranges import CsvScan, CsvSourceError, Ranges, _Stretch

PIECES = ["", "x", 'say "hi"', 'a"b', '"', '""', "a,b", "two\nlines", "three\n\nlines\n", " pad ", "é", "\\", "'", "long " * 30, '"quoted" ' * 9, "\r"]


def plain(text, has_header):
    """Cells as a whole reading gives them; short rows get None."""
    rows = list(csv.reader(io.StringIO(io.StringIO(text, newline=None).read())))
    if has_header:
        header, *rows = [row for row in rows if row]
        return [tuple((row + [None] * len(header))[: len(header)]) for row in rows]
    width = max(map(len, rows))
    return [tuple(row + [None] * (width - len(row))) for row in rows]


def found(spark, path, columns, **options):
    rows = csv_pull(spark, str(path), "*.csv", CsvOptions(**options))
    assert len(rows.columns) == columns + 4
    return sorted((tuple(r)[:columns] for r in rows.collect()), key=repr)


@pytest.fixture(params=[96])
def small_ranges(spark, request):
    with setting(spark, "spark.sql.files.maxPartitionBytes", str(request.param)), setting(spark, "spark.sql.files.openCostInBytes", "1"):
        yield


def written(rng, rows, ends="\n"):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=ends, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    for row in rows:
        writer.writerow(row)
    return out.getvalue()


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_give_the_rows_of_the_whole_file(spark, small_ranges, tmp_path, seed):
    rng = random.Random(seed)
    rows = [[f"id{i}", *(rng.choice(PIECES) for _ in range(rng.choice([3, 3, 2, 1, 4])))] for i in range(16)]
    text = written(rng, [["id", "b\n2", "c", "d"], *rows], rng.choice(["\n", "\r\n"]))
    # Quotes inside of cells that do not begin with one are text.
    text += 'q1,a"b,c"d,"e"f\nq2,"x"y"z,1\n\n"q3",,"",\n'
    (tmp_path / "a.csv").write_bytes(text.encode())
    assert found(spark, tmp_path, 4) == sorted(plain(text, True), key=repr)


@pytest.mark.parametrize("seed", [5])
def test_ranges_without_a_header(spark, small_ranges, tmp_path, seed):
    rng = random.Random(seed)
    rows = [[f"id{i}", *(rng.choice(PIECES) for _ in range(rng.choice([3, 2, 1])))] for i in range(14)]
    rows.insert(5, ["wide", "over\nranges " * 5, *map(str, range(9))])
    text = written(rng, rows) + "\nlast"
    (tmp_path / "a.csv").write_bytes(text.encode("cp1252"))
    expected = plain(text, False)
    assert found(spark, tmp_path, 11, has_header=False, encoding="cp1252") == sorted(expected, key=repr)


def test_a_cell_longer_than_many_ranges_and_an_open_quote(spark, small_ranges, tmp_path):
    text = 'id,"head\ner"\n1,"' + "line\n" * 40 + '"\n2,b\n3,"never closed\nat all\n'
    (tmp_path / "a.csv").write_text(text)
    assert found(spark, tmp_path, 2) == sorted(plain(text, True), key=repr)


def test_a_quote_cell_that_was_lost(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y,z\na"b,c"d\n')
    assert found(spark, tmp_path, 3) == [('a"b', 'c"d', None)]


@pytest.mark.parametrize("encoding", ["utf-16", "utf-32-le", "cp1252", "latin-1", "utf-8", "shift_jis"])
def test_encodings(spark, tmp_path, encoding):
    text = 'id,name\r1,"a\r\nb"\n2,' + ("漢字" if encoding == "shift_jis" else "Jörg") + "\r\n"
    (tmp_path / "a.csv").write_bytes(text.encode(encoding))
    assert found(spark, tmp_path, 2, encoding=encoding) == sorted(plain(text, True))


def test_bytes_that_the_encoding_lacks_stop_the_pull(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"id\n\xff\n")
    with pytest.raises(Exception, match="decode"):
        found(spark, tmp_path, 1)


def test_files_with_other_headers_in_small_ranges(spark, small_ranges, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f'{i},"v\n{i}"\n' for i in range(8)))
    (tmp_path / "b.csv").write_text("y,z,x\n" + "".join(f'"w\n{i}",,{i}\n' for i in range(8)))
    (tmp_path / "c.csv").write_text("")
    expected = [(str(i), f"v\n{i}", None) for i in range(8)] + [(str(i), f"w\n{i}", "") for i in range(8)]
    assert found(spark, tmp_path, 3) == sorted(expected, key=repr)


def test_one_file_uses_many_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t\n" + "".join(f'{i},"x\ny"\n' for i in range(4_000)))
    with setting(spark, "spark.sql.files.maxPartitionBytes", "8k"), setting(spark, "spark.sql.files.openCostInBytes", "1"):
        scan = CsvScan(spark, [str(tmp_path / "a.csv")], ",", "utf-8", True)
        assert scan._lines.rdd.getNumPartitions() > 4
        assert scan.records({None: [0, 1]}, 2).count() == 4_000


def test_ranges_that_moved_are_noticed():
    ranges = Ranges([{"path": "p", "start": 0, "inside": False}, {"path": "p", "start": 64, "inside": True}])
    at = lambda start: _Stretch("p", 0, 200, start, 64, [], False)
    assert not ranges.begins_inside(at(0)) and ranges.begins_inside(at(64))
    with pytest.raises(CsvSourceError, match="other ranges"):
        ranges.begins_inside(at(50))
