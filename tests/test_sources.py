from __future__ import annotations

import csv as pycsv
import hashlib
import io
import json
import random
from collections import defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from snapdelta.functions.digest import WIDTHS, tree_digest
from snapdelta.plans.publish import csv_rows, union_rows
from snapdelta.sources.artifacts import read_delta
from snapdelta.sources.catalog import catalog
from snapdelta.sources.csvfiles import (
    CsvOptions,
    CsvSourceError,
    FileMark,
    clean_errors,
    csv_pull,
    file_checkpoint,
    file_listing,
    file_manifest_hash,
    normalize_header,
)
from snapdelta.sources.pages import PageChainError, item_rows, json_pages, missing_fields, page_chain, page_errors, page_gaps, read_pages
from snapdelta.sources.sql import bound_query, high_water_mark, jdbc_options, sql_pull


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


# SQL


def test_sql_pull_takes_the_mark(spark):
    rows = [(kilns, f"glaze {kilns}", f"2019-0{kilns}-30 07:15") for kilns in range(1, 7)]
    spark.createDataFrame(rows, "kilns int, glaze string, fired string").createOrReplaceTempView("pottery_t")
    query = "SELECT glaze, fired FROM pottery_t WHERE fired > :watermark AND kilns <> 5"
    found, mark = sql_pull(spark, query, "2019-03-30 07:15", "fired")
    assert rows_of(found, "glaze") == [("glaze 4",), ("glaze 6",)]
    assert mark.first()[0] == "2019-06-30 07:15"
    none, kept = sql_pull(spark, query, "2019-06-30 07:15", "fired")
    assert none.isEmpty() and kept.first()[0] == "2019-06-30 07:15"
    assert sql_pull(spark, query, None, "fired")[0].isEmpty()


def test_marks_compare_as_text(spark):
    df = spark.createDataFrame([(9, "b"), (10, None)], "n int, t string")
    assert high_water_mark(df, "n", None).first()[0] == "9"
    assert high_water_mark(df, "n", None, typed=True).first()[0] == "10"
    assert high_water_mark(df, "t", None).first()[0] == "b"
    assert high_water_mark(df, None, "p").first()[0] == "p"
    assert high_water_mark(df, "absent", "p").first()[0] == "p"
    assert high_water_mark(df.where("false"), "n", None).first()[0] is None


def test_jdbc_options():
    options = jdbc_options("select * from t where u > :watermark;", "o'clock", "id", (0, 100), 4)
    assert options["dbtable"] == "(select * from t where u > 'o''clock') pulled"
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "4"
    assert "NULL" in jdbc_options("select :watermark", None)["dbtable"]
    query = """select ':watermark', "a:watermark", b -- :watermark
        /* :watermark */ from t where x::watermark > :watermark and y > :watermark_x"""
    assert bound_query(query, "m") == query.replace("> :watermark and", "> 'm' and")
    assert bound_query(":watermark", "a\\'b") == "'a\\''b'" and bound_query(":watermark", "a\\b", "mysql") == "'a\\\\b'"
    with pytest.raises(ValueError):
        jdbc_options("select 1", partition_column="id")


# CSV


def test_rows_carry_their_file_and_the_checkpoint_their_mark(spark, tmp_path):
    ships = {"north": ["wren,7", "heron,12"], "south": ["plover,9"]}
    for name, lines in ships.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(["ship,knots", *lines]) + "\n")
    (tmp_path / "north.bak").write_text("ship,knots\nwreck,0\n")
    found = csv_pull(spark, str(tmp_path), "*.csv").collect()
    assert {(r["file_name"], f"{r['ship']},{r['knots']}") for r in found} == {
        (f"{name}.csv", line) for name, lines in ships.items() for line in lines
    }
    for row in found:
        file = tmp_path / row["file_name"]
        assert (row["file_path"], row["file_size_bytes"]) == (str(file), file.stat().st_size)
    files = file_listing(spark, str(tmp_path), "*.csv")
    mark = FileMark.parse(file_checkpoint(files, csv_pull(spark, str(tmp_path), "*.csv"), "ship", None))
    assert (mark.rows, mark.files, mark.digest) == ("wren", 2, file_manifest_hash(files).first()["digest"])
    assert mark.latest == max(r["mtime"] for r in files.collect())
    none = csv_pull(spark, str(tmp_path), "*.csv").where("false")
    assert FileMark.parse(file_checkpoint(files, none, "ship", "older")).rows == "older"


def test_file_mode(spark, tmp_path):
    (tmp_path / "tides.csv").write_bytes(b"harbour,low,high\r\nWick,0.4,3.1\rOban,#ERROR no gauge\n")
    (tmp_path / "blank.csv").write_bytes(b"\r\n")
    options = CsvOptions(document_mode="file", clean_errors=True)
    found = {r["file_name"]: r for r in csv_pull(spark, str(tmp_path), "*.csv", options).collect()}
    assert found["tides.csv"]["file_content_raw"] == "harbour,low,high\nWick,0.4,3.1\nOban,#ERROR no gauge\n"
    cells = [["Wick", "0.4", "3.1"], ["Oban", "", None]]
    assert json.loads(found["tides.csv"]["file_rows_json"]) == [dict(zip(["harbour", "low", "high"], row)) for row in cells]
    assert (found["blank.csv"]["file_content_raw"], found["blank.csv"]["file_rows_json"]) == ("\n", "[]")


def test_western_letters_and_pipes_without_header(spark, tmp_path):
    lines = ["Ærø|æble|½", "Fanø||", "", "Samsø"]
    (tmp_path / "isles.csv").write_bytes("\n".join(lines).encode("iso8859-1"))
    rows = csv_pull(spark, str(tmp_path), "*.csv", CsvOptions(delimiter="|", has_header=False, encoding="iso8859-1"))
    names = [f"column_{n}" for n in (1, 2, 3)]
    # A blank line is a record without cells.
    assert rows_of(rows, *names) == sorted([("Ærø", "æble", "½"), ("Fanø", "", ""), (None, None, None), ("Samsø", None, None)], key=str)


def test_headers_that_differ_and_collide(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Höhe (m);Gipfel;Größe/Art\n4810;Blanc;x\n")
    (tmp_path / "2.csv").write_text("GIPFEL;file_path;hohe--m\nRosa;mine;4634\n")
    (tmp_path / "3.csv").write_text("a b;a-b\nfirst;last\n")
    rows = csv_pull(spark, str(tmp_path), "*.csv", CsvOptions(delimiter=";", normalize_headers=True))
    assert rows.columns[:5] == ["hohe_m", "gipfel", "groe_art", "a_b", "file_path"]
    assert rows_of(rows, "gipfel", "hohe_m", "a_b", "file_name") == [
        ("Blanc", "4810", None, "1.csv"), ("Rosa", "4634", None, "2.csv"), (None, None, "last", "3.csv")
    ]
    assert rows_of(rows.where("gipfel = 'Rosa'"), "file_path") == [(str(tmp_path / "2.csv"),)]
    names = {"": "", "--": "", "A": "a", "ﬁn 1": "fin_1", " x..y ": "x_y", "Ωmega": "mega"}
    assert {name: normalize_header(name) for name in names} == names


def test_header_over_two_lines_and_true_width(spark, tmp_path):
    (tmp_path / "h.csv").write_text('id,"na\nme",c\n1,x,"two\nlines"\n')
    rows = csv_pull(spark, str(tmp_path), "h.csv")
    assert rows.columns[:3] == ["id", "na\nme", "c"]
    assert tuple(rows.first())[:3] == ("1", "x", "two\nlines")
    (tmp_path / "n.csv").write_text('1,"x\na,b,c,d",3\n2,y\n')
    bare = csv_pull(spark, str(tmp_path), "n.csv", CsvOptions(has_header=False))
    assert bare.columns[:4] == ["column_1", "column_2", "column_3", "file_path"]
    assert rows_of(bare, "column_1", "column_2", "column_3") == [("1", "x\na,b,c,d", "3"), ("2", "y", None)]


def test_cells_agree_with_a_plain_csv_reader(spark, tmp_path):
    rng = random.Random(3)
    pieces = ["", "x", 'say "hi"', "a,b", "two\nlines", "#ERROR (x)", " pad ", "é", "\\", "'"]
    for name in ("p.csv", "q.csv"):
        out = io.StringIO()
        writer = pycsv.writer(out, lineterminator="\n", quoting=rng.choice([pycsv.QUOTE_MINIMAL, pycsv.QUOTE_ALL]))
        writer.writerow(["id", "b", "c", "d"])
        for i in range(60):
            row = [f"{name}{i}"] + [rng.choice(pieces) for _ in range(3)]
            writer.writerow(row[: rng.choice([4, 4, 4, 2, 3])])
        (tmp_path / name).write_text(out.getvalue())
    expected = []
    for name in ("p.csv", "q.csv"):
        with open(tmp_path / name, newline="") as handle:
            expected += [(r["id"], r["b"], r["c"], r["d"]) for r in pycsv.DictReader(handle)]
    rows = csv_pull(spark, str(tmp_path), "*.csv")
    assert rows_of(rows, "id", "b", "c", "d") == sorted(expected, key=str)


def test_csv_contract_errors(spark, tmp_path):
    with pytest.raises(CsvSourceError):
        csv_pull(spark, str(tmp_path), "**/*.csv")
    with pytest.raises(CsvSourceError):
        csv_pull(spark, str(tmp_path / "gone"), "*.csv")
    (tmp_path / "plain").write_text("x")
    with pytest.raises(CsvSourceError):
        csv_pull(spark, str(tmp_path / "plain"), "*.csv")
    assert csv_pull(spark, str(tmp_path), "*.csv").count() == 0
    assert file_listing(spark, str(tmp_path), "*.csv").count() == 0
    (tmp_path / "x.csv").write_text("a\n1\n")
    with pytest.raises(CsvSourceError):
        csv_pull(spark, str(tmp_path), "*.csv", CsvOptions(encoding="no-such"))
    with pytest.raises(ValueError):
        CsvOptions(delimiter=";;")
    with pytest.raises(ValueError):
        CsvOptions(document_mode="cell")


def test_file_marks_of_all_times():
    mark = FileMark("m", 3, "t", "sha256:x")
    assert FileMark.parse(mark.text()) == mark
    assert FileMark.parse('{"v":1,"rw":17,"fc":2}') == FileMark(None, 2)
    for plain in ("2020-05-05", "[1]", '{"v":2,"rw":"m"}', "{broken"):
        assert FileMark.parse(plain) == FileMark(rows=plain)
    assert FileMark.parse("") == FileMark.parse(None) == FileMark()
    with pytest.raises(CsvSourceError):
        FileMark("y" * 250).text()


def test_manifest_hash_depends_on_the_listing_only(spark):
    files = spark.createDataFrame([("b", "t2", 2), ("a", "t1", 1)], "path string, mtime string, size bigint")
    found = file_manifest_hash(files).first()
    assert file_manifest_hash(files.orderBy("path").coalesce(1)).first() == found and found["rows"] == 2
    for other in (files.where("path = 'a'"), files.withColumn("size", F.lit(1)), files.unionByName(files)):
        assert file_manifest_hash(other).first()["digest"] != found["digest"]
    assert file_manifest_hash(files.where("false")).first()["rows"] == 0


@pytest.mark.parametrize("rows", [99_999, 200_000])
def test_digest_has_one_form_at_every_size(spark, rows):
    lines = [str(i * i) for i in range(rows)]

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    nodes = sorted(f"{digest(line)}:1" for line in lines)
    for width in WIDTHS:
        groups = defaultdict(list)
        for item in nodes:
            groups[item[:width]].append(item)
        nodes = sorted(f"{name}:{digest(','.join(items))}" for name, items in groups.items())
    found = tree_digest(spark.range(rows).selectExpr("cast(id * id as string) as line"), F.col("line")).first()
    assert found[:] == (digest(",".join(nodes)), rows)


def test_clean_errors_touches_text_only(spark):
    df = spark.createDataFrame([("#ERROR a", 1, "#ERROR b")], "a string, n int, b string")
    assert clean_errors(df).first()[:] == ("", 1, "")
    assert clean_errors(df, ["a"]).first()[:] == ("", 1, "#ERROR b")


def test_export_header_is_the_ordered_union(spark):
    birds = spark.createDataFrame([(4, "owl")], "legs int, bird string")
    fish = spark.createDataFrame([(None, "cod", 9)], "legs int, fish string, fins int")
    cells = csv_rows(union_rows([birds, fish, birds]))
    assert cells.columns == ["legs", "bird", "fish", "fins"]
    assert rows_of(cells, *cells.columns) == [("", "", "cod", "9"), ("4", "owl", "", ""), ("4", "owl", "", "")]


# Pages


def pages(spark, *bodies):
    rows = [(f"p{i}", body) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "page string, body string")


def test_pages_flatten(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"items":[{"id":1,"title":"A"},{"id":2,"title":null}],"paging":{"next_cursor":"c2"}}')
    (tmp_path / "2.json").write_text('[{"id":3}, 4, null, "x", [1]]')
    (tmp_path / "3.json").write_text('{"paging":{}}')
    items = json_pages(read_pages(spark, str(tmp_path)))
    ids = sorted(r[0] for r in items.select(F.variant_get("item", "$.id", "int")).collect())
    assert ids == [1, 2, 3]
    assert [tuple(r) for r in missing_fields(items, ["id", "title"]).collect()] == [("title", 1)]


def test_pages_of_another_form_are_refused(spark):
    bad = pages(spark, "5", '{"items":{}}', '{"items":null}', "{broken", "[]", "{}")
    assert rows_of(page_errors(bad), "page") == [("p0",), ("p1",), ("p2",), ("p3",)]
    with pytest.raises(PySparkException, match="'items'"):
        json_pages(bad).collect()
    with pytest.raises(PySparkException, match="'items'"):
        json_pages(bad).count()


def test_item_rows_print_scalars_and_names(spark):
    body = json.dumps([{"a": True, "b": None, "c": 1, "d": "x", "users": ["u", None, 1], "group": "g"}, {"users": None}])
    rows = item_rows(json_pages(pages(spark, body)), ["a", "b", "c", "d"], ["users", "group"])
    assert [tuple(r) for r in rows.orderBy(F.desc("c")).collect()] == [
        ("True", None, "1", "x", ["u", "1"], ["g"]),
        (None, None, None, None, None, None),
    ]


def test_page_gaps(spark):
    rows = [
        (None, '{"paging":{"next":"a"}}'),
        ("a", '{"paging":{"next":"b"}}'),
        ("c", '{"paging":{"next":0}}'),
        ("d", '{"paging":{"next":""}}'),
        ("e", '{"paging":"x"}'),
        ("f", "[1]"),
        ("g", '{"paging":{"next":false}}'),
        ("h", '{"paging":{"next":7}}'),
    ]
    gaps = page_gaps(spark.createDataFrame(rows, "cursor string, body string"), "paging.next")
    assert rows_of(gaps, "cursor", "next_cursor") == [("a", "b"), ("h", "7")]


def chain(spark, links, first="p0"):
    found = page_chain(spark.createDataFrame(links, "cursor string, next_cursor string"), first)
    return sorted((r["place"], r["cursor"]) for r in found.collect())


@pytest.mark.parametrize("pages", [1, 2, 3, 8, 37])
def test_chain_is_ranked_and_leftovers_are_not_in_it(spark, pages):
    links = [(f"p{i}", f"p{i + 1}" if i + 1 < pages else None) for i in range(pages)]
    left = [("old1", "p0"), ("old2", "old3"), ("old3", "old2"), ("old4", "gone"), ("old5", None)]
    rng = random.Random(pages)
    mixed = links + left
    rng.shuffle(mixed)
    assert chain(spark, mixed) == [(i, f"p{i}") for i in range(pages)]


def test_chain_with_a_hole_ends_there(spark):
    assert chain(spark, [("p0", "p1"), ("p1", "p2"), ("p3", None)]) == [(0, "p0"), (1, "p1")]


@pytest.mark.parametrize("links", [[("p0", "p0")], [("p0", "p1"), ("p1", "p2"), ("p2", "p1")], [(f"p{i}", f"p{(i + 1) % 9}") for i in range(9)]])
def test_cycles_fail(spark, links):
    with pytest.raises(PageChainError, match="cycle"):
        chain(spark, links)


def test_one_cursor_for_two_pages_and_an_absent_first_page_fail(spark):
    with pytest.raises(PageChainError, match="2 pages"):
        chain(spark, [("p0", "p1"), ("p1", None), ("p1", None)])
    with pytest.raises(PageChainError, match="no page"):
        chain(spark, [("p1", None)])


# Catalog and artifacts


def test_catalog_skips_nameless_and_lets_the_last_file_win(spark):
    specs = [
        ("a.yaml", '{"metadata":{"name":"x"},"spec":{"mode":"sql_pull","source":{"type":"postgres"}}}'),
        ("b.yaml", '{"metadata":{},"spec":{}}'),
        ("c.yaml", '{"metadata":{"name":"x"},"spec":{"mode":"rest_push","schedule":"s"}}'),
        ("d.yaml", "[1]"),
    ]
    found = catalog(spark.createDataFrame(specs, "path string, body string")).collect()
    assert [tuple(r) for r in found] == [("x", "a.yaml", "rest_push", "s", None)]


def test_read_delta(spark, tmp_path):
    line = {"doc_id": "a", "title": "t", "content": "c", "updated_at": "2026-01-01T00:00:00Z", "checksum": "s", "op": "UPSERT"}
    (tmp_path / "u.ndjson").write_text(json.dumps(line) + "\n\n  \n" + json.dumps(line | {"doc_id": "b", "metadata": {"k": 1}}))
    found = read_delta(spark, str(tmp_path / "u.ndjson"))
    assert rows_of(found, "doc_id", "mime_type", "metadata") == [("a", "text/plain", "{}"), ("b", "text/plain", '{"k":1}')]
    assert read_delta(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "bad.ndjson").write_text('{"doc_id":"a"}')
    with pytest.raises(Exception, match="document without title"):
        read_delta(spark, str(tmp_path / "bad.ndjson")).collect()
