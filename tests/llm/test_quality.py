from __future__ import annotations

import random
import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from check_queries import table_of
from snapdelta.llm import quality, queries

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = GAP.findall(text)
    lines = [x for x in text.split("\n") if GAP.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, window in enumerate(windows):
        if windows.count(window) > 1:
            covered |= set(range(i, i + 8))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    repeat = len(covered)
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeat, failed


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t ", "a", "x " * 30, "the of and " * 30, "é|ü  b\x0b#c\n\n<d>\na\na\n", "the cat and a dog " + " ".join(f"w{i}" for i in range(30))]
    for _ in range(60):
        words = [rng.choice(["the", "of", "alpha", "beta", "ü*", "x"]) for _ in range(rng.randint(0, 60))]
        out.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words))
    return out


def test_counts_match_brute_force(frame):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in quality.measured(frame(rows)).collect()}
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(text), text
        assert not (r.kept and r.base_failed)


def test_rows_without_words_and_repeats(frame):
    got = quality.measured(frame([(None, None), (None, None), (1, "")])).collect()
    assert len(got) == 3 and all(r.base_failed and not r.kept for r in got)
    assert quality.measured(frame([])).count() == 0


def test_accepted_keeps_columns(frame):
    good = "the river and the hill are in a valley of green trees that by now have grown " + " ".join(f"word{i}" for i in range(20))
    docs = frame([(1, good), (2, "### " * 40), (3, None)]).withColumn("m", F.lit(0)).withColumn("n_words", F.lit("own"))
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [1]


def test_very_long_text(frame):
    text = " ".join(f"the w{i % 5_000} of" for i in range(20_000))
    r = quality.measured(frame([(1, text)])).first()
    assert r.n_words == 60_000 and r.n_repeat_words == 60_000


def test_no_user_functions(frame):
    plan = quality.measured(frame([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hash" not in plan


def long_text(n_words, vocabulary):
    rng = random.Random(n_words + vocabulary)
    return " ".join("the" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n_words))


def test_verdict_does_not_depend_on_length(frame):
    rows = [(n, long_text(n, 2_000)) for n in (400, 20_000, 200_000)] + [(n + 1, long_text(n, 60)) for n in (400, 20_000, 200_000)]
    got = {r.doc_id: r.kept for r in quality.measured(frame(rows)).collect()}
    assert got == {400: True, 20_000: True, 200_000: True, 401: False, 20_001: False, 200_001: False}


def test_clean_text_with_one_repeated_line_is_kept(frame):
    body = "the river and the hill are in a valley of green trees that by now " + " ".join(f"word{i}" for i in range(60))
    shout = "\n".join(["the same five words again and again"] * 4)
    rows = [(1, f"a short line\n{body}\na short line"), (2, f"{body[:150]}\n{shout}")]
    got = {r.doc_id: (r.n_dup_lines, r.base_failed, r.kept) for r in quality.measured(frame(rows)).collect()}
    assert got[1] == (1, False, True) and not got[2][2]
    assert [r.doc_id for r in quality.accepted(frame(rows)).collect()] == [1]


def test_sql_and_code_agree_on_long_texts(spark, frame):
    rng = random.Random(6)
    small = [f"the word{i}" for i in range(400)]
    large = [f"of term{i}" for i in range(60_000)]
    rows = [
        (1, " ".join(rng.choice(small) for _ in range(1_500))),
        (2, " ".join(rng.choice(large) for _ in range(100_000))),
        (3, "the one line\n" * 3 + " ".join(rng.choice(large) for _ in range(60))),
        (4, "\n".join(" ".join(rng.choice(large) for _ in range(6)) for _ in range(3)) + "\nof it\nof it"),
        (5, "\n".join(["the same line of words"] * 30)),
        (6, None),
        (7, " ".join(["a b c d e f g the"] * 4) + " " + " ".join(rng.choice(large) for _ in range(300))),
    ]
    docs = frame(rows)
    database = duckdb.connect()
    database.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())}))
    cursor = database.execute(queries.QUALITY_SQL)
    want = table_of([c[0] for c in cursor.description], cursor.fetchall())
    found = quality.measured(docs)
    assert table_of(found.columns, [tuple(r) for r in found.collect()]) == want
    kept = {r["doc_id"] for r in found.where("kept").collect()}
    assert {1, 2, 3, 4} <= kept and not kept & {5, 6}
