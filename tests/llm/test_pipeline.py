from __future__ import annotations

import hashlib

import duckdb
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check_queries import duck, table_of
from snapdelta.llm import bpe, queries
from snapdelta.llm.common import documents, tokenizer
from tests.llm.test_mixing import brute as mixing_brute
from tests.llm.test_near import brute as near_brute

DATA = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    """Each stage against plain Python or SQL on what the stage before kept."""
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{DATA}/documents.parquet'").fetchall()
    database = duck(DATA)
    kept = {r[0] for r in database.execute(f"SELECT doc_id FROM ({queries.QUALITY_SQL}) WHERE kept").fetchall()}
    rows = [r for r in rows if r[0] in kept]
    last = {r[1]: r[0] for r in sorted(rows)}
    rows = [r for r in rows if last[r[1]] == r[0]]
    components = near_brute([r[:2] for r in rows], 5)
    rows = [r for r in rows if components[r[0]][2]]
    drawn = mixing_brute(rows, corpus_pipeline.MIX)
    rows = [r for r in rows if drawn[r[0]][1]]
    path, pattern = tokenizer()
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = {}
    for doc_id, text, *_ in rows:
        ids = reference.encode_ordinary(text)
        want[doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and len(got) > 20


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = documents(spark, DATA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    found = entry.queries()[name](spark, DATA)
    cursor = duck(DATA).execute(entry.oracle_sql()[name])
    assert table_of(found.columns, [tuple(r) for r in found.collect()]) == table_of([c[0] for c in cursor.description], cursor.fetchall())


def test_nulls_repeats_and_clashing_columns_go_through_all_stages(spark):
    docs = documents(spark, DATA).where("doc_id < 60")
    odd = docs.where("doc_id = 1").selectExpr("doc_id + 1000 AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(docs.where("doc_id % 9 = 0")).unionByName(odd)
    names = ("ids", "bytes", "node", "component", "kept", "digest", "row", "budget", "times", "salt")
    wide = docs.withColumns({name: F.lit(f"own {name}") for name in names})
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        wide = stage(spark, wide, DATA)
        if number < 4:
            assert set(wide.columns) == {*docs.columns, *names}
            assert all(r.ids == "own ids" for r in wide.select("ids").distinct().collect())
    assert 0 < wide.count() < 60


def test_all_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
