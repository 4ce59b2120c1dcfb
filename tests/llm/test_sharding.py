from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from snapdelta.llm import sharding


def test_table_is_balanced_and_stable():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != names[-1])
    assert moved < 0.2 * 1009


@pytest.mark.parametrize("shards,slots", [([], 7), (["a", "a"], 7), (["a", "b"], 9)])
def test_bad_parameters(shards, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, slots)


def test_places(frame):
    rows = [(i, "") for i in range(300)] + [(None, None), (5, "again")]
    docs = frame(rows).withColumn("slot", F.lit("own")).withColumn("shard", F.lit(1))
    got = sharding.placed(docs).collect()
    table = sharding.lookup_table()
    assert len(got) == len(rows)
    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sharding.placed(frame([])).count() == 0


def test_main_path_has_no_python_and_no_shuffle(frame, spark, tmp_path):
    frame([(1, "a")]).write.parquet(str(tmp_path / "d"))
    plan = sharding.placed(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Exchange hashpartitioning" not in plan
