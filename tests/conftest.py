from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from snapdelta.session import clear_scratch, tuned  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = tuned(SparkSession.builder.master("local[8]").appName("tests"))
    builder = (
        builder.config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "2")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
