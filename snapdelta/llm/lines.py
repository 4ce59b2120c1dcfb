"""Line dedup: repeated runs of a few lines are found by counting hashed names, and later copies are deleted.

A line's name is a 128-bit digest of its text; contents are not compared again. Names of runs of 1, 2, 4 ... lines are made from the names of their
halves, and the last step overlaps two names to reach ``run`` lines; only positions whose name occurs twice go on, so after the
first step the work is on repeated lines alone. No suffix order is built, so runs longer than
``run`` are known by their windows only. The earliest position of a name stays; at the others all lines of the run are deleted. Neighbouring
deleted lines are reported as one run.

Names are counted with partial sums before the shuffle and are joined back by adaptive joins that split hot names; the rows of
a name never meet in a group. Order is by ``doc_id`` (nulls first), then a hash of the text, then the line.

A passage may sit in one or two lines, so a later copy of fewer than ``run`` lines goes too if it has ``long_words`` words.

Defined results: a null or empty text is one empty line, as is every empty line; texts with fewer than ``run`` lines lose
only long passages. Rows that agree in id and text are one document and get equal results. Runs are judged on the input. Extra columns
are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapdelta.functions.once import once
from snapdelta.llm.common import words_of
from snapdelta.session import settled

RUN = 3
LONG_WORDS = 50
_AT = ["doc_id", "tie", "line"]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def _name(content: Column) -> Column:
    """A digest by which contents are told apart."""
    return F.unhex(F.md5(content))


def _often(named: DataFrame) -> DataFrame:
    """Only the positions whose name occurs at more than one."""
    counts = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    return named.join(counts, "name", "left_semi")


def _wider(named: DataFrame, step: int) -> DataFrame:
    """Names of runs that begin with one name and go on with that of ``step`` lines further, where both are known."""
    lines = Window.partitionBy("doc_id", "tie").orderBy("line").rangeBetween(step, step)
    follow = F.max("name").over(lines)
    paired, counts = named.withColumn("follow", follow), []
    if "words" in named.columns:
        paired = paired.withColumn("after", F.max("tail").over(lines))
        counts = [(F.col("words") + F.col("after")).alias("words"), F.col("after").alias("tail")]
    paired = paired.where("follow IS NOT NULL")
    return paired.select(*_AT, _name(F.concat("name", "follow")).alias("name"), *counts)


def _levels(docs: DataFrame, id_col: str, text_col: str, run: int, counted: bool):
    """Width and repeated positions of each level up to ``run`` lines; every width, with its words, if they are counted."""
    texts = _documents(docs, id_col, text_col)
    lines = texts.select("doc_id", "tie", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    words = F.size(words_of(F.col("content")))
    counts = [words.alias("words"), words.alias("tail")] if counted else []
    # Repeated rows are one document: their positions agree, so each is taken once among the few that go on.
    named = _often(lines.select(*_AT, _name(F.col("content")).alias("name"), *counts))
    named = settled(named, "line-names").dropDuplicates(_AT)
    width = 1
    yield width, named
    while width < run:
        step = 1 if counted else min(width, run - width)
        named = settled(_often(_wider(named, step)), "line-names")
        width += step
        yield width, named


def _later(named: DataFrame) -> DataFrame:
    """All positions of a name but the earliest."""
    least = named.groupBy("name").agg(F.min(F.struct(*_AT)).alias("first"))
    same = F.struct(*_AT).eqNullSafe(F.col("first"))
    return named.join(least, "name").where(~same).select(*_AT)


def _checked(run: int) -> None:
    if run < 1:
        raise ValueError("run must be at least one line")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """Starts of runs of ``run`` lines that also start earlier: ``doc_id``, ``tie`` and ``line`` from 0."""
    _checked(run)
    *_, (_, named) = _levels(docs, id_col, text_col, run, False)
    return _later(named)


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_words: int = LONG_WORDS
) -> DataFrame:
    """Lines of later copies of ``run`` lines, or of fewer lines with ``long_words`` words; a line may come repeatedly."""
    _checked(run)
    gone = None
    for width, named in _levels(docs, id_col, text_col, run, True):
        starts = _later(named if width == run else named.where(F.col("words") >= long_words))
        lines = starts.select("doc_id", "tie", F.explode(F.sequence("line", F.col("line") + (width - 1))).alias("line"))
        gone = lines if gone is None else gone.unionByName(lines)
    return gone


def _runs(starts: DataFrame, run: int) -> DataFrame:
    """Unbroken stretches of deleted lines per document, in order."""
    order = Window.partitionBy("doc_id", "tie").orderBy("line")
    new = F.coalesce((F.col("line") - F.lag("line").over(order) > run).cast("int"), F.lit(1))
    numbered = starts.withColumn("new", new).withColumn("number", F.sum("new").over(order))
    spans = numbered.groupBy("doc_id", "tie", "number").agg(F.min("line").alias("first"), (F.max("line") + run).alias("end"))
    return spans.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("runs"))


def _kept(lines: Column, runs: Column) -> Column:
    """The lines outside all runs."""

    def gap(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["end"])
        return F.slice(lines, begin + 1, F.coalesce(F.get(runs, i)["first"], F.size(lines)) - begin)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), gap))


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_words: int | None = LONG_WORDS
) -> DataFrame:
    """``doc_id``, ``n_lines``, deleted ``runs`` (first line from 0, end) and the remaining ``text`` of every row.

    Without ``long_words`` only runs of ``run`` lines are deleted.
    """
    if long_words is None:
        found = _runs(repeated_runs(docs, id_col, text_col, run), run)
    else:
        found = _runs(repeated_lines(docs, id_col, text_col, run, long_words), 1)
    spans = found.select(
        F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), "runs"
    )
    texts = _documents(docs, id_col, text_col)
    found = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")), "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("runs").isNull(), F.col("text")).otherwise(
        once(lines, lambda x: F.array_join(_kept(x, F.col("runs")), "\n"))
    )
    none = F.array().cast("array<struct<first:int,end:int>>")
    return found.select("doc_id", F.size(lines).alias("n_lines"), F.coalesce("runs", none).alias("runs"), kept.alias("text"))
