"""Records of CSV files in byte ranges, so that one large file is read by many tasks.

Whether a line break ends a record depends on all quotes before it. So each range is first walked twice, as if it began outside
and as if it began inside of a quoted cell, and tells in which of the two states it ends for either. Composing these small
functions along a file fixes the true state at every range's begin. Then each range parses the records that begin in it; a
record that goes on over ranges is put together from its parts, of which there are at most two a range.

Ranges are those of Spark's text reader, which gives every line to the range in which it begins. Cells follow the rules of
Python's ``csv`` module: a quote opens a quoted cell only at the cell's start, and elsewhere is text. Line ends of all three
kinds are one line feed, also inside of cells.
"""

from __future__ import annotations

import codecs
import csv
import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapdelta.session import setting, settled

# Fixed name: Spark's setting for the least number of partitions of a read, which bears on where files are divided.
_PARTITIONS = "spark.sql.files.minPartitionNum"
_LINE_COLUMNS = ("path", "mtime", "size", "start", "length", "line")


class CsvSourceError(ValueError):
    """The directory, the glob or the checkpoint breaks the file pull contract."""


def line_wise(encoding: str) -> bool:
    """Whether line ends, quotes and commas are the same single bytes as in ASCII, so that files can be cut at line ends."""
    return "\r\n,\"".encode(encoding) == b"\r\n,\"" and not codecs.lookup(encoding).name.startswith("utf-7")


def lines_of(spark: SparkSession, paths: list[str], encoding: str) -> tuple[DataFrame, str]:
    """Physical lines of the files as bytes, with file and range, and the encoding these bytes are in.

    Files of encodings whose line ends are not single bytes are read whole, one range each.
    """
    facts = [F.col("_metadata.file_path").alias("path"), F.unix_micros("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size")]
    if line_wise(encoding):
        place = [F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length")]
        return spark.read.text(paths).select(*facts, *place, F.col("value").cast("binary").alias("line")), encoding
    files = spark.read.format("binaryFile").load(paths).select(*facts, "content")

    def split(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                text = one.column(3)[0].as_py().decode(encoding)
                lines = [line.encode() for line in io.StringIO(text, newline=None).read().split("\n")]
                lines = lines[:-1] if lines and not lines[-1] else lines
                for first in range(0, len(lines), 10_000):
                    part = lines[first : first + 10_000]
                    repeated = [pa.array([one.column(k)[0].as_py()] * len(part), one.column(k).type) for k in range(3)]
                    places = [pa.array([0] * len(part), pa.int64()), pa.array([one.column(2)[0].as_py()] * len(part), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*repeated, *places, pa.array(part, pa.binary())], list(_LINE_COLUMNS))

    schema = "path string, mtime bigint, size bigint, start bigint, length bigint, line binary"
    return files.mapInArrow(split, schema), "utf-8"


@dataclass
class _Stretch:
    """Neighbouring lines of one range."""

    path: str
    mtime: int
    size: int
    start: int
    length: int
    lines: list[str]
    quoted: bool

    @property
    def is_whole_file(self) -> bool:
        return self.start == 0 and self.length >= self.size

    @property
    def is_last(self) -> bool:
        return self.start + self.length >= self.size


def _stretches(batches, encoding: str) -> Iterator[_Stretch]:
    for batch in batches:
        path, start = batch.column(0), batch.column(3).to_numpy()
        if not len(start):
            continue
        names = path.dictionary_encode()
        codes = names.indices.to_numpy()
        cuts = np.flatnonzero(np.append(True, (np.diff(codes) != 0) | (np.diff(start) != 0)))
        for low, high in zip(cuts, [*cuts[1:], len(start)]):
            raw = batch.column(5).slice(low, high - low).to_pylist()
            lines = [line.decode(encoding) + "\n" for line in raw]
            quoted = any(b'"' in line for line in raw)
            facts = [batch.column(k)[low].as_py() for k in (0, 1, 2, 3, 4)]
            yield _Stretch(*facts, lines, quoted)


class _Feed:
    """Lines for a reader; tells when it was asked for more than there are, as for a record that is not over."""

    def __init__(self, lines: list[str]):
        self._lines, self.asked_on = iter(lines), False

    def __iter__(self):
        return self

    def __next__(self) -> str:
        for line in self._lines:
            return line
        self.asked_on = True
        raise StopIteration


def _records(lines: list[str], delimiter: str) -> Iterator[tuple[list[str], int, bool]]:
    """Each record with the number of lines read so far, and whether it is over."""
    csv.field_size_limit(min(sys.maxsize, 2**31 - 1))
    feed = _Feed(lines)
    reader = csv.reader(feed, delimiter=delimiter)
    for record in reader:
        yield record, reader.line_num, not feed.asked_on


class _Walk:
    """A range under one assumption of how it begins: the state it has come to, and the greatest number of cells seen."""

    def __init__(self, delimiter: str, inside: bool):
        self._delimiter, self.inside = delimiter, inside
        self._cells = 0  # of the open record so far, in this range
        self._foreign = inside  # the open record began before this range
        self.width, self.first = 0, None

    def take(self, stretch: _Stretch, has_header: bool) -> None:
        # Without quotes the state stays, and with a header widths are not asked for.
        if not stretch.quoted and (self.inside or has_header and (self.first is not None or stretch.start > 0)):
            return
        lines = ['"' + stretch.lines[0], *stretch.lines[1:]] if self.inside else stretch.lines
        went_on, foreign, self.inside = self.inside, self._foreign, False
        for record, _, over in _records(lines, self._delimiter):
            cells = self._cells + len(record) - 1 if went_on else len(record)
            if not over:
                self.inside, self._cells, self._foreign = True, cells, foreign and went_on
                break
            if not (went_on and foreign):
                self.width = max(self.width, cells)
                # A first record over two stretches is left to the parse of the whole.
                if has_header and self.first is None and record and not went_on:
                    self.first = record
            went_on = False


def _scan(lines: DataFrame, encoding: str, delimiter: str, has_header: bool) -> DataFrame:
    """One row per range: how it ends for either begin, its greatest number of cells for either, and a file's first record."""

    def run(batches):
        def told(now, walks):
            first = walks[0].first if now.start == 0 else None
            values = ([now.path], [now.start], [now.length], [now.size], [walks[0].inside], [walks[-1].inside], [walks[0].width], [walks[-1].width], [first])
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            names = ["path", "start", "length", "size", "after_outside", "after_inside", "width_outside", "width_inside", "first"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        now, walks = None, []
        for stretch in _stretches(batches, encoding):
            if now is None or (stretch.path, stretch.start) != (now.path, now.start):
                if now is not None:
                    yield told(now, walks)
                now = stretch
                walks = [_Walk(delimiter, False)] + ([] if stretch.is_whole_file else [_Walk(delimiter, True)])
            if stretch.is_whole_file and has_header and walks[0].first is not None:
                continue
            for walk in walks:
                walk.take(stretch, has_header)
        if now is not None:
            yield told(now, walks)

    schema = "path string, start bigint, length bigint, size bigint, after_outside boolean, after_inside boolean, width_outside int, width_inside int, first array<string>"
    return lines.select(*_LINE_COLUMNS).mapInArrow(run, schema)


def _with_states(ranges: DataFrame) -> DataFrame:
    """Adds ``inside``: the true state at each range's begin.

    A range that ends alike for both begins fixes the state after it; one that does not either keeps the state or turns it.
    So the state is that after the last fixing range, turned once for each turning range since.
    """
    along = Window.partitionBy("path").orderBy("start")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("after_outside") == F.col("after_inside"), F.col("after_outside").cast("int"))
    turns = (F.col("after_outside") & ~F.col("after_inside")).cast("int")
    counted = ranges.withColumn("_turns", F.sum(turns).over(along))
    at_fix = F.when(fixed.isNotNull(), F.struct(fixed.alias("state"), F.col("_turns").alias("turns")))
    last = F.last(at_fix, ignorenulls=True).over(earlier)
    so_far = F.coalesce(F.sum(turns).over(earlier), F.lit(0))
    state = F.pmod(F.coalesce(last["state"], F.lit(0)) + so_far - F.coalesce(last["turns"], F.lit(0)), F.lit(2))
    return counted.withColumn("inside", state == 1).drop("_turns")


class Ranges:
    """Where the ranges of the files begin, and which begin inside of a cell; eight bytes and one for each range of a divided file."""

    def __init__(self, rows):
        self._starts, self._inside = {}, {}
        for row in rows:
            self._starts.setdefault(row["path"], []).append(row["start"])
            self._inside.setdefault(row["path"], []).append(row["inside"])
        self._starts = {path: np.array(starts, np.int64) for path, starts in self._starts.items()}
        self._inside = {path: np.array(inside, bool) for path, inside in self._inside.items()}

    @property
    def any_inside(self) -> bool:
        return any(inside.any() for inside in self._inside.values())

    def begins_inside(self, stretch: _Stretch) -> bool:
        if stretch.is_whole_file:
            return False
        starts = self._starts.get(stretch.path, np.zeros(0, np.int64))
        at = int(np.searchsorted(starts, stretch.start))
        if at == len(starts) or starts[at] != stretch.start:
            raise CsvSourceError(f"{stretch.path} is cut into other ranges than when it was scanned; read it again")
        return bool(self._inside[stretch.path][at])


def _parts(batches, encoding: str, delimiter: str, ranges: Ranges, has_header: bool) -> Iterator[tuple[_Stretch, str, object]]:
    """The records that a range holds whole (``record``), and its parts of others: ``head``, ``middle``, ``tail``; ``header`` for a tail that holds a file's first record."""
    now, open_, foreign, seen = None, [], False, True

    def closing():
        """What is open when a range ends."""
        if not open_:
            return
        if foreign:
            yield now, "middle", "".join(open_)
        elif now.is_last:
            record = next(_records(open_, delimiter))[0]
            if record or not has_header:
                yield now, "header" if not seen and record else "record", record
        else:
            yield now, "tail" if seen else "header", "".join(open_)

    for stretch in _stretches(batches, encoding):
        if now is None or (stretch.path, stretch.start) != (now.path, now.start):
            yield from closing()
            foreign = ranges.begins_inside(stretch)
            open_, seen = [], not has_header or stretch.start > 0
        now = stretch
        if not stretch.quoted and (open_ or foreign):
            open_ += stretch.lines
            continue
        lines = [*open_, *stretch.lines]
        open_, taken = [], 0
        # A part that began in an earlier range is read as if its quote stood before it.
        for record, upto, over in _records(['"' + lines[0], *lines[1:]] if foreign else lines, delimiter):
            if not over:
                open_ = lines[taken:]
                break
            if foreign:
                yield now, "head", "".join(lines[taken:upto])
                foreign = False
            elif seen:
                if record or not has_header:
                    yield now, "record", record
            elif record:
                seen = True
            taken = upto
    if now is not None:
        yield from closing()


def _fragments(lines: DataFrame, encoding: str, delimiter: str, ranges, has_header: bool) -> DataFrame:
    """The parts of records that lie in more than one range."""

    def run(batches):
        for stretch, kind, text in _parts(batches, encoding, delimiter, ranges.value, has_header):
            if kind in ("head", "middle", "tail") or kind == "header" and isinstance(text, str):
                values = [[stretch.path], [stretch.mtime], [stretch.size], [stretch.start], [kind], [text]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["path", "mtime", "size", "start", "kind", "text"])

    return lines.select(*_LINE_COLUMNS).mapInArrow(run, "path string, mtime bigint, size bigint, start bigint, kind string, text string")


def _stitched(fragments: DataFrame, delimiter: str) -> DataFrame:
    """Records out of their parts: ``path, mtime, size, cells`` and whether it is the file's ``header``."""
    begins = F.col("kind").isin("tail", "header")
    order = F.struct("start", F.when(begins, 1).otherwise(0).alias("place"))
    along = Window.partitionBy("path").orderBy("start", F.when(begins, 1).otherwise(0))
    grouped = fragments.withColumn("record", F.sum(begins.cast("int")).over(along)).groupBy("path", "record").agg(
        F.any_value("mtime").alias("mtime"), F.any_value("size").alias("size"), F.bool_or(F.col("kind") == "header").alias("header"),
        F.sort_array(F.collect_list(F.struct(order.alias("at"), "text"))).alias("parts"),
    )
    texts = grouped.select("path", "mtime", "size", "header", F.array_join("parts.text", "").alias("text"))

    def run(batches):
        for batch in batches:
            cells = [next(_records(io.StringIO(text).readlines(), delimiter))[0] for text in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cells, pa.list_(pa.string()))], ["path", "mtime", "size", "header", "cells"])

    return texts.mapInArrow(run, "path string, mtime bigint, size bigint, header boolean, cells array<string>")


class CsvScan:
    """Files that have been scanned once: their first records or widths are known, and the state at each range's begin.

    All reads ask for the same number of partitions, so that executors which come or go between them do not move the ranges.
    """

    def __init__(self, spark: SparkSession, paths: list[str], delimiter: str, encoding: str, has_header: bool):
        self._spark, self._delimiter, self._has_header = spark, delimiter, has_header
        self._least = spark.conf.get(_PARTITIONS, None) or str(spark.sparkContext.defaultParallelism)
        self._lines, self._encoding = lines_of(spark, paths, encoding)
        with setting(spark, _PARTITIONS, self._least):
            scanned = settled(_scan(self._lines, self._encoding, delimiter, has_header), "csv-ranges")
        divided = settled(_with_states(scanned.where("start > 0 OR length < size")), "csv-states")
        ranges = Ranges(divided.select("path", "start", "inside").orderBy("path", "start").toLocalIterator())
        self._ranges = spark.sparkContext.broadcast(ranges)
        self._whole = scanned.where("start = 0 AND length >= size")
        self._divided = divided
        self._stitched = None
        if ranges.any_inside:
            with setting(spark, _PARTITIONS, self._least):
                parts = settled(_fragments(self._lines, self._encoding, delimiter, self._ranges, has_header), "csv-parts")
            self._stitched = settled(_stitched(parts, delimiter), "csv-stitched")

    def headers(self) -> dict[str, list[str]]:
        """The first record of every file that has one."""
        found = self._whole.unionByName(self._divided.drop("inside")).where("start = 0").select("path", "first")
        if self._stitched is not None:
            over = self._stitched.where("header").select("path", F.col("cells").alias("first"))
            found = found.join(over.select("path"), "path", "left_anti").unionByName(over)
        return {row["path"]: row["first"] for row in found.where("first IS NOT NULL").toLocalIterator()}

    def width(self) -> int:
        """The greatest number of cells in any record."""
        true_width = F.when(F.col("inside"), F.col("width_inside")).otherwise(F.col("width_outside"))
        widths = self._whole.select(F.col("width_outside").alias("w")).unionByName(self._divided.select(true_width.alias("w")))
        if self._stitched is not None:
            widths = widths.unionByName(self._stitched.select(F.size("cells").alias("w")))
        return widths.agg(F.max("w")).first()[0] or 0

    def records(self, places: dict[str, list[int]], width: int) -> DataFrame:
        """All records as ``path, mtime, size, c0 .. c<width - 1>``, written once.

        ``places`` gives per file which of a record's cells each column takes (-1: none); the key None stands for files
        that are not named. A cell that a record lacks is null.
        """
        names = ["path", "mtime", "size", *(f"c{i}" for i in range(width))]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * width]
        schema = "path string, mtime bigint, size bigint" + "".join(f", c{i} string" for i in range(width))
        shared = self._spark.sparkContext.broadcast(places)
        encoding, delimiter, ranges, has_header = self._encoding, self._delimiter, self._ranges, self._has_header

        def cells_of(record, own):
            n = len(record)
            return [record[k] if 0 <= k < n else None for k in own]

        def run(batches):
            rows = []

            def packed():
                columns = list(zip(*rows))
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

            path, own = None, None
            for stretch, kind, record in _parts(batches, encoding, delimiter, ranges.value, has_header):
                if kind != "record":
                    continue
                if stretch.path != path:
                    path = stretch.path
                    own = shared.value.get(path, shared.value.get(None))
                if own is not None:
                    rows.append((path, stretch.mtime, stretch.size, *cells_of(record, own)))
                if len(rows) >= 4_096:
                    yield packed()
                    rows = []
            if rows:
                yield packed()

        found = self._lines.select(*_LINE_COLUMNS).mapInArrow(run, schema)

        def arranged(batches):
            for batch in batches:
                rows = []
                for path, mtime, size, cells in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    own = shared.value.get(path, shared.value.get(None))
                    if own is not None and (cells or not has_header):
                        rows.append((path, mtime, size, *cells_of(cells, own)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        if self._stitched is not None:
            over = self._stitched.where("NOT header").select("path", "mtime", "size", "cells")
            found = found.unionByName(over.mapInArrow(arranged, schema))
        with setting(self._spark, _PARTITIONS, self._least):
            return settled(found, "csv-rows")
