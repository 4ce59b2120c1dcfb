"""Digests of published deltas and the rows in which two deltas differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.digest import WIDTHS, tree_digest
from snapdelta.functions.text import iso_text
from snapdelta.operators.diff import concat_delta
from snapdelta.operators.merkle import Tree, differing_rows, grown, moved_on
from snapdelta.operators.normalize import json_text

_FIELDS = ("doc_id", "op", "checksum", "updated_at")


def _line() -> Column:
    """The JSON object of one delta row, keys in order and spaced after ``:`` and ``,``."""
    values = {
        "checksum": F.col("checksum"),
        "doc_id": F.col("doc_id"),
        "op": F.col("op"),
        "updated_at": iso_text(F.col("updated_at")),
    }
    pairs = []
    for name, value in values.items():
        quoted = F.regexp_extract(json_text(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
        pairs.append(F.concat(F.lit(f'"{name}": '), quoted))
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def replay_digest(upserts: DataFrame, deletes: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Digest of a delta: equal for equal deltas, however large they are and however they are partitioned.

    It covers operation, id, checksum and time of every row. ``widths`` sets the shape of the tree and with it the value.
    """
    delta = concat_delta(upserts, deletes).select(*_FIELDS)
    return tree_digest(delta, _line(), widths)


def delta_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two deltas that differ, with ``side`` and how many more copies that side has."""
    signed = a.select(*_FIELDS, F.lit(1).alias("n")).unionByName(b.select(*_FIELDS, F.lit(-1).alias("n")))
    totals = signed.groupBy(*_FIELDS).agg(F.sum("n").alias("n")).where("n <> 0")
    return totals.select(*_FIELDS, F.when(F.col("n") > 0, "a").otherwise("b").alias("side"), F.abs("n").alias("copies"))


def delta_tree(delta: DataFrame, path: str, widths: tuple[int, int] = WIDTHS) -> Tree:
    """Keep the digest tree of a delta under a folder; its root is the ``replay_digest`` of the delta."""
    return grown(delta.select(*_FIELDS), _line(), path, widths)


def delta_tree_after(tree: Tree, come: DataFrame, gone: DataFrame, note: str) -> Tree:
    """The tree of a delta that has won and lost some rows; only the nodes they touch are read and written."""
    return moved_on(tree, _line(), come.select(*_FIELDS), gone.select(*_FIELDS), note)


def tree_diff(a: Tree, b: Tree) -> DataFrame:
    """``delta_diff`` of two deltas with kept trees: only leaves that differ are read."""
    return delta_diff(*differing_rows(a, b))
