"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import functools
import importlib

# Fixed names: modules with QUERIES and ORACLES.
_MODULES = ("documents", "ledger", "push", "checks", "pulls")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for module in _MODULES:
        found = getattr(importlib.import_module(f"registry.{module}"), attribute)
        clash = merged.keys() & found.keys()
        if clash:
            raise ValueError(f"defined twice: {sorted(clash)}")
        merged |= found
    return merged


def _in_utc(query):
    """The query with the session zone it counts on, whatever session it is given."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def all_queries() -> dict:
    return {name: _in_utc(query) for name, query in _merged("QUERIES").items()}


def all_oracles() -> dict:
    return _merged("ORACLES")
