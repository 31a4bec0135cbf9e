"""Names, Spark plans and SQL of the engine's queries, gathered from the query modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Entry(NamedTuple):
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


#: Modules that register queries when they are imported.
MODULES = ["search_queries", "risk_queries", "chunk_queries", "eval_queries", "context_queries", "store_queries", "event_queries", "stream_queries", "present_queries", "service_queries", "source_queries", "detail_queries"]

_ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None):
    """Register a function ``(spark, sf_dir)`` under its own name, with its SQL where there is one."""

    def add(f):
        _ENTRIES[f.__name__] = Entry(f.__name__, f, sql)
        return f

    return add


def entries() -> list[Entry]:
    for name in MODULES:
        importlib.import_module(f"marlspike.plans.{name}")
    return list(_ENTRIES.values())
