"""Folders in which a session keeps what it has made from a table, for as long as the table stays as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession

from marlspike.operators.iterate import removed, temporary
from marlspike.sources.commits import file_system

_KEPT: dict[tuple[str, str, str], tuple[list, str]] = {}


def fingerprint(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Files under a path with their sizes and times of change."""
    fs, where = file_system(spark, path)
    out, left = [], [fs.getFileStatus(where)]
    while left:
        s = left.pop()
        if s.isDirectory():
            left += fs.listStatus(s.getPath())
        else:
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


def folder_of(spark: SparkSession, path: str, label: str, make) -> str:
    """The folder that ``make(folder)`` has filled from the table at ``path``; filled anew, and the old one deleted, once the table's files change."""
    key = (spark.sparkContext.applicationId, path, label)
    now = fingerprint(spark, path)
    kept = _KEPT.get(key)
    if kept and kept[0] == now:
        return kept[1]
    folder = temporary(spark, label)
    make(folder)
    _KEPT[key] = (now, folder)
    if kept:
        removed(spark, kept[1])
    return folder
