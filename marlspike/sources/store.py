"""Tables kept in folders: JSON tables with upserts, versions to go back to, buffered telemetry."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.sources.commits import State, Table, file_system
from marlspike.sources.files import latest


class JsonTable:
    """Rows with an ``id`` and a ``version`` as JSON lines; writers append by commits, readers take the newest of each id from a snapshot."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.table = Table(spark, path, f"{schema}, id string, version bigint, gone boolean", "json")

    def rows(self) -> DataFrame:
        return self._newest(self.table.state()).filter("not gone").drop("gone")

    def _newest(self, state: State) -> DataFrame:
        return latest(self.table.read(state), ["id"], ["version"])

    def upsert(self, rows: DataFrame) -> None:
        self.table.append(rows.withColumn("gone", F.lit(False)))

    def delete(self, ids: DataFrame) -> None:
        """Ids whose rows go, at ``version``."""
        self.table.append(ids.select("id", "version", F.lit(True).alias("gone")))

    def compact(self) -> None:
        """Only the newest rows, in one folder. What others append meanwhile stays beside it; deletions stay, as an older row may still come."""
        state = self.table.state()
        if len(state.folders) > 1:
            self.table.replace(list(state.folders), self._newest(state), merged=True)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the versions of a table, oldest first; names sort by time."""
    fs, where = file_system(spark, root)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def back_up(df: DataFrame, root: str, keep: int = 5) -> str:
    """Write a version of a table and let the oldest go, so that ``keep`` stay. A version counts once it is whole."""
    spark = df.sparkSession
    name = f"v{time.time_ns():020d}"
    df.write.option("compression", "zstd").parquet(f"{root}/{name}")
    for old in versions(spark, root)[:-keep]:
        fs, where = file_system(spark, f"{root}/{old}")
        fs.delete(where, True)
    return name


def restored(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """A version of a table, the newest unless one is named."""
    there = versions(spark, root)
    if not there or name is not None and name not in there:
        raise ValueError(f"no version {name or ''} under {root}")
    return spark.read.parquet(f"{root}/{name or there[-1]}")


def migrated(df: DataFrame, added: dict[str, str], renamed: dict[str, str] | None = None) -> DataFrame:
    """Rows of an older schema under a newer one: columns renamed, and those that lack added by an expression."""
    for old, new in (renamed or {}).items():
        df = df.withColumnRenamed(old, new)
    return df.withColumns({c: F.expr(e) for c, e in added.items() if c not in df.columns})


class Telemetry:
    """Events held back until there are enough, then appended in one batch; a batch that can't be written stays for the next try."""

    def __init__(self, spark: SparkSession, path: str, schema: str, size: int = 100, most: int = 10_000):
        self.spark, self.path, self.schema, self.size, self.most, self.held = spark, path, schema, size, most, []

    def record(self, event: tuple) -> None:
        self.held = [*self.held, event][-self.most :]  # while nothing can be written the oldest go
        if len(self.held) >= self.size:
            self.flush()

    def flush(self) -> bool:
        if not self.held:
            return True
        try:
            self.spark.createDataFrame(self.held, self.schema).coalesce(1).write.mode("append").json(self.path)
        except Exception:  # noqa: BLE001  whatever the sink's reason, the events are kept
            return False
        self.held = []
        return True
