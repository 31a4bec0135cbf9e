"""Shared pieces of the training-data operators: tables, scratch space, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the regular expressions of every word-based operator take it.
SPACE = r"[\x20\x09-\x0D]"
#: One word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, as in tests on one machine, a temporary folder is made
    and set as the checkpoint folder of the session's context. Elsewhere that is
    an error, since executors would not see the folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = sc._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="marlspike-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows in a batch that goes to Python, and bytes, one row at least. The session's own setting holds if it is lower.
BATCH_ROWS, BATCH_BYTES = 2500, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let fewer rows go to Python at once than Spark would, as rows hold whole texts."""
    for name, most, unset in (("maxRecordsPerBatch", BATCH_ROWS, "10000"), ("maxBytesPerBatch", BATCH_BYTES, "67108864b")):
        name = f"spark.sql.execution.arrow.{name}"
        given = spark.conf.get(name, unset).lower().removesuffix("b")
        if not (given.isdigit() and 0 < int(given) <= most):
            spark.conf.set(name, str(most))


#: How the operators that have run in this worker let go of what they keep there from task to task.
_HELD: dict[str, Callable[[], None]] = {}


def begins(operator: str, forget: Callable[[], None] | None = None) -> None:
    """A task of ``operator`` begins in this worker: what other operators keep here goes. ``forget`` lets go of what this one keeps.

    Workers outlive stages. A vocabulary, and the words that a stage has met, would
    stand beside those of the next one, and beside the heap where a stage needs no Python.
    """
    others = [k for k in _HELD if k != operator]
    for k in others:
        _HELD.pop(k)()
    if others:
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
            trim(0)
    pa.default_memory_pool().release_unused()
    if forget:
        _HELD[operator] = forget


class Scratch:
    """Tables written to the shared folder, to cut lineage and to be read more than once.

    Files are compressed Parquet, so an executor that is lost loses nothing.
    ``drop`` deletes a table once no later step reads it; what is left is
    deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}  # the tables are held, so that no other gets their ids
        self.counts: dict[int, tuple[DataFrame, int]] = {}
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone when the driver ends
            return

    def save(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``df`` as a written table, in folders by a column if one is named."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def path(self, saved: DataFrame) -> str:
        """Where a saved table lies."""
        return self.paths[id(saved)][1]

    def count(self, saved: DataFrame) -> int:
        """Rows of a table, counted once."""
        if id(saved) not in self.counts:
            self.counts[id(saved)] = (saved, saved.count())
        return self.counts[id(saved)][1]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.counts.pop(id(t), None)
            if found := self.paths.pop(id(t), None):
                self._remove(found[1])

    def rename(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """``new`` stands for the saved table that it only selects from."""
        if found := self.paths.pop(id(old), None):
            self.paths[id(new)] = (new, found[1])
        return new


#: Edges in a partition while components are sought; small graphs go through few tasks and files.
EDGES = 250_000


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of ``edges(a, b)``: comp is the least node of its component.

    Alternating large-star and small-star steps: a logarithmic number of rounds
    whatever the shape (chains included), each of a few shuffles of the edges.
    A hub's edges meet only in joins, which AQE splits, and in ``min``, which
    is combined before its shuffle.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, state = scratch.save(ordered), None
    parts = scratch.count(now) // EDGES + 4
    while True:
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).coalesce(parts)
        large = both.join(least, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.least("m", "hi").alias("lo")).distinct().coalesce(parts)
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).coalesce(parts)
        small = large.join(least, "hi").select(
            F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")
        )
        small = small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct().coalesce(parts)
        following = scratch.save(small)
        scratch.drop(now)
        now = following
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct()
    )
