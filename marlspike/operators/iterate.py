"""Iteration over DataFrames with lineage cut by checkpoints in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, as in tests on one machine, a temporary folder becomes the checkpoint folder. Elsewhere that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    kept = sc._jsc.sc().getCheckpointDir()
    if not found and kept.isDefined():
        found = kept.get()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="marlspike-core-")
    if not kept.isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def temporary(spark: SparkSession, label: str) -> str:
    """A folder of its own below the shared one, for tables that are read while the session lasts; it is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, if the session is still there to do it."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended first
        return


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, node, depth`` of all nodes reachable along ``edges(source, target)`` from ``starts(start)``, least depth first.

    Breadth first: each round joins the frontier with the edges and leaves out
    what is known, so cycles end it.
    """
    edges = edges.select(F.col("source").alias("node"), "target").distinct()
    seen = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    frontier = seen
    while not frontier.isEmpty():
        following = frontier.join(edges, "node").select("start", F.col("target").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = cut(following.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


#: Starts whose ways are followed together, a bit of a long each.
BITS = 63


def reach_counts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, n``: how many other nodes each of ``starts(start)`` reaches along ``edges(source, target)``.

    Starts go in groups of ``BITS``, and a node has one number for each group, whose
    bits say which of it reach the node; a step ors the numbers of a node's
    predecessors. So there is a row for each node and group, not for each pair of nodes
    that reach each other.
    """
    steps = cut(edges.select(F.col("source").alias("node"), "target").distinct())
    numbered = starts.select("start").distinct().withColumn("i", F.monotonically_increasing_id())
    named = cut(numbered.select("start", F.floor(F.col("i") / BITS).alias("group"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("i") % BITS).cast("int")).alias("bit")))
    seen = cut(named.select("group", F.col("start").alias("node"), F.col("bit").alias("bits")))
    fresh = seen
    while not fresh.isEmpty():
        sent = fresh.join(steps, "node").groupBy("group", F.col("target").alias("node")).agg(F.bit_or("bits").alias("more"))
        met = sent.join(seen, ["group", "node"], "full_outer").select("group", "node", F.coalesce("bits", F.lit(0).cast("bigint")).alias("had"), F.coalesce("more", F.lit(0).cast("bigint")).alias("more"))
        met = cut(met.select("group", "node", F.col("had").bitwiseOR(F.col("more")).alias("bits"), F.col("more").bitwiseAND(F.bitwise_not("had")).alias("new")))
        seen, fresh = met.select("group", "node", "bits"), met.filter("new <> 0").select("group", "node", F.col("new").alias("bits"))
    held = [F.sum(F.shiftright("bits", i).bitwiseAND(F.lit(1).cast("bigint"))).alias(f"n{i}") for i in range(BITS)]
    by = seen.groupBy("group").agg(*held)
    counts = by.select("group", F.posexplode(F.array(*(f"n{i}" for i in range(BITS)))).alias("i", "n")).select("group", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("i")).alias("bit"), "n")
    return named.join(counts, ["group", "bit"]).select("start", (F.col("n") - 1).alias("n"))  # each reaches itself


def folded(df: DataFrame, keys: list[str], order: list[str], step, out: str) -> DataFrame:
    """``df`` through a state machine: each key's rows in order, one after another.

    ``step(state, row)`` gets a dict that starts empty for each key and gives a
    tuple of the columns ``out``. Partitions are sorted and read as they come, so
    a key of any number of rows takes the memory of a batch and of its state.
    """
    names = df.columns
    sorted_ = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    where = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = {}, None
        for b in batches:
            got = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = [row[i] for i in where]
                if key != last:
                    state, last = {}, key
                got.append(step(state, row))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True) if got else [[]] * len(schema), schema.types, strict=True)], schema.names)

    schema = to_arrow_schema(T._parse_datatype_string(out))
    return sorted_.mapInArrow(run, out)


def in_blocks(small: DataFrame, key: str, rows: int) -> list[DataFrame]:
    """``small`` in blocks of some ``rows`` rows, dealt by a hash of ``key``, for broadcasts of a bounded size."""
    n = small.count() // rows + 1
    if n == 1:
        return [small]
    return [small.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]
