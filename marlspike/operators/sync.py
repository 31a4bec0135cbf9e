"""Content-addressed sync: manifests, changed files, three-way actions, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """``path, status`` (new, changed) for ``files(path, text)`` whose hash is not that of ``stored(path, hash)``."""
    now = files.select("path", F.sha2("text", 256).alias("now"))
    met = now.join(stored, "path", "left").filter(~F.col("now").eqNullSafe(F.col("hash")))
    return met.select("path", F.when(F.col("hash").isNull(), "new").otherwise("changed").alias("status"))


def is_binary(content: Column) -> Column:
    """Whether a zero byte stands in the first 8 KiB."""
    return F.call_function("contains", F.substring(content, 1, 8192), F.lit(b"\0"))


def manifest(files: DataFrame, block: int) -> DataFrame:
    """``path, file_hash, size, is_binary, blocks`` of ``files(path, content)``: hashes of blocks of so many bytes, one at least."""
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / block)).cast("int")
    part = lambda i: F.substr(F.col("content"), i * block + 1, F.lit(block))
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("index"), F.sha2(part(i), 256).alias("hash"), F.length(part(i)).alias("size")))
    return files.select("path", F.sha2("content", 256).alias("file_hash"), F.length("content").cast("bigint").alias("size"), is_binary(F.col("content")).alias("is_binary"), blocks.alias("blocks"))


def text_blocks(docs: DataFrame, size: int) -> DataFrame:
    """``hash, size`` of blocks of so many characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / size)).cast("int")
    part = F.substr(F.col("text"), F.col("i") * size + 1, F.lit(size))
    return docs.select("text", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select(F.sha2(part, 256).alias("hash"), F.length(part).alias("size"))


def dedup_savings(blocks: DataFrame) -> DataFrame:
    """One row: blocks, distinct ones, and their sizes. Equal blocks meet after they are combined in each task."""
    by = blocks.groupBy("hash").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return by.agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_distinct"), F.sum(F.col("n") * F.col("size")).alias("total_size"), F.sum("size").cast("bigint").alias("stored_size"))


def actions(local: DataFrame, remote: DataFrame, last: DataFrame, mode: str = "both", strategy: str = "newest-wins") -> DataFrame:
    """``path, action`` for files on either side.

    ``local`` and ``remote`` have path, hash, modified; ``last`` has path and the
    hash at the last sync. One side only: up- or download unless the mode
    forbids it. Equal hashes are synced. A side that alone changed wins; where
    both did, the strategy decides: local-wins, remote-wins, newest-wins (the
    local one if equally new) or manual, which makes a conflict.
    """
    side = lambda d, s: d.select("path", F.col("hash").alias(f"{s}_hash"), F.col("modified").alias(f"{s}_modified"))
    both = side(local, "l").join(side(remote, "r"), "path", "full_outer").join(last.select("path", F.col("hash").alias("last_hash")), "path", "left")
    up, down = F.lit("skip" if mode == "pull" else "upload"), F.lit("skip" if mode == "push" else "download")
    if strategy == "local-wins":
        clash = up
    elif strategy == "remote-wins":
        clash = down
    elif strategy == "newest-wins":
        clash = F.when(F.col("l_modified") >= F.col("r_modified"), up).otherwise(down)
    else:
        clash = F.lit("conflict")
    local_changed = ~F.col("l_hash").eqNullSafe(F.col("last_hash"))
    remote_changed = ~F.col("r_hash").eqNullSafe(F.col("last_hash"))
    action = (
        F.when(F.col("r_hash").isNull(), up)
        .when(F.col("l_hash").isNull(), down)
        .when(F.col("l_hash") == F.col("r_hash"), "synced")
        .when(local_changed & ~remote_changed, up)
        .when(~local_changed & remote_changed, down)
        .otherwise(clash)
    )
    return both.select("path", action.alias("action"))


def line_diff(old: Column, new: Column, preview: int = 1200) -> Column:
    """Lines compared by place: ``-`` and ``+`` where they differ, a space where not; cut to a preview."""
    a, b = F.split(old, "\n", -1), F.split(new, "\n", -1)

    def line(x: Column, y: Column) -> Column:
        parts = F.array(F.when(x.eqNullSafe(y), F.concat(F.lit(" "), x)), F.when(~x.eqNullSafe(y), F.concat(F.lit("-"), x)), F.when(~x.eqNullSafe(y), F.concat(F.lit("+"), y)))
        return F.filter(parts, lambda p: p.isNotNull())

    return F.substring(F.array_join(F.flatten(F.zip_with(a, b, line)), "\n"), 1, preview)


def shortened(content: Column, limit: int = 1200) -> Column:
    return F.when(F.length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit("..."))).otherwise(content)


def without_stale(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Rows of ``stored(path, hash, ...)`` that a file still has among its ``now(path, hash)``; of files that ``now`` does not name all rows stay."""
    named = now.select("path").distinct()
    kept = stored.join(now.select("path", "hash").distinct(), ["path", "hash"], "left_semi")
    return kept.unionByName(stored.join(named, "path", "left_anti"))
