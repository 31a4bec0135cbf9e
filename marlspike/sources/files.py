"""Files as tables: scans with globs, increments, persistence, keyed upserts, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.functions.globs import glob_regex
from marlspike.operators.iterate import cut

# What is indexed and what is not, unless asked otherwise.
INCLUDE = ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.py", "**/*.java", "**/*.go", "**/*.rs", "**/*.md", "**/*.json"]
EXCLUDE = """**/node_modules/** **/dist/** **/build/** **/out/** **/.git/** **/.next/** **/.vercel/** **/.turbo/** **/.output/** **/.cache/**
**/coverage/** **/*.min.js **/package-lock.json **/pnpm-lock.yaml **/yarn.lock""".split()


def fits(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | F.rlike(path, F.lit(glob_regex(g, "path")))
    return out


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """``path, content, size, modified`` of files under a folder; excluding globs come first. Paths are relative."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.substring_index("path", base + "/", -1), "^/+", "")
    d = d.select(path.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return d.filter(~fits(F.col("path"), EXCLUDE if exclude is None else exclude) & fits(F.col("path"), include or INCLUDE))


def replaced(chunks: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Chunks after a change: those of files in ``fresh`` or ``gone`` go, the fresh ones come in."""
    paths = fresh.select("file_path").distinct()
    if gone is not None:
        paths = paths.union(gone.select("file_path")).distinct()
    return chunks.join(paths, "file_path", "left_anti").unionByName(fresh)


def save(df: DataFrame, path: str, *by: str) -> None:
    """A table as compressed Parquet, in folders by column where asked."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def _there(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, where, fs.exists(where)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved table, or the JSON lines that an earlier version left at ``<path>.json``; an empty one where neither is."""
    if _there(spark, path)[2]:
        return spark.read.schema(schema).parquet(path)
    if _there(spark, f"{path}.json")[2]:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{path}.json")
    return spark.createDataFrame([], schema)


def save_over(df: DataFrame, path: str, *by: str) -> None:
    """:func:`save`, then without the JSON of an earlier version."""
    save(df, path, *by)
    fs, where, there = _there(df.sparkSession, f"{path}.json")
    if there:
        fs.delete(where, True)


def write_files(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Chunks in folders by a hash of their file, which :func:`rewrite_files` can replace one by one."""
    save(chunks.withColumn("bucket", _bucket(buckets)).repartition("bucket"), path, "bucket")


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("file_path"), F.lit(n)).cast("int")


def rewrite_files(spark: SparkSession, path: str, fresh: DataFrame, gone: DataFrame | None = None, buckets: int = 64) -> None:
    """Replace the chunks of files in ``fresh`` or ``gone``; only the folders that hold such files are read and written.

    A folder that is left without chunks keeps none.
    """
    old = spark.read.parquet(path)
    touched = fresh.select("file_path").union(gone.select("file_path")) if gone is not None else fresh.select("file_path")
    which = [r[0] for r in touched.select(_bucket(buckets).alias("b")).distinct().collect()]  # `buckets` numbers at most
    now = cut(replaced(old.filter(F.col("bucket").isin(which)).drop("bucket"), fresh, gone).withColumn("bucket", _bucket(buckets)))
    left = {r[0] for r in now.select("bucket").distinct().collect()}
    now.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path)
    for b in set(which) - left:
        fs, where, _ = _there(spark, f"{path}/bucket={b}")
        fs.delete(where, True)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by order: an upsert of batches that were only appended."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def cache_key(model: str, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{model}:"), text), 256), 1, 32)


def cached_embeddings(chunks: DataFrame, cache: DataFrame, model: str, now: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Chunks whose embedding is cached and not too old, and those to embed. Vectors meet chunks by the key alone."""
    live = cache.filter(F.col("created_at") > now - F.expr(f"interval {days} days")).select("cache_key", "embedding")
    d = chunks.withColumn("cache_key", cache_key(model, F.col("content")))
    return d.join(live, "cache_key"), d.join(live.select("cache_key"), "cache_key", "left_anti")


def evicted(cache: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` entries: a cutoff is found by a top-k of times, so rows need not be ordered as a whole."""
    kept = cache.select("created_at", "cache_key").orderBy(F.desc("created_at"), "cache_key").limit(most)
    return cache.join(kept, ["created_at", "cache_key"], "left_semi")


def changed_paths(diff: DataFrame) -> DataFrame:
    """``status, path`` of lines of ``diff(value)`` as version control lists them; a rename is a deletion and an addition."""
    p = F.split("value", "\t")
    d = diff.select(F.substring(F.get(p, F.lit(0)), 1, 1).alias("status"), p.alias("p")).filter(F.size("p") >= 2)
    rename = F.array(F.struct(F.lit("D").alias("status"), F.get("p", F.lit(1)).alias("path")), F.struct(F.lit("A").alias("status"), F.get("p", F.lit(2)).alias("path")))
    plain = F.array(F.struct("status", F.get("p", F.lit(1)).alias("path")))
    return d.select(F.explode(F.when(F.col("status") == "R", rename).otherwise(plain)).alias("x")).select("x.*")
