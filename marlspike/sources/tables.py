"""Tables of a data folder, by whatever path Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(files: DataFrame) -> DataFrame:
    """A table as read from files, over all cores if it is small: its files may be a single block that one task would read.

    Small is less than half a split for each core, which bounds the shuffle;
    larger tables stay as they are.
    """
    spark = files.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return files.repartition(cores) if 2 * size < cores * split else files
