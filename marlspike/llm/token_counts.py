"""Token counts: an exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.llm.common import Scratch, bounded_batches
from marlspike.llm.tokens import ByteCounter, public_path, worker

#: Lengths summed together before suffix sums run over the sums.
RANGE = 1024


def _counted(name: str, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker(ByteCounter, path or public_path(name))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.columns[0], pa.array([count(t.as_py()) for t in b.columns[1]], pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` for every row of ``docs(doc_id, text)``; null and empty texts have 0, null ids keep their rows, other columns are ignored, whatever their names."""
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_counted(vocabulary, path), "doc_id bigint, n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs in ``lengths(n_tokens)``, or in ``lengths(n_tokens, n_docs)`` that is summed already.

    ``n_tokens``, ``n_docs``, ``n_longer`` (documents of more tokens),
    ``tokens_at_least`` (tokens of documents of this length or more),
    ``truncated_total`` (tokens of all documents cut to this length), ``total``
    (tokens of all documents) and ``quantile`` (share of documents of this
    length or less: the q-quantile is the first length with quantile >= q).
    For a limit that is no row, take the next row below:
    truncated_total + n_longer * (limit - n_tokens).

    Repeated rows each count. An empty table gives an empty result. Documents
    are summed by length before anything is ordered, and suffix sums run
    within ranges of lengths and over ranges, so no task gets more than
    a range or the ranges.
    """
    n = F.sum("n_docs") if "n_docs" in lengths.columns else F.count("*")
    by = lengths.groupBy("n_tokens").agg(n.alias("n_docs")).withColumn("r", F.floor(F.col("n_tokens") / RANGE))
    sums = by.groupBy("r").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    sums = sums.select(
        "r",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(every).alias("docs"),
        F.sum("t").over(every).alias("total"),
    )
    within = Window.partitionBy("r").orderBy(F.col("n_tokens").desc())
    tokens = F.col("n_docs") * F.col("n_tokens")
    out = by.join(sums, "r").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(within) - F.col("n_docs") + F.col("d_after")).alias("n_longer"),
        (F.sum(tokens).over(within) + F.col("t_after")).alias("tokens_at_least"),
        "total",
        "docs",
    )
    held = F.col("total") - F.col("tokens_at_least") + F.col("n_tokens") * (F.col("n_longer") + F.col("n_docs"))
    return out.select("n_tokens", "n_docs", "n_longer", "tokens_at_least", held.alias("truncated_total"), "total", ((F.col("docs") - F.col("n_longer")) / F.col("docs")).alias("quantile"))


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> DataFrame:
    """:func:`length_histogram` of the token counts of ``docs(doc_id, text)``."""
    lengths = token_lengths(docs, vocabulary, path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    return length_histogram(Scratch(docs.sparkSession, "lengths").save(lengths))
