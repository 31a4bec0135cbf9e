"""Exact nearest neighbours: cosine, inner product, Euclidean.

Queries are a bounded block that is broadcast; each Arrow batch of the vectors
answers with its own best rows before anything is shuffled. All arithmetic is in
doubles, component after component, in numpy as on the JVM, so scores are the same in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.operators.iterate import in_blocks
from marlspike.sources.tables import spread


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


#: Queries that are broadcast at once: some MB of vectors.
QUERIES = 4096
SCORES = {
    "cosine": cosine,
    "ip": dot,
    "l2": lambda a, b: 1 / (1 + l2(a, b)),
}


#: Scores that a task holds at once, and components beyond which rows are left to the JVM.
HELD, LARGE = 2_000_000, 1e100
#: A score this near to where it is rounded up, in units of the ninth place, may be rounded either way.
UNSURE = 1e-5


def _scores(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Rows of ``x`` against rows of ``y``; sums run over the components in order."""
    s = np.zeros((len(y), len(x)))
    for d in range(x.shape[1]):
        if metric == "l2":
            t = x[:, d][None, :] - y[:, d][:, None]
            s += t * t
        else:
            s += x[:, d][None, :] * y[:, d][:, None]
    if metric == "l2":
        return 1 / (1 + np.sqrt(s))
    if metric == "ip":
        return s
    lengths = [np.sqrt(_squares(v)) for v in (y, x)]
    n = lengths[0][:, None] * lengths[1][None, :]
    return np.divide(s, n, out=np.zeros_like(s), where=n != 0)


def _squares(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x))
    for d in range(x.shape[1]):
        s += x[:, d] * x[:, d]
    return s


def _candidates(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of all rows that can be among the ``k`` best by score to nine places and id, and few others."""
    if len(score) <= k:
        return np.arange(len(score))
    at = score * 1e9
    sure = np.floor(at + 0.5 - UNSURE)
    kth = np.partition(sure, len(sure) - k)[len(sure) - k]
    above, level = np.flatnonzero(sure > kth), np.flatnonzero(sure == kth)
    if len(level) > k - len(above):
        level = level[np.argsort(ids[level], kind="stable")[: k - len(above)]]
    most = np.floor(at + 0.5 + UNSURE)
    return np.union1d(np.concatenate([above, level]), np.flatnonzero((most != sure) & (most >= kth)))


def _best(sent, k: int, metric: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, y = sent.value
        step = None
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            step = max(1, HELD // len(x))
            for i in range(0, len(y), step):
                s = _scores(x, y[i : i + step], metric)
                kept = [_candidates(r, ids, k) for r in s]
                at = np.concatenate(kept)
                who = np.repeat(np.arange(len(kept)), [len(c) for c in kept])
                yield pa.RecordBatch.from_arrays([pa.array([names[i + w] for w in who], kind), b.column(0).take(pa.array(at)), pa.array(s[who, at])], ["query_id", "vec_id", "score"])

    return run


def _joined(vectors: DataFrame, queries: DataFrame, metric: str) -> DataFrame:
    return vectors.join(F.broadcast(queries)).select("query_id", "vec_id", SCORES[metric](F.col("embedding"), F.col("query")).alias("score"))


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """``query_id, vec_id, score, rank`` of the k best rows for each of ``queries(query_id, query)``; rank from 0, ties by vec_id.

    ``queries`` are counted and broadcast in blocks of ``QUERIES`` rows. Every row is compared with
    every query, a batch at a time, and the rows that can be among the best go on; the last word is by rounded scores on
    the JVM. Rows and queries that are null, of another size than the first query, or hold null or very large components are scored on the JVM.
    """
    fields = {**dict(vectors.dtypes), **dict(queries.dtypes)}
    schema = f"query_id {fields['query_id']}, vec_id {fields['vec_id']}, score double"
    first = queries.filter(F.size("query") > 0).select(F.size("query")).head()
    width = first[0] if first else 0
    sound = lambda c: F.coalesce((F.size(c) == width) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGE)), F.lit(False)) & F.lit(width > 0)
    plain = vectors.filter(sound("embedding") & F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    other = vectors.filter(~(sound("embedding") & F.col("vec_id").isNotNull()))
    scored = None
    for block in in_blocks(queries, "query_id", QUERIES):
        t = block.filter(sound("query")).select("query_id", F.col("query").cast("array<double>").alias("query")).toArrow()
        part = _joined(other, block, metric).unionByName(_joined(plain, block.filter(~sound("query")), metric))
        if len(t):
            y = t["query"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
            sent = vectors.sparkSession.sparkContext.broadcast((t["query_id"].to_pylist(), y))
            part = part.unionByName(spread(plain).mapInArrow(_best(sent, k, metric, t.schema.field("query_id").type), schema))
        scored = part if scored is None else scored.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < k)
