"""Evaluation: detection rates, retrieval quality, run statistics."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.functions.stats import pass_at_k, pass_hat_k, ratio, t_critical, wilson


def outcome(expected: Column, detected: Column) -> Column:
    return F.when(expected & detected, "TP").when(expected, "FN").when(detected, "FP").otherwise("TN")


def rates(results: DataFrame, *by: str, default_detection: float = 1.0) -> DataFrame:
    """Counts and rates of ``results(outcome, score)``, by columns if any are named.

    Without positives the detection rate is ``default_detection`` and precision
    1; without negatives the false positive rate is 0.
    """
    n = {k: F.count_if(F.col("outcome") == k).alias(k.lower()) for k in ("TP", "FP", "TN", "FN")}
    d = results.groupBy(*by).agg(*n.values(), F.count("*").alias("n"), F.avg("score").alias("avg_score"))
    d = d.withColumns({
        "detection_rate": ratio(F.col("tp"), F.col("tp") + F.col("fn"), default_detection),
        "false_positive_rate": ratio(F.col("fp"), F.col("fp") + F.col("tn"), 0.0),
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0),
    })
    p, r = F.col("precision"), F.col("detection_rate")
    return d.withColumn("f1", ratio(2 * p * r, p + r, 0.0))


def intervals(d: DataFrame) -> DataFrame:
    """Wilson bounds of detection and false positive rate beside them."""
    _, dl, dh = wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    _, fl, fh = wilson(F.col("fp"), F.col("fp") + F.col("tn"))
    return d.withColumns({"dr_lower": dl, "dr_upper": dh, "fpr_lower": fl, "fpr_upper": fh})


def pass_rates(trials: DataFrame, key: str, k: int) -> DataFrame:
    """``key, n, c, pass_at_k, pass_hat_k`` of ``trials(key, passed)``."""
    d = trials.groupBy(key).agg(F.count("*").alias("n"), F.count_if("passed").alias("c"))
    return d.withColumns({"pass_at_k": pass_at_k(F.col("n"), F.col("c"), k), "pass_hat_k": pass_hat_k(F.col("n"), F.col("c"), k)})


#: Ranges that are counted at once on the way to a median.
RANGES = 1 << 14


def lower_median(values: DataFrame, column: str) -> int | None:
    """The value of rank n / 2, rounded up, among whole numbers without nulls, as ``percentile_disc(0.5)``; None of none.

    Values are counted in ranges, then those of the range that holds the rank in narrower
    ones. So a task and the driver hold ``RANGES`` counts at most, where the
    aggregate holds all distinct values in one task.
    """
    x = F.col(column)
    low, high, n = values.agg(F.min(x), F.max(x), F.count(x)).first()
    rank = (n + 1) // 2
    while n and low < high:
        width = (high - low) // RANGES + 1
        counts = values.filter(x.between(low, high)).groupBy(F.expr(f"(`{column}` - {low}L) div {width}L").alias("i")).count()
        for i, m in sorted(map(tuple, counts.collect())):
            if rank <= m:
                break
            rank -= m
        low, high = low + i * width, min(high, low + (i + 1) * width - 1)
    return low


def percentiles(values: DataFrame, key: str, value: str) -> DataFrame:
    """Nearest-rank p50, p95 and p99."""
    pick = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return values.groupBy(key).agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"))


def run_stats(values: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, sample deviation, median, extremes and a t interval within [0, 1]."""
    d = values.groupBy(key).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.expr(f"percentile({value}, 0.5)").alias("median"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    t = F.when(F.col("n") >= 30, F.lit(1.96)).otherwise(t_critical(F.col("n") - 1))
    margin = t * F.col("std") / F.sqrt("n")
    return d.withColumns({"ci_lower": F.greatest(F.lit(0.0), F.col("mean") - margin), "ci_upper": F.least(F.lit(1.0), F.col("mean") + margin)})


def bootstrap(samples: DataFrame, key: str, value: str, iterations: int = 2000, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """Percentile interval of a mean by Poisson resampling.

    Each row draws its weight in each of the resamples from a hash of the seed,
    the row and the resample, so rows need not meet: a task adds up its own rows'
    weights and values, and one row for each key, task and resample is shuffled.
    Results are the same in every run.
    """
    # quantiles of Poisson(1); beyond 7 there are 10 in a million
    edges = np.cumsum([exp(-1) / factorial(k) for k in range(8)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            keys, h, x = b.columns[0].to_pylist(), b.columns[1].to_numpy().view(np.uint64), b.columns[2].to_numpy()
            at: dict = {}
            for i, k in enumerate(keys):
                at.setdefault(k, []).append(i)
            for k, rows in at.items():
                total = held.setdefault(k, np.zeros((2, iterations)))
                for part in np.array_split(np.array(rows), -(-len(rows) // 256)):
                    w = np.searchsorted(edges, _uniform(h[part, None], np.arange(iterations, dtype=np.uint64)), side="right")
                    total += np.stack([w.sum(0), x[part] @ w])
        for k, (w, wx) in held.items():  # a row for each key and resample: keys are strata of an evaluation
            yield pa.RecordBatch.from_arrays([pa.array([k] * iterations, pa.string()), pa.array(np.arange(iterations)), pa.array(w), pa.array(wx)], ["key", "i", "w", "wx"])

    given = samples.filter(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("key"), F.xxhash64(F.lit(seed), F.col(key), F.col("id")).alias("h"), F.col(value).cast("double").alias("x"))
    means = given.mapInArrow(sums, "key string, i bigint, w double, wx double").groupBy("key", "i").agg((F.sum("wx") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    bounds = means.groupBy("key").agg(F.expr(f"percentile_disc({alpha / 2}) within group (order by m)").alias("lower"), F.expr(f"percentile_disc({1 - alpha / 2}) within group (order by m)").alias("upper"))
    points = samples.groupBy(F.col(key).cast("string").alias("key")).agg(F.avg(value).alias("point"))
    return points.join(bounds, "key").select(F.col("key").cast(dict(samples.dtypes)[key]).alias(key), "point", "lower", "upper")


def bootstrap_metric(samples: DataFrame, key: str, sums: dict[str, Column], metric, iterations: int = 1000, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """``key, point, lower, upper`` of a metric of sums, such as F1 or precision at k, with bias-corrected bounds.

    ``sums`` names what is added up of each row of ``samples(id, key, ...)``, and ``metric``
    makes a column of the summed columns, the same for the sample and its
    resamples (null, where it is undefined, counts as 0). Rows draw Poisson weights from
    hashes, as in :func:`bootstrap`, and never meet: tasks add up weighted sums, and a row
    for each key, task and resample is shuffled. Bounds are percentiles
    shifted by the bias, that is, by the share of resamples below the point.
    """
    names = list(sums)
    edges = np.cumsum([exp(-1) / factorial(k) for k in range(8)])

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            keys = np.array(b.columns[0].to_pylist(), object)
            h = b.columns[1].to_numpy().view(np.uint64)
            x = np.stack([c.to_numpy() for c in b.columns[2:]])
            for k in set(keys.tolist()):
                rows = np.flatnonzero(keys == k)
                total = held.setdefault(k, np.zeros((len(names), iterations)))
                for part in np.array_split(rows, -(-len(rows) // 256)):
                    total += x[:, part] @ np.searchsorted(edges, _uniform(h[part, None], np.arange(iterations, dtype=np.uint64)), side="right")
        for k, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * iterations, pa.string()), pa.array(np.arange(iterations)), *(pa.array(t) for t in total)], ["key", "i", *names])

    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    given = samples.select(F.col(key).cast("string").alias("key"), F.xxhash64(F.lit(seed), F.col(key), F.col("id")).alias("h"), *(zero(c).alias(n) for n, c in sums.items()))
    resampled = given.mapInArrow(weighted, "key string, i bigint, " + ", ".join(f"{n} double" for n in names)).groupBy("key", "i").agg(*(F.sum(n).alias(n) for n in names))
    value = zero(metric(**{n: F.col(n) for n in names}))
    points = given.groupBy("key").agg(*(F.sum(n).alias(n) for n in names)).select("key", value.alias("point"))
    each = resampled.select("key", value.alias("m")).join(points, "key")
    by = each.groupBy("key", "point").agg(F.array_sort(F.collect_list("m")).alias("ms"), (F.count_if(F.col("m") < F.col("point")) + F.count_if(F.col("m") == F.col("point")) / 2).alias("below"))  # a row for each resample

    @F.pandas_udf("lower double, upper double")
    def bounds(ms: pd.Series, below: pd.Series) -> pd.DataFrame:
        out = []
        for m, b in zip(ms, below, strict=True):
            share = min(max(b / len(m), 0.5 / len(m)), 1 - 0.5 / len(m))
            bias, z = NormalDist().inv_cdf(share), NormalDist().inv_cdf(1 - alpha / 2)
            at = [NormalDist().cdf(2 * bias + s * z) for s in (-1, 1)]
            out.append([m[min(len(m) - 1, int(p * len(m)))] for p in at])
        return pd.DataFrame(out, columns=["lower", "upper"])

    return by.select("key", "point", bounds("ms", "below").alias("b")).select(F.col("key").cast(dict(samples.dtypes)[key]).alias(key), "point", "b.lower", "b.upper")


def _uniform(h: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 for each row's hash and each resample."""
    x = h + (i + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def retrieval_quality(results: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, precision, recall, mrr, hit`` of ``results(query_id, item, rank)`` against ``relevant(query_id, item)``.

    An item counts at its best rank; precision divides by the items returned, not by k.
    """
    marked = results.join(relevant.withColumn("rel", F.lit(1)), ["query_id", "item"], "left")
    return marked_quality(marked, relevant.groupBy("query_id").agg(F.count("*").alias("wanted")), k)


def marked_quality(results: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """:func:`retrieval_quality` where ``results`` has ``rel`` (1, or null if not relevant) and ``wanted(query_id, wanted)`` says how many items are relevant."""
    first = results.groupBy("query_id", "item").agg(F.min("rank").alias("rank"), F.max("rel").alias("rel"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item"))
    top = first.withColumn("place", place).filter(F.col("place") <= k)
    by = top.groupBy("query_id").agg(F.count("*").alias("returned"), F.count("rel").alias("found"), F.min(F.when(F.col("rel") == 1, F.col("place"))).alias("first"))
    d = wanted.join(by, "query_id", "left")
    found = F.coalesce("found", F.lit(0))
    return d.select(
        "query_id",
        ratio(found, F.coalesce("returned", F.lit(0)), 0.0).alias("precision"),
        ratio(found, F.col("wanted"), 0.0).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (found > 0).alias("hit"),
    )
