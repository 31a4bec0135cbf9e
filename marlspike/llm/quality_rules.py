"""Quality rules with risk-controlled thresholds.

Base rules are fixed. Beside them a document has one score, its *rarity*: the
share of good documents that reach its value in a measure of ``MEASURES``, by
steps of ``GRID``, in the measure where that is least. Each stratum (language)
gets one cutoff of ``RARITIES``, up to which its documents go.

Labelled documents are parted by a hash of their ids: shares come from the good ones
of the one half (fit), in all strata together, so that small strata have full
tails; certificates come from the good ones of the other half (held out). A
cutoff is certified where an exact binomial test on the held-out ones shows that
at most ``risk`` of the good documents of the stratum are rejected. Cutoffs
of a stratum are tested from lenient to strict until the first that fails, which
needs no correction (fixed sequence); strata share the error ``delta`` (Bonferroni),
except those with too few held-out labels to certify anything whatever the
outcome, which are not tested. Of the certified cutoffs the most lenient that
rejects as many bad documents as any is used. So one score and one cutoff take
the whole risk, and with probability 1 - ``delta`` it holds in all strata.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from marlspike.llm.common import Scratch, begins

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"
#: Measures in thousandths of the counts, as (numerator, denominator, per, turned): 1000 * numerator / denominator / per, or 1000 less that if turned.
MEASURES = {
    "symbol_share": ("n_symbols", "word_chars", 1, False),
    "dup_line_share": ("n_dup_lines", "n_lines", 1, False),
    "repeat_share": ("n_repeat_words", "n_words", 1, False),
    "long_words": ("word_chars", "n_words", 20, False),
    "short_words": ("word_chars", "n_words", 20, True),
}
#: Steps of a measure; a value is at the number of steps that it reaches.
GRID = [5, *range(10, 100, 10), *range(100, 300, 20), *range(300, 1001, 50)]
#: Cutoffs on trial, lenient first, in millionths: documents of at most this rarity go.
RARITIES = [0, 1000, 2000, 5000, 10_000, 20_000, 50_000]
#: Strata up to which their cutoffs are broadcast: rows of a few numbers, a few MB at most. Beyond, the join shuffles.
BROADCAST_STRATA = 20_000


def base_counts(text: str | None) -> tuple[int, ...]:
    """The counts of ``BASE`` for one text, over all of it."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blanks = sum(map(raw.count, (bytes([c]) for c in _BLANK)))
    symbols = sum(map(raw.count, (bytes([c]) for c in _SYMBOLS)))
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(_BLANK):
            seen.add(line)
    repeat = 0
    if n >= 4:
        h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
        g = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        _, at, counts = np.unique(g, return_inverse=True, return_counts=True)
        again = counts[at] > 1
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : i + n - 2] |= again
        repeat = int(covered.sum())
    return n, len(text) - blanks, symbols, dup, repeat, len(lines)


def measures(counts: np.ndarray) -> np.ndarray:
    """The measures of rows of ``BASE`` counts, 0 where there is nothing to divide by."""
    of = {name: counts[:, i].astype(float) for i, name in enumerate(BASE)}
    out = []
    for above, below, per, turned in MEASURES.values():
        share = 1000 * of[above] / np.maximum(of[below], 1) / per
        out.append(np.where(of[below] > 0, 1000 - share if turned else share, 0.0))
    return np.column_stack(out)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begins("quality_rules")
    for b in batches:
        got = np.array([base_counts(t.as_py()) for t in b.columns[-1]], np.int64).reshape(-1, len(BASE))
        values = measures(got)
        steps = np.searchsorted(np.array(GRID, float), values, side="right").astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * len(MEASURES)), pa.array(steps.ravel()))
        named = dict(zip(MEASURES, map(pa.array, np.ascontiguousarray(values.T)), strict=True))
        columns = [*b.columns[:-1], *(pa.array(got[:, i]) for i in range(len(BASE))), *named.values(), lists]
        yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], *BASE, *named, "steps"])


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ B(n, p), summed down from k; above the mean 1 is returned, which certifies nothing."""
    if n <= 0 or k >= n * p:
        return 1.0
    term = exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p))
    total, i = term, k
    while i > 0 and term > total * 1e-15:
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        i -= 1
    return min(total, 1.0)


def labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """``stratum, steps, part`` of the documents with a label: ``fit`` and ``held`` halves of the good ones, ``bad``. A document with differing labels counts as good."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    half = F.when(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8", "fit").otherwise("held")
    known = known.select("doc_id", F.when(F.col("quality") == 1, half).otherwise("bad").alias("part"))
    return measured.select("doc_id", "stratum", "steps").join(known, "doc_id").select("stratum", "steps", "part")


def shares(known: DataFrame) -> DataFrame:
    """One row ``shares``: for each measure and number of steps, how many millionths of the good documents to fit on reach it; null without such documents."""
    fit = known.filter("part = 'fit'")
    counts = fit.select(F.posexplode("steps").alias("measure", "step")).groupBy("measure", "step").agg(F.count("*").alias("n"))
    # at most len(GRID) + 1 entries for a measure
    reach = lambda m, k: F.aggregate(F.filter("by", lambda e: (e["measure"] == m) & (e["step"] >= k)), F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
    share = lambda m: F.transform(F.sequence(F.lit(0), F.lit(len(GRID))), lambda k: F.floor(F.try_divide(reach(m, k) * 1_000_000, reach(m, F.lit(0)))).cast("bigint"))
    gathered = counts.agg(F.collect_list(F.struct("measure", "step", "n")).alias("by"))
    return gathered.select(F.array(*(share(F.lit(m)) for m in range(len(MEASURES)))).alias("shares"))


def _share_of() -> Column:
    """For each measure, the share of good documents that reach this document's step."""
    return F.zip_with("shares", "steps", lambda share, step: F.get(share, step))


def cutoffs(known: DataFrame, by_share: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``stratum, n_held, cutoff, n_false, p_value``: the cutoff of each stratum that has one, how many of the held-out good documents it rejects, and the probability of so few if it rejected more than ``risk`` of all."""
    rare = known.filter("part <> 'fit'").crossJoin(F.broadcast(by_share)).select("stratum", "part", F.array_min(_share_of()).alias("rarity"))
    at = lambda part: F.array(*(F.count_if((F.col("part") == part) & (F.col("rarity") <= c)) for c in RARITIES))
    tallies = rare.groupBy("stratum").agg(F.count_if(F.col("part") == "held").alias("n_held"), at("held").alias("n_false"), at("bad").alias("n_bad"))
    testable = tallies.filter(F.col("n_held") * log(1 - risk) <= log(delta))
    level = delta / max(1, testable.count())

    @F.pandas_udf("array<double>")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([[binomial_cdf(int(x), int(b), risk) for x in a] for a, b in zip(k, n, strict=True)])

    tested = testable.withColumn("p", tail("n_false", "n_held"))
    failed = F.array_position(F.transform("p", lambda x: x > level), F.lit(True))
    sure = tested.withColumn("passed", F.when(failed == 0, F.lit(len(RARITIES))).otherwise(failed - 1).cast("int")).filter("passed > 0")
    most = F.array_max(F.slice("n_bad", F.lit(1), F.col("passed")))
    i = (F.array_position("n_bad", most) - 1).cast("int")
    return sure.select("stratum", "n_held", F.get(F.array(*(F.lit(c).cast("bigint") for c in RARITIES)), i).alias("cutoff"), F.get("n_false", i).alias("n_false"), F.get("p", i).alias("p_value"))


def judge_quality(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``doc_id, stratum, text_hash`` (xxhash64 of the text), the counts of ``BASE``, the measures, ``base_failed``, ``rarity`` (millionths), ``cutoff, n_held, n_false, p_value`` of the stratum, ``failed`` (measures rare enough to reject) and ``kept``.

    One row for each row of ``docs(doc_id, text, lang)``; without a lang column
    all are one stratum; a null lang is a stratum of its own. Words are runs of
    anything but ASCII white space; null and empty texts have none and fail the
    base rules. Where a stratum has too few labelled good documents for any
    certificate its cutoff is null and only the base rules hold, as everywhere if
    labels are empty. A document without a label, or with a null id, is judged
    like others and counts in no tally; repeated rows count each. Ties in
    rarity are rejected together. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(lang, F.lit("")).alias("stratum"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    columns = [*(f"{c} bigint" for c in BASE), *(f"{m} double" for m in MEASURES), "steps array<int>"]
    measured = scratch.save(given.mapInArrow(_counted, "doc_id bigint, stratum string, text_hash bigint, " + ", ".join(columns)))
    known = scratch.save(labelled(measured, labels))
    by_share = scratch.save(shares(known))
    chosen = scratch.save(cutoffs(known, by_share, risk, delta))
    if chosen.count() <= BROADCAST_STRATA:
        chosen = F.broadcast(chosen)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.crossJoin(F.broadcast(by_share)).withColumn("share", _share_of()).drop("shares", "steps")  # one row
    out = out.join(chosen, "stratum", "left").withColumn("base_failed", base)
    names = F.array(*map(F.lit, MEASURES))
    failed = F.filter(F.zip_with(names, "share", lambda m, x: F.when(x <= F.col("cutoff"), m)), lambda x: x.isNotNull())
    out = out.withColumn("rarity", F.array_min("share")).withColumn("failed", F.coalesce(failed, F.array().cast("array<string>")))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("rarity") <= F.col("cutoff"), F.lit(False))
    return out.withColumn("kept", kept).drop("share")
