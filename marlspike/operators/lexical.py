"""Inverted index, BM25 ranking, prefix and fuzzy terms.

The index is two kinds of postings over the same terms: ``raw`` (lower-cased) and
``stem``. Documents' lengths count stems. It is written once: postings in a folder
for each kind, sorted by term, so that the few terms of a query, which are pushed
down to the files, read little beside their own rows; a row for each term with its
document frequency; a row of totals. A search reads these and never a text.
Where documents are asked once, an index that is not written (:func:`unwritten`)
gives the same rows: a filter for the query's terms comes before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.functions.text import stem, terms
from marlspike.operators.iterate import temporary

K1, B = 1.5, 0.75
#: Factor for matches of the raw kind, and for terms that the symbols hold.
RAW_BOOST, SYMBOL_BOOST = 1.5, 2.0


class Index(NamedTuple):
    """``postings(kind, term, doc_id, tf, dl)``, ``vocabulary(kind, term, df, cf)`` and ``totals(n_docs, avgdl)``, of one row."""

    postings: DataFrame
    vocabulary: DataFrame
    totals: DataFrame


#: Documents whose terms a worker sorts together.
SORTED = 256


def _placed(shared: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, SORTED) for i in range(0, whole.num_rows, SORTED)):
                ids, *words = b.columns
                sizes = words[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
                coded = pa.concat_arrays([w.flatten() for w in words]).dictionary_encode()
                n = max(1, len(coded.dictionary))
                raw, stems = np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), 2)
                found = []
                for codes in (raw, stems):
                    key = row * n + codes
                    order = np.argsort(key, kind="stable")
                    first = np.flatnonzero(np.diff(key[order], prepend=-1))
                    found.append((key[order][first], np.diff(np.append(first, len(key))), order, first))
                # a term that is its own stem and the only one of it in a document has the same places as both
                _, i, j = np.intersect1d(found[0][0], found[1][0], assume_unique=True, return_indices=True)
                at = found[0][2][found[0][3][i]]
                same = (found[0][1][i] == found[1][1][j]) & (raw[at] == stems[at]) if shared else np.zeros(len(i), bool)
                for kind, (key, tf, order, first), alike in zip(("raw", "stem"), found, (i[same], j[same]), strict=True):
                    kinds = np.full(len(key), kind, object)
                    kinds[alike] = "both"
                    ends = pa.array(np.append(first, len(order)).astype(np.int32))
                    columns = [pa.array(kinds, pa.string()), coded.dictionary.take(pa.array(key % n)), ids.take(pa.array(key // n)), pa.array(tf), pa.array(sizes[key // n]), pa.ListArray.from_arrays(ends, pa.array(place[order]))]
                    out = pa.RecordBatch.from_arrays(columns, ["kind", "term", "doc_id", "tf", "dl", "places"])
                    if kind == "stem" and len(alike):
                        out = out.filter(pa.array(kinds != "both"))
                    yield out

    return run


def placed_postings(docs: DataFrame, shared: bool = False) -> DataFrame:
    """``kind, term, doc_id, tf, dl, places`` of ``docs(doc_id, text)``, whose ids stand once: raw terms and stems with their places among the document's terms, from 0.

    If ``shared``, rows that are the same for a term and its stem stand once, as kind ``both``.
    A document's terms are grouped where its row is; nothing is shuffled.
    """
    words = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), terms(F.col("text")).alias("t"))
    words = words.select("doc_id", "t", F.transform("t", stem).alias("s"))
    return words.mapInArrow(_placed(shared), "kind string, term string, doc_id bigint, tf bigint, dl bigint, places array<int>")


def by_term(found: DataFrame) -> DataFrame:
    """Postings in files by term, each sorted; very frequent terms are dealt over several. Rows are made once, as no sample is drawn."""
    return found.hint("rebalance", "kind", "term").sortWithinPartitions("kind", "term", "doc_id")


def doc_stats(docs: DataFrame) -> DataFrame:
    """``doc_id, dl``: terms of each document, without a shuffle."""
    return docs.select("doc_id", F.size(terms(F.col("text"))).cast("bigint").alias("dl"))


def write_index(docs: DataFrame, folder: str) -> Index:
    """The index of ``docs(doc_id, text)`` under a folder; an index that is there is replaced.

    Ids stand once. A term that is in very many documents is dealt over several files.
    """
    found = by_term(placed_postings(docs).drop("places"))
    found.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/postings")
    spark = docs.sparkSession
    written = spark.read.parquet(f"{folder}/postings")
    counts = written.groupBy("kind", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    counts.repartitionByRange("kind", "term").sortWithinPartitions("kind", "term").write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/vocabulary")
    doc_stats(docs).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")
    return read_index(spark, folder)


def read_index(spark, folder: str) -> Index:
    """An index as it was written; documents that changed since are not in it."""
    schemas = ["term string, doc_id bigint, tf bigint, dl bigint, kind string", "term string, df bigint, cf bigint, kind string", "n_docs bigint, avgdl double"]
    return Index(*(spark.read.schema(x).parquet(f"{folder}/{t}") for t, x in zip(Index._fields, schemas, strict=True)))


def unwritten(docs: DataFrame, wanted: DataFrame) -> Index:
    """The index of ``docs(doc_id, text)`` for the few terms of ``wanted(kind, term)``; only their counts are written, once.

    Texts are read once for the postings and once for the lengths.
    """
    spark, by = docs.sparkSession, _by_kind(wanted)
    words = docs.select("doc_id", terms(F.col("text")).alias("t"))
    # outer, as Spark filters by the size of the exploded list otherwise, and cuts each text twice
    words = words.select("doc_id", F.size("t").cast("bigint").alias("dl"), F.explode_outer("t").alias("term"))
    is_raw, is_stem = F.col("term").isin(by.get("raw", [])), stem(F.col("term")).isin(by.get("stem", []))
    folder = temporary(spark, "asked")
    words.filter(is_raw | is_stem).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")).write.parquet(folder)
    hit = spark.read.schema("doc_id bigint, dl bigint, term string, tf bigint").parquet(folder)
    stems = hit.filter(is_stem).groupBy("doc_id", "dl", stem(F.col("term")).alias("term")).agg(F.sum("tf").alias("tf"))
    found = hit.filter(is_raw).withColumn("kind", F.lit("raw")).unionByName(stems.withColumn("kind", F.lit("stem")))
    counts = found.groupBy("kind", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return Index(found.select("kind", "term", "doc_id", "tf", "dl"), counts, doc_stats(docs).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))


def index_stats(index: Index) -> DataFrame:
    """One row: documents, distinct terms of both kinds, mean length."""
    counts = index.vocabulary.agg(F.count_if(F.col("kind") == "raw").alias("raw_terms"), F.count_if(F.col("kind") == "stem").alias("stem_terms"))
    return index.totals.crossJoin(counts)  # one row each


def corpus_stats(docs: DataFrame) -> DataFrame:
    """The row of :func:`index_stats` from ``docs(doc_id, text)`` themselves: distinct terms are all that is shuffled, and only these are stemmed."""
    words = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
    counts = words.agg(F.count("term").alias("raw_terms"), F.count_distinct(stem(F.col("term"))).alias("stem_terms"))
    return doc_stats(docs).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).crossJoin(counts)  # one row each


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def bm25(idf_: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def query_terms(spark, query: str) -> DataFrame:
    """``kind, term`` of a query, of each kind once; stop words stay, as in the index's own search."""
    row = spark.range(1).select(F.array_distinct(terms(F.lit(query), stop_words=False)).alias("t"))
    raw = row.select(F.lit("raw").alias("kind"), F.explode("t").alias("term"))
    return raw.unionByName(row.select(F.lit("stem").alias("kind"), F.explode(F.array_distinct(F.transform("t", stem))).alias("term")))


def _by_kind(wanted: DataFrame) -> dict[str, list[str]]:
    by: dict[str, list[str]] = {}
    for r in wanted.select("kind", "term").distinct().collect():
        by.setdefault(r["kind"], []).append(r["term"])
    return by


def asked(wanted: DataFrame) -> Column:
    """A filter for the rows of ``wanted(kind, term)``, the few terms of a query, that can be pushed down to files."""
    out = F.lit(False)
    for kind, ts in _by_kind(wanted).items():
        out = out | ((F.col("kind") == kind) & F.col("term").isin(ts))
    return out


def scored(index: Index, wanted: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """``doc_id, score, highlights`` of every document with a term of ``wanted(kind, term)``.

    A score is the sum over the matched terms of both kinds; a term that is asked
    for twice counts twice. ``symbols(doc_id, symbols)`` doubles terms that stand
    anywhere in a document's symbols.
    """
    these = asked(wanted)
    times = wanted.groupBy("kind", "term").agg(F.count("*").alias("times"))
    df = index.vocabulary.filter(these).select("kind", "term", "df")
    hit = index.postings.filter(these).join(F.broadcast(df), ["kind", "term"]).join(F.broadcast(times), ["kind", "term"]).crossJoin(F.broadcast(index.totals))  # a query's terms; one row
    boost = F.when(F.col("kind") == "raw", RAW_BOOST).otherwise(1.0)
    if symbols is not None:
        hit = hit.join(symbols, "doc_id", "left")
        boost = boost * F.when(F.contains(F.lower("symbols"), F.col("term")), SYMBOL_BOOST).otherwise(1.0)
    value = bm25(idf(F.col("n_docs"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl")) * boost * F.col("times")
    return hit.withColumn("value", value).groupBy("doc_id").agg(F.sum("value").alias("score"), F.array_sort(F.collect_set("term")).alias("highlights"))


def search(index: Index, wanted: DataFrame, limit: int, symbols: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` rows of :func:`scored`, ties by doc_id."""
    return scored(index, wanted, symbols).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(limit)


def prefix_matches(vocab: DataFrame, wanted: DataFrame) -> DataFrame:
    """``kind, asked, term``: longer index terms that start with an asked one; a query's few terms are broadcast and met by their first letter."""
    q = wanted.select("kind", F.col("term").alias("asked"), F.substring("term", 1, 1).alias("lead"))
    v = vocab.withColumn("lead", F.substring("term", 1, 1))
    met = v.join(F.broadcast(q), ["kind", "lead"])
    return met.filter(F.col("term").startswith(F.col("asked")) & (F.col("term") != F.col("asked"))).select("kind", "asked", "term")


def fuzzy_matches(vocab: DataFrame, wanted: DataFrame, least: float = 0.8) -> DataFrame:
    """``kind, asked, term, similarity`` for asked terms that have neither an exact nor a prefix match.

    similarity = 1 - distance / longer length; lengths must allow it before the
    distance is computed.
    """
    q = wanted.select("kind", F.col("term").alias("asked"))
    exact = vocab.select("kind", F.col("term").alias("asked"))
    some = exact.join(F.broadcast(q), ["kind", "asked"], "left_semi").unionByName(prefix_matches(vocab, wanted).select("kind", "asked").distinct())
    open_ = q.join(some, ["kind", "asked"], "left_anti")
    longer = F.greatest(F.length("term"), F.length("asked"))
    shorter = F.least(F.length("term"), F.length("asked"))
    met = vocab.join(F.broadcast(open_), "kind").filter(shorter >= least * longer)
    similarity = 1 - F.levenshtein("term", "asked") / longer
    return met.withColumn("similarity", similarity).filter(F.col("similarity") >= least).select("kind", "asked", "term", "similarity")
