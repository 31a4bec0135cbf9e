"""Rank fusion, filters, rerank blending and confidence over ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K, W_LEXICAL, W_SEMANTIC = 60, 0.6, 0.4
MAX_RRF = (W_LEXICAL + W_SEMANTIC) / (RRF_K + 1)
RERANKED, W_OWN, W_RERANK = 20, 0.3, 0.7

# Extensions of the languages that a filter may name.
EXTENSIONS = {
    "typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs", "cjs"], "python": ["py"], "rust": ["rs"], "go": ["go"],
    "java": ["java"], "ruby": ["rb"], "markdown": ["md", "mdx"], "json": ["json"], "yaml": ["yml", "yaml"],
}


def fuse(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """``doc_id, semantic_score, lexical_score, rrf_score`` from two lists ``(doc_id, score, rank)``, ranks from 0."""
    s = semantic.select("doc_id", F.col("score").alias("semantic_score"), F.col("rank").alias("sr"))
    x = lexical.select("doc_id", F.col("score").alias("lexical_score"), F.col("rank").alias("lr"))
    part = lambda rank, w: F.coalesce(F.lit(w) / (RRF_K + F.col(rank) + 1), F.lit(0.0))
    both = s.join(x, "doc_id", "full_outer")
    return both.select("doc_id", "semantic_score", "lexical_score", (part("sr", W_SEMANTIC) + part("lr", W_LEXICAL)).alias("rrf_score"))


def ranked(results: DataFrame, score: str, limit: int, key: str = "doc_id") -> DataFrame:
    """The best rows by score with ``rank`` from 0; ties by key. Input is a short list."""
    best = results.orderBy(F.desc(F.round(score, 9)), key).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(score, 9)), key)) - 1)


def keep(results: DataFrame, file_types=None, paths=None, symbols=None, chunk_types=None, least: float | None = None, score: str = "rrf_score") -> DataFrame:
    """Filters after retrieval: any of a kind, all kinds. Columns file_path, language, symbols, type where used."""
    out = results
    if file_types:
        named = [e for t in file_types for e in EXTENSIONS.get(t.lower(), [t.lower().removeprefix(".")])]
        ext = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
        out = out.filter(ext.isin(named) | F.lower("language").isin([t.lower() for t in file_types]))
    if paths:
        hit = F.lit(False)
        for p in paths:
            hit = hit | F.contains(F.lower("file_path"), F.lit(p.lower()))
        out = out.filter(hit)
    if symbols:
        out = out.filter(F.exists("symbols", lambda s: F.lower(s).isin([x.lower() for x in symbols])))
    if chunk_types:
        out = out.filter(F.col("type").isin(chunk_types))
    return out if least is None else out.filter(F.col(score) >= least)


def rerank(results: DataFrame, relevance: str = "relevance", n: int = RERANKED) -> DataFrame:
    """``rank`` and ``final_score`` after blending relevance into the first n; the rest keeps its place behind them."""
    head = F.col("rank") < n
    score = F.when(head, W_OWN * F.col("rrf_score") + W_RERANK * F.col(relevance)).otherwise(F.col("rrf_score"))
    order = Window.orderBy((~head).cast("int"), F.when(head, -F.round(score, 9)).otherwise(F.col("rank")), "rank")
    return results.withColumn("final_score", score).withColumn("rank", F.row_number().over(order) - 1)


def rerank_text(content: Column, type_: Column, symbols: Column) -> Column:
    """What a reranker reads: type and symbols, then at most 4,000 characters."""
    head = F.concat(F.lit("["), type_, F.when(F.size(symbols) > 0, F.concat(F.lit(": "), F.array_join(symbols, ", "))).otherwise(F.lit("")), F.lit("]\n"))
    return F.concat(head, F.when(F.length(content) > 4000, F.concat(F.substring(content, 1, 4000), F.lit("..."))).otherwise(content))


def confidence(results: DataFrame, score: str = "rrf_score", reranked: bool = False) -> DataFrame:
    """One row ``confidence, suggestion, n_results`` for a result list."""
    top = results.agg(F.count("*").alias("n_results"), F.array_sort(F.collect_list(score), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("s"))
    first, second = F.get("s", F.lit(0)), F.coalesce(F.get("s", F.lit(1)), F.lit(0.0))
    near = F.size(F.filter("s", lambda v: v >= 0.5 * first))
    gap = F.when(F.size("s") > 1, first - second).otherwise(first)
    value = (
        0.5 * F.least(2 * F.least(first / MAX_RRF, F.lit(1.0)), F.lit(1.0))
        + 0.3 * F.least(5 * F.least(gap / MAX_RRF, F.lit(1.0)), F.lit(1.0))
        + 0.2 * F.least(near / 5, F.lit(1.0))
        + (0.1 if reranked else 0.0)
    )
    value = F.when(F.size("s") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), value))
    say = F.when(F.size("s") == 0, "no_matches").when(value < 0.2, "low_confidence").when(value < 0.4, "query_unclear").otherwise("use_results")
    return top.select("n_results", F.round(value, 6).alias("confidence"), say.alias("suggestion"))


#: How many times the wanted results each list brings to the fusion.
OVER_FETCH = 5


def response(semantic: DataFrame, lexical: DataFrame, payload: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` of two lists that were asked for ``OVER_FETCH`` times as many, with ``payload(doc_id, ...)`` and the lexical list's ``highlights``.

    A result without a payload goes, after the cut; one that only the semantic list brought has no highlights.
    """
    top = ranked(fuse(semantic, lexical), "rrf_score", limit)
    with_ = top.join(payload, "doc_id").join(lexical.select("doc_id", "highlights"), "doc_id", "left")  # short lists
    return with_
