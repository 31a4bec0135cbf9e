"""The corpus pipeline: five stages over ``documents``, each the work of one operator.

Every stage but the last returns the columns of ``documents``. A stage's result
is written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm.common import Scratch, table
from marlspike.llm.jaccard_join import near_duplicates
from marlspike.llm.line_dedup import dedup_lines
from marlspike.llm.packing import pack_documents
from marlspike.llm.quality_rules import judge_quality
from marlspike.llm.secrets import redact_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Words that a worker remembers while it packs, and bytes of text that it encodes together; other stages need its memory too.
WORDS_KEPT, TEXT_TOGETHER = 200_000, 1 << 20

#: Rejects up to which their keys are broadcast: two longs each, 32 MB at most. With more, the join shuffles.
BROADCAST_KEYS = 1_000_000


def _without(docs: DataFrame, gone: DataFrame, on) -> DataFrame:
    few = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return docs.join(few, on, "left_anti")


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text, and its length."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or a cutoff certified on ``labels``, go.

    Null and empty texts have no words, so they go. Rows are judged by id and text:
    repeated rows share a verdict, unlike texts under one id have their own. Without
    labels the base rules alone decide; no rows, no rows. Other columns are left out.
    """
    judged = judge_quality(docs, table(spark, sf_dir, "labels"))
    gone = judged.filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    gone = Scratch(spark, "rejects").save(gone)
    return _without(docs, gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"])).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in at least ten documents go; a document keeps its row even if no line is left.

    Null and empty texts become empty; texts of any length are cut at every line; repeated
    rows are one document in the counts and each keep what is left; no rows, no rows.
    """
    return _with_text(dedup_lines(docs), F.col("kept_text"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 80 hundredths) the least doc_id stays.

    Rows with one doc_id are judged together: unlike texts under one id all stay
    or all go. Equal rows of an id stay once, as they are copies of each other. Null ids,
    null and empty texts are in no group and stay; no rows, no rows.
    """
    found = near_duplicates(docs, k=5, similarity=80)
    found = Scratch(spark, "groups").save(found)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    out = _without(docs, gone, "doc_id").select(*COLUMNS)
    again = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if again.isEmpty():
        return out
    again = Scratch(spark, "repeated").save(again)
    # one row of each id and text: the least of the others' columns, so that it is the same in every run
    repeated = out.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("least"))
    return out.join(again, "doc_id", "left_anti").unionByName(repeated.select("doc_id", "text", "least.lang", "least.source", "least.n_chars"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in place; every document stays, whatever its id, text or length. No rows, no rows."""
    return _with_text(redact_secrets(docs.select(*COLUMNS)), F.col("text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 4096 tokens.

    Null and empty texts are a piece of the end token alone; long ones are cut; every
    row is packed, repeated ones too. No rows, no sequences.
    """
    return pack_documents(docs, kept=WORDS_KEPT, batch=TEXT_TOGETHER)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Certified cutoffs, merges of tokens and packing are no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
