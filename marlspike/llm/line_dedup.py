"""Line dedup: drop lines that many documents share, keep the rest in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import Scratch

#: Characters stripped from both ends of a line before it is compared.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    """A line as it is compared: stripped of ASCII white space, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """All rows and columns of ``docs(doc_id, text, ...)`` with ``n_lines, n_dropped, kept_text``.

    A text is split at \\n; null and empty texts are one empty line. Lines whose
    key has at least ``min_chars`` code points and stands in at least
    ``min_docs`` documents go from every document; the others stay, joined by
    \\n (``''`` if none stays).

    Keys are compared by two 64-bit hashes. Rows with one doc_id (null counts as
    one id) are one document in the counts; each row keeps its own lines. Input
    columns named as the new ones are replaced. An empty table gives an empty
    result.

    Only (hashes, doc_id, position) of lines are shuffled for the counts, which
    are combined before their shuffle; the text itself moves once, to meet the
    positions that go.
    """
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), lines.alias("lines"), F.xxhash64("text").alias("th"))
    key = line_key(F.col("line"))
    each = rows.select("id", "th", F.posexplode("lines").alias("pos", "line")).select("id", "th", "pos", key.alias("key"))
    each = each.filter(F.length("key") >= min_chars).select("id", "th", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"))
    common = each.select("k1", "k2", "id").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    # written, so that both sides of the join below have exchanges of their own and AQE can split a line that is everywhere
    common = Scratch(docs.sparkSession, "lines").save(common.select("k1", "k2"))
    gone = each.join(common, ["k1", "k2"], "left_semi").groupBy(F.col("id").alias("gid"), F.col("th").alias("gth")).agg(F.collect_set("pos").alias("gone"))
    met = rows.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda p: F.get("lines", p)), "\n"))
    new = {
        "n_lines": F.size("lines").cast("bigint"),
        "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("bigint"),
        "kept_text": text,
    }
    old = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in new]
    return met.select(*old, *(v.alias(k) for k, v in new.items()))
