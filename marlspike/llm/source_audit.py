"""Source divergence audit: how far the sources of a language use its terms alike.

A count-min sketch of document frequencies is filled by each task over the texts
that it reads and the sketches are merged. The sketch never says less than
the true frequency, so a term below the threshold in it is below it, and is
discarded before anything is shuffled. What survives is counted exactly.

Sources are then compared by the terms that both have; all other terms of
a pair are answered from the counts of one source, or from none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.llm.common import Scratch, bounded_batches

#: Rows of the sketch.
DEPTH = 4
#: Powers of two of a row's cells: by the number of documents, within these bounds (64 MB in each worker at most, 8 MB of bits for all).
LEAST_BITS, MOST_BITS = 16, 24
CELLS_PER_DOC = 64
#: Cells of a block, in which sketches are merged.
BLOCK = 1 << 16
#: Terms that a worker holds, or bytes of text that it has read, before it hands on their sums.
HELD, HELD_BYTES = 400_000, 64 << 20
#: Bytes of a text that are cut into terms together.
SLICE = 1 << 20
#: Sources that meet for a term in one task, and groups up to which they are broadcast (some 100 bytes each).
MET, BROADCAST_GROUPS = 256, 50_000

#: A-Z lower-cased; other ASCII characters that are no letters become spaces.
_FOLD = bytes((b | 32) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, a slice at a time: runs of ASCII letters and of all other characters beyond ASCII."""
    at, n = 0, len(raw)
    while at < n:
        part = raw[at : at + SLICE].translate(_FOLD)
        end = n - at if at + SLICE >= n else part.rfind(b" ")
        while end < 0:  # one term longer than the slice
            more = raw[at + len(part) : at + len(part) + SLICE].translate(_FOLD)
            space = more.find(b" ")
            part += more if space < 0 else more[:space]
            end = len(part) if space >= 0 or at + len(part) >= n else -1
        yield part[:end].split()
        at += max(end, 1)


def hashes(lang: str, found: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    seed = crc32(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxh3_64_intdigest(t, seed) for t in found), np.uint64, len(found))


def cells(h: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each hash in each row, numbered over all rows."""
    low, high, mask = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1), np.uint64((1 << bits) - 1)
    return np.stack([((low + np.uint64(i) * high) & mask) + np.uint64(i << bits) for i in range(DEPTH)]).astype(np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, str, bytes]]:
    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _sketches(bits: int, need: int):
    """The sketch of a task's texts as blocks ``(block, cells)``; a cell stops counting at ``need``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, size = np.zeros(DEPTH << bits, np.uint8), {}, 0

        def add() -> None:
            for lang, c in held.items():
                at = cells(hashes(lang, list(c)), bits).ravel()
                n = np.tile(np.minimum(np.fromiter(c.values(), np.int64, len(c)), need), DEPTH)
                which, where = np.unique(at, return_inverse=True)
                sums = sketch[which] + np.bincount(where, n, len(which)).astype(np.int64)
                sketch[which] = np.minimum(sums, need)
            held.clear()

        for b in batches:
            for lang, _, raw in _rows(b):
                seen: set[bytes] = set()
                for part in terms(raw):
                    seen.update(part)
                held.setdefault(lang, Counter()).update(seen)
                size += len(raw)
                if size > HELD_BYTES:
                    add()
                    size = 0
            if sum(map(len, held.values())) > HELD:
                add()
                size = 0
        add()
        blocks = sketch.reshape(-1, min(BLOCK, 1 << bits))
        at = np.flatnonzero(blocks.any(1))
        for i in range(0, len(at), 64):
            part = at[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([blocks[j].tobytes() for j in part], pa.binary())], ["block", "cells"])

    return run


def _merged(need: int):
    """Blocks of all tasks summed; of each, which cells have reached ``need``, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new = np.frombuffer(raw, np.uint8).astype(np.uint16)
                sums[block] = np.minimum(sums[block] + new, need) if block in sums else new
        rows = [(k, np.packbits(v >= need).tobytes()) for k, v in sums.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["block", "bits"])

    return run


def _counts(bits: int, reached):
    """``(lang, source, term, n, docs)`` of a task's texts for terms that the sketch lets through; a null term names the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(reached.value, np.uint8)
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                found = list(n)
                at = cells(hashes(lang, found), bits)
                able = np.flatnonzero((flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(0))
                kept = [None, *(found[i] for i in able)]
                column = lambda c: pa.array([0, *(c[t] for t in kept[1:])], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(kept)), pa.array([source] * len(kept)), pa.array(kept, pa.binary()).cast(pa.string()), column(n), column(docs)],
                    ["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for b in batches:
            for lang, source, raw in _rows(b):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for part in terms(raw):
                    n.update(part)
                    seen.update(part)
                docs.update(seen)
                size += len(raw)
                if size > HELD_BYTES:
                    yield from rows()
                    size = 0
            if sum(len(c[0]) for c in held.values()) > HELD:
                yield from rows()
                size = 0
        yield from rows()

    return run


def _share(n: Column | str, total: str, terms: str) -> Column:
    """Smoothed share in billionths, plus one. In decimals, as totals times a billion pass a long."""
    n = F.col(n) if isinstance(n, str) else n
    return F.expr("1L") + F.call_function("div", ((n + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")), (F.col(total) + 2 * F.col(terms)).cast("decimal(20,0)"))


def _far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _by_lang(left: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """``left(lang, ...)`` with all groups ``(other_lang, ...)`` of its language, which are dealt over 64 parts where they are many, ``left`` being repeated."""
    if few:
        return left.join(F.broadcast(groups), F.col("lang") == F.col("other_lang"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(63))))
    right = groups.withColumn("other_part", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int"))
    return left.join(right, (F.col("lang") == F.col("other_lang")) & (F.col("part") == F.col("other_part"))).drop("part", "other_part")


def term_counts(docs: DataFrame, min_docs: int = 10, scratch: Scratch | None = None, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(counts, kept)``: exact counts by ``lang, source, term`` of terms that the sketch lets through (a null term names each group), and ``lang, term, total, docs, sources`` of terms in at least ``min_docs`` documents of the language."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = scratch or Scratch(spark, "audit")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    need = min(max(min_docs, 1), 255)  # a cell that counts to 255 lets through whatever has more
    if bits is None:
        bits = min(max((CELLS_PER_DOC * given.count()).bit_length(), LEAST_BITS), MOST_BITS)
    tasks = 4 * spark.sparkContext.defaultParallelism  # each makes one sketch
    parts = given.coalesce(tasks).mapInArrow(_sketches(bits, need), "block bigint, cells binary")
    blocks = parts.repartition("block").mapInArrow(_merged(need), "block bigint, bits binary").toArrow().to_pylist()  # (DEPTH << bits) / 8 bytes at most
    size = min(BLOCK, 1 << bits) // 8
    reached = bytearray((DEPTH << bits) // 8)
    for b in blocks:
        reached[b["block"] * size : (b["block"] + 1) * size] = b["bits"]
    sent = spark.sparkContext.broadcast(bytes(reached))
    counted = given.mapInArrow(_counts(bits, sent), "lang string, source string, term string, n bigint, docs bigint")
    counts = scratch.save(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    sent.destroy()
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.count("*").alias("sources"))
    return counts, scratch.save(kept.filter(F.col("docs") >= min_docs))


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, met: int = MET, broadcast_groups: int = BROADCAST_GROUPS, bits: int | None = None) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs(text, lang, source)``.

    A language keeps the V terms that stand in at least ``min_docs`` of its rows.
    A group (lang, source) gives a term of count n the share
    p = 1 + floor(10^9 (n + 2) / (N + 2 V)), N being its sum over kept terms; the
    language's share q is of its own counts. Two shares are
    floor((p - q)^2 / (p + q)) apart. Part ``pair``: the distance to each other
    source of the language, summed over all kept terms, all ranks. Part ``term``:
    kept terms that a group uses more than its language, the ``top`` farthest.
    Ranks go by value, largest first, then by item. All numbers are exact.

    Null texts, languages and sources count as ''. Every row is a document of
    its own, repeated ones too. A language without kept terms has pairs of value
    0 and no terms. No rows: no result. Other columns are ignored, whatever
    their names; very long texts are cut into terms a slice at a time.

    A term that more than ``met`` sources share is dealt out by the second
    source of its pairs. With more than ``broadcast_groups`` groups these are
    dealt out too instead of being broadcast.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    counts, kept = term_counts(docs, min_docs, scratch, bits)
    k = kept.select(F.col("lang").alias("l"), F.col("term").alias("t"), "total", "sources")
    found = counts.filter("term is not null").join(k, (F.col("lang") == F.col("l")) & (F.col("term") == F.col("t"))).select("lang", "source", "term", "n", "total", "sources")
    found = scratch.save(found)
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("size")).select(F.col("lang").alias("gl"), F.col("source").alias("gs"), "size")
    langs = kept.groupBy("lang").agg(F.count("*").alias("V"), F.sum("total").alias("lang_size")).withColumnRenamed("lang", "ll")
    groups = counts.filter("term is null").select("lang", "source")
    groups = groups.join(sums, (F.col("lang") == F.col("gl")) & (F.col("source") == F.col("gs")), "left").join(langs, F.col("lang") == F.col("ll"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    groups = groups.select("lang", "source", *(zero(F.col(c)).alias(c) for c in ("size", "V", "lang_size")))
    groups = scratch.save(groups.withColumn("p0", F.when(F.col("V") > 0, _share(F.lit(0).cast("bigint"), "size", "V")).otherwise(F.lit(0).cast("bigint"))))
    few = scratch.count(groups) <= broadcast_groups
    g = groups.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), "size", "V", "lang_size", "p0")
    at = found.join(F.broadcast(g) if few else g, (F.col("lang") == F.col("gl")) & (F.col("source") == F.col("gs")))
    at = at.select("lang", "source", "term", "sources", _share("n", "size", "V").alias("p"), _share("total", "lang_size", "V").alias("q"), "p0")
    at = scratch.save(at)

    farthest = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    p, q = F.col("p"), F.col("q")
    by_term = at.filter(p > q).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far(p, q).alias("value"))
    by_term = by_term.withColumn("rank", F.row_number().over(farthest)).filter(F.col("rank") <= top)

    other = groups.select(F.col("lang").alias("other_lang"), F.col("source").alias("b"), F.col("p0").alias("q0"), "V")
    p0, q0 = F.col("p0"), F.col("q0")
    none = F.when(F.col("V") > 0, F.col("V") * _far(p0, q0)).otherwise(F.lit(0).cast("bigint"))  # as if neither had a term
    parts = _by_lang(groups.select("lang", F.col("source").alias("a"), "p0"), other, few).filter("a < b").select("lang", "a", "b", none.alias("v"))
    ones = at.groupBy("lang", F.col("source").alias("a"), "p", "p0").agg(F.count("*").alias("m"))  # terms of one source by their share
    ones = _by_lang(ones, other, few).filter("a <> b")
    ones = ones.select("lang", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), (F.col("m") * (_far(p, q0) - _far(p0, q0))).alias("v"))
    parts = parts.unionByName(ones.select("lang", F.col("x").alias("a"), F.col("y").alias("b"), "v"))
    deal = F.floor(F.col("sources") / met).cast("int")
    left = at.select("lang", "term", F.col("source").alias("a"), "p", "p0", F.explode(F.sequence(F.lit(0), deal)).alias("deal"))
    right = at.select(F.col("lang").alias("rl"), F.col("term").alias("rt"), F.col("source").alias("b"), F.col("p").alias("s"), F.col("p0").alias("q0"), F.pmod(F.xxhash64("source"), deal + 1).cast("int").alias("rd"))
    both = left.join(right, (F.col("lang") == F.col("rl")) & (F.col("term") == F.col("rt")) & (F.col("deal") == F.col("rd")) & (F.col("a") < F.col("b")))
    s = F.col("s")
    both = both.select("lang", "a", "b", (_far(p, s) - _far(p, q0) - _far(p0, s) + _far(p0, q0)).alias("v"))
    pairs = parts.unionByName(both).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    by_pair = pairs.select("lang", "value", ways).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", F.row_number().over(farthest))
    return by_pair.unionByName(by_term)
