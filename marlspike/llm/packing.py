"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only how many pieces there are of each length decides which lengths share a
sequence. So the plan is made from a histogram of at most ``capacity`` counts,
whatever the number of documents, and each piece finds its place by its rank
among the pieces of its length:

* large items, above a third of the capacity, go at most two to a bin: from the
  longest on, each is matched with the longest large item that still fits;
* smaller items, from the longest on, go where the least room is left that holds them;
* bins that hold the same are one *type* with a number, so a step places many
  pieces at once. A placement takes at least half of a type's free room, or
  splits one type, so there are O(capacity * log capacity) rows in the plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.llm.common import Scratch, bounded_batches
from marlspike.llm.tokens import KEPT, WordEncoder, public_path, worker

CAPACITY = 4096
#: The id after each document.
END = 1
#: Pieces of one length that are ranked together, at least; with more than its square in all, the root of their number.
PART = 500
#: Bytes of text that a worker encodes and hands on together, one text at least.
BATCH = 4 << 20
PIECES = "array<struct<piece:int,start:bigint,ids:binary>>"
_PIECES = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("ids", pa.binary())]))


def _encoded(name: str, path: str | None, capacity: int, kept: int, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker(WordEncoder, path or public_path(name), kept)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            ids, texts = b.columns
            at = 0
            while at < len(texts):  # a few texts at a time, so that long ones do not pile up
                size, stop = 0, at
                while stop < len(texts) and (size < batch or stop == at):
                    size += len(texts[stop].as_buffer() or b"") if texts[stop].is_valid else 0
                    stop += 1
                out = []
                for raw in encoder.encode(texts.slice(at, stop - at).to_pylist()):
                    raw += end
                    out.append([{"piece": i, "start": i * capacity, "ids": raw[4 * i * capacity : 4 * (i + 1) * capacity]} for i in range(-(-len(raw) // (4 * capacity)))])
                yield pa.RecordBatch.from_arrays([ids.slice(at, stop - at), pa.array(out, _PIECES)], ["doc_id", "pieces"])
                at = stop

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "word_bpe_49k.json", path: str | None = None, kept: int = KEPT, batch: int = BATCH) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit) of all of ``docs(doc_id, text)``.

    ``path`` names the vocabulary file if workers do not find it by its name;
    ``kept`` is how many words a worker remembers (some 250 MB for a
    million), ``batch`` how many bytes of text it encodes together.
    Null and empty texts are the end id alone.
    """
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = given.mapInArrow(_encoded(vocabulary, path, capacity, kept, batch), f"doc_id bigint, pieces {PIECES}")
    each = found.select("doc_id", F.explode("pieces").alias("p"))
    return each.select("doc_id", "p.piece", "p.start", (F.length("p.ids") / 4).cast("bigint").alias("length"), "p.ids")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: rows (length, first rank, past last rank, per bin, first bin, offset).

    The piece of rank r among those of its length is in bin ``first bin + (r -
    first rank) // per bin``, at ``offset + (r - first rank) % per bin * length``.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    rank = dict.fromkeys(left, 0)
    bins = 0
    free: dict[int, list[list]] = {}  # room -> types [number of bins, first bin, used, rows (length, first rank, per bin, offset)]
    rows: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []

    def take(length: int, n: int) -> int:
        r = rank[length]
        rank[length] += n
        left[length] -= n
        return r

    def put(kind: list) -> None:
        room = capacity - kind[2]
        if room not in free:
            free[room] = []
            insort(rooms, room)
        free[room].append(kind)

    def opened(n: int, items: list[tuple[int, int]]) -> None:
        nonlocal bins
        used, held = 0, []
        for length, per in items:
            held.append((length, take(length, n * per), per, used))
            used += length * per
        put([n, bins, used, held])
        bins += n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        big = large[-1]
        # the longest large item that fits beside it, if need be another of its own length
        i = bisect_left(large, capacity - big + 1) - 1
        if i < 0:
            opened(left[big], [(big, 1)])
        elif large[i] == big:
            if left[big] > 1:
                opened(left[big] // 2, [(big, 2)])
            if left[big]:
                # one is left: it takes the next shorter
                if i > 0:
                    opened(1, [(big, 1), (large[i - 1], 1)])
                    if not left[large[i - 1]]:
                        large.pop(i - 1)
                else:
                    opened(1, [(big, 1)])
        else:
            n = min(left[big], left[large[i]])
            opened(n, [(big, 1), (large[i], 1)])
            if not left[large[i]]:
                large.pop(i)
        if not left[big]:
            large.pop()

    for size in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[size]:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                per = capacity // size
                if left[size] >= per:
                    opened(left[size] // per, [(size, per)])
                if left[size]:
                    opened(1, [(size, left[size])])
                continue
            room = rooms[i]
            kind = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(i)
            n, first, used, held = kind
            per = room // size
            whole = min(n, left[size] // per)
            if whole == 0:  # the last ones go into one bin of the type
                whole, per = 1, left[size]
            if whole < n:
                put([n - whole, first + whole, used, [(k, r + whole * p, p, o) for k, r, p, o in held]])
            put([whole, first, used + per * size, [*held, (size, take(size, whole * per), per, used)]])
    for kinds in free.values():
        for n, first, _, held in kinds:
            rows += [(k, r, r + n * p, p, first, o) for k, r, p, o in held]
    return rows


def _longs(spark: SparkSession, names: list[str], rows: list[tuple[int, ...]]) -> DataFrame:
    """A small table of longs, handed over as Arrow: from a list of rows Spark would start a second set of Python workers."""
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=names))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of ``pieces(doc_id, piece, length, ...)`` with ``sequence_id`` and ``offset``, in place of any so named.

    Every piece gets a place; lengths are from 1 to ``capacity``. Equal rows get
    places of their own. Names of other columns are free. An empty table gives an
    empty result. ``pieces`` is read three times and must give the same rows each
    time, as a written table does.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    order = [F.col("row")[c] for c, t in pieces.dtypes if c in names and "map<" not in t]
    row = F.struct(*(pieces[f"`{c}`"].alias(c) for c in names)).alias("row")
    # at most `capacity` rows and O(capacity log capacity) rows: bounded by the length of a sequence, not by the documents
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    together = max(PART, isqrt(sum(histogram.values())))
    parts = _longs(spark, ["length", "parts"], [(k, v // together + 1) for k, v in histogram.items()])
    plan = _longs(spark, ["length", "r0", "r1", "per", "first", "off"], plan_bins(histogram, capacity))
    dealt = pieces.select(row, pieces["length"].cast("bigint").alias("length"), F.xxhash64("doc_id", "piece").alias("hash")).join(F.broadcast(parts), "length")
    dealt = dealt.withColumn("part", F.pmod("hash", "parts")).drop("hash", "parts")
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    # a row for each part: `capacity` and the root of the number of pieces at most
    sums = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)) - 1)
    ranked = ranked.join(F.broadcast(sums), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    met = ranked.join(F.broadcast(plan), "length").filter("rank >= r0 and rank < r1")
    k = F.col("rank") - F.col("r0")
    sequence = (F.col("first") + F.floor(k / F.col("per"))).cast("bigint").alias("sequence_id")
    return met.select(*(F.col("row")[c].alias(c) for c in names), sequence, (F.col("off") + k % F.col("per") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "word_bpe_49k.json", path: str | None = None, kept: int = KEPT, batch: int = BATCH) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row of ``docs``.

    Only documents over the capacity are cut. The ids themselves come from
    :func:`token_pieces`; here their CRC-32 is kept. Null ids and repeated rows
    keep their rows; other columns are ignored, whatever their names. Null and empty
    texts are the end token alone; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = token_pieces(docs, capacity, vocabulary, path, kept, batch)
    pieces = scratch.save(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(pieces, capacity)
