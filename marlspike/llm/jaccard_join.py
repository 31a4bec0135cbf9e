"""N-gram Jaccard join: near-duplicate groups of whole texts.

The method is prefix filtering with rare n-grams first, then length, positional
and suffix filters, and one exact verification for each pair that is left.

How it stays exact and bounded
------------------------------
* A document's n-grams become a set of 64-bit hashes. Documents with equal sets
  are one *class*; only its least id, the representative, takes part in the join.
* The global order of n-grams puts rare ones first: after all others stand the
  ``RANKS`` n-grams that repeat most often inside blocks of documents, by their
  exact counts. Any fixed order gives exact results, so what the table misses
  only costs time.
* Two sets of sizes x <= y can only reach similarity t if x >= t*y and if their
  prefixes (all but the last ceil(t*size)-1 n-grams) have an n-gram in common.
  They also have two in common among the prefixes that are longer by one; where a
  prefix n-gram is so frequent that it pays, documents meet under the first two
  common n-grams and a band of lengths, instead of under the first alone.
* A pair counts only where it meets under its first common n-grams. The positional
  filter relies on that, and the last n-grams before show most later meetings.
* The question is which documents hang together, so a pair inside one component
  needs no check. Star rounds first compare every member of a bucket (the
  documents that meet) with a leader of that bucket, until all pairs of a bucket
  that are still in different components are few enough to be candidates. The first
  leader is the member whose prefix is shared most, as the text that the others were
  altered from may be the only one that links with all of them. A large
  group of near copies with such a text thus costs about its size; without one,
  pairs that pass the filters may still grow faster. No candidate is left out.
* The suffix filter bounds the size of the symmetric difference from below by the
  number of bits in which two 512-bit parity sketches differ (each n-gram flips
  one bit). It never removes a pair that reaches the threshold.

Sets are sets of 64-bit hashes throughout, in the verification too: two n-grams
with one hash would count as equal.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from marlspike.llm.common import Scratch, begins, components

#: N-grams in the table of the most repeated ones: 3 MB in driver and workers at most, whatever the input.
RANKS = 1 << 18
#: N-grams that are counted together before only the repeated ones are passed on.
BLOCK = 1 << 20
#: Longs in a parity sketch.
LONGS = 8
#: Ids up to which those of the texts to verify are broadcast, 16 MB of longs; with more, the texts are shuffled to them.
BROADCAST_IDS = 2_000_000
#: Sets that a worker keeps while it verifies.
SETS_KEPT = 64
#: Star rounds go on until buckets hold at most so many pairs for each row, and begin only above one; from so many on that rounds leave, frequent n-grams are split.
PAIRS_A_ROW, SPLIT_FROM = 4, 256
#: At most so many rounds; after the third, those that leave more than this share of the pairs end them.
ROUNDS, LEFT = 6, 0.9
#: N-grams before a meeting that are compared, to see that a pair has met before.
BEFORE = 6

_ODD = [np.uint64(2 * int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") + 1 & (2**64 - 1)) for i in range(64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[62]
    x = (x ^ (x >> np.uint64(29))) * _ODD[63]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word n-grams; the whole sequence where there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    w = min(k, len(words))
    n = len(words) - w + 1
    s = np.full(n, w, np.uint64)
    for i in range(w):
        s = _mixed((s + h[i : i + n]) * _ODD[i % 60])
    return np.unique(s)


def prefix_length(n, similarity: int):
    """N-grams in the prefix of a set of n, for a similarity in hundredths."""
    return n - (n * similarity + 99) // 100 + 1


def parities(s: np.ndarray, bits: int) -> np.ndarray:
    """Which of so many bits (a power of two) are flipped an odd number of times, one flip for each n-gram, as bytes."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def fine_bits(n: int) -> int:
    """Bits of the finer sketch of a set: at least twice its size, so the bound stays close for long texts."""
    return max(64 * LONGS, 1 << (2 * n - 1).bit_length()) if n else 64 * LONGS


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference, from two finer sketches; the larger one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), 0) ^ y).sum())


def _repeated(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("jaccard_join")
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            every, counts = np.unique(np.concatenate(held), return_counts=True)
            more = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(every[more].view(np.int64)), pa.array(counts[more], pa.int64())], ["gram", "n"])

        for b in batches:
            for text in b.columns[0]:
                held.append(shingle_set(text.as_py(), k))
                n += len(held[-1])
                if n >= BLOCK:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def rarity(scratch: Scratch, docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``RANKS`` most repeated n-grams at most, sorted, and their counts."""
    counts = scratch.save(docs.select("text").mapInArrow(_repeated(k), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
    sizes = counts.groupBy(F.least("n", F.lit(RANKS)).alias("n")).agg(F.count("*").alias("grams"))
    sizes = sizes.toPandas().sort_values("n", ascending=False)  # a row for each count up to RANKS
    fitting = sizes["n"][sizes["grams"].cumsum() <= RANKS]
    found = counts.filter(F.col("n") >= (int(fitting.min()) if len(fitting) else 2**63 - 1)).toPandas()
    grams = found["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    scratch.drop(counts)
    return grams[order], np.minimum(found["n"].to_numpy(np.int64), 2**32 - 1).astype(np.uint32)[order]


def _counts(s: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The count of each n-gram of a sorted set, 0 for those that the table lacks."""
    grams, counts = table
    if not len(grams):
        return np.zeros(len(s), np.uint32)
    at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
    return np.where(grams[at] == s, counts[at], 0)


def _features(k: int, similarity: int, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("jaccard_join")
        table = ranks.value
        for b in batches:
            ids, texts = b.columns
            n, keys, sketches, fine, prefixes = [], [], [[] for _ in range(LONGS)], [], []
            for text in texts:
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                for to, v in zip(sketches, parities(s, 64 * LONGS).view(np.int64), strict=True):
                    to.append(v)
                fine.append(parities(s, fine_bits(len(s))).tobytes())
                p = prefix_length(len(s), similarity) + 1 if len(s) else 0  # one more, for the second common n-gram
                prefixes.append(s[np.lexsort((s, _counts(s, table)))[:p]].view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), *(pa.array(x, pa.int64()) for x in sketches), pa.array(fine, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["doc_id", "n", "key", *(f"s{i}" for i in range(LONGS)), "fine", "prefix"],
            )

    return run


def _close(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, n, m, x, y = b.columns
            most = [(100 - similarity) * (p + q) // (100 + similarity) for p, q in zip(n.to_pylist(), m.to_pylist(), strict=True)]
            keep = [least_difference(p, q) <= d for p, q, d in zip(x.to_pylist(), y.to_pylist(), most, strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), c.filter(mask)], ["a", "b"])

    return run


def _verified(k: int, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, np.ndarray] = {}  # rows come ordered by b, and leaders repeat

        def of(i: int, text: pa.Scalar) -> np.ndarray:
            key = (i, text.as_py())  # an id may have several texts
            s = kept.pop(key, None)
            s = shingle_set(key[1], k) if s is None else s
            kept[key] = s
            if len(kept) > SETS_KEPT:
                kept.pop(next(iter(kept)))
            return s

        for b in batches:
            a, c, x, y = b.columns
            keep = []
            for i, j, p, q in zip(a.to_pylist(), c.to_pylist(), x, y, strict=True):
                both = np.concatenate((of(i, p), of(j, q)))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= similarity * (len(both) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), c.filter(mask)], ["a", "b"])

    return run


def _few(scratch: Scratch, pairs: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``of``, or the pairs themselves, broadcast if there are few pairs; it holds at most two rows for each."""
    return F.broadcast(of or pairs) if scratch.count(pairs) <= BROADCAST_IDS // 2 else of or pairs


def _verify(scratch: Scratch, docs: DataFrame, rows: DataFrame, pairs: DataFrame, k: int, similarity: int) -> DataFrame:
    """The pairs ``(a, b)`` that reach the similarity.

    Finer sketches, an eighth of the texts or less, meet first; then the texts of
    the pairs that are left. Texts are half as large as their sets of hashes.
    """
    def sides(table: DataFrame, among: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
        need = among.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        held = scratch.save(table.join(_few(scratch, among, need), "doc_id", "left_semi"))
        return tuple(held.select(F.col("doc_id").alias(to), *(F.col(c).alias(f"{to}_{c}") for c in columns)) for to in ("a", "b"))

    left, right = sides(rows.select("doc_id", "n", "fine"), pairs, "n", "fine")
    both = left.join(_few(scratch, pairs), "a").join(right, "b").select("a", "b", "a_n", "b_n", "a_fine", "b_fine")
    close = scratch.save(both.mapInArrow(_close(similarity), "a bigint, b bigint").distinct())
    left, right = sides(docs.select("doc_id", "text"), close, "text")
    both = left.join(_few(scratch, close), "a").join(right, "b").select("a", "b", "a_text", "b_text")
    return scratch.save(both.mapInArrow(_verified(k, similarity), "a bigint, b bigint").distinct())


def _nearer(links: DataFrame) -> DataFrame:
    """``comp, into``: the least node within two of ``links(a, b)``, for nodes that are not it; a star becomes one."""
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    there = ends.join(least.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("into"))
    return there.filter("a <> into").select(F.col("a").alias("comp"), "into")


def _possible(similarity: int) -> str:
    """Length and suffix filter between sets of n and m n-grams with sketches s* and t*."""
    bits = " + ".join(f"bit_count(s{i} ^ t{i})" for i in range(LONGS))
    # |A n B| >= t*|A u B| is the same as |A d B| * (100 + t) <= (100 - t) * (n + m)
    return f"100 * least(n, m) >= {similarity} * greatest(n, m) and ({bits}) * {100 + similarity} <= {100 - similarity} * (n + m)"


def near_duplicates(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id``.

    A-Z are lower-cased; words are runs of anything but ASCII white space. Sets
    are distinct k-word n-grams of the whole text; a text of fewer words is one
    n-gram. Two documents link where 100*|A n B| >= similarity*|A u B|;
    component_id is the least doc_id reachable by links.

    Null and empty texts have no n-grams and link with nothing. Rows with one
    doc_id count as one document and share a component. A null doc_id keeps its
    row with a null component. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranks = spark.sparkContext.broadcast(rarity(scratch, docs, k))
    longs = [f"s{i}" for i in range(LONGS)]
    schema = "doc_id bigint, n bigint, key binary, " + ", ".join(f"{c} bigint" for c in longs) + ", fine binary, prefix array<bigint>"
    rows = scratch.save(docs.mapInArrow(_features(k, similarity, ranks), schema))

    ranks.destroy()

    classes = rows.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rid"))
    classes = scratch.save(classes)
    copies = rows.select("doc_id", "key").join(classes, "key").filter("doc_id <> rid").select("doc_id", "key").distinct()
    copies = scratch.save(copies)
    reps = rows.filter("n > 0 and doc_id is not null").join(_few(scratch, copies), ["doc_id", "key"], "left_anti")
    reps = scratch.save(reps.select(F.col("doc_id").alias("rid"), "n", *longs, "prefix"))
    if reps.count() > classes.count():  # rows that repeat
        reps = scratch.save(reps.dropDuplicates(["rid", "n", *longs]))
    sketch = reps.select("rid", "n", *longs)

    own = F.slice("prefix", F.lit(1), F.expr(f"cast(n - (n * {similarity} + 99) div 100 + 1 as int)"))
    posting = reps.select("rid", "n", F.posexplode(own).alias("pos", "key"))
    shared = posting.groupBy("key").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).filter("low < high").select("key")
    posting = scratch.save(posting.join(shared, "key").withColumns({"first": F.lit(-1), "up": F.lit(0), "comp": F.col("rid")}))

    # a repeated doc_id with several texts is one document: its classes hang together
    member = rows.join(classes, "key").filter("doc_id is not null").groupBy("doc_id").agg(F.min("rid").alias("rid"), F.max("rid").alias("other"))
    member = scratch.save(member)
    repeated = rows.join(classes, "key").join(member.filter("rid <> other").select("doc_id", F.col("rid").alias("low")), "doc_id").filter("rid <> low")
    same = scratch.save(repeated.select(F.col("rid").alias("a"), F.col("low").alias("b")).distinct())
    links = tested = None
    rest = F.expr(f"n - (n * {similarity} + 99) div 100 + 1 - pos")
    # a little wider than the ratio of lengths that may link, so rounding can't put such lengths two bands apart
    width = 1.000001 * math.log(100 / similarity) or 1.0

    def kept(p: DataFrame) -> DataFrame:
        """Without the buckets that lie inside one component: they stay so."""
        mixed = p.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
        return scratch.save(p.join(mixed, "key"))

    def pairs_of(p: DataFrame, *by: str) -> DataFrame:
        """Pairs of different components that meet in some bucket, once for each bucket."""
        sizes = p.groupBy(*by, "key", "comp").agg(F.count("*").alias("c")).groupBy(*by, "key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"))
        return sizes.groupBy(*by).agg(F.sum((F.col("c") * F.col("c") - F.col("cc")) / 2).alias("pairs"), F.sum("c").alias("rows"))

    def pairs_left() -> tuple[float, int]:
        found = pairs_of(posting).first()
        return found["pairs"] or 0, found["rows"] or 0

    def split_buckets() -> DataFrame:
        """Rows under two n-grams, of the buckets where fewer pairs meet so."""
        large = posting.groupBy("key").agg(F.count("*").alias("c"), F.sum(rest).alias("rows")).filter("c * (c - 1) > 8 * rows + 64").select("key")
        large = scratch.save(large)
        second = posting.join(large, "key").join(reps.select("rid", "prefix"), "rid")
        after = F.posexplode(F.expr("slice(prefix, pos + 2, size(prefix))")).alias("skip", "second")
        second = second.select("rid", "n", "comp", F.col("pos").alias("first"), (F.col("pos") + 1).alias("from"), F.col("key").alias("origin"), after)
        band = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
        second = second.select("*", F.posexplode(F.array(band, band + 1)).alias("up", "band"))  # its own band, and the next for shorter ones
        second = second.select("origin", "rid", "n", "first", (F.col("from") + F.col("skip")).cast("int").alias("pos"), "up", F.xxhash64("origin", "second", "band").alias("key"), "comp")
        second = kept(second)
        were = pairs_of(posting.join(large, "key").withColumn("origin", F.col("key")), "origin").select("origin", F.col("pairs").alias("were"))
        worth = were.join(pairs_of(second, "origin"), "origin", "left")
        worth = scratch.save(worth.filter("2 * (coalesce(pairs, 0) + coalesce(rows, 0)) < were").select(F.col("origin").alias("key")))
        second = second.join(worth.withColumnRenamed("key", "origin"), "origin", "left_semi").select(*posting.columns)
        alone = posting.join(worth, "key", "left_semi").filter(f"n * {similarity} <= 100")  # one n-gram in common is enough for these
        return scratch.save(posting.join(worth, "key", "left_anti").unionByName(alone).unionByName(second))

    def filtered(pairs: DataFrame) -> DataFrame:
        a = sketch.select(F.col("rid").alias("a"), "n", *longs)
        b = sketch.select(F.col("rid").alias("b"), F.col("n").alias("m"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(longs)))
        return pairs.join(a, "a").join(b, "b").filter(_possible(similarity)).select("a", "b", "ca", "cb")

    def every_pair() -> DataFrame:
        before = F.expr(f"slice(prefix, greatest(1, pos + 1 - {BEFORE}), least(pos, {BEFORE}))")
        before = F.when(F.col("first") >= 0, F.array_except(before, F.expr("slice(prefix, first + 1, 1)"))).otherwise(before)
        p = scratch.save(posting.join(reps.select("rid", *longs, "prefix"), "rid").withColumn("before", before).drop("prefix"))
        q = p.select("key", F.col("rid").alias("b"), F.col("n").alias("m"), F.col("pos").alias("pos2"), F.col("first").alias("first2"), F.col("up").alias("up2"), F.col("comp").alias("cb"), F.col("before").alias("before2"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(longs)))
        met = p.withColumnRenamed("rid", "a").withColumnRenamed("comp", "ca").join(q, "key").filter("a < b and ca <> cb and least(up, up2) = 0")
        # positional filter: the n-grams of the key are the first in common, so what can be common is these and the rest
        so_far = "(case when first >= 0 and first2 >= 0 then 2 else 1 end)"
        met = met.filter(f"({so_far} + least(n - pos, m - pos2) - 1) * {100 + similarity} >= {similarity} * (n + m)")
        return met.filter(_possible(similarity)).filter("not arrays_overlap(before, before2)").select("a", "b", "ca", "cb")

    def star_pairs() -> DataFrame:
        order, ranked = F.xxhash64(F.col("rid"), F.lit(r), F.pmod("key", F.lit(1 << r))), posting
        if r == 0:  # the nearest to the middle: most of its prefix is shared
            meets = posting.groupBy("rid").agg((-F.count("*") / F.first(F.expr(f"n - (n * {similarity} + 99) div 100 + 1"))).alias("alone"))
            order, ranked = F.struct("alone", order.alias("hash")), posting.join(meets, "rid")
        lead = ranked.groupBy("key").agg(F.min_by(F.struct("rid", "comp"), order).alias("lead"))
        met = posting.join(lead, "key").filter("comp <> lead.comp")
        turned = F.col("rid") > F.col("lead.rid")
        ends = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(to) for x, y, to in (("rid", "lead.rid", "a"), ("lead.rid", "rid", "b"), ("comp", "lead.comp", "ca"), ("lead.comp", "comp", "cb"))]
        return filtered(met.select(*ends).dropDuplicates(["a", "b"]))

    r, split, (left, size) = 0, False, pairs_left()
    last = left <= min(1, PAIRS_A_ROW) * size
    while True:
        pairs = every_pair().dropDuplicates(["a", "b"]) if last else star_pairs()
        pairs = scratch.save(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs)
        n, confirmed = scratch.count(pairs), 0
        if n:
            found = _verify(scratch, docs, rows, pairs.select("a", "b"), k, similarity)
            confirmed = scratch.count(found)
        if confirmed:
            links = found if links is None else links.unionByName(found)
        if last:
            break
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        if confirmed:
            # only what has been linked now, between the components so far; whole components are sought at the end
            joined = pairs.join(_few(scratch, found), ["a", "b"], "left_semi").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            moved = scratch.save(_nearer(joined))
            relabelled = posting.join(_few(scratch, moved), "comp", "left").withColumn("comp", F.coalesce("into", "comp")).drop("into")
            held, posting = posting, kept(relabelled)
            scratch.drop(held)
        r += 1
        was, (left, size) = left, pairs_left()
        over = r >= ROUNDS or r >= 3 and left > LEFT * was
        if over and not split and left > SPLIT_FROM * size:
            held, posting, split = posting, split_buckets(), True
            scratch.drop(held)
            left, size = pairs_left()
            r, over = 0, False
        last = over or left <= PAIRS_A_ROW * size
    if not same.isEmpty():
        links = same if links is None else links.unionByName(same)
    comp = components(scratch, links) if links is not None else sketch.select(F.col("rid").alias("node"), F.col("rid").alias("comp")).limit(0)
    return (
        rows.select("doc_id", F.col("n").alias("n_shingles"))
        .join(member.select("doc_id", "rid"), "doc_id", "left")
        .join(comp.withColumnRenamed("node", "rid"), "rid", "left")
        .select("doc_id", "n_shingles", F.coalesce("comp", "rid", "doc_id").alias("component_id"))
    )
