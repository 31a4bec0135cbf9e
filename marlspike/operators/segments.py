"""A lexical index that follows its documents: segments in immutable files, removals noted, merged by size.

A segment holds the postings of the documents that were added together, by kind and
term, with their places, and a row for each document; a posting that is the same for a
term and its stem stands once. What is added later with
the same id takes the place of what was there; removed ids are rows too. So the last word
on an id counts, and only ids that changed since the oldest segment have to be asked
for theirs. Numbers of documents and frequencies follow changes exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.text import terms
from marlspike.operators.lexical import Index, by_term, placed_postings
from marlspike.sources.commits import Conflict, Table

#: Segments of one size class that are merged, and how much larger the next class is.
MERGED, FACTOR = 4, 4
_SCHEMA = "kind string, term string, doc_id bigint, tf bigint, dl bigint, places array<int>, seq bigint"
#: Places farther apart than this add nothing to a score by place.
FAR = 100


#: Changed ids up to which they are broadcast: two longs each, some 200 MB at most. With more, the join shuffles.
BROADCAST_IDS = 4_000_000


class SegmentedIndex:
    """See the module. ``root`` is a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.table = spark, Table(spark, root, _SCHEMA)

    def add(self, docs: DataFrame) -> None:
        """Documents ``(doc_id, text)`` that are new or have changed. A null text has no terms; ids are not null and stand once."""
        given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        none = lambda t: F.lit(None).cast(t)
        found = placed_postings(given, shared=True)
        rows = given.select(F.lit("doc").alias("kind"), none("string").alias("term"), "doc_id", none("bigint").alias("tf"), F.size(terms(F.col("text"))).cast("bigint").alias("dl"), none("array<int>").alias("places"))
        self._append(found.unionByName(rows))

    def remove(self, ids: DataFrame) -> None:
        none = lambda t: F.lit(None).cast(t)
        self._append(ids.select(F.lit("gone").alias("kind"), none("string").alias("term"), F.col("doc_id").cast("bigint").alias("doc_id"), none("bigint").alias("tf"), none("bigint").alias("dl"), none("array<int>").alias("places")).distinct())

    def _append(self, rows: DataFrame) -> None:
        """A segment under the next number; who is overtaken by another writer writes it anew under a later one."""
        while True:
            seq = self.table.state().properties.get("seq", -1) + 1
            name = self.table.write(by_term(rows.withColumn("seq", F.lit(seq).cast("bigint"))))
            notes = self._notes(name)

            def make(now, name=name, seq=seq, notes=notes):
                return {} if now.properties.get("seq", -1) >= seq else {"add": {name: notes}, "properties": {"seq": seq}}

            self.table.commit(make)
            if name in self.table.state().folders:
                return

    def _notes(self, name: str) -> dict:
        r = self.table.read(folders=[name]).agg(F.count("*"), F.min("seq"), F.max("seq"), F.count_if(F.col("kind") == "doc"), F.sum(F.when(F.col("kind") == "doc", F.col("dl")))).first()
        return dict(zip(("rows", "first", "last", "n_docs", "length"), (x or 0 for x in r), strict=True))

    def _words(self, state) -> tuple[DataFrame, DataFrame]:
        """All rows, and ``doc_id, last``: the last number of each id that was added or removed more than once; broadcast unless there are very many."""
        every = self.table.read(state)
        oldest = min((n["first"] for n in state.folders.values()), default=0)
        if all(n["last"] <= oldest for n in state.folders.values()):
            return every, every.select("doc_id", F.col("seq").alias("last")).limit(0)
        said = every.filter(F.col("kind").isin("doc", "gone")).groupBy("doc_id").agg(F.max("seq").alias("last"), F.min("seq").alias("first"))
        changed = said.filter("first < last").select("doc_id", "last")
        return every, F.broadcast(changed) if changed.count() <= BROADCAST_IDS else changed

    def _live(self, rows: DataFrame, last: DataFrame) -> DataFrame:
        return rows.join(last, "doc_id", "left").filter(F.col("last").isNull() | (F.col("seq") >= F.col("last"))).drop("last")

    def index(self) -> Index:
        """What searches take; a filter for terms reaches the files through it."""
        state = self.table.state()
        every, last = self._words(state)
        of = lambda k: every.filter(F.col("kind").isin(k, "both")).withColumn("kind", F.lit(k))
        postings = self._live(of("raw").unionByName(of("stem")), last).select("kind", "term", "doc_id", "tf", "dl", "places")
        vocabulary = postings.groupBy("kind", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        # what the segments noted, less the documents that are no longer the last word on their ids
        n, length = (sum(x[k] for x in state.folders.values()) for k in ("n_docs", "length"))
        dead = every.filter("kind = 'doc'").join(last, "doc_id").filter("seq < last").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
        totals = dead.select((F.lit(n) - F.col("n")).alias("n_docs"), ((F.lit(length) - F.col("dl")) / F.nullif(F.lit(n) - F.col("n"), F.lit(0))).alias("avgdl"))
        return Index(postings, vocabulary, totals)

    def merge(self) -> int:
        """Merge segments of one size class where there are enough of them; returns how many were merged. Other segments are not touched."""
        state = self.table.state()
        by_size: dict[int, list[str]] = {}
        for name, n in state.folders.items():
            size, k = max(1, n["rows"]), 0
            while size >= FACTOR:
                size, k = size // FACTOR, k + 1
            by_size.setdefault(k, []).append(name)
        for _, names in sorted(by_size.items()):
            if len(names) < MERGED:
                continue
            every, last = self._words(state)
            kept = self._live(self.table.read(folders=names), last)
            if min(state.folders, key=lambda f: state.folders[f]["first"]) in names:
                # no older segment is left in which a removed id could stand
                others = self.table.read(folders=[f for f in state.folders if f not in names]).select("doc_id").distinct()
                kept = kept.filter("kind <> 'gone'").unionByName(kept.filter("kind = 'gone'").join(others, "doc_id", "left_semi"))
            name = self.table.write(by_term(kept.select(*every.columns)))
            notes = self._notes(name)
            try:
                self.table.commit(lambda _, name=name, notes=notes, names=names: {"add": {name: notes}, "remove": names})
            except Conflict:  # someone else has merged them
                return 0
            return len(names)
        return 0


def by_place(index: Index, asked: list[str]) -> DataFrame:
    """``doc_id, score`` of documents that hold all of some stems, by how near these stand to each other.

    Two places of different stems that are d apart weigh
    w(d) = 0.1 / sqrt(1.005 + 0.05 exp(d / 1.5 - 2)) up to 100 places; the score is one less the product of all
    (1 - w). A single stem of n places scores 0.1 (1 + 1/4 + ... + 1/n^2) / 1.64493406685.
    Places meet within neighbouring stretches of a document, so no document
    is one group. No text is read.
    """
    asked = sorted(set(asked))
    hit = index.postings.filter((F.col("kind") == "stem") & F.col("term").isin(asked)).select("doc_id", "term", "places")
    if len(asked) == 1:
        squares = F.aggregate(F.sequence(F.lit(1), F.size("places")), F.lit(0.0), lambda s, n: s + 1 / (n.cast("double") * n))
        return hit.select("doc_id", (0.1 * squares / 1.64493406685).alias("score"))
    whole = hit.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(asked)).select("doc_id")
    place = hit.join(whole, "doc_id").select("doc_id", "term", F.explode("places").alias("place"))
    stretch = F.floor(F.col("place") / (FAR + 1))
    left = place.select("doc_id", F.col("term").alias("a"), F.col("place").alias("p"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    right = place.select("doc_id", F.col("term").alias("b"), F.col("place").alias("q"), stretch.alias("stretch"))
    far = F.abs(F.col("p") - F.col("q"))
    near = left.join(right, ["doc_id", "stretch"]).filter((F.col("a") < F.col("b")) & (far <= FAR))
    weight = 0.1 / F.sqrt(1.005 + 0.05 * F.exp(far / 1.5 - 2))
    scored = near.groupBy("doc_id").agg((1 - F.exp(F.sum(F.log(1 - weight)))).alias("score"))
    return whole.join(scored, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
