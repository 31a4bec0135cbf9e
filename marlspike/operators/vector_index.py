"""A stored approximate index of vectors: inverted lists with residual product codes, re-ranked exactly.

Coarse centroids and codebooks are fitted on a bounded sample. Each vector lies in the
list of its nearest centroid, with the code of what is left of it; lists are
sorted by cell in immutable files, so the cells that a query opens are pushed
down to them. A query ranks what it opens by codes and the best of that
by the vectors themselves. Changes are commits: new rows are appended with a number that
grows, and removed ids are noted with theirs, so the last word on an id counts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.operators.iterate import in_blocks
from marlspike.operators.vector import cosine
from marlspike.sources.commits import Table

#: Bound of the sample that is fitted on, in vectors, and the most cells.
SAMPLE, CELLS = 16_384, 4096
#: Parts of a vector that have a code of a byte each, and values of a code.
PARTS, VALUES = 16, 256
#: Share of the ten nearest vectors of a sample that the opened cells must hold, and vectors that ask for it when the index is built.
WANTED, ASKING = 0.97, 400
#: Queries that are sent to all tasks together.
QUERIES = 1024
#: Scores by codes that a task holds at once.
HELD = 1_000_000
_SCHEMA = "cell int, vec_id bigint, seq bigint, code binary, embedding array<float>"


class Quantizer(NamedTuple):
    """Unit centroids (cells x width) and codebooks (parts x values x width of a part)."""

    centroids: np.ndarray
    books: np.ndarray

    def cells(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each row, nearest first."""
        s = x @ self.centroids.T
        n = min(n, s.shape[1])
        top = np.argpartition(-s, n - 1, axis=1)[:, :n]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), 1, kind="stable"), 1)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = _parts(x - self.centroids[cell], len(self.books))
        out = np.empty((len(x), len(self.books)), np.uint8)
        for p, book in enumerate(self.books):
            out[:, p] = (np.einsum("ij,ij->i", book, book) - 2 * rest[:, p] @ book.T).argmin(1)
        return out

    def packed(self) -> dict:
        return {k: [base64.b64encode(v.astype("<f4").tobytes()).decode(), list(v.shape)] for k, v in zip(self._fields, self, strict=True)}

    @classmethod
    def unpacked(cls, d: dict) -> Quantizer:
        return cls(*(np.frombuffer(base64.b64decode(d[k][0]), "<f4").reshape(d[k][1]) for k in cls._fields))


def _parts(x: np.ndarray, n: int) -> np.ndarray:
    """Rows in ``n`` parts, filled up with zeros."""
    wide = -(-x.shape[1] // n)
    return np.pad(x, ((0, 0), (0, n * wide - x.shape[1]))).reshape(len(x), n, wide)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows without a length stay zero."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0).astype(np.float32)


def _means(x: np.ndarray, k: int, rng, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def fit(sample: np.ndarray, rows: int, seed: int = 0) -> Quantizer:
    """A quantizer for so many rows, fitted on unit vectors: four cells for each root of the rows, of 64 rows or more."""
    rng = np.random.default_rng(seed)
    k = int(max(1, min(CELLS, 4 * np.sqrt(rows), rows / 64, len(sample) / 4)))
    centroids = _means(sample, k, rng)
    rest = _parts(sample - centroids[(sample @ centroids.T).argmax(1)], PARTS)
    books = [_means(np.ascontiguousarray(rest[:, p]), VALUES, rng, 6) for p in range(PARTS)]
    most = max(map(len, books))
    return Quantizer(centroids, np.stack([np.pad(b, ((0, most - len(b)), (0, 0)), mode="edge") for b in books]))


def probes_for(q: Quantizer, sample: np.ndarray, wanted: float = WANTED) -> int:
    """The least number of cells that hold the wanted share of the ten nearest vectors, for vectors of the sample.

    In a sample neighbours lie farther away than among all rows, so this is rather too many than too few.
    """
    asking = sample[:ASKING]
    near = asking @ sample.T
    near[np.arange(len(asking)), np.arange(len(asking))] = -np.inf
    n = min(10, len(sample) - 1)
    if n < 1:
        return 1
    nearest = np.argpartition(-near, n - 1, axis=1)[:, :n]
    order = q.cells(asking, len(q.centroids))
    place = np.argsort(order, 1)  # of each cell in the order in which it would be opened
    at = np.sort(np.take_along_axis(place, q.cells(sample, 1)[:, 0][nearest], 1).ravel())
    return int(at[int(np.ceil(wanted * len(at))) - 1]) + 1


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), width)


class VectorIndex:
    """See the module. ``root`` is a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.table = Table(spark, root, _SCHEMA)

    def _checked(self, vectors: DataFrame, width: int) -> DataFrame:
        """Rows that can be stored; one of another size is refused, one that is null, holds nulls or is not finite has no place."""
        other = vectors.filter(F.size("embedding") != width).select("vec_id").head()
        if other is not None:
            raise ValueError(f"vector {other[0]} does not have {width} components")
        sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter(F.col("vec_id").isNotNull() & sound)

    def _coded(self, vectors: DataFrame, q: Quantizer, seq: int) -> DataFrame:
        """Rows of the lists, sorted by cell within files that are cut by cell and id, so that a large cell lies in several."""
        width = q.centroids.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = unit(_rows(b.column(1), width))
                    cell = q.cells(x, 1)[:, 0]
                    codes = [c.tobytes() for c in q.codes(x, cell)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell, pa.int32()), b.column(0), pa.array(np.full(len(cell), seq), pa.int64()), pa.array(codes, pa.binary()), b.column(1)], ["cell", "vec_id", "seq", "code", "embedding"]
                    )

        return vectors.mapInArrow(run, _SCHEMA).repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")

    def build(self, vectors: DataFrame, dimensions: int, seed: int = 0) -> VectorIndex:
        """The index of ``vectors(vec_id, embedding)``, in place of what is there. Of rows with one id the first by components stays."""
        given = self._checked(vectors, dimensions).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        n = given.count()
        drawn = given.orderBy(F.xxhash64("embedding")).limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
        q = fit(unit(_rows(drawn, dimensions)), n, seed) if len(drawn) else Quantizer(np.zeros((1, dimensions), np.float32), np.zeros((PARTS, 1, -(-dimensions // PARTS)), np.float32))
        name = self.table.write(self._coded(given, q, 0))
        probes = probes_for(q, unit(_rows(drawn, dimensions))) if len(drawn) else 1
        properties = {"width": dimensions, "quantizer": q.packed(), "seq": 0, "probes": probes}
        self.table.commit(lambda s: {"add": {name: {}}, "remove": list(s.folders), "properties": properties})
        return self

    def add(self, vectors: DataFrame) -> None:
        """Rows that are new, or take the place of those with their ids. Only these are written."""
        p = self.table.state().properties
        given = self._checked(vectors, p["width"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        self._append(lambda seq: self._coded(given, Quantizer.unpacked(p["quantizer"]), seq), p["quantizer"])

    def remove(self, ids: DataFrame) -> None:
        """Ids that are no longer found."""
        p = self.table.state().properties
        none = lambda t: F.lit(None).cast(t)
        given = ids.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct()
        self._append(lambda seq: given.select(F.lit(-1).alias("cell"), "vec_id", F.lit(seq).cast("bigint").alias("seq"), none("binary").alias("code"), none("array<float>").alias("embedding")), p["quantizer"])

    def _append(self, rows, quantizer: dict) -> None:
        """Rows with the next number. Who is overtaken by another writer writes them anew with a later one."""
        while True:
            state = self.table.state()
            seq = state.properties["seq"] + 1
            if state.properties["quantizer"] != quantizer:
                raise ValueError("the index was rebuilt meanwhile")
            name = self.table.write(rows(seq))

            def make(now, name=name, seq=seq):
                return {} if now.properties["seq"] >= seq else {"add": {name: {"seq": seq}}, "properties": {"seq": seq}}

            self.table.commit(make)
            if name in self.table.state().folders:
                return

    def _last_words(self, lists: DataFrame) -> DataFrame:
        """The last number of each id that was added or removed after the index was built: as many rows as changed since."""
        return lists.filter("seq > 0").groupBy("vec_id").agg(F.max("seq").alias("last"))

    def rows(self) -> DataFrame:
        """``vec_id, embedding`` of what is in the index."""
        lists = self.table.read()
        met = lists.join(self._last_words(lists), "vec_id", "left").filter(F.col("seq") == F.coalesce("last", F.lit(0)))
        return met.filter("cell >= 0").select("vec_id", "embedding")

    def rebuild(self, seed: int = 0) -> None:
        """Fit anew on what is there and write it without what is gone."""
        state = self.table.state()
        rows, width = self.rows(), state.properties["width"]
        self.build(rows, width, seed)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, again: int = 10) -> DataFrame:
        """``query_id, vec_id, score, rank`` of about the ``k`` nearest by cosine for each of ``queries(query_id, query)``.

        ``probes`` cells are opened for a query (unless given, as many as the sample asked for when the index was
        built) and ``again * k`` rows ranked exactly. Queries go to all tasks in blocks of at most ``QUERIES``.
        Those of another size are refused; null ones find nothing.
        """
        state = self.table.state()
        q, width = Quantizer.unpacked(state.properties["quantizer"]), state.properties["width"]
        lists, probes = self.table.read(state), probes or state.properties["probes"]
        queries = queries.filter("query is not null").select("query_id", F.col("query").cast("array<double>").alias("query"))
        if (other := queries.filter(F.size("query") != width).select("query_id").head()) is not None:
            raise ValueError(f"query {other[0]} does not have {width} components")
        best = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
        last = self._last_words(lists)
        changed = state.properties["seq"] > 0
        out = None
        for block in in_blocks(queries, "query_id", QUERIES):
            t = block.toArrow()
            ids, x = t["query_id"].to_pylist(), unit(_rows(t["query"].combine_chunks(), width)) if len(t) else np.zeros((0, width), np.float32)
            opened = q.cells(x, probes)
            sent = self.spark.sparkContext.broadcast((q, ids, x, opened))
            schema = f"query_id {dict(queries.dtypes)['query_id']}, cell int, vec_id bigint, seq bigint, near float"
            wanted = lists.filter(F.col("cell").isin(sorted(set(opened.ravel().tolist()))))
            near = wanted.select("cell", "vec_id", "seq", "code").mapInArrow(_ranked(sent, again * k, schema), schema)
            if changed:  # the last word on an id counts
                near = near.join(last, "vec_id", "left").filter(F.col("seq") == F.coalesce("last", F.lit(0))).drop("last")
            near = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= again * k).select("query_id", "cell", "vec_id", "seq")
            met = wanted.select("cell", "vec_id", "seq", "embedding").join(near, ["cell", "vec_id", "seq"]).join(F.broadcast(block), "query_id")
            part = met.select("query_id", "vec_id", cosine(F.col("embedding"), F.col("query")).alias("score"))
            out = part if out is None else out.unionByName(part)
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
        return out.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


def _ranked(sent, most: int, schema: str):
    """Of each batch the rows that are nearest to each query by their codes, ``most`` at most."""
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids, x, opened = sent.value
        parts = _parts(x, len(q.books))
        by_cell: dict[int, np.ndarray] = {int(c): np.flatnonzero((opened == c).any(1)) for c in np.unique(opened)}
        for b in batches:
            cell, number = b.column("cell").to_numpy(), b.column("vec_id").to_numpy()
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for c in np.unique(cell):
                at, every = np.flatnonzero(cell == c), by_cell.get(int(c))
                if every is None:
                    continue
                at = at[np.argsort(number[at], kind="stable")]
                codes = np.frombuffer(b"".join(b.column("code").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                step = max(1, HELD // len(at))
                for i in range(0, len(every), step):  # some queries at a time, of which only the nearest rows are kept
                    who = every[i : i + step]
                    near = np.repeat((x[who] @ q.centroids[c])[:, None], len(at), 1)
                    for p, book in enumerate(q.books):
                        near += (parts[who, p] @ book.T)[:, codes[:, p]]
                    first = np.argsort(-near, 1, kind="stable")[:, :most]
                    found.append((np.repeat(who, first.shape[1]), at[first].ravel(), np.take_along_axis(near, first, 1).ravel()))
            if not found:
                continue
            who, at, near = (np.concatenate(f) for f in zip(*found, strict=True))
            order = np.lexsort((number[at], -near, who))
            who, at, near = who[order], at[order], near[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            keep = place < most
            who, at, near = who[keep], at[keep], near[keep]
            columns = [pa.array([ids[i] for i in who], fields.field(0).type), *(b.column(n).take(pa.array(at)) for n in ("cell", "vec_id", "seq")), pa.array(near, pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, fields.names)

    return run


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``queries, expected, found``: how many of the exact neighbours ``(query_id, vec_id)`` were found."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    met = exact.join(hit, ["query_id", "vec_id"], "left")
    return met.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("expected"), F.count("hit").alias("found"))
