"""Embedding near-dedup with a robust-pruned flat graph.

1. Equal vectors are one *class*, with a number of its own in the order of its hash.
2. Centroids fitted on a bounded sample deal the classes to cells, each to its
   nearest. Cells over ``MOST`` are dealt anew by centroids of their own, and
   cut by hash where nothing separates them, so a cell fits one task at any size
   of input.
3. Each cell builds a graph by insertion, in batches that never exceed what the
   graph holds: the graph so far is searched for a vector's candidates; these, the
   nearest of its batch and some at random are robust-pruned; edges lead back too.
4. Each cell searches its graph: from the nearest medoids greedily with a
   beam, then, from whatever lies in range, along edges as long as more does.
   The cell audits itself against brute force on a part of its vectors and
   doubles the beam until the wanted recall is reached. A cell with very many
   links is compared with itself in blocks instead.
5. Vectors of different cells are compared in blocks, every pair of cells once,
   except for vectors that lie too far from a cell's centre to reach any of it
   (by the triangle inequality). This step is exact: no link between cells is lost.
6. Pairs are verified in double precision. Tasks return counts and a spanning
   forest, never pairs.

Step 5 takes time with the square of the number of vectors where they are spread
so widely that distance from centres excludes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import Scratch, components

#: Vectors that a cell should and may hold.
WANTED, MOST = 2048, 8192
#: Bound of the sample on which a set of centroids is fitted, in vectors, and the most centroids in a set.
SAMPLE, CENTROIDS = 16_384, 512
#: Edges kept by pruning, candidates (found, of the same batch, random), and how much shorter a detour must be to prune.
DEGREE, NEAREST, MATES, RANDOM, ALPHA = 32, 48, 16, 16, 1.2
#: Vectors that a graph begins with, and that are inserted or searched for together.
BEGIN, TOGETHER = 64, 512
#: Beam at first, the share of a cell that is audited, and the recall it must show.
BEAM, AUDITED, RECALL = 32, 0.02, 0.98
#: Links (each from both ends) from which on a cell is compared in blocks, pairs in a block, and bytes of vectors sent to all tasks at once.
DENSE, BLOCK, HELD = 1 << 22, 1 << 21, 1 << 23


class NearDuplicates(NamedTuple):
    """``rows``: vec_id, n_links, component_id, kept. ``audit``: cell, n, beam, audited, expected, found."""

    rows: DataFrame
    audit: DataFrame


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids(x: np.ndarray, k: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """At most k unit centroids of unit vectors, by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.linalg.norm(sums, axis=1)
        c = np.where(n[:, None] > 1e-9, sums / np.maximum(n, 1e-9)[:, None], c)
    return c


def _stack(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _pruned(f: np.ndarray, nodes: np.ndarray, c: np.ndarray) -> np.ndarray:
    """At most DEGREE of each node's candidates (-1 for none), nearest first, without those that one taken before leads to more shortly."""
    out = np.full((len(nodes), DEGREE), -1, np.int32)
    d = 1 - np.einsum("ij,ikj->ik", f[nodes], f[c])
    d[(c == nodes[:, None]) | (c < 0)] = np.inf
    order = np.argsort(d, 1, kind="stable")
    c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
    v = f[c]
    between = 1 - v @ v.transpose(0, 2, 1)
    alive, row = np.isfinite(d), np.arange(len(nodes))
    for r in range(DEGREE):
        j = alive.argmax(1)
        ok = alive[row, j]
        if not ok.any():
            break
        out[ok, r] = c[row[ok], j[ok]]
        alive[row, j] = False
        # squared distances of unit vectors are 2 - 2 cos: alpha applies to distances
        alive &= ~((ALPHA**2 * between[row, j] <= d) & ok[:, None])
    return out


def build(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The graph of unit vectors as offsets and targets, with edges both ways."""
    n, f, rng = len(x), x.astype(np.float32), np.random.default_rng(seed)
    near = np.full((n, DEGREE), -1, np.int32)
    order = rng.permutation(n)
    done = min(n, BEGIN)
    near[order[:done]] = _pruned(f, order[:done], np.broadcast_to(order[:done], (done, done)))
    while True:
        src, dst = np.repeat(np.arange(n), DEGREE), near.ravel().astype(np.int64)
        starts, targets = _lists(np.concatenate([src, dst]), np.concatenate([dst, src]), n)
        if done == n:
            return starts, targets
        batch = order[done : done + min(done, TOGETHER)]
        found = _beam(f, starts, targets, order[:BEGIN], f[batch], NEAREST)[0]
        mates = f[batch] @ f[batch].T
        mates = batch[np.argpartition(-mates, min(MATES, len(batch) - 1), axis=1)[:, :MATES]]
        drawn = order[rng.integers(0, done, (len(batch), RANDOM))]
        near[batch] = _pruned(f, batch, np.concatenate([found, mates, drawn], 1))
        done += len(batch)


def _lists(pairs_from: np.ndarray, pairs_to: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct edges of n nodes as offsets and targets."""
    keep = (pairs_from != pairs_to) & (pairs_from >= 0) & (pairs_to >= 0)
    code = np.unique(pairs_from[keep].astype(np.int64) * n + pairs_to[keep])
    return np.searchsorted(code, np.arange(n + 1) * n), (code % n).astype(np.int32)


def _expand(starts: np.ndarray, targets: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``nodes`` its targets: (index into nodes, target)."""
    size = starts[nodes + 1] - starts[nodes]
    of = np.repeat(np.arange(len(nodes)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[nodes], size)
    return of, targets[at]


def _beam(f: np.ndarray, starts: np.ndarray, targets: np.ndarray, entry: np.ndarray, fq: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Greedy search for each row of ``fq``: the ``beam`` nearest nodes found (-1 for none), which nodes were seen, and all that was met as (query, node, cosine)."""
    m, row = len(fq), np.arange(len(fq))
    seen = np.zeros((m, len(f)), bool)
    s = fq @ f[entry].T
    width = min(beam, len(entry))
    top = np.argpartition(-s, width - 1, axis=1)[:, :width]
    seen[row[:, None], entry[top]] = True
    ids = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -np.inf, np.float32)
    ids[:, :width], sims[:, :width] = entry[top], np.take_along_axis(s, top, 1)
    opened = np.zeros((m, beam), bool)
    met = [(np.repeat(row, width), ids[:, :width].ravel(), sims[:, :width].ravel())]
    while True:
        best = np.where(opened | (ids < 0), -np.inf, sims)
        j = best.argmax(1)
        go = row[best[row, j] > -np.inf]
        if not len(go):
            return ids, seen, met
        opened[go, j[go]] = True
        of, to = _expand(starts, targets, ids[go, j[go]])
        who = go[of]
        new = ~seen[who, to]
        who, to = who[new], to[new]
        seen[who, to] = True
        sim = np.einsum("ij,ij->i", fq[who], f[to])
        met.append((who, to, sim))
        if not len(who):
            continue
        count = np.bincount(who, minlength=m)
        place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        wide = int(count.max())
        more_ids, more = np.full((m, wide), -1, np.int64), np.full((m, wide), -np.inf, np.float32)
        more_ids[who, place], more[who, place] = to, sim
        all_ids, all_sims = np.concatenate([ids, more_ids], 1), np.concatenate([sims, more], 1)
        all_open = np.concatenate([opened, np.zeros((m, wide), bool)], 1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids, sims, opened = (np.take_along_axis(a, keep, 1) for a in (all_ids, all_sims, all_open))


def search(x: np.ndarray, starts: np.ndarray, targets: np.ndarray, medoids: np.ndarray, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of a cell with cosine >= threshold that the graph search finds."""
    n, f = len(x), x.astype(np.float32)
    low = np.float32(threshold - 1e-5)
    outs: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(queries), TOGETHER):
        q = queries[i : i + TOGETHER]
        _, seen, met = _beam(f, starts, targets, medoids, f[q], beam)
        inside = [s >= low for _, _, s in met]
        fq, fn = (np.concatenate([x[k][ok] for x, ok in zip(met, inside, strict=True)]) for k in (0, 1))
        del met
        got_q, got_n = [fq], [fn]
        while len(fq):  # range expansion: what lies in range leads on to what else does
            next_q, next_n = [], []
            for k in range(0, len(fq), 20_000):
                of, to = _expand(starts, targets, fn[k : k + 20_000])
                who = fq[k : k + 20_000][of]
                new = ~seen[who, to]
                code = np.unique(who[new].astype(np.int64) * n + to[new])
                who, to = code // n, code % n
                seen[who, to] = True
                inside = np.einsum("ij,ij->i", f[q[who]], f[to]) >= low
                next_q.append(who[inside])
                next_n.append(to[inside])
            fq, fn = np.concatenate(next_q), np.concatenate(next_n)
            got_q.append(fq)
            got_n.append(fn)
        a, b = q[np.concatenate(got_q)], np.concatenate(got_n)
        true = _true(x, a, b, threshold)
        outs.append((a[true], b[true]))
    return np.concatenate([a for a, _ in outs]), np.concatenate([b for _, b in outs])


def _true(x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold in double precision."""
    return np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 50_000]], x[b[i : i + 50_000]]) >= threshold for i in range(0, len(a), 50_000)] or [np.empty(0, bool)])


def _hits(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of a block of unit vectors reach the threshold: in single precision, in double where that is unsure."""
    s = x.astype(np.float32) @ y.astype(np.float32).T
    hit = s >= np.float32(threshold + 1e-5)
    a, b = np.nonzero((s >= np.float32(threshold - 1e-5)) & ~hit)
    for i in range(0, len(a), 50_000):
        p, q = a[i : i + 50_000], b[i : i + 50_000]
        hit[p, q] = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
    return hit


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least of its component over edges (a, b)."""
    root = np.arange(n)
    while True:  # least index over all pairs, with pointers halved, until nothing moves
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


class _Tally:
    """Links and roots of nodes, which may be added, from one block of hits after another."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.links, self.root = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def grow(self, weights: np.ndarray) -> int:
        n = len(self.root)
        self.weights = np.concatenate([self.weights, weights])
        self.links = np.concatenate([self.links, np.zeros(len(weights), np.int64)])
        self.root = np.concatenate([self.root, n + np.arange(len(weights))])
        return n

    def add(self, rows: np.ndarray, cols: np.ndarray, hit: np.ndarray, both: bool = True) -> None:
        """Count ``hit`` for its rows and, if ``both``, its columns; each is a node in one row or column only."""
        i, j = np.nonzero(hit)
        if not len(i):
            return
        a, b = rows[i], cols[j]
        self.links[rows] += np.bincount(i, self.weights[b], len(rows)).astype(np.int64)
        if both:
            self.links[cols] += np.bincount(j, self.weights[a], len(cols)).astype(np.int64)
        p, q = self.root[a], self.root[b]
        new = p != q
        if new.any():
            nodes, at = np.unique(np.concatenate([p[new], q[new]]), return_inverse=True)
            to = np.arange(len(self.root))
            to[nodes] = nodes[_roots(len(nodes), *np.split(at, 2))]
            self.root = to[self.root]


def _cells(kind: str, sets):
    """Deal vectors to the nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rid, w, vec = b.columns
                to = (unit(_stack(vec.to_pylist(), kind)) @ sets.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([rid, w, vec, pa.array(to, pa.int64())], ["rid", "w", "vec", "cell"])

    return run


def _deal_anew(kind: str):
    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(_stack(pdf["vec"], kind))
        k = int(min(64, max(2, pdf["size"].iloc[0] // WANTED)))
        c = centroids(x, k)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "centers": [c.tobytes()], "k": [len(c)]})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, w, vec, cell, centers, k = b.columns
            to = []
            for v, c, n in zip(vec.to_pylist(), centers.to_pylist(), k.to_pylist(), strict=True):
                to.append(int((unit(_stack([v], kind)) @ np.frombuffer(c).reshape(n, -1).T).argmax()))
            yield pa.RecordBatch.from_arrays([rid, w, vec, cell, pa.array(to, pa.int64())], ["rid", "w", "vec", "cell", "to"])

    return train, deal


def _searched(kind: str, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        rid, w = pdf["rid"].to_numpy(np.int64), pdf["w"].to_numpy(np.int64)
        n, cell = len(rid), int(pdf["cell"].iloc[0])
        x = unit(_stack(pdf["vec"], kind))
        every = np.arange(n)
        audit = np.unique(np.linspace(0, n - 1, max(1, int(np.ceil(AUDITED * n)))).astype(int))
        truth = int(((x[audit] @ x.T) >= threshold).sum()) - len(audit)
        tally = _Tally(w)
        if truth * n >= DENSE * len(audit):
            beam, found, step = n, truth, max(1, BLOCK // n)
            for i in range(0, n, step):
                part = every[i : i + step]
                hit = _hits(x[part], x, threshold)
                hit[np.arange(len(part)), part] = False
                tally.add(part, every, hit, both=False)
            links, root = tally.links, tally.root
        else:
            starts, targets = build(x)
            c = centroids(x, max(1, int(4 * np.sqrt(n))), rounds=3)
            medoids = np.unique((c @ x.T).argmax(1))
            beam = min(BEAM, max(1, n - 1))
            while True:  # the widest beam holds the whole cell
                a, b = search(x, starts, targets, medoids, audit, threshold, beam)
                found = int((a != b).sum())
                if found >= RECALL * truth or beam >= n:
                    break
                beam = min(n, 2 * beam)
            a, b = search(x, starts, targets, medoids, every, threshold, beam)
            code = np.unique(np.minimum(a, b)[a != b].astype(np.int64) * n + np.maximum(a, b)[a != b])
            a, b = code // n, code % n
            links = np.bincount(a, weights=w[b], minlength=n) + np.bincount(b, weights=w[a], minlength=n)
            root = _roots(n, a, b)
        out = pd.DataFrame({"rid": rid, "links": links.astype(np.int64), "root": rid[root]})
        return out.assign(cell=cell, n=n, beam=beam, audited=len(audit), expected=truth, found=found)

    return run


def _compared(kind: str, threshold: float, held):
    """Links between the given vectors and those of other cells in ``held`` (cell, rid, w, vectors, by cell), each pair of cells from one side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rid, w, vec = held.value
        y = unit(vec)
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        end, name = np.append(start[1:], len(cell)), cell[start]
        center = np.add.reduceat(y, start)
        size = np.linalg.norm(center, axis=1, keepdims=True)
        center = np.where(size > 1e-9, center / np.maximum(size, 1e-9), y[start])
        radius = [np.arccos(np.clip((y[s:e] @ c).min(), -1, 1)) for s, e, c in zip(start, end, center, strict=True)]
        reach = np.cos(np.minimum(np.pi, np.array(radius) + np.arccos(threshold) + 1e-5))
        tally, ids = _Tally(w), [rid]
        for b in batches:
            if not b.num_rows:
                continue
            here, weight, own = (b.column(c).to_numpy() for c in ("rid", "w", "cell"))
            x = unit(_stack(b.column("vec").to_pylist(), kind))
            first = tally.grow(weight)
            ids.append(here)
            side = (own[:, None] < name) ^ ((own[:, None] ^ name) & 1).astype(bool)  # half of the others, evenly for all cells
            near = (own[:, None] != name) & side & (x @ center.T >= reach)
            for k in np.flatnonzero(near.any(0)):
                rows, cols = np.flatnonzero(near[:, k]), np.arange(start[k], end[k])
                step = max(1, BLOCK // len(cols))
                for i in range(0, len(rows), step):
                    part = rows[i : i + step]
                    tally.add(first + part, cols, _hits(x[part], y[cols], threshold))
        ids = np.concatenate(ids)
        linked = np.flatnonzero(tally.links)
        for i in range(0, len(linked), 50_000):
            part = linked[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[part], tally.links[part], ids[tally.root[part]])], ["rid", "links", "root"])

    return run


def _across(scratch: Scratch, placed: DataFrame, n: int, kind: str, width: int, threshold: float) -> DataFrame | None:
    """``rid, links, root`` over pairs of vectors in different cells; None if there is one cell.

    Some cells at a time go to all tasks, in a bounded number of bytes.
    """
    spark = placed.sparkSession
    sizes = sorted((r["cell"], r["n"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect())  # a row for WANTED vectors or so
    if len(sizes) < 2:
        return None
    room = max(MOST, HELD // (width * int(kind[-1])))
    parts = max(2 * spark.sparkContext.defaultParallelism, n >> 15)
    sorted_ = scratch.save(placed.repartitionByRange(parts, "cell").sortWithinPartitions("cell"))
    at, paths, schema = 0, [], "rid bigint, links bigint, root bigint"
    while at < len(sizes):
        total, stop = 0, at
        while stop < len(sizes) and (stop == at or total + sizes[stop][1] <= room):
            total += sizes[stop][1]
            stop += 1
        t = sorted_.filter(F.col("cell").between(sizes[at][0], sizes[stop - 1][0])).select("cell", "rid", "w", "vec").toArrow().sort_by([("cell", "ascending"), ("rid", "ascending")])
        held = spark.sparkContext.broadcast((*(t[c].to_numpy() for c in ("cell", "rid", "w")), _stack(t["vec"].to_pylist(), kind)))
        paths.append(scratch.path(scratch.save(sorted_.mapInArrow(_compared(kind, threshold, held), schema))))
        held.destroy()
        at = stop
    return spark.read.schema(schema).parquet(*paths)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9) -> NearDuplicates:
    """Links of cosine >= ``threshold`` among ``vectors(vec_id, embedding)``: one row for each row.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    least vec_id reachable, ``kept`` says they are equal. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing and
    keep their rows, as do rows with a null vec_id (component_id null, kept
    false). A shorter vector counts as followed by zeros. Of equally near centres
    the first takes a vector, which changes no link. Rows may repeat; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    double = "array<double>" in dict(vectors.dtypes)["embedding"]
    kind = "<f8" if double else "<f4"
    value = F.col("embedding").cast("array<double>" if double else "array<float>")
    key = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit("second"), "embedding").alias("k2")]
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), value.alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.select("vec_id", "embedding", valid.alias("valid"), *key)
    good = rows.filter("valid")
    width = good.agg(F.max(F.size("embedding"))).first()[0]
    alone = rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    none = spark.createDataFrame([], "cell bigint, n bigint, beam bigint, audited bigint, expected bigint, found bigint")
    if width is None:
        return NearDuplicates(alone, none)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.pad(np.asarray(v, kind), (0, width - len(v))).tobytes() for v in b.columns[2].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(raw, pa.binary())], ["rid", "w", "vec"])

    classes = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("rid"), F.count("*").alias("w"), F.first("embedding").alias("embedding"))
    # a vec_id may lead several classes, so the number of a class is its own; it grows with the hash in every run
    numbered = classes.sort("k1", "k2").withColumn("node", F.monotonically_increasing_id())
    member = scratch.save(numbered.select("k1", "k2", "node", "rid", "w", "embedding"))
    reps = scratch.save(member.select("node", "w", "embedding").mapInArrow(packed, "rid bigint, w bigint, vec binary"))
    n = reps.count()
    size = min(SAMPLE, max(1, (1 << 23) // width))
    drawn = reps.select("vec").orderBy(F.xxhash64("vec", F.lit("sample"))).limit(size).toPandas()
    k = int(min(CENTROIDS, max(1, -(-n // WANTED))))
    first = spark.sparkContext.broadcast(centroids(unit(_stack(drawn["vec"], kind)), k))  # at most CENTROIDS vectors
    vec = "rid bigint, w bigint, vec binary"
    dealt = scratch.save(reps.mapInArrow(_cells(kind, first), f"{vec}, cell bigint"))
    train, deal = _deal_anew(kind)
    done: list[DataFrame] = []
    largest = None
    while True:
        sizes = dealt.groupBy("cell").agg(F.count("*").alias("size"))
        large = scratch.save(sizes.filter(F.col("size") > MOST))
        most = large.agg(F.max("size")).first()[0]
        if most is None:
            done.append(dealt)
            break
        done.append(dealt.join(large, "cell", "left_anti"))
        left = dealt.join(large, "cell")
        if largest is not None and most > 0.9 * largest:  # nothing separates what is left: cut
            piece = F.pmod(F.xxhash64("vec", F.lit("piece")), F.ceil(F.col("size") / WANTED))
            done.append(left.select("rid", "w", "vec", F.xxhash64("cell", piece).alias("cell")))
            break
        largest = most
        share = F.pmod(F.xxhash64("vec", "cell"), F.lit(1 << 30)) * F.col("size") < F.lit(2048 * (1 << 30))
        sets = left.filter(share).groupBy("cell").applyInPandas(train, "cell bigint, centers binary, k bigint")
        anew = left.join(sets, "cell").select("rid", "w", "vec", "cell", "centers", "k").mapInArrow(deal, f"{vec}, cell bigint, to bigint")
        dealt = scratch.save(anew.select("rid", "w", "vec", F.xxhash64("cell", "to").alias("cell")))
    placed = done[0].select("rid", "w", "vec", "cell")
    for d in done[1:]:
        placed = placed.unionByName(d.select("rid", "w", "vec", "cell"))
    placed = scratch.save(placed) if len(done) > 1 else placed

    schema = "rid bigint, links bigint, root bigint, cell bigint, n bigint, beam bigint, audited bigint, expected bigint, found bigint"
    within = scratch.save(placed.groupBy("cell").applyInPandas(_searched(kind, threshold), schema))
    found = within.select("rid", "links", "root")
    if (across := _across(scratch, placed, n, kind, width, threshold)) is not None:
        found = found.unionByName(across)
    comp = components(scratch, found.select(F.col("rid").alias("a"), F.col("root").alias("b")).filter("a <> b"))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    by = links.join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumnRenamed("rid", "node")
    ids = member.select("k1", "k2", "node", "rid", "w").join(by, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = scratch.save(ids.select("k1", "k2", "rid", "comp", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.lit(True).alias("valid")))
    least = ids.groupBy("comp").agg(F.min("rid").alias("component_id"))
    ids = ids.join(least, "comp").select("k1", "k2", "valid", "n_links", "component_id")
    out = rows.join(ids, ["k1", "k2", "valid"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    audit = within.groupBy("cell").agg(*(F.max(c).alias(c) for c in ("n", "beam", "audited", "expected", "found")))
    return NearDuplicates(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), audit)


def recall(vectors: DataFrame, rows: DataFrame, threshold: float = 0.9, every: int = 50) -> DataFrame:
    """One row ``queries, expected, found``: links of the vectors whose id is divisible by ``every``, by brute force over all of ``vectors`` and in ``rows``.

    For vectors with an id each. Queries go to all tasks in blocks of a bounded
    number of bytes.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "recall")
    given = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    given = given.filter(sound & F.col("vec_id").isNotNull())
    width = given.agg(F.max(F.size("embedding"))).first()[0] or 1
    asked = given.filter(F.col("vec_id") % every == 0)
    blocks = asked.count() * width * 8 // HELD + 1
    asked = scratch.save(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))
    pad = lambda rows: unit(np.array([np.pad(np.asarray(v, float), (0, width - len(v))) for v in rows]))

    def counted(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            for b in batches:
                if b.num_rows:
                    hit = _hits(q, pad(b.column(1).to_pylist()), threshold) & (ids[:, None] != b.column(0).to_numpy()[None])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit.sum(1).astype(np.int64))], ["vec_id", "expected"])

        return run

    out = None
    for i in range(blocks):
        t = asked.filter(F.col("block") == i).toPandas()
        if len(t):
            held = spark.sparkContext.broadcast((t["vec_id"].to_numpy(np.int64), pad(t["embedding"])))
            part = scratch.save(given.mapInArrow(counted(held), "vec_id bigint, expected bigint").groupBy("vec_id").agg(F.sum("expected").alias("expected")))
            held.destroy()
            out = part if out is None else out.unionByName(part)
    out = out if out is not None else spark.createDataFrame([], "vec_id bigint, expected bigint")
    met = out.join(rows.select("vec_id", "n_links"), "vec_id", "left")
    return met.agg(F.count("*").alias("queries"), F.coalesce(F.sum("expected"), F.lit(0)).alias("expected"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("found"))
