"""Stored indexes that follow their tables: segments of postings, inverted lists of vectors."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspike.operators import lexical, segments
from marlspike.operators.vector import knn
from marlspike.operators.vector_index import VectorIndex, recall

WORDS = "alpha beta gamma delta run runs running jump jumped tree trees wide river stone".split()


def text(rnd):
    return " ".join(rnd.choices(WORDS, k=rnd.randrange(0, 30)))


def answers(index, spark, query="running trees delta"):
    found = lexical.search(index, lexical.query_terms(spark, query), 1000).collect()
    return [(r.doc_id, round(r.score, 9), r.highlights) for r in found], [tuple(r) for r in lexical.index_stats(index).collect()]


def test_changes_give_what_a_fresh_index_gives(spark, tmp_path):
    rnd, now = random.Random(5), {}
    x = segments.SegmentedIndex(spark, str(tmp_path / "x"))
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").coalesce(1)
    merged = 0
    for step in range(7):
        batch = {rnd.randrange(60): text(rnd) for _ in range(rnd.choice([3, 6, 15]))}
        x.add(frame(batch))
        now |= batch
        gone = rnd.sample(sorted(now), 3)
        x.remove(spark.createDataFrame([(g,) for g in [*gone, 999]], "doc_id bigint"))
        now = {k: v for k, v in now.items() if k not in gone}
        merged += x.merge()
        if step in (2, 6):
            fresh = lexical.write_index(frame(now), str(tmp_path / f"fresh{step}"))
            assert answers(x.index(), spark) == answers(fresh, spark)
    assert merged >= 8 and len(x.table.state().folders) < 12
    x.remove(spark.createDataFrame([(k,) for k in now], "doc_id bigint"))
    assert x.index().postings.count() == 0 and x.index().totals.first().n_docs == 0


def test_only_touched_segments_are_written(spark, tmp_path):
    rnd = random.Random(6)
    x = segments.SegmentedIndex(spark, str(tmp_path / "x"))
    for n in (400, 2, 2, 2):
        x.add(spark.createDataFrame([(i, text(rnd) if n > 2 else f"alpha beta river {i}") for i in range(n)], "doc_id bigint, text string").coalesce(1))
    first, *small = x.table.state().folders
    x.add(spark.createDataFrame([(i, "alpha stone river") for i in (1, 2)], "doc_id bigint, text string").coalesce(1))
    while x.merge():
        pass
    left = list(x.table.state().folders)
    assert first in left and not set(small) & set(left)
    plan = x.index().postings.filter("kind = 'stem' and term in ('stone')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(term,stone)" in plan


def test_places(spark, tmp_path):
    rnd = random.Random(7)
    rows = {i: text(rnd) for i in range(30)} | {90: "stone " + "alpha " * 150 + "river", 91: "river stone", 92: ""}
    x = segments.SegmentedIndex(spark, str(tmp_path / "x"))
    x.add(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string"))
    got = {r.doc_id: r.score for r in segments.by_place(x.index(), ["river", "stone"]).collect()}
    want = {}
    for i, t in rows.items():
        at = {w: [k for k, y in enumerate(t.split()) if y == w] for w in ("river", "stone")}
        if all(at.values()):
            left = 1.0
            for p in at["river"]:
                for q in at["stone"]:
                    if abs(p - q) <= 100:
                        left *= 1 - 0.1 / np.sqrt(1.005 + 0.05 * np.exp(abs(p - q) / 1.5 - 2))
            want[i] = 1 - left
    assert want[90] == 0 and got == pytest.approx(want)
    alone = {r.doc_id: r.score for r in segments.by_place(x.index(), ["river"]).collect()}
    assert alone[91] == pytest.approx(0.1 / 1.64493406685)


def test_search_sees_a_table_that_was_overwritten(spark, tmp_path):
    """The index that a session keeps belongs to the files that it was made from."""
    from marlspike.plans.search_queries import QUERY, bm25_topk

    where = str(tmp_path / "sf")
    schema = "doc_id bigint, text string, lang string, source string"
    spark.createDataFrame([(i, QUERY, "en", "s") for i in range(5)], schema).write.parquet(f"{where}/documents.parquet")
    assert bm25_topk(spark, where).count() == 5
    spark.createDataFrame([(i, "nothing of it", "en", "s") for i in range(5)], schema).write.mode("overwrite").parquet(f"{where}/documents.parquet")
    assert bm25_topk(spark, where).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 24))
    rows = [(int(i), (centers[i % 40] + rng.normal(size=24)).tolist()) for i in range(6000)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4).cache()


def test_vector_index(spark, tmp_path, vectors):
    x = VectorIndex(spark, str(tmp_path / "x")).build(vectors, 24)
    cells = x.table.read().select("cell").distinct().count()
    assert cells > 50 and x.table.state().properties["probes"] < cells / 2  # clusters are found, and few are opened
    ask = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    r = recall(x.search(ask, 10), knn(vectors, ask, 10)).first()
    assert r.queries == 120 and r.expected == 1200 and r.found >= 0.9 * r.expected
    one = x.search(ask.limit(1), 5)
    assert [y.rank for y in one.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    near = x.table.read().filter(F.col("cell").isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(cell,3)" in near


def test_vector_index_changes(spark, tmp_path, vectors):
    some = vectors.filter("vec_id < 600")
    x = VectorIndex(spark, str(tmp_path / "x")).build(some, 24)
    ask = some.filter("vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    ids = lambda: [r.vec_id for r in x.search(ask, 3).orderBy("rank").collect()]
    assert ids()[0] == 7
    before = {f: os.stat(f"{x.table.root}/{f}").st_mtime for f in x.table.state().folders}
    x.remove(some.filter("vec_id = 7"))
    assert 7 not in ids()
    x.add(vectors.filter("vec_id between 600 and 700").unionByName(spark.createDataFrame([(900, ask.first().query)], "vec_id bigint, embedding array<float>")))
    assert ids()[0] == 900
    x.add(some.filter("vec_id = 7"))
    assert ids()[:2] == [7, 900]
    x.add(some.filter("vec_id = 7").withColumn("embedding", F.transform("embedding", lambda v: -v)))
    assert ids()[0] == 900 and 7 not in ids()
    assert before == {f: os.stat(f"{x.table.root}/{f}").st_mtime for f in before}  # what was there is not written again
    held = sorted((r.vec_id, round(r.embedding[0], 5)) for r in x.rows().collect())
    x.rebuild()
    assert held == sorted((r.vec_id, round(r.embedding[0], 5)) for r in x.rows().collect()) and len(x.table.state().folders) == 1
    assert len(held) == 702 and ids()[0] == 900
    with pytest.raises(ValueError, match="components"):
        x.add(spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>"))
    with pytest.raises(ValueError, match="components"):
        x.search(spark.createDataFrame([(1, [1.0])], "query_id bigint, query array<float>"), 3)
    odd = spark.createDataFrame([(5001, None), (5002, [float("nan")] * 24), (None, [1.0] * 24), (5003, [0.0] * 24)], "vec_id bigint, embedding array<float>")
    x.add(odd)
    assert x.rows().filter("vec_id > 5000").count() == 1  # the zero vector has a place


def test_empty_vector_index(spark, tmp_path, vectors):
    x = VectorIndex(spark, str(tmp_path / "x")).build(vectors.limit(0), 24)
    ask = vectors.limit(2).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert x.search(ask, 3).count() == 0
    x.add(vectors.filter("vec_id < 5"))
    assert x.search(ask, 3).count() == 6
