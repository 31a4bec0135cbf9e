"""Queries against their SQL on rows that the smallest tables lack."""

import datetime as dt

import duckdb
import pytest

from conftest import compare
from marlspike.plans import registry

ENTRIES = {e.name: e for e in registry.entries()}


@pytest.fixture
def both(spark, tmp_path):
    """Runs a query over given tables in both engines and compares the rows."""

    def run(name, **tables):
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for t, df in tables.items():
            df.write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        return compare(ENTRIES[name].run(spark, str(tmp_path)), con, ENTRIES[name].sql)

    return run


def _events(spark, micros):
    """Events ``(event_id, ts, user_id, event_type, value, props)`` at some microseconds after a start, by user."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(microseconds=us), user, "view", 1.0, '{"k": 1}') for i, (user, us) in enumerate(micros)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


@pytest.mark.parametrize("name", ["session_minutes", "rate_limit_fixed", "rate_limit_whole", "token_bucket", "bandwidth_throttle", "shared_window", "stream_rate_limited"])
def test_milliseconds_are_rounded(spark, both, name):
    # cut, the second is 1 ms before a minute, an hour, a day or half a minute has passed since the first; rounded, it is on it
    times = [(u, us) for u, size in enumerate((30_000, 60_000, 3_600_000, 86_400_000)) for us in (400, size * 1000 - 500, size * 1000 + 300, 2 * size * 1000 - 600)]
    assert both(name, events=_events(spark, times)) > 0


def test_minutes_of_rounded_milliseconds(spark, both):
    assert both("session_minutes", events=_events(spark, [(1, 600), (1, 30_000_400), (2, 400), (2, 29_999_600)])) == 2


def test_throttle_takes_rounded_milliseconds(spark, both):
    rows = _events(spark, [(7, 400), (7, 999_600)])
    sized = rows.withColumn("event_id", rows.event_id * 5000 + 899)  # 900 bytes each, the second a second after the first
    assert both("bandwidth_throttle", events=sized) == 2


def test_edges_of_words_are_ascii(spark, both):
    texts = ["é" + "de x la", "idé the und andé", "de l'and", "thé la", "the_ la", "de\nla"]
    rows = [(i, 0, "assistant", t) for i, t in enumerate(texts)]
    assert both("detector_signals", conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == len(texts)


def test_edges_of_words_in_rules(spark, both):
    texts = ["éloser", "loseré", "a loser", "losers", "stupid_ idiot"]
    docs = spark.createDataFrame([(i, t, "en", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    assert both("headline_metrics", documents=docs, labels=labels) == 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_imports_are_not_tried_with_each_ending(spark):
    from marlspike.operators import graph

    files = spark.createDataFrame([(f,) for f in ("a/x.ts", "a/x.js", "a/x", "a/y/index.ts", "a/y.jsx", "/index.ts", "b.ts")], "path string")
    asked = [("a/m.ts", "./x"), ("a/m.ts", "./x.js"), ("a/m.ts", "./y"), ("a/m.ts", "../b"), ("a/y/k.ts", "./../../b"), ("a/m.ts", "@/y/"), ("a/m.ts", "./none"), ("a/m.ts", "@s/p/q"), ("a/m.ts", "lib/z")]
    got = graph.resolve(spark.createDataFrame(asked, "source string, specifier string"), files, {"@/": "a/"})
    assert "posexplode" not in _plan(got)
    want = {("a/m.ts", "a/x", False), ("a/m.ts", "a/x.js", False), ("a/m.ts", "a/y.jsx", False), ("a/m.ts", "b.ts", False), ("a/y/k.ts", "b.ts", False), ("a/m.ts", "@s/p", True), ("a/m.ts", "lib", True)}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("name", ["architecture_objects", "architecture_connections"])
def test_imports_are_resolved_once(spark, name):
    from conftest import SF

    assert "Generate" not in _plan(ENTRIES[name].run(spark, str(SF)))


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_neighbours_as_on_the_jvm(spark, metric):
    import random

    from marlspike.operators import vector

    rnd = random.Random(4)
    some = [[rnd.choice([-1.0, 0.5, 2.0, 3.25]) for _ in range(5)] for _ in range(60)]  # many ties
    rows = [(i, v) for i, v in enumerate(some + some[:20])] + [(80, [0.0] * 5), (81, None), (82, [1.0, None, 1.0, 1.0, 1.0]), (83, [1.0]), (84, [float("nan")] * 5)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = v.filter("vec_id % 4 = 0").selectExpr("vec_id as query_id", "embedding as query")
    got = vector.knn(v, q, 7, metric)
    assert "PythonMapInArrow" in _plan(got) or "MapInArrow" in _plan(got)
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    want = v.crossJoin(q).select("query_id", "vec_id", vector.SCORES[metric](F.col("embedding"), F.col("query")).alias("score")).withColumn("rank", F.row_number().over(by) - 1).filter("rank < 7")
    assert sorted(str(tuple(r)) for r in got.select("query_id", "vec_id", "score", "rank").collect()) == sorted(str(tuple(r)) for r in want.collect())


def test_few_codes_are_held_at_once(spark, tmp_path, monkeypatch):
    import numpy as np

    from marlspike.operators import vector_index

    rnd = np.random.default_rng(3)
    v = spark.createDataFrame([(i, [float(a) for a in rnd.integers(-3, 4, 8)]) for i in range(600)], "vec_id long, embedding array<float>")
    q = v.filter("vec_id % 5 = 0").selectExpr("vec_id as query_id", "embedding as query")
    x = vector_index.VectorIndex(spark, str(tmp_path / "x")).build(v, 8)
    found = lambda: sorted(str(tuple(r)) for r in x.search(q, 6).collect())
    whole = found()
    monkeypatch.setattr(vector_index, "HELD", 50)
    assert found() == whole and len(whole) == 720


def test_source_texts_go_over_all_cores(spark):
    from conftest import SF

    assert "Repartition" in _plan(ENTRIES["syntax_units"].run(spark, str(SF)))


def test_statistics_need_no_index(spark, both, monkeypatch):
    from marlspike.operators import lexical

    monkeypatch.setattr(lexical, "write_index", lambda *a: pytest.fail("an index was written"))
    docs = spark.createDataFrame([(1, "Running runs ran, the end"), (2, None), (3, ""), (4, "ending run of x")], "doc_id long, text string")
    assert both("bm25_doc_stats", documents=docs) == 1


def test_watched_batches_wait_for_the_watermark(spark, both):
    minute, end = 60_000_000, 600
    # by user: the minutes before the end at which changes come; the first of 2, 3 and 4 are over only for a change that the watermark has not passed
    before = {1: [600, 595, 0], 2: [500, 66, 2], 3: [69, 5], 4: [66, 30, 3], 5: [71, 9], 6: [300, 130, 65, 1], 7: [80, 15]}
    events = _events(spark, [(user, (end - m) * minute) for user, ms in before.items() for m in ms])
    assert both("stream_watch", events=events) == 6


_SEARCHES = ["rrf_fusion", "overlay_composite", "multi_workspace_search"]


@pytest.mark.parametrize("name", _SEARCHES)
def test_one_search_needs_no_index(spark, duck, monkeypatch, name):
    from conftest import SF
    from marlspike.operators import lexical

    monkeypatch.setattr(lexical, "write_index", lambda *a: pytest.fail("an index was written"))
    assert compare(ENTRIES[name].run(spark, str(SF)), duck, ENTRIES[name].sql) > 0


def test_postings_are_grouped_without_a_shuffle(spark):
    from marlspike.operators import lexical

    texts = {1: "jumps jump Jumped, a river", 2: None, 3: "", 4: "river rivers x stone stone", 5: "runs run"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for shared in (False, True):
        found = lexical.placed_postings(docs, shared)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        rows = {(r.term, r.doc_id, r.kind): (r.tf, r.dl, r.places) for r in found.collect()}
        assert rows[("jump", 1, "raw")] == (1, 4, [1]) and rows[("jump", 1, "stem")] == (3, 4, [0, 1, 2])
        assert rows[("run", 5, "raw")] == (1, 2, [1]) and rows[("run", 5, "stem")] == (2, 2, [0, 1])
        assert [(k, *v) for (t, i, k), v in sorted(rows.items()) if (t, i) == ("stone", 4)] == ([("both", 2, 4, [2, 3])] if shared else [("raw", 2, 4, [2, 3]), ("stem", 2, 4, [2, 3])])


def test_only_ids_that_changed_are_asked_for(spark, tmp_path):
    from marlspike.operators import segments

    x = segments.SegmentedIndex(spark, str(tmp_path / "x"))
    for ids in ((1, 2, 3), (4, 5), (2,)):
        x.add(spark.createDataFrame([(i, f"river stones {i}") for i in ids], "doc_id bigint, text string"))
    every, last = x._words(x.table.state())
    assert [tuple(r) for r in last.collect()] == [(2, 2)]
    plan = x.index().postings._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_median_is_counted_in_ranges(spark, monkeypatch):
    import numpy as np

    from marlspike.operators import evalstats

    rnd = np.random.default_rng(5)
    sets = [[7], [7, 7, 7], [-5, 9], [-1, 0, 1, 2], [10**15, -(10**15), 3, 3], *(rnd.integers(-(10**9), 10**9, n).tolist() for n in (50, 51)), rnd.integers(-3, 3, 60).tolist()]
    for ranges in (40, 1 << 14):
        monkeypatch.setattr(evalstats, "RANGES", ranges)
        for xs in sets:
            d = spark.createDataFrame([(x,) for x in xs], "us long").coalesce(1)
            assert evalstats.lower_median(d, "us") == sorted(xs)[(len(xs) - 1) // 2]
        assert evalstats.lower_median(spark.range(0).withColumnRenamed("id", "us"), "us") is None


def test_watch_has_few_stores_and_no_whole_percentile(spark, tmp_path, both, monkeypatch):
    from pathlib import Path

    from marlspike.plans import stream_queries

    expr = stream_queries.F.expr
    monkeypatch.setattr(stream_queries.F, "expr", lambda s: pytest.fail("all distinct times meet in one task") if "percentile" in s else expr(s))
    monkeypatch.setattr(stream_queries, "temporary", lambda spark, label: f"{tmp_path}/{label}")
    minute = 60_000_000
    events = _events(spark, [(user, k * 50 * minute + user) for user in range(30) for k in (0, 1, 3, 9)])
    parts, kept = "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"
    before = spark.conf.get(parts)
    spark.conf.set(parts, "40")
    try:
        assert both("stream_watch", events=events) == 60
        assert spark.conf.get(parts) == "40" and spark.conf.get(kept, None) is None
    finally:
        spark.conf.set(parts, before)
    assert len(list(Path(tmp_path, "watch/state/state/0").glob("[0-9]*"))) == 16  # four for each core


def test_hot_path_is_read_frame_by_frame():
    import pandas as pd

    from marlspike.streaming import events

    class Handle:
        def getListState(self, *a):  # noqa: N802
            self.rows = []
            return self

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def registerTimer(self, at):  # noqa: N802
            self.at = at

    gap, at_once = 3_600_000_000, []

    def frames():
        # each frame's changes lie between those of the others, 12 minutes apart in all, but for one long pause
        for k in range(5):
            us = [(3 * i + (i >= 50) * 30) * gap // 3 + k * gap // 5 for i in range(100)]
            yield pd.DataFrame({"us": us, "id": [100 * k + i for i in range(100)], "kind": [str(k)] * 100})

    held, b = Handle(), events._Batches(gap, 600_000_000)
    b.init(held)
    joined = b._joined
    b._joined = lambda rows: at_once.append(len(rows)) or joined(rows)
    (done,) = b.handleInputRows((1,), frames(), None)
    assert done[["n", "last_kind"]].values.tolist() == [[250, "4"]]
    assert [r[3:] for r in held.rows] == [(250, "4")]
    assert at_once == [100, 200, 102, 102, 102]
