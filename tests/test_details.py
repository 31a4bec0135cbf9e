"""Odd rows of the smaller operators."""

from pyspark.sql import functions as F

from marlspike.functions.globs import fits, parts, relative
from marlspike.operators import chunking, kvstore, services, sync


def test_paths(spark):
    rows = [("a/b.TS",), ("a\\b\\c.d.md",), ("x",), (".env",), ("a/.env",), ("a/",), ("",), (None,)]
    d = spark.createDataFrame(rows, "p string").select("p", parts(F.col("p")).alias("x"), relative(F.col("p"), F.lit("a/")).alias("r"))
    got = {r.p: (*r.x, r.r) for r in d.collect() if r.p is not None}
    assert got["a/b.TS"] == ("a", "b.TS", "b", "ts", "b.TS") and got["a\\b\\c.d.md"] == ("a/b", "c.d.md", "c.d", "md", "b/c.d.md")
    assert got["x"] == ("", "x", "x", "", "x") and got[".env"] == ("", ".env", ".env", "", ".env") and got["a/.env"][1:4] == (".env", ".env", "")
    assert got["a/"][:2] == ("a", "") and got[""] == ("", "", "", "", "")


def test_globs_that_fit_themselves(spark):
    d = spark.createDataFrame([("a(1).ts",), ("a\\b.ts",), ("a/b.ts",), ("ab",)], "p string")
    of = lambda g, how: {r.p for r in d.filter(fits(F.col("p"), g, how)).collect()}
    assert of("a(1).ts", "exact") == {"a(1).ts"} and of("a/b.ts", "exact") == {"a\\b.ts", "a/b.ts"} and of("a/*.ts", "strict") == {"a/b.ts"}
    assert of("a_", "like") == {"ab"} and of("a*.ts", "like") == {"a(1).ts", "a\\b.ts", "a/b.ts"}


def test_calls_of_methods(spark):
    src = spark.createDataFrame([(1, "class Store {\n  get() {}\n}"), (2, "Store.get(1); Store . put(2)\nOther.x(); Math.abs(1)"), (3, None)], "doc_id bigint, text string")
    calls = chunking.api_calls(src, ["Math"])
    assert sorted((r.doc_id, r.line, r.object, r.method) for r in calls.collect()) == [(2, 1, "Store", "get"), (2, 1, "Store", "put"), (2, 2, "Other", "x")]
    defs = spark.createDataFrame([("Store", 1), ("Store", 1)], "name string, chunk bigint")
    bad = chunking.invalid_calls(calls, defs, src.select(F.col("doc_id").alias("chunk"), F.col("text").alias("content")))
    assert [(r.object, r.method) for r in bad.collect()] == [("Store", "put")]


def test_chains_end(spark):
    c = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (9, 8)], "id bigint, parent bigint")
    assert sorted(tuple(r) for r in services.chained_calls(c).collect()) == [(1, 0, True), (2, 1, True), (3, 2, True), (4, 3, False)]


def test_hashes_and_expiry(spark):
    old = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "path string, hash string")
    now = spark.createDataFrame([("a", "2"), ("a", "9"), ("a", "2")], "path string, hash string")
    assert sorted(tuple(r) for r in sync.without_stale(old, now).collect()) == [("a", "2"), ("b", "3")]
    t = lambda s: F.to_timestamp(F.lit(s))
    row = spark.range(1).select(
        kvstore.outlived(t("2024-01-01 00:00:00"), F.lit(1000), t("2024-01-01 00:00:01")).alias("a"), kvstore.outlived(t("2024-01-01 00:00:00"), F.lit(999), t("2024-01-01 00:00:01")).alias("b"),
        kvstore.outlived(t("2024-01-01"), F.lit(0), t("2025-01-01")).alias("c"), kvstore.expired_at(F.lit(None).cast("timestamp"), t("2025-01-01")).alias("d"),
    )
    assert tuple(row.first()) == (False, True, False, False)


def test_queue_of_a_client(spark):
    import random

    rnd = random.Random(3)
    reached = {(c, s): rnd.random() < 0.3 for c in range(4) for s in range(15)}
    events, i = [], 0
    for c, s in reached:
        for _ in range(rnd.randrange(6)):
            events.append((c, s, i))
            i += 1
    want, queue = {}, {c: [] for c in range(4)}
    for (c, s), ok in sorted(reached.items()):
        batch = queue[c] + [e for a, b, e in events if (a, b) == (c, s)]
        if ok:
            want |= dict.fromkeys(batch, "sent")
            queue[c] = []
        else:
            want |= dict.fromkeys(batch[:-7], "dropped")
            queue[c] = batch[-7:]
    want |= {e: "waiting" for q in queue.values() for e in q}
    e = spark.createDataFrame(events, "client long, session long, id long")
    s = spark.createDataFrame([(*k, v) for k, v in reached.items()], "client long, session long, reached boolean")
    assert {r.id: r.state for r in services.sent_or_kept(e, s, 7).collect()} == want and set(want.values()) == {"sent", "dropped", "waiting"}
