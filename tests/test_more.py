"""Caches of any size, the whole limiter, closed paths, bootstrap of metrics, similar names: against brute force on small fixtures."""

import random
from collections import OrderedDict

import numpy as np
from pyspark.sql import functions as F

from marlspike.operators import evalstats, graph, present, services
from marlspike.operators import events as ev


def test_caches_of_all_sizes(spark):
    rnd = random.Random(2)
    calls = [(i, s, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", rnd.choice("abcdefghij"[: 3 + 3 * s])) for i in range(400) for s in (rnd.randrange(3),)]
    d = spark.createDataFrame(calls, "id long, session long, ts string, key string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.capacity: (r.calls, r.hits, r.evictions) for r in ev.lru_hits(d.repartition(3), [1, 2, 3, 5, 20]).collect()}
    for size in (1, 2, 3, 5, 20):
        hits = evictions = 0
        caches = [OrderedDict() for _ in range(3)]
        for _, s, _, key in calls:
            c = caches[s]
            if key in c:
                hits += 1
                c.move_to_end(key)
                continue
            if len(c) == size:
                c.popitem(last=False)
                evictions += 1
            c[key] = True
        assert got[size] == (400, hits, evictions)
    most = ev.reuse_distances(d, 2)
    assert {r.distance for r in most.collect()} == {None, 0, 1}


def test_limiter_in_order():
    limits = {"concurrent": 1, "minute": 2, "hour": 3, "day": 9, "tokens": 10}
    state: dict = {}
    ask = lambda now, lasts=0, tokens=1: ev.admitted(state, now, lasts, tokens, limits)
    assert ask(0, lasts=500) == (None, 0)
    assert ask(400) == ("concurrent", 1)  # still running
    assert ask(500, tokens=11) == ("tokens", 0)
    assert ask(500) == (None, 0)
    assert ask(1500) == ("minute", 59)  # the window began with the first request
    assert ask(60_000) == (None, 0)
    assert ask(121_000) == ("hour", 3479)
    assert state["hour"][1:] == [3, 3] and state["running"] == []


def test_closed_paths(spark):
    rnd = random.Random(4)
    edges = {(rnd.randrange(25), rnd.randrange(25)) for _ in range(45)} | {(i, i + 1) for i in range(50, 65)} | {(65, 50), (99, 99), (65, 58)}
    reach = {a: {b for x, b in edges if x == a} for a, _ in edges}
    for _ in range(40):
        reach = {a: bs | {c for b in bs for c in reach.get(b, ())} for a, bs in reach.items()}
    cover = {(r.source, r.target): r.path for r in graph.cycle_cover(spark.createDataFrame(list(edges), "source int, target int")).collect()}
    assert set(cover) == {(a, b) for a, b in edges if a in reach.get(b, ())}
    for edge, path in cover.items():
        steps = list(zip(path, path[1:] + path[:1], strict=True))
        assert edge in steps and set(steps) <= edges and len(set(path)) == len(path) and path[0] == min(path)
    assert len(cover[65, 50]) == 16  # as long as it has to be
    assert graph.cycle_cover(spark.createDataFrame([(1, 2)], "source int, target int")).collect() == []


def test_bootstrap_of_a_ratio(spark):
    rng = np.random.default_rng(5)
    tp, fp = rng.random(300) < 0.6, rng.random(300) < 0.3
    rows = [(i, "a", bool(t), bool(f)) for i, (t, f) in enumerate(zip(tp, fp, strict=True))] + [(900, "b", False, False)]
    d = spark.createDataFrame(rows, "id long, key string, t boolean, f boolean").repartition(3)
    sums = {"tp": F.col("t").cast("int"), "fp": F.col("f").cast("int")}
    precision = lambda tp, fp: F.try_divide(tp, tp + fp)
    got = {r.key: r for r in evalstats.bootstrap_metric(d, "key", sums, precision).collect()}
    again = {r.key: r for r in evalstats.bootstrap_metric(d.repartition(5), "key", sums, precision).collect()}
    assert got == again and tuple(got["b"])[1:] == (0.0, 0.0, 0.0)
    a = got["a"]
    assert abs(a.point - tp.sum() / (tp.sum() + fp.sum())) < 1e-12
    draws = rng.integers(0, 300, (4000, 300))
    plain = np.quantile(tp[draws].sum(1) / (tp[draws].sum(1) + fp[draws].sum(1)), [0.025, 0.975])
    assert abs(a.lower - plain[0]) < 0.015 and abs(a.upper - plain[1]) < 0.015


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_similar_names(spark):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choices("abcd", k=n))
    known = sorted({word(rnd.randrange(1, 9)) for _ in range(60)} | {"readFile", "ReadFiles", "x" * 40, "É"})
    unknown = sorted({word(rnd.randrange(1, 9)) for _ in range(40)} | {"readfil", "x" * 38 + "yz", "é", "openReadFileNow"})
    name = "name string"
    frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None, ""]], name)
    found = present.similar_names(frame(unknown), frame(known))
    want = []
    for u in unknown:
        near = []
        for k in known:
            a, b = u.lower(), k.lower()
            if a in b or b in a or distance(a, b) <= 2:
                near.append((distance(a, b), k))
        want += [(u, i + 1, k) for i, (_, k) in enumerate(sorted(near)[:3])]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_subscribers_of_everything(spark, monkeypatch):
    monkeypatch.setattr(services, "STARS", 2)
    m = spark.createDataFrame([(i, f"c{i % 2}", i % 4) for i in range(9)], "id long, channel string, sender long")
    subs = [("c0", 1), ("c1", 2), ("c1", 2), *(("*", k) for k in range(5))]
    got = sorted((r.id, r.channel, r.subscriber) for r in services.delivered(m, spark.createDataFrame(subs, "channel string, subscriber long")).collect())
    assert got == sorted({(i, f"c{i % 2}", s) for i in range(9) for c, s in subs if c in ("*", f"c{i % 2}") and s != i % 4})


def test_reach_counts(spark, monkeypatch):
    from marlspike.operators import iterate

    rnd = random.Random(9)
    edges = {(rnd.randrange(30), rnd.randrange(30)) for _ in range(40)} | {(i, i + 1) for i in range(40, 60)}
    monkeypatch.setattr(iterate, "BITS", 7)
    got = {r.start: r.n for r in iterate.reach_counts(spark.createDataFrame(list(edges), "source int, target int"), spark.createDataFrame([(i,) for i in [*range(60), 5, 99]], "start int").repartition(3)).collect()}
    for s in [*range(60), 99]:
        seen, left = {s}, [s]
        while left:
            x = left.pop()
            new = {b for a, b in edges if a == x} - seen
            seen |= new
            left += new
        assert got[s] == len(seen) - 1
