"""Sources and sinks on small files."""

from pyspark.sql import functions as F

from conftest import SF
from marlspike.sources import files, logs


def test_scan_and_increment(spark, tmp_path):
    for name, text in {"src/a.ts": "a", "src/deep/b.py": "b", "node_modules/x/c.ts": "c", "d.bin": "d", "x.min.js": "e", "R.MD": "f"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    d = files.scan(spark, str(tmp_path))
    assert sorted(r.path for r in d.collect()) == ["R.MD", "src/a.ts", "src/deep/b.py"]


def test_replaced(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file_path string, n int")
    new = spark.createDataFrame([("a", 9)], "file_path string, n int")
    gone = spark.createDataFrame([("c",)], "file_path string")
    assert sorted(tuple(r) for r in files.replaced(old, new, gone).collect()) == [("a", 9), ("b", 2)]


def test_embedding_cache(spark):
    chunks = spark.createDataFrame([("x",), ("y",), ("z",)], "content string")
    key = files.cache_key("m", F.col("content"))
    cache = chunks.filter("content <> 'z'").select(key.alias("cache_key"), F.array(F.lit(1.0)).alias("embedding"), F.to_timestamp(F.when(F.col("content") == "x", "2024-01-20").otherwise("2023-01-01")).alias("created_at"))
    hit, miss = files.cached_embeddings(chunks, cache, "m", F.to_timestamp(F.lit("2024-02-01")))
    assert [r.content for r in hit.collect()] == ["x"] and sorted(r.content for r in miss.collect()) == ["y", "z"]
    assert files.evicted(cache, 1).count() == 1


def test_latest_and_diff(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")], "key string, v int, x string")
    assert sorted(r.x for r in files.latest(rows, ["key"], ["v"]).collect()) == ["new", "only"]
    diff = spark.createDataFrame([("M\ta.ts",), ("R100\told.ts\tnew.ts",), ("D\tz",), ("",)], "value string")
    assert sorted(tuple(r) for r in files.changed_paths(diff).collect()) == [("A", "new.ts"), ("D", "old.ts"), ("D", "z"), ("M", "a.ts")]


def test_logs(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "n": 2}\nnot json\n{"id": "2", "n": 3}\n')
    good, bad = logs.results(spark, str(p), "id string, n int")
    assert sorted(r.n for r in good.select("id", "n", "file").collect()) == [2, 3] and [r.line for r in bad.collect()] == ["not json"]
    (tmp_path / "audit.jsonl").write_text('{"id": "1", "category": "auth", "actor": {"type": "key", "id": "k"}, "details": {"a": "b"}}\n{broken\n')
    assert [r.actor.id for r in logs.audit_log(spark, str(tmp_path / "audit.jsonl")).collect()] == ["k"]
    logs.append(good.select("id", "n"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_rotation(spark):
    d = spark.createDataFrame([(i, 4) for i in range(10)], "id int, size int")
    assert [r.file_no for r in logs.rotation(d, 10, 1).orderBy("id").collect()] == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3]


def test_corpus(spark):
    rows = logs.corpus_rows(["category: x\nsamples:\n- {id: a, content: hi, expected_detection: true, difficulty: easy}\n- {id: a, content: '', expected_detection: false, difficulty: odd}\n", ""])
    d = spark.createDataFrame(rows, "id string, content string, expected_detection boolean, difficulty string, context string, category string")
    good, bad = logs.validated(d)
    assert good.count() == 0 and sorted(r.error for r in bad.collect()) == ["duplicate id", "duplicate id", "missing content", "unknown difficulty"]
    assert logs.report_markdown(bad.orderBy("error"), "Errors").startswith("# Errors\n\n| id | error |")


def test_save(spark, tmp_path):
    files.save(spark.range(3).withColumn("k", F.col("id") % 2), str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).filter("k = 1").count() == 1


def test_code_chunks_cover_all_documents(spark):
    from marlspike.operators import chunking
    from marlspike.plans import chunk_queries

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("trim(text) <> ''")
    got = chunk_queries.code_chunks(spark, str(SF))
    assert docs.select("doc_id").exceptAll(got.select("doc_id").distinct()).count() == 0
    src = chunk_queries.sources(spark, str(SF))
    assert chunking.code_chunks(src).select("doc_id").distinct().count() == src.count()


def test_files_are_rewritten_in_place(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    rows = [(f"f{i}", i, f"old {i}") for i in range(200)]
    files.write_files(spark.createDataFrame(rows, "file_path string, n int, content string"), path, 8)
    fresh = spark.createDataFrame([("f7", 0, "new"), ("g", 1, "more")], "file_path string, n int, content string")
    gone = spark.createDataFrame([("f9",)], "file_path string")
    files.rewrite_files(spark, path, fresh, gone, 8)
    got = {r.file_path: r.content for r in spark.read.parquet(path).collect()}
    assert got == {f: c for f, _, c in rows if f not in ("f7", "f9")} | {"f7": "new", "g": "more"}
    files.rewrite_files(spark, path, fresh.limit(0), spark.read.parquet(path).select("file_path"), 8)
    assert not any(p.name.startswith("bucket=") for p in (tmp_path / "chunks").iterdir())


def test_load_falls_back(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.load(spark, path, "a int").count() == 0
    (tmp_path / "t.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert sorted(r.a for r in files.load(spark, path, "a int").collect()) == [1, 2]
    files.save_over(spark.createDataFrame([(3,)], "a int"), path)
    assert [r.a for r in files.load(spark, path, "a int").collect()] == [3] and not (tmp_path / "t.json").exists()


def test_collected_runs(spark, tmp_path):
    for name, text in {
        "r1": '{"timestamp": "2024-01-02", "n": 1}\n{broken}\n{"n": 2}\n',
        "r2": '[{"timestamp": "2024-03-01", "a": {"b": [1]}}, {"n": 4}]',
        "r3": '{\n  "n": 5\n}',
        "r4": 'log line\n{\n "n": 6\n}\nand\n{\n "n": 7\n}\n',
        "r5": "",
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "results.jsonl").write_text(text)
    runs = logs.collected_runs(spark, str(tmp_path))
    n = {(r.run, r.n) for r in runs.select("run", F.get_json_object("result", "$.n").alias("n")).collect()}
    assert n == {("r1", "1"), ("r1", "2"), ("r2", None), ("r2", "4"), ("r3", "5"), ("r4", "6"), ("r4", "7")}
    assert [r.run for r in logs.newest_runs(runs).collect()] == ["r4", "r3", "r2", "r1"]


def test_reports(spark, tmp_path):
    d = spark.createDataFrame([("a", True), ("a", False), ("<b>", True)], "category string, detected boolean")
    by = logs.by_category(d)
    logs.report_csv(by, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).select("category", "n").collect()) == [("<b>", "1"), ("a", "2")]
    page = logs.report_html({"By category": by}, "Runs & results")
    assert "<td>&lt;b&gt;</td>" in page and "<h1>Runs &amp; results</h1>" in page and page.count("<tr>") == 3


def test_strong_components(spark):
    import random

    from marlspike.operators import graph

    rnd = random.Random(4)
    edges = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(55)} | {(i, i + 1) for i in range(50, 70)} | {(70, 50), (99, 99)}
    reach = {a: {b for x, b in edges if x == a} for a, _ in edges}
    for _ in range(80):
        reach = {a: bs | {c for b in bs for c in reach.get(b, ())} for a, bs in reach.items()}
    got = {r.node: r.component for r in graph.strong_components(spark.createDataFrame(list(edges), "source int, target int")).collect()}
    assert set(got) == {a for a in reach if a in reach[a]}
    assert all((got[a] == got[b]) == (b in reach[a] and a in reach[b]) for a in got for b in got)


def test_class_members_and_dispatch(spark):
    from marlspike.operators import chunking, syntax

    source = "import a from 'b'\n\nexport class Foo extends Bar {\n  x: number = 1;\n  /** Makes it. */\n  constructor(a) {\n    if (a) { this.x = a; }\n  }\n\n  async run() { }\n}\nconst f = (a) => {\n  return a\n}\n"
    parts = chunking.source_chunks(source)
    assert parts[0].strip() == "import a from 'b'" and parts[-1].startswith("const f")
    members = [u for u in syntax.units(source) if u[0] in ("method", "property")]
    assert [u[:3] for u in members] == [("property", "Foo.x", True), ("method", "Foo.constructor", True), ("method", "Foo.run", True)]
    assert members[1][3].startswith("export class Foo extends Bar {\n  x: number = 1;\n  // ...\n  /** Makes it. */\n  constructor(a) {")
    assert syntax.units("class Empty {\n}")[0][0] == "class"
    d = spark.createDataFrame([(1, "a.ts", source), (2, "b.md", "# T\n\ntext"), (3, "c.py", "x = 1"), (4, "d.js", None)], "doc_id bigint, path string, text string")
    assert {(r.doc_id, r.strategy) for r in chunking.chunk_files(d).collect()} == {(1, "code"), (2, "recursive"), (3, "fixed")}


def test_json_table(spark, tmp_path):
    from marlspike.sources.store import JsonTable

    t = JsonTable(spark, str(tmp_path / "t"), "name string")
    row = "name string, id string, version bigint"
    assert t.rows().count() == 0
    t.upsert(spark.createDataFrame([("a", "1", 1), ("b", "2", 1)], row))
    t.upsert(spark.createDataFrame([("A", "1", 2)], row))
    t.delete(spark.createDataFrame([("2", 3)], "id string, version bigint"))
    assert [(r.id, r.name) for r in t.rows().collect()] == [("1", "A")]
    t.compact()
    assert [(r.id, r.name) for r in t.rows().collect()] == [("1", "A")] and len(t.table.state().folders) == 1


def test_versions_and_migration(spark, tmp_path):
    import pytest

    from marlspike.sources import store

    root = str(tmp_path / "v")
    names = [store.back_up(spark.range(i), root, keep=2) for i in (1, 2, 3)]
    assert store.versions(spark, root) == names[1:]
    assert store.restored(spark, root).count() == 3 and store.restored(spark, root, names[1]).count() == 2
    with pytest.raises(ValueError):
        store.restored(spark, root, names[0])
    d = store.migrated(spark.range(1), {"k": "0", "n": "1"}, {"id": "n"})
    assert d.columns == ["n", "k"]


def test_telemetry_keeps_what_it_cannot_write(spark, tmp_path):
    from marlspike.sources.store import Telemetry

    (tmp_path / "file").write_text("x")
    t = Telemetry(spark, str(tmp_path / "file" / "x"), "n int", size=2, most=3)
    for i in range(5):
        t.record((i,))
    assert [n for (n,) in t.held] == [2, 3, 4]
    t.path = str(tmp_path / "out")
    assert t.flush() and not t.held and spark.read.json(t.path).count() == 3


def test_listeners(spark):
    from marlspike.plans.stream_queries import stream_rate
    from marlspike.streaming.listeners import Handlers

    seen: dict = {"started": [], "progress": [], "ended": []}
    h = Handlers().on("progress", lambda e: 1 / 0)
    for kind, held in seen.items():
        h.on(kind, held.append)
    h.attached(spark)
    try:
        assert stream_rate(spark, str(SF)).count() > 0
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(h)
    assert len(seen["started"]) == 1 and seen["progress"] and seen["progress"][0]["numInputRows"] > 0
    assert len(seen["ended"]) <= 1 and all(isinstance(e, ZeroDivisionError) for e in h.failed) and h.failed


def test_only_small_tables_are_spread(spark):
    from marlspike.sources.tables import spread, table

    d = table(spark, str(SF), "documents")
    assert spread(d).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(d).count() == d.count()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        large = table(spark, str(SF), "documents")
        assert spread(large) is large
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
