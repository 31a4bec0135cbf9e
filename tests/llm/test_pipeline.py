"""The corpus pipeline stage by stage against plain versions, on a small corpus with odd rows."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
import public_tokenizers as P
from marlspike.llm import common, packing, quality_rules, secrets, tokens
from marlspike.llm.secrets import redacted, scan
from test_operators import base_spans, check_packing, find, grams, plain_counts, words


def rows():
    rnd = random.Random(11)
    base = [words(rnd, 120) for _ in range(8)]
    out = []
    for i in range(90):
        t = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 1, 2, 30])):
            t[rnd.randrange(len(t))] = "edit" + str(rnd.randrange(999))
        t = " ".join(t)
        if i % 2:
            t = "Shared line of a licence\n" + t
        if i % 7 == 0:
            t += " password=s3cr3tvalue" + str(i)
        out.append((i, t, "en", "s", len(t)))
    out += [(500, None, "en", None, None), (501, "", None, None, None), (502, "short", "fr", "s", 5), (503, "# $ " * 200, "en", "s", 9), (None, words(rnd, 90), None, None, None)]
    return out + [out[3], out[3], (4, base[0] + " other text", "en", "s", 1)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def plain_line_dedup(docs):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").lower()
    where: dict = {}
    for i, t in docs:
        for s in (t or "").split("\n"):
            where.setdefault(key(s), set()).add(i)
    return [(i, "\n".join(s for s in (t or "").split("\n") if not key(s) or len(where[key(s)]) < 10)) for i, t in docs]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    state = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [(i, t) for i, t in state if not ((c := plain_counts(t))[0] < 50 or 100 * c[4] > 50 * c[0])]
    deduped = plain_line_dedup(kept)
    known = sorted({i for i, _ in deduped if i is not None})
    g = [(i, grams(t, 5)) for i, t in deduped if i is not None]
    comp = find([(a, b) for (a, x), (b, y) in combinations(g, 2) if a != b and x and y and 100 * len(x & y) >= 80 * len(x | y)], known)
    leaders = {i for i in known if comp[i] == i}
    want = {
        "quality_rules": Counter(kept),
        "line_dedup": Counter(deduped),
    }
    for n, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        got = docs.collect()
        if name in want:
            assert Counter((r.doc_id, r.text) for r in got) == want[name]
        if name != "best_fit_packing":
            assert docs.columns == cp.COLUMNS
        if name == "jaccard_join":
            stay = {(i, t) for i, t in deduped if i in leaders}  # equal rows once, unlike texts under one id all
            assert Counter((r.doc_id, r.text) for r in got) == Counter([*stay, *((i, t) for i, t in deduped if i is None)]) and len(stay) > len(leaders)
            before = Counter((r.doc_id, redacted(r.text, scan(r.text))) for r in got)
        if name == "secret_scans":
            assert Counter((r.doc_id, r.text) for r in got) == before and all(r.n_chars == len(r.text) and not base_spans(r.text) for r in got)
            packed = [r.text for r in got]
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert sum(r.length for r in got) == sum(len(bpe.encode(t, add_special_tokens=False).ids) + 1 for t in packed)
    assert check_packing([(r.sequence_id, r.offset, r.length) for r in got], 4096) == int(np.ceil(sum(r.length for r in got) / 4096))


def test_unlike_texts_under_one_id(spark, tmp_path):
    """Neither of two texts under one id goes by chance; equal rows go to one; very long texts go through every stage."""
    rnd = random.Random(8)
    one, other, long = words(rnd, 90), words(rnd, 95), "\n".join(words(rnd, 12) for _ in range(60_000))
    rows = [(1, one, "en", "a", 1), (1, other, "en", "b", 2), (1, one, "de", "a", 1), (2, words(rnd, 80), "en", "s", 3), (3, long, "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(map(tuple, cp.jaccard_join(spark, docs.repartition(3), "").collect()))
    assert got == sorted([(1, one, "de", "a", 1), rows[1], rows[3], rows[4]])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = Counter(r.doc_id for r in cp.run(spark, str(tmp_path)).collect())
    assert packed[1] == 2 and packed[2] == 1 and packed[3] > 100


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 0 and cp.ORACLE_SQL is None
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "secret_scans", "best_fit_packing"]


def test_empty_tables(spark, sf, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_a_certified_cutoff_takes_effect(spark, tmp_path):
    """Rejects by the method, not by base rules; columns with names that the stage uses inside."""
    rnd = random.Random(12)
    rows = [(i, words(rnd, 60) + (" ###" * 30 if i % 4 == 0 else ""), ["en", "fr"][i % 2], "s", 0, "x", 1, 2, "y") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, rarity int, cutoff int, steps string")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 1200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [r.doc_id for r in cp.quality_rules(spark, docs, str(tmp_path)).collect()]
    assert not any(i % 8 == 0 for i in got if i % 2 == 0 and i % 4 == 0), "junk goes where its language is certified"
    assert len([i for i in got if i % 4]) >= 0.95 * 900
    assert all(rows[i][1].count("#") == 0 for i in got if rows[i][2] == "en")


def test_batches_hold_few_bytes(spark):
    """Long texts do not go to Python by thousands; one longer than a batch goes alone."""
    common.Scratch(spark, "bytes")
    docs = spark.range(0, 120, 1, 1).selectExpr("repeat('some words ', if(id = 60, 500000, 10000)) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    got = docs.mapInArrow(sizes, "n bigint, size bigint").collect()
    assert sum(r.n for r in got) == 120 and len(got) >= 4
    assert all(r.size <= common.BATCH_BYTES + 200_000 for r in got if r.size < 5_000_000) and sum(r.size >= 5_000_000 for r in got) == 1


def test_a_worker_serves_one_stage():
    """What packing and scans keep in a worker is gone once the rules begin there."""
    docs = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["Ein kurzer Text", "password: Tr0ub4dor&3xyz"]})
    assert len(list(secrets._scanned(10.0, True)(iter([docs])))) == 1 and secrets.ranks.cache_info().currsize
    (packed,) = packing._encoded("word_bpe_49k.json", None, 4096, 10, 100)(iter([docs]))
    assert tokens._WORKERS and not secrets.ranks.cache_info().currsize and packed.num_rows == 2
    assert sum(b.num_rows for b in quality_rules._counted(iter([docs]))) == 2
    assert not tokens._WORKERS
    again = list(packing._encoded("word_bpe_49k.json", None, 4096, 10, 100)(iter([docs])))
    assert again[0].equals(packed)


def test_packing_starts_no_second_workers(spark, sf):
    """The plan of packing is not dealt out through Python workers of another kind."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = cp.best_fit_packing(spark, docs, sf)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan
