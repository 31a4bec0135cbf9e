"""Source audit, conversation repair and lattice scoring against brute force, on small fixtures with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from marlspike.llm import conversations as cv
from marlspike.llm import lattice_lm, source_audit
from test_operators import SCHEMA, corpus


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(corpus(), SCHEMA).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)))
    # columns whose names the operators use inside
    return d.withColumns({n: F.lit(1) for n in ("term", "n", "docs", "value", "rank", "item", "part", "word", "c", "row_id", "score", "total")}).cache()


# --- source audit ---


def plain_audit(rows, need, top):
    """The definition, with dense tables and fractions."""
    tokens = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    frequency, count, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        found = [t.translate(lower) for t in tokens.findall(text or "")]
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        frequency.update((lang, t) for t in set(found))
        count.update((lang, source, t) for t in found)
    kept = defaultdict(list)
    for (lang, t), n in sorted(frequency.items()):
        if n >= need:
            kept[lang].append(t)
    share = lambda n, size, v: 1 + math.floor(Fraction(10**9 * (n + 2), size + 2 * v))
    far = lambda p, q: math.floor(Fraction((p - q) ** 2, p + q))
    out = []
    by_lang = defaultdict(list)
    for lang, source in groups:
        by_lang[lang].append(source)
    for lang, sources in by_lang.items():
        terms, v = kept[lang], len(kept[lang])
        n = {s: [count[lang, s, t] for t in terms] for s in sources}
        p = {s: [share(x, sum(n[s]), v) for x in n[s]] for s in sources}
        whole = [sum(n[s][i] for s in sources) for i in range(v)]
        q = [share(x, sum(whole), v) for x in whole]
        for s in sources:
            pairs = [(o, sum(far(a, b) for a, b in zip(p[s], p[o], strict=True))) for o in sources if o != s]
            terms_ = [(t, far(p[s][i], q[i])) for i, t in enumerate(terms) if n[s][i] and p[s][i] > q[i]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms_, top)):
                for r, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, value, r + 1))
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"bits": 4}, {"met": 1, "broadcast_groups": 0}], ids=["as it is", "full sketch", "dealt out"])
def test_source_audit(docs, how):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    got = sorted(tuple(r) for r in source_audit.divergence(docs, 10, 10, **how).collect())
    assert got == plain_audit(rows, 10, 10) and {r[2] for r in got} == {"pair", "term"}


def test_source_audit_of_little(spark, docs):
    none = docs.limit(0)
    assert source_audit.divergence(none).collect() == []
    few = spark.createDataFrame([(None, None, None), ("a b", None, "x"), ("", "en", "y")], "text string, lang string, source string")
    got = sorted(tuple(r) for r in source_audit.divergence(few).collect())
    assert got == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]


def test_terms_in_slices(monkeypatch):
    rnd = random.Random(2)
    raw = "".join(rnd.choices("abÄ €Z.1\n𐍈", k=4000)).encode()
    want = re.findall(rb"[a-z\x80-\xff]+", raw.lower())
    for size in (1, 7, 64, 5000):
        monkeypatch.setattr(source_audit, "SLICE", size)
        assert [t for part in source_audit.terms(raw) for t in part] == want
    assert list(source_audit.terms(b"")) == []


def test_sketch_never_says_less(spark):
    """Terms that are frequent pass a sketch of any size; nearly all rare ones stop at one that is large enough."""
    rows = [(f"all w{i % 40} r{i}", "en", "s") for i in range(800)]
    d = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for bits, most in ((6, 900), (16, 45)):
        counts, kept = source_audit.term_counts(d, 10, None, bits)
        assert {r.term for r in kept.collect()} == {"all", "w", "r"}  # digits are no letters
    rows = [(f"all {chr(97 + i % 20) * 3} {''.join(chr(97 + int(c)) for c in str(i))}zz", "en", "s") for i in range(800)]
    d = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for bits, most in ((6, 900), (16, 30)):
        counts, kept = source_audit.term_counts(d, 10, None, bits)
        assert kept.count() == 21 and 21 <= counts.filter("term is not null").count() <= most


# --- conversations ---


def plain_repair(rows):
    """Cheapest edits by a forward pass over all states with whole audits, and what they leave."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    read = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    make = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def inserted(best):
        for _ in range(3):
            for q, (c, a, t) in list(best.items()):
                to, role = make[q]
                best[to] = min(best.get(to, (10**9,)), (c + 3, a + "I", [*t, role + ":"]))
        return best

    best = {0: (0, "", [])}
    for (_, role, text), kind in zip(rows, faults, strict=True):
        ways = defaultdict(list)
        for q, (c, a, t) in inserted(best).items():
            ways[q].append((c + 4, a + "D", t))
            if kind not in ("blank", "duplicate"):
                more = 3 if kind == "truncated" else 0
                if (role[:1], q) in read:
                    ways[read[role[:1], q]].append((c + more, a + "K", [*t, f"{role}:{text}"]))
                to, name = make[q]
                ways[to].append((c + 3 + more, a + "R", [*t, f"{name}:{text}"]))
        best = {q: min(w) for q, w in ways.items()}
    c, a, t = min(x for q, x in inserted(best).items() if q in (0, 3))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [x[1][:1] + y[1][:1] for x, y in zip(rows, rows[1:], strict=False)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), c, a, "\n".join(t)


def talk(seed=4):
    rnd, out = random.Random(seed), []
    for conv in [*range(60), None]:
        for turn in range(rnd.choice([0, 1, 2, 5, 9, 14])):
            role = rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""])
            text = rnd.choice(["Yes.", "No!", "cut off", "", " \n", None, f"Turn {turn}?", "Ünï 𐍈. ", " "])
            out += [(conv, rnd.choice([turn, turn, turn, turn + 3, None]), role, text)] * rnd.choice([1, 1, 1, 2])
    return out


def by_conversation(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, " " if role is None else role, " " if text is None else text))
    # code points sort as UTF-8 does
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


TALK = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("limits", [{}, {"long_rows": 0, "run_rows": 4}, {"long_rows": 8, "run_rows": 3}, {"long_bytes": 20, "run_rows": 1000}], ids=["short", "all in runs", "some in runs", "one run"])
def test_repair(spark, limits):
    rows = talk()
    d = spark.createDataFrame(rows, TALK).withColumns({n: F.lit(0) for n in ("part", "g", "audit", "cost", "place", "n")}).repartition(3)
    got = cv.repair_conversations(d, **limits)
    left = defaultdict(list)
    for r in sorted(got.turns.collect(), key=lambda r: r.place):
        left[r.conv_id].append(f"{r.role}:{r.text}")
    want = {k: plain_repair(v) for k, v in by_conversation(rows).items()}
    audits = {r.conv_id: tuple(r)[1:] for r in got.audits.collect()}
    assert set(audits) == set(want) and None in want
    for conv, (*counts, text) in want.items():
        assert audits[conv] == (*counts, hashlib.sha256(text.encode()).hexdigest()), conv
        assert "\n".join(left[conv]) == text
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in left[conv]))


def test_repair_of_little(spark):
    none = spark.createDataFrame([], TALK)
    assert cv.repair_conversations(none).audits.collect() == [] == cv.repair_conversations(none, long_rows=0).audits.collect()
    gone = spark.createDataFrame([(7, 1, "user", "x", False)], TALK + ", present boolean")
    want = [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    for limits in ({}, {"long_rows": 0}):
        assert [tuple(r) for r in cv.repair_conversations(gone, **limits).audits.collect()] == want


def test_long_repair(spark):
    """A conversation of many equal rows, and texts that are long: runs give what one pass gives."""
    rows = [(1, i % 50, "user", "same.") for i in range(400)] + [(1, i, ["user", "assistant"][i % 2], "word " * 3000 + f"{i}.") for i in range(60)]
    d = spark.createDataFrame(rows, TALK).repartition(4)
    one, many = (cv.repair_conversations(d, **x).audits.first() for x in ({}, {"long_rows": 10, "run_rows": 50}))
    assert one == many and one.duplicate == 399


def test_walk_is_least_of_the_cheapest():
    rnd = random.Random(9)
    for _ in range(300):
        rows = [(i, rnd.choice(["system", "user", "assistant", "x"]), rnd.choice(["a.", "b", "", f"{i}."])) for i in range(rnd.randrange(12))]
        _, codes, turns = cv._solved([(1, *r, True) for r in rows])
        left = cv.distances(codes, cv.GOALS)
        audit, _ = cv.walk(codes, left, 0, True)
        want = plain_repair(rows)
        assert (left[0], audit) == want[5:7] and "\n".join(f"{r}:{t}" for _, r, t in cv.edited(audit, 0, turns)) == want[7]


def test_damage(spark):
    rows = [(c, t, "assistant", "Hi. You?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = Counter((r.conv_id, r.turn, r.role, r.text, r.present) for r in cv.damage(spark.createDataFrame(rows, TALK)).collect())
    want = Counter()
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        draw = zlib.crc32(key.encode()) % 20
        role, text = role or " ", text or " "
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        want[c, t, "user" if draw == 4 else role, text, draw != 0] += 2 if draw == 3 else 1
    assert got == want


# --- lattice ---


def segmentations(word: bytes, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in segmentations(word[k:], pieces):
                yield [word[:k], *rest]


@pytest.fixture(scope="module")
def lattice():
    pieces, end, share = lattice_lm.vocabulary()
    return pieces, lattice_lm.Lattice(pieces, [math.log(x) if x else -math.inf for x in share]), share


def test_lattice_sums_all_segmentations(lattice):
    pieces, net, share = lattice
    assert abs(share.sum() - 1) < 1e-9
    for word in ("a", "the", "über", "zqx!", "日", "ab\x00c"):
        raw = word.encode()
        every = list(segmentations(lattice_lm.MARK + raw, pieces))
        chance = [math.prod(share[pieces[p]] for p in s) for s in every]
        assert len(every) > 1 and abs(net.scores([raw])[0] - math.log(math.fsum(chance))) < 1e-9
        want = Counter()
        for s, c in zip(every, chance, strict=True):
            for p in s:
                want[pieces[p]] += c / math.fsum(chance)
        got = net.expected([raw, raw], [2, 1])
        assert all(abs(3 * want[i] - got[i] / lattice_lm.FRACTION) < 1e-3 for i in want)
    assert net.scores([b"x" * 200_000])[0] < -1000  # a word of any length
    mixed = [b"the", b"a", b"", b"the", "über".encode(), b"cat"]
    assert net.scores(mixed) == [net.scores([w])[0] for w in mixed] and net.scores([]) == []


def plain_scores(rows, net, end_log):
    lower = lambda t: t.encode().lower().split() if t else []
    training = [lower(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for t in training for w in t)
    log = lambda w: net.scores([w])[0]
    ends = len(training)
    total, kinds = sum(c.values()) + ends, len(c) + (ends > 0)
    out = []
    for d, t in rows:
        ws = lower(t)
        counts = [c[w] for w in ws] + [ends]
        base = math.fsum(math.log10((x + 1) / (total + kinds + 1)) for x in counts)
        score = (math.fsum(log(w) for w in ws) + end_log) / math.log(10)
        out.append((d, len(counts), sum(x > 0 for x in counts), total, base, score))
    return out


@pytest.mark.parametrize("held", [10**6, 20, 0])
def test_scores(docs, lattice, held):
    """Without rounds the pieces keep the vocabulary's scores, so sums are those of the lattice above."""
    pieces, net, share = lattice
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    training = docs.filter(lattice_lm.learned(F.col("doc_id")))
    got = lattice_lm.score_texts(docs, training, words_held=held, rounds=0)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6))
    got = sorted((tuple(r) for r in got.collect()), key=key)
    want = sorted(plain_scores(rows, net, math.log(share[lattice_lm.vocabulary()[1]])), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)


def test_learning_pays(spark, docs):
    """Expected counts of the training texts make texts like them likelier, in the same way in every run."""
    training = docs.filter(lattice_lm.learned(F.col("doc_id")))
    held = docs.filter(~lattice_lm.learned(F.col("doc_id")))
    mean = lambda rounds, parts: [r.score for r in lattice_lm.score_texts(held, training.repartition(parts), rounds=rounds).orderBy("doc_id", "n_tokens", "score").collect()]
    before, after, again = mean(0, 1), mean(1, 2), mean(1, 7)
    assert sum(after) > sum(before) and after == again
    assert lattice_lm.score_texts(docs.limit(0), training).collect() == []
    alone = lattice_lm.score_texts(spark.createDataFrame([(1, "x y"), (None, None)], "doc_id bigint, text string")).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in alone} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}
