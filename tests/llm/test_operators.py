"""The training-data operators against brute force, on small fixtures with odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers as P
from marlspike.llm import jaccard_join as jj
from marlspike.llm import language_id, line_dedup, packing, piece_encoding, quality_rules, secrets, token_counts, tokens, url_filters, vector_dedup
from marlspike.llm.common import Scratch, components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()


def words(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(n))


def corpus() -> list[tuple]:
    """Texts of many shapes: copies, near copies, shared lines, nulls, empties, ties, repeats, a long one."""
    rnd = random.Random(3)
    rows, base = [], [words(rnd, 80) for _ in range(6)]
    for i in range(120):
        t = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 9])):
            t[rnd.randrange(len(t))] = "edit" + str(rnd.randrange(999))
        t = " ".join(t)
        if i % 3 == 0:
            t = t.replace(" ", "\n", 5) + "\n  All Rights RESERVED \n"
        rows.append((i, t, "en" if i % 2 else None, "s", len(t)))
    odd = [None, "", " ", "\n\n", "one", "One", "two words", "\u00a0 \u2028x", "#$% &|", "a" * 3000, "Ünïcödé ▁ \x00 日本 𐍈", words(rnd, 6000)]
    rows += [(1000 + i, t, "de", None, None) for i, t in enumerate(odd)]
    rows += [rows[5], rows[5], (7, rows[8][1] + " tail", "en", "s", 1), (None, "null id", "en", "s", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(corpus(), SCHEMA)
    # columns whose names the operators use inside
    return d.withColumns({"row": F.lit("x"), "id": F.lit(1), "n": F.lit(2), "key": F.lit(3), "n_lines": F.lit("old"), "kept": F.lit("k"), "a": F.lit(0), "b": F.lit(0)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- very long texts ---


@pytest.fixture(scope="module")
def long_texts(spark):
    """Ten million characters, a near copy of them, and a text without a space."""
    rnd = random.Random(11)
    vocabulary = [w + str(i) for i in range(400) for w in WORDS]
    text = " ".join(rnd.choices(vocabulary, k=1_250_000))
    text = text[:5_000_000] + "\npassword=abcdef123 \n" + text[5_000_000:]
    solid = "".join(rnd.choices("abcdefghijkmnopqrstuvwxyz0123456789", k=300_000))
    rows = [(1, text, "en"), (2, solid, "de"), (3, text + " tail", "en")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3).cache()


def test_long_texts(spark, long_texts):
    rows, d = long_texts
    got = {r.doc_id: r for r in jj.near_duplicates(d, 5, 80).collect()}
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 2, 1] and got[2].n_shingles == 1
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    judged = {r.doc_id: r.n_words for r in quality_rules.judge_quality(d, labels).collect()}
    assert judged == {i: len(t.split()) for i, t, _ in rows}
    lines = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(d, min_docs=2).collect()}
    assert lines == {1: (3, 2), 2: (1, 0), 3: (3, 2)}
    spans = {r.doc_id: [(s.kind, s.start) for s in r.spans if s.kind == "assign"] for r in secrets.find_secrets(d).collect()}
    assert spans == {1: [("assign", 5_000_001)], 2: [], 3: [("assign", 5_000_001)]}
    net = language_id.learn(d)
    assert {r.doc_id: r.lang_pred for r in language_id.predict(d, net).collect()} == {1: "en", 2: "de", 3: "en"}


def test_long_texts_in_tokens(long_texts):
    rows, d = long_texts
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_lengths(d).collect()}
    assert counts[1] < counts[3] <= counts[1] + 3 and counts[2] > 100_000
    pieces = packing.pack_documents(d).collect()
    assert all(r.length == 4096 for r in pieces if r.start + r.length < max(x.start + x.length for x in pieces if x.doc_id == r.doc_id))
    out = piece_encoding.decode(piece_encoding.encode(d, dropout=0.1, seed=1).withColumn("decoded", F.lit(1))).select("doc_id", (F.col("decoded") == F.col("text")).alias("same"))
    assert {r.doc_id: r.same for r in out.collect()} == {1: True, 2: True, 3: True}


# --- components, n-gram join ---


def find(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    got = components(Scratch(spark, "t"), spark.createDataFrame(edges, "a bigint, b bigint"))
    want = find(edges, {x for e in edges if e[0] != e[1] for x in e})
    assert {r.node: r.comp for r in got.collect()} == want


def grams(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("k", "similarity"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(docs, k, similarity):
    rows = [(r.doc_id, grams(r.text, k)) for r in docs.select("doc_id", "text").collect()]
    known = [(i, g) for i, g in rows if i is not None]
    links = [(a, b) for (a, x), (b, y) in combinations(known, 2) if x and y and 100 * len(x & y) >= similarity * len(x | y)]
    want = find(links, {i for i, _ in known})
    got = jj.near_duplicates(docs, k, similarity).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(g)) for i, g in rows)
    assert all(r.component_id == want.get(r.doc_id) for r in got)


@pytest.mark.parametrize(("pairs_a_row", "rounds", "ranked"), [(0, 4, True), (0, 1, False), (10**9, 8, False)])
def test_hot_ngrams(spark, monkeypatch, pairs_a_row, rounds, ranked):
    """N-grams that thousands of unlike documents share, met by rounds, by split buckets and by all pairs at once."""
    rnd = random.Random(8)
    texts = [f"here stands a common passage {words(rnd, rnd.randrange(4, 16))}" for _ in range(1500)]
    for t in texts[:150]:
        w = t.split()
        w[rnd.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    sets = [grams(t, 2) for t in texts]
    index: dict = {}
    for i, g in enumerate(sets):
        for x in g:
            index.setdefault(x, []).append(i)
    common = Counter(p for x, ids in index.items() if x[0] not in ("here", "stands", "a", "common") for p in combinations(ids, 2))
    hot = {i: sum(x[0] in ("here", "stands", "a", "common") for x in g) for i, g in enumerate(sets)}
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if 2 * min(hot[a], hot[b]) + 2 * common[a, b] >= 0.5 * min(len(sets[a]), len(sets[b]))]
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 50 * len(sets[a] | sets[b])]
    monkeypatch.setattr(jj, "PAIRS_A_ROW", pairs_a_row)
    monkeypatch.setattr(jj, "ROUNDS", rounds)
    monkeypatch.setattr(jj, "SPLIT_FROM", 0)
    if not ranked:  # any order has to give the same result
        monkeypatch.setattr(jj, "rarity", lambda *_: (np.empty(0, np.uint64), np.empty(0, np.uint32)))
    got = jj.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 2, 50)
    assert {r.doc_id: r.component_id for r in got.collect()} == find(links, range(len(texts)))


def test_altered_copies(spark, monkeypatch):
    """Copies that link with the text they were altered from and hardly with each other: candidates grow with their number."""
    rnd = random.Random(5)
    text = [f"w{rnd.randrange(3000)}" for _ in range(150)]
    texts = [" ".join(text)]
    for _ in range(400):
        w = list(text)
        for at in rnd.sample(range(150), 2):
            w[at] = f"x{rnd.randrange(10**9)}"
        texts.append(" ".join(w))
    rnd.shuffle(texts)
    compared, verify = [], jj._verify
    monkeypatch.setattr(jj, "_verify", lambda *a: compared.append(a[3].count()) or verify(*a))
    got = jj.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 4, 85)
    assert {r.component_id for r in got.collect()} == {0}
    assert sum(compared) <= 2 * len(texts)


def test_ngram_join_of_nothing(none):
    assert jj.near_duplicates(none).count() == 0


@settings(deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_suffix_bound_holds(x, y, both):
    a, b = (np.array(sorted(s | both), np.uint64) for s in (x, y))
    low = jj.least_difference(jj.parities(a, jj.fine_bits(len(a))).tobytes(), jj.parities(b, jj.fine_bits(len(b))).tobytes())
    assert low <= len((x | both) ^ (y | both))


# --- line dedup ---


def test_line_dedup(docs):
    rows = docs.select("doc_id", "text").collect()
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    where: dict = {}
    for r in rows:
        for s in (r.text or "").split("\n"):
            where.setdefault(key(s), set()).add(r.doc_id)
    want = Counter()
    for r in rows:
        ls = (r.text or "").split("\n")
        kept = [s for s in ls if not key(s) or len(where[key(s)]) < 10]
        want[r.doc_id, len(ls), len(ls) - len(kept), "\n".join(kept)] += 1
    out = line_dedup.dedup_lines(docs, 10, 1)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()) == want
    assert any(n for (_, _, n, _) in want) and {"row", "id", "key", "source"} <= set(out.columns)


def test_line_dedup_of_nothing(none):
    assert line_dedup.dedup_lines(none).count() == 0


# --- quality rules ---


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for s in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", s):
            dup += s in seen
            seen.add(s)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cov = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), dup, len(cov), len(text.split("\n"))


@settings(deadline=None)
@given(st.text("ab \n\t#|\u00e9\u2003", max_size=60))
def test_base_counts(text):
    assert quality_rules.base_counts(text) == plain_counts(text)


def test_binomial():
    from math import comb

    for n, k, p in [(10, 0, 0.3), (50, 2, 0.1), (200, 1, 0.02)]:
        assert quality_rules.binomial_cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)
    assert quality_rules.binomial_cdf(5, 10, 0.1) == 1.0
    assert 0 < quality_rules.binomial_cdf(9_000, 1_000_000, 0.01) < 1e-20


def test_cutoffs_keep_their_promise(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(6000):
        bad = i % 3 == 0
        t = words(rnd, 60)
        rows.append((i, t + (" ###" * 40 if bad else " #" if rnd.random() < 0.3 else ""), "en" if i % 2 else "fr", "s", 0))
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(6000)], "doc_id bigint, quality int")
    out = {r.doc_id: r for r in quality_rules.judge_quality(d, labels).collect()}
    assert all(r.cutoff is not None and r.n_held > 500 and r.p_value <= 0.025 for r in out.values()), "both strata are certified"
    assert not any(out[i].kept for i in range(0, 6000, 3)), "junk goes"
    assert all("symbol_share" in out[i].failed and not out[i].base_failed for i in range(0, 6000, 3)), "by the method, not by a base rule"
    good = [i for i in range(6000) if i % 3]
    assert sum(not out[i].kept for i in good) <= 0.05 * len(good)


def plain_verdicts(rows, labels, risk=0.05, delta=0.05):
    """Rarity, cutoff and verdict of each row (doc_id, stratum, counts), by loops."""
    from hashlib import md5
    from math import comb

    grid, of = quality_rules.GRID, {}
    for i, q in labels:
        of[i] = max(q, of.get(i, 0))
    part = {i: "bad" if q == 0 else "fit" if md5(str(i).encode()).hexdigest()[0] < "8" else "held" for i, q in of.items()}
    valued = []
    for i, s, (n, chars, symbols, dup, repeat, lines) in rows:
        ms = [symbols / chars if chars else 0, dup / lines, repeat / n if n else 0, chars / n / 20 if n else 0, 1 - chars / n / 20 if n else 0]
        valued.append((i, s, [sum(1000 * m + 1e-9 >= c for c in grid) for m in ms], n < 50 or 100 * repeat > 50 * n))
    fit = [v for i, _, v, _ in valued if part.get(i) == "fit"]
    rarity = [min(sum(x[m] >= v[m] for x in fit) * 10**6 // len(fit) for m in range(5)) for _, _, v, _ in valued]
    strata = {s for _, s, _, _ in valued}
    held, bad = ({s: [r for (i, t, _, _), r in zip(valued, rarity, strict=True) if t == s and part.get(i) == kind] for s in strata} for kind in ("held", "bad"))
    testable = [s for s in strata if (1 - risk) ** len(held[s]) <= delta]
    cut = {}
    for s in testable:
        best = None
        for c in quality_rules.RARITIES:
            n, k = len(held[s]), sum(r <= c for r in held[s])
            if sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1)) > delta / len(testable):
                break
            if best is None or sum(r <= c for r in bad[s]) > best[0]:
                best = sum(r <= c for r in bad[s]), c
        cut[s] = best and best[1]
    return [(i, r, cut.get(s), not base and not (cut.get(s) is not None and r <= cut[s])) for (i, s, _, base), r in zip(valued, rarity, strict=True)]


def test_quality_against_loops(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        t = words(rnd, rnd.randrange(40, 90)) + " #" * rnd.choice([0, 0, 0, 1, 2, 30]) + "\nsame line" * rnd.choice([0, 0, 3])
        rows.append((i, t, ["en", "fr", "de", None][min(3, rnd.randrange(12) // 3)] if i < 1450 else "few", "s", 0))
        if rnd.random() < 0.9:
            labels.append((i, 0 if t.count("#") > 20 else 1))
    labels += [(1, 0), (5000, 1)]
    got = quality_rules.judge_quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    want = plain_verdicts([(r[0], r[2] or "", plain_counts(r[1])) for r in rows], labels)
    assert sorted((r.doc_id, r.rarity, r.cutoff, r.kept) for r in got) == sorted(want)
    assert len({c for _, _, c, _ in want}) > 1


def test_quality_of_odd_rows(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    got = quality_rules.judge_quality(docs, labels).collect()
    texts = Counter((r.doc_id, *plain_counts(r.text)) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, *(r[c] for c in quality_rules.BASE)) for r in got) == texts
    assert all(r.kept != r.base_failed for r in got), "too few labels certify nothing"
    assert quality_rules.judge_quality(none, labels).count() == 0
    assert quality_rules.judge_quality(docs.drop("lang"), labels.limit(0)).count() == docs.count()


# --- secrets ---

PLAIN = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}


def base_spans(text):
    return sorted(((k, *m.span()) for k, (p, g, n) in PLAIN.items() for m in p.finditer(text or "") if len(m[g]) >= n), key=lambda s: (s[1], secrets.KINDS.index(s[0])))


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from(["token", "=", ":", " ", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "PassWord", "api_key", "apikey", "'", '"', "x", "\u017fecret", "\u212aey", "pwd", "Zk39!xq77Q"]), max_size=14))
def test_base_spans_stay(parts):
    text = "".join(parts)
    got = secrets.scan(text)
    assert [s[:3] for s in got if s[0] != "guess"] == base_spans(text)
    assert "[SECRET]" in (secrets.redacted(text, got) or "") or not got


def test_guess_costs_order():
    cost = secrets.guess_cost
    assert cost("password1") < cost("Dragon2019") < cost("kq8#Zp1x!") < cost("f3a9c1e07b5d2846")
    assert cost("aaaaaaaaaa") < cost("qwertyuiop") + 2 < cost("xkqzvjwpyt")
    assert cost("2021-03-04") < 7 and cost("") == 0
    assert cost("ab" * 50_000) < 12


def least_cost(value):
    """Over all cuts of a value, pieces costed one by one from their definitions."""
    from functools import cache
    from math import log10

    rank, n = secrets.ranks()[0], len(value)
    low = value.lower()
    swap = {"@": "a", "4": "a", "3": "e", "8": "b", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}
    plain = "".join(swap.get(c, c) for c in low)

    def piece(i, j):
        s = value[i:j]
        found = [(j - i) * log10(size) for holds, size in secrets.ALPHABETS if all(map(holds, s))]
        if plain[i:j] in rank:
            case = 1 if s == s.lower() else 2 if s == s.capitalize() or s == s.upper() else 2 ** (j - i)
            found.append(rank[plain[i:j]] + log10(case) + (log10(2 * (j - i)) if plain[i:j] != low[i:j] else 0))
        if (m := secrets.DATE.match(value, i)) and m.end() == j:
            found.append(log10(480 * (366 if j - i > 4 else 1)))
        for u in range(1, 5):
            end = next((k for k in range(i + u, n) if value[k] != value[k - u]), n)
            begins = i == 0 or i - 1 + u >= n or value[i - 1] != value[i - 1 + u]
            times = (end - i) // u
            if begins and times * u - u >= 2 and j == i + times * u:
                found.append(u * log10(62) + log10(times))
        steps = [any(low[k : k + 2] in w or low[k : k + 2][::-1] in w for w in secrets.WALKS) for k in range(n - 1)]
        if j - i >= 3 and all(steps[i : j - 1]) and not (i and steps[i - 1]) and not (j < n and steps[j - 1]):
            found.append(log10(94 * (j - i)))
        return min(found) + secrets.PIECE

    @cache
    def best(i):
        return 0.0 if i == n else min(piece(i, j) + best(j) for j in range(i + 1, n + 1))

    return best(0)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from(["mango", "Blue", "dR4g0n", "PASS", "kitchen", "2019-03-04", "1999", "31121999", "aaa", "ababab", "xyzxyz", "qwer", "rewq", "abc", "98765", "1qaz", "zk", "Q", "7", "#", "-", "é", "日", "f3a9"]), max_size=6))
def test_guess_cost_is_the_least_segmentation(parts):
    value = "".join(parts)[:28]
    assert secrets.guess_cost(value) == pytest.approx(least_cost(value))


def test_words_of_the_vocabulary_are_cheap_and_long_values_bounded():
    cost = secrets.guess_cost
    assert cost("elephantmountain77") < 14 and cost("kitchen-window") < 14 < cost("qjxv-kzpw-mbtr-hgfd")
    assert cost("zq7K" * 50_000) < 20
    assert cost("".join(random.Random(1).choices("abcXYZ019#", k=20_000))) > 10_000


def test_method_spans():
    found = secrets.scan("pwd: Xk39fjQpz81 then https://bob:hunter9Zk31qq@h/ and pass is password and auth is something")
    assert [f[0] for f in found] == ["guess", "guess"]


@pytest.mark.parametrize("text", ["pwd=hRt-QwZp_LmXcVb", "passphrase: XqLmZvRtWkPdNsGh", 'auth = "kzQvXjwPmTrb"', "https://bob:hRtQwZpLmXcVb@h/"])
def test_assigned_values_without_digits_are_weighed(text):
    assert [s[0] for s in secrets.scan(text)] == ["guess"]
    assert not any(secrets.scan(t) for t in ("pwd=passwordpassword", "pass the documentation", "the secret is important", "auth Benutzerkonto"))


def test_the_cost_decides_in_prose_too():
    for text in ("auth is hRtQwZpLmXcVb", "pass qjxv-kzpw-mbtr-hgfd on", "credentials Xk39fjQpz81w"):
        assert [s[0] for s in secrets.scan(text)] == ["guess"]
    assert not secrets.scan("pass hunter2019 on"), "cheap, though it has digits"


def test_only_a_text_column(spark):
    assert [s[1:3] for s in secrets.scan("pwd=h$T9k!q")] == [(4, 11)]  # the cost alone decides, whatever the length
    got = secrets.redact_secrets(spark.createDataFrame([("pwd=hRt-QwZp_LmXcVb",), (None,)], "text string")).collect()
    assert [r.text for r in got] == ["pwd=[SECRET]", None]


def test_secret_frames(docs, none):
    got = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.kind != "guess")) for r in secrets.find_secrets(docs).collect())
    assert got == Counter((r.doc_id, tuple(base_spans(r.text))) for r in docs.select("doc_id", "text").collect())
    assert secrets.find_secrets(none).count() == 0
    red = secrets.redact_secrets(docs.withColumn("text", F.concat("text", F.lit(" password=abcdef123"))))
    assert red.columns == docs.columns and red.filter("text like '%abcdef123%'").count() == 0
    assert red.filter("text is null").count() == docs.filter("text is null").count()


# --- tokens, counts, packing ---


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text("aB'sé\u0301Hh\u0331 \t\n.,!?<|>09ß日İΣσς\x1c\u00a0Ŀſ", max_size=30), max_size=4))
def test_word_ids(word_bpe, texts):
    texts = [*texts, "<|endoftext|> don't", None]
    got = tokens.worker(tokens.WordEncoder, P.path("word_bpe_49k.json")).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [word_bpe.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(deadline=None, max_examples=100)
@given(st.text("ab' 's\n\t\x1c\u00a0é9<|>", max_size=60))
def test_byte_counts(text):
    count = tokens.worker(tokens.ByteCounter, P.path("byte_bpe_50k.tiktoken"))
    assert count(text) == len(count.encoding.encode_ordinary(text))


def test_histogram(spark, docs, none):
    got = {r.n_tokens: r for r in token_counts.token_counts(docs).collect()}
    count = tokens.worker(tokens.ByteCounter, P.path("byte_bpe_50k.tiktoken"))
    sizes = [len(count.encoding.encode_ordinary(r.text or "")) for r in docs.select("text").collect()]
    assert set(got) == set(sizes)
    for n, r in got.items():
        assert r.n_docs == sizes.count(n) and r.n_longer == sum(s > n for s in sizes) and r.total == sum(sizes)
        assert r.tokens_at_least == sum(s for s in sizes if s >= n) and r.truncated_total == sum(min(s, n) for s in sizes)
        assert r.quantile == pytest.approx(sum(s <= n for s in sizes) / len(sizes))
    assert token_counts.token_counts(none).count() == 0


def check_packing(rows, capacity):
    by: dict = {}
    for seq, off, length in rows:
        by.setdefault(seq, []).append((off, length))
    for items in by.values():
        at = 0
        for off, length in sorted(items):
            assert off == at
            at += length
        assert at <= capacity
    return len(by)


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=20))
def test_plan(counts):
    rows = packing.plan_bins(counts, 60)
    placed, ranks = [], Counter()
    for length, r0, r1, per, first, off in rows:
        for r in range(r0, r1):
            placed.append((first + (r - r0) // per, off + (r - r0) % per * length, length))
            ranks[length, r] += 1
    assert set(ranks.values()) <= {1} and Counter(k for k, _ in ranks) == Counter(counts)
    n, total = check_packing(placed, 60), sum(k * v for k, v in counts.items())
    assert n <= 1 + 1.5 * max(-(-total // 60), sum(v for k, v in counts.items() if k > 30))


def test_packing(docs, none, word_bpe):
    got = packing.pack_documents(docs, capacity=256).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = word_bpe.encode(r.text or "", add_special_tokens=False).ids + [1]
        for i in range(0, len(ids), 256):
            p = ids[i : i + 256]
            want[r.doc_id, i // 256, i, len(p), zlib.crc32(np.array(p, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    n = check_packing([(r.sequence_id, r.offset, r.length) for r in got], 256)
    assert n <= 1.1 * -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack_documents(none).count() == 0


# --- URL filters ---

RULES = [url_filters.Rule("block", "com", "/en/"), url_filters.Rule("allow", "example.com", "/en/7"), url_filters.Rule("block", "org", "")]


def judged(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        r = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)))
        return host, path, r.host + r.path, r.verdict
    return host, path, None, "block" if host in listed and host else "allow"


def test_urls(spark):
    rnd = random.Random(2)
    urls = [f"http://h{rnd.randrange(900)}.Net/p?q#f" for _ in range(3000)]
    urls += [None, "", "nothing", "://", "x://", "http://A.COM", "http://a.com/en/x", "http://b.example.com/en/77", "http://notexample.com/en/7", "ftp://o.org#x", "http://u?x://y/z", "http://h.net://x/"] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({"host": F.lit("old"), "verdict": F.lit("old"), "listed": F.lit(1)})
    listed = {f"h{i}.net" for i in range(0, 900, 7)}
    table = spark.createDataFrame([(h,) for h in [*listed, "absent.net", None, "h7.net", ""]], "host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages, RULES, table).collect()}
    assert got == {i: judged(u, listed) for i, u in enumerate(urls)}
    plan = url_filters.judge_urls(pages, RULES, table)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan
    assert url_filters.judge_urls(pages, RULES, table.limit(0)).filter("rule is null and verdict = 'block'").count() == 0
    assert url_filters.judge_urls(pages.limit(0), [], table).count() == 0


def test_cascade_is_exact_with_tight_filters(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "BITS", 3)
    monkeypatch.setattr(url_filters, "HASHES", 2)
    universe = spark.createDataFrame([(f"k{i}", i % 5 == 0) for i in range(2000)], "host string, listed boolean")
    filters = url_filters.cascade(Scratch(spark, "t"), universe)
    assert len(filters) > 2
    assert universe.filter(url_filters.is_listed(F.col("host"), filters) != F.col("listed")).count() == 0


# --- pieces ---


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@settings(deadline=None, max_examples=80)
@given(st.text("ab the ing\n\té日𐍈\x00<s>", max_size=90))
def test_without_dropout_pieces_are_the_librarys(sp, text):
    e = piece_encoding._encoder("piece_bpe_32k.model", None, 0.0, 1)
    (raw,) = e.encode([text], [1])
    assert np.frombuffer(raw, "<u4").tolist() == sp.encode(text)
    assert e.decode(raw) == text


@settings(deadline=None, max_examples=60)
@given(st.text("thein g\n▁é", max_size=70))
def test_dropout_is_lossless_and_repeats(text):
    e = piece_encoding._encoder("piece_bpe_32k.model", None, 0.3, 9)
    a, b = e.encode([text, text], [5, 5])
    assert a == b and e.decode(a) == text


def test_both_agendas_agree(monkeypatch):
    e = piece_encoding._encoder("piece_bpe_32k.model", None, 0.2, 4)
    text = " ".join(WORDS * 3) + " antidisestablishmentarianism\n" + "x" * 40
    side = e.encode([text], [3])
    monkeypatch.setattr(piece_encoding, "SIDE_BY_SIDE", 0)
    assert e.encode([text], [3]) == side


def test_each_occurrence_of_a_word_is_cut_on_its_own():
    e = piece_encoding._encoder("piece_bpe_32k.model", None, 0.3, 2)
    word = "antidisestablishmentarianism"
    got = e.encode([word] * 2000, list(range(2000)))
    assert len(set(got)) > 100 and all(e.decode(x) == word for x in got)
    assert len(set(e.encode([word + "\n"] * 3 + [f"{word}\n" * 500], [1, 1, 2, 1]))) == 3


def test_pieces_of_frames(docs, none, sp):
    enc = piece_encoding.encode(docs, dropout=0.2, seed=3)
    rows = piece_encoding.decode(enc).collect()
    assert all(r.decoded == (r.text or "") for r in rows) and len(rows) == docs.count()
    longer = sum(len(r.ids) // 4 for r in rows)
    assert longer > sum(len(sp.encode(r.text or "")) for r in rows), "dropout cuts finer"
    assert piece_encoding.encode(none).count() == 0


def plain_cut(e, chunk, key):
    """The agenda for one chunk by looking at all pairs again after each merge, with the skip rule in whole numbers."""
    top = 2**64

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % top
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % top
        return x ^ (x >> 31)

    def skipped(start, middle, end):
        return mix((mix((key + start * 0x9E3779B97F4A7C15) % top) + middle * 0xBF58476D1CE4E5B9 + end * 0x94D049BB133111EB) % top) < e.dropout * top

    parts = [(int(e.of_char[ord(c)]), i, i + 1) for i, c in enumerate(chunk)]
    while True:
        found = []
        for a, b in zip(parts, parts[1:]):
            m = e.pairs.get(a[0] * e.size + b[0]) if a[0] >= 0 and b[0] >= 0 else None
            if m is not None and not skipped(a[1], a[2], b[2]):
                found.append((-float(e.scores[m]), a[1], m, b[2]))
        if not found:
            out = []
            for p, i, _ in parts:
                out += [p] if p >= 0 else [int(e.byte_ids[b]) for b in chunk[i].encode()]
            return out
        _, start, m, end = min(found)
        parts = [p for p in parts if p[1] < start] + [(m, start, end)] + [p for p in parts if p[1] >= end]


def test_dropout_by_plain_agenda():
    from xxhash import xxh3_64_intdigest

    e = piece_encoding.PieceEncoder(tokens.public_path("piece_bpe_32k.model"), 0.3, 9)
    texts = ["The quick brown foxes jumped over internationalization.\n\nNew  lines, 日本 ▁ and 𐍈", "a" * 70 + " tail " + "abc" * 30, "", "same same same same"]
    for doc, (text, got) in enumerate(zip(texts, e.encode(texts, list(range(len(texts)))), strict=True)):
        base, want = xxh3_64_intdigest(str(doc).encode(), seed=9), []
        for place, chunk in enumerate(re.findall(" *[^ \n]+|\n| +", " " + text) if text else []):
            x = (place * 0x9E3779B97F4A7C15 + base) % 2**64
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
            want += plain_cut(e, chunk, x ^ (x >> 31))
        assert np.frombuffer(got, "<u4").tolist() == want


def test_occurrences_are_cut_on_their_own():
    e = piece_encoding.PieceEncoder(tokens.public_path("piece_bpe_32k.model"), 0.3, 1)
    n, ways = 3000, set()
    raw = e.encode(["internationalization"] * n, list(range(n)))
    ways = {r for r in raw}
    assert len(ways) > 50 and {e.decode(r) for r in raw} == {"internationalization"}


# --- language ---


def plain_softmax(net, window):
    """One window through the network, a byte and a filter at a time."""
    x = [net.embed[b] for b in window.tolist()]
    pooled = []
    for f in range(net.filters.shape[2]):
        pooled.append(max(sum(float(x[i + k] @ net.filters[k, :, f]) for k in range(4)) for i in range(len(x) - 3)) + net.bias[f])
    z = np.maximum(pooled, 0) @ net.dense + net.shift
    e = np.exp(z - z.max())
    return e / e.sum()


def test_tables_say_what_the_convolution_says():
    rng = np.random.default_rng(3)
    windows = rng.integers(0, 256, (40, language_id.WINDOW), dtype=np.uint8)
    net = language_id.fit(windows, [["aa", "bb", "cc"][i % 3] for i in range(40)])
    assert np.allclose(net.softmax(windows[:4]), [plain_softmax(net, w) for w in windows[:4]], atol=1e-4)
    narrow = np.concatenate([np.full(n, w) for w, n in language_id.WIDTHS.items()])
    assert not any(net.filters[k, :, f].any() for f, w in enumerate(narrow) for k in range(w, 4)), "narrow filters stay narrow"


def test_language_of_odd_rows(docs):
    """Columns with names that are used inside, repeated rows, a null id; ties go to the first language by name."""
    net = language_id.learn(docs)
    assert language_id.fit(*(lambda d: (np.frombuffer(b"".join([w for _, w in d]), np.uint8).reshape(-1, language_id.WINDOW), [x for x, _ in d]))([("en", b"x" * 512), ("de", b"y" * 512)])).langs == ["de", "en"]
    got = language_id.predict(docs.withColumns({"lang_pred": F.lit(1), "score": F.lit(2), "window": F.lit(3), "i": F.lit(4)}), net).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    by = {}
    for r, t in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.score)), range(10**6)):
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert len(by[5]) == 1, "repeated rows have one answer"
    assert by[1000] == {("und", 0.0)}
    again = language_id.learn(docs.withColumns({"window": F.lit(1), "i": F.lit("x")}).repartition(3))
    assert all(np.array_equal(a, b) for a, b in ((net.embed, again.embed), (net.dense, again.dense)))
    flat = language_id.Network(["de", "en"], net.embed, net.filters, net.bias, np.zeros((len(net.bias), 2)), np.zeros(2))
    assert language_id.predict_text(flat, "some words") == ("de", 0.5)


def test_language(spark, none):
    rnd = random.Random(8)
    alphabets = {"aa": "abcdefg", "bb": "uvwxyzß", "cc": "mnopqé"}
    rows = []
    for i in range(600):
        lang = rnd.choice(list(alphabets))
        t = " ".join("".join(rnd.choice(alphabets[lang]) for _ in range(5)) for _ in range(rnd.choice([3, 60, 300])))
        rows.append((i, t, lang, "s", 0))
    rows += [(2000, None, "aa", "s", 0), (2001, "12 34 !", "bb", "s", 0), (2002, "", None, "s", 0), (None, "uvwxy zß", None, "s", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    net = language_id.learn(d.filter(~language_id.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in language_id.predict(d, net).collect()}
    held = [(i, lang) for i, _, lang, _, _ in rows if i is not None and i < 2000 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2000, 2001, 2002))
    assert got[None].lang_pred in alphabets and all(0 <= r.score <= 1 for r in got.values())
    again = language_id.learn(d.filter(~language_id.held_out(F.col("doc_id"))))
    assert np.array_equal(again.embed, net.embed)
    assert language_id.learn(none) is None
    assert {r.lang_pred for r in language_id.predict(d, None).collect()} == {"und"}


@settings(deadline=None)
@given(st.binary(max_size=3000))
def test_windows_cover_all_bytes(raw):
    w = language_id.cut(raw)
    assert w.shape[1] == language_id.WINDOW
    if len(raw) >= language_id.WINDOW:
        assert len(w) <= 1 + len(raw) // (language_id.WINDOW - language_id.OVERLAP) + 1
        assert w[0].tobytes() == raw[: language_id.WINDOW] and w[-1].tobytes() == raw[-language_id.WINDOW :]


def test_packing_keeps_columns_of_any_name(spark):
    rows = [(i % 40, i // 40, [5, 5, 5, 9][i % 4], f"x{i}", "s", i, i, i, i, i, i, "m") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint, part string, rank string, before int, per int, first int, r0 int, r1 int, off int, offset string")
    got = packing.pack(d.withColumn("a.b", F.lit(1)), 16).collect()
    assert sorted(tuple(r)[:-3] for r in got) == sorted(r[:-1] for r in rows)
    used: dict = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for places in used.values():
        places.sort()
        assert places[0][0] == 0 and all(a[1] == b[0] for a, b in zip(places, places[1:])) and places[-1][1] <= 16
    assert len({(r.sequence_id, r.offset) for r in got}) == 3000


def test_shards_of_filters(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 300}.{['com', 'net'][i % 2]}/en/{i}" + ("?utm_x=1" if i % 300 < 90 else "")) for i in range(1500)] + [(None, None), (7, "x")], "page_id bigint, url string")
    rules = [url_filters.Rule("block", "com", "/en/1"), url_filters.Rule("allow", "h3.net", "/")]
    want = Counter(map(tuple, url_filters.judge_urls(pages, rules, url_filters.tracking_hosts(pages)).collect()))
    monkeypatch.setattr(url_filters, "LONGS", 5)
    got = Counter(map(tuple, url_filters.judge_urls(pages, rules, url_filters.tracking_hosts(pages)).collect()))
    assert got == want and sum(got.values()) == 1502
    assert {r[4] for r in got} == {"allow", "block"}


def test_foreign_chunks_are_encoded_plainly(spark, monkeypatch):
    """Where the splitter does not do what is foreseen, ids are still the library's."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    monkeypatch.setattr(tokens, "_LATIN", re.compile(r"[A-Za-z'\u00e9-]+[.,;:!?]*").fullmatch)
    texts = ["it's don't x-y-z hello", "plain words, only", "l'été déjà-vu."]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.WordEncoder(path).encode(texts)] == want


# --- vectors ---


def vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16))
    x[300:360] = x[300] + rng.normal(size=(60, 16)) * 0.08
    x[400:420] = x[5]
    x[500:530] = x[500] * np.linspace(1, 9, 30)[:, None]
    rows = [(int(i), v.astype("f4").tolist(), 0) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1.0, None] + [1.0] * 14]
    rows += [(9000 + i, v, 1) for i, v in enumerate(odd)] + [(None, x[5].astype("f4").tolist(), 2), (9100, [1.0, 2.0], 3), (9101, [2.0, 4.0], 3)]
    return rows


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "WANTED", 150)
    d = spark.createDataFrame(vectors(), "vec_id bigint, embedding array<float>, rid int").withColumn("cell", F.lit(1))
    found = vector_dedup.near_duplicate_vectors(d)
    good = [(i, np.pad(np.array(v, "f8"), (0, 16 - len(v)))) for i, v, _ in vectors() if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, x = [i for i, _ in good], np.stack([v for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.9
    comp = find([(ids[a], ids[b]) for a, b in zip(*np.nonzero(s), strict=True)], ids)
    n = dict(zip(ids, (s.sum(1) - 1).tolist(), strict=True))
    got = {r.vec_id: r for r in found.rows.collect()}
    true = sum(n.values())
    assert all(got[i].n_links <= n[i] for i in ids) and sum(got[i].n_links for i in ids) >= 0.95 * true
    assert sum(got[i].component_id == comp[i] for i in ids) >= 0.99 * len(ids)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9000, 9006))
    assert got[None].component_id is None and not got[None].kept and got[9100].component_id == got[9101].component_id == 9100
    assert all(r.found >= 0.9 * r.expected for r in found.audit.collect())


def test_large_cells_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "WANTED", 40)
    monkeypatch.setattr(vector_dedup, "MOST", 60)
    monkeypatch.setattr(vector_dedup, "CENTROIDS", 2)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(60, 12)), 5, 0) + rng.normal(size=(300, 12)) * 0.02
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = vector_dedup.near_duplicate_vectors(d)
    assert sum(r.n_links for r in found.rows.collect()) >= 0.9 * 300 * 4
    assert max(r.n for r in found.audit.collect()) < 300


def test_a_large_cell_loses_no_links(spark, monkeypatch):
    """All 400 vectors lie in range of each other; cells hold 60."""
    monkeypatch.setattr(vector_dedup, "WANTED", 40)
    monkeypatch.setattr(vector_dedup, "MOST", 60)
    rng = np.random.default_rng(2)
    x = rng.normal(size=16) + rng.normal(size=(400, 16)) * 0.1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (u @ u.T).min() >= 0.9
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = vector_dedup.near_duplicate_vectors(d)
    rows = found.rows.collect()
    assert len(rows) == 400 and sum(r.n_links for r in rows) >= 0.98 * 400 * 399 and {r.component_id for r in rows} == {0}
    assert max(r.n for r in found.audit.collect()) <= 60


def test_links_between_many_cells(spark, monkeypatch):
    """Hundreds of cells against brute force over the whole table."""
    monkeypatch.setattr(vector_dedup, "WANTED", 4)
    rng = np.random.default_rng(6)
    c = rng.normal(size=(600, 16))
    x = np.concatenate([c, c + rng.normal(size=(600, 16)) * np.linalg.norm(c, axis=1, keepdims=True) * 0.105])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = vector_dedup.near_duplicate_vectors(d)
    assert found.audit.count() >= 200
    s = u @ u.T >= 0.9
    comp = find(list(zip(*np.nonzero(s), strict=True)), range(1200))
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.rows.collect()} == {i: (s[i].sum() - 1, comp[i]) for i in range(1200)}


def test_the_graph_of_a_cell_finds_its_links():
    """A graph built by insertion, searched from a few entries, against all pairs."""
    rng = np.random.default_rng(2)
    x = vector_dedup.unit(np.repeat(rng.normal(size=(250, 32)), 8, 0) + rng.normal(size=(2000, 32)) * rng.uniform(0.05, 0.5, (2000, 1)))
    starts, targets = vector_dedup.build(x)
    a, b = vector_dedup.search(x, starts, targets, np.arange(0, 2000, 11), np.arange(2000), 0.9, 32)
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if i != j}
    got = {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i != j}
    assert got <= want and len(got) >= 0.99 * len(want) > 5000
    degree = np.diff(starts)
    assert degree.min() > 0 and degree.mean() <= 2 * vector_dedup.DEGREE


def test_recall_over_the_whole_table(spark, monkeypatch):
    """At least eight cells; vectors whose id is divisible by 50 against all rows, in several blocks."""
    monkeypatch.setattr(vector_dedup, "WANTED", 300)
    monkeypatch.setattr(vector_dedup, "HELD", 1 << 13)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(800, 24)), 5, 0) + rng.normal(size=(4000, 24)) * rng.uniform(0.05, 0.45, (4000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(rng.permutation(x))] + [(4000, None), (4050, [0.0] * 24)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = vector_dedup.near_duplicate_vectors(d)
    assert found.audit.count() >= 8
    r = vector_dedup.recall(d, found.rows).first()
    assert r.queries == 80 and r.expected > 100 and r.found >= 0.99 * r.expected
    assert vector_dedup.recall(d.limit(0), found.rows).first().expected == 0


def test_one_id_with_several_vectors(spark):
    """Each of the vectors with id 1 has links of its own: to 10 and 11, and to 0."""
    rows = [(1, [1.0, 0.0, 0.0]), (10, [1.0, 0.1, 0.0]), (11, [1.0, 0.0, 0.1]), (1, [0.0, 1.0, 0.0]), (0, [0.0, 1.0, 0.1]), (2, [0.0, 0.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicate_vectors(d).rows.collect())
    assert got == Counter([(1, 2, 1, True), (10, 2, 1, False), (11, 2, 1, False), (1, 1, 0, False), (0, 1, 0, True), (2, 0, 2, True)])


def test_vectors_of_nothing(spark):
    d = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vector_dedup.near_duplicate_vectors(d).rows.count() == 0
    assert vector_dedup.near_duplicate_vectors(d).audit.count() == 0


