"""Secret scans: fixed patterns, and a guess-cost estimate for values in credential contexts.

Guess cost is the least sum, over all ways to cut a value into pieces, of the
decimal logarithm of the guesses each piece takes: a word by its rank (with case
and look-alike letters), a date, a repeated unit, a keyboard walk, or a
brute-force span over the smallest alphabet that holds it. The cost alone decides;
where a value stands in prose, as in "pass the ...", it has to be higher than
behind a colon or an equals sign, as few of these are values at all.

Words are common passwords first, then the whole words of a public vocabulary in
its own order, which is by how often they were met. Every kind of piece adds a
number of steps in proportion to the value's length, and what is kept while
a value is read does not grow with it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from heapq import merge
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.llm.common import begins, bounded_batches
from marlspike.llm.tokens import public_path

KINDS = ["assign", "access", "hex", "guess"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Contexts beyond the fixed patterns whose values are weighed; and user:value@ in addresses.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pwd|pass|passphrase|passcode|credentials?|auth|bearer|private_?key|access_?key|client_?secret|secret_?key|password|passwd|secret|token)["']?(?:\x20*[:=]\x20*|\x20+is\x20+|\x20+)["']?([^\x00-\x20"'<>,;]+)""",
    re.A | re.I,
)
ADDRESS = re.compile(r"://[^\x00-\x20/:@]+:([^\x00-\x20/@]+)@")
_KEYWORDS = (b"pass", b"secret", b"token", b"api", b"pwd", b"credential", b"auth", b"bearer", b"key")
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: Common passwords and their parts, the likeliest first.
WORDS = """password admin welcome login master dragon monkey letmein football baseball shadow sunshine princess
superman batman trustno iloveyou secret hello freedom whatever qazwsx michael jordan hunter ranger buster soccer hockey
killer george charlie andrew michelle jessica pepper access flower cheese summer winter spring autumn january february
march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday
test guest user root default change changeme temp demo sample example server system manager oracle mysql backup public
private internet computer service secure security love money happy lucky angel tiger eagle falcon silver golden orange
banana apple purple yellow green black white blue red star house mother father sister brother the and for you""".split()
#: Rows of a keyboard, the alphabet and the digits.
WALKS = ["`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789", "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm"]
LOOKALIKE = str.maketrans("@4381!0$57", "aaebiiosst")
_NEXT = {(a, b) for row in WALKS for a, b in [*zip(row, row[1:]), *zip(row[::-1], row[::-1][1:])]}
#: Alphabets of brute force: what they hold, their size.
ALPHABETS = [(lambda c: c.isdigit() and c < "\x80", 10), (lambda c: c in "0123456789abcdef", 16), (lambda c: "a" <= c <= "z", 26), (lambda c: c < "\x80" and c.isalnum(), 62), (lambda c: c < "\x80", 95), (lambda c: True, 10_000)]
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d", re.A)
#: Each piece also costs the choice of where it starts and what kind it is.
PIECE = log10(6)
#: A value in a credential context is a secret from so many guesses on, as a power of ten: behind a sign or in an address, and in prose.
GUESSES, PROSE_GUESSES = 10.0, 18.0
#: Values up to this length are remembered, and so many of them.
SHORT, KEPT = 64, 4096
#: The vocabulary whose whole words are guessed, shortest first three letters.
VOCABULARY, LEAST = "word_bpe_49k.json", 3


@cache
def ranks(path: str | None = None) -> tuple[dict[str, float], list[int]]:
    """Decimal logarithms of words' ranks, and the words' lengths; read once in each worker."""
    with open(path or public_path(VOCABULARY), encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    whole = (t.removesuffix("</w>") for t in sorted(ids, key=ids.get) if t.endswith("</w>"))
    words = dict.fromkeys([*WORDS, *(w for w in whole if len(w) >= LEAST and w.isascii() and w.isalpha())])
    return {w: log10(i + 2) for i, w in enumerate(words)}, sorted({len(w) for w in words})


def _repeats(value: str, unit: int) -> Iterator[tuple[int, int, float]]:
    """Runs of a repeated unit, each from where it starts."""
    i, n = 0, len(value)
    while i + 2 * unit <= n:
        j = i + unit
        while j < n and value[j] == value[j - unit]:
            j += 1
        times = (j - i) // unit
        if times * unit - unit >= 2:
            yield i, i + times * unit, unit * log10(62) + log10(times)
            i = j - unit + 1
        else:
            i += 1


def _walks(low: str) -> Iterator[tuple[int, int, float]]:
    """Steps along a row of keys, the alphabet or the digits, of three at least."""
    i, n = 0, len(low)
    while i < n - 1:
        j = i + 1
        while j < n and (low[j - 1], low[j]) in _NEXT:
            j += 1
        if j - i >= 3:
            yield i, j, log10(47 * (j - i) * 2)
        i = max(j - 1, i + 1) if j - i >= 3 else i + 1


def guess_cost(value: str) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` takes."""
    return _short_cost(value) if len(value) <= SHORT else _cost(value)


def _cost(value: str) -> float:
    n, (rank, lengths) = len(value), ranks()
    low = value.lower()
    low = low if len(low) == n else value
    plain = low.translate(LOOKALIKE)
    runs = merge(*(_repeats(value, unit) for unit in range(1, 5)), _walks(low))
    run = next(runs, None)
    far = float("inf")
    ahead = {0: 0.0}  # the cheapest cut of the first so many characters, where a piece ends there
    spans = [far] * len(ALPHABETS)  # the cheapest cut up to here whose last piece is a brute-force span in that alphabet
    for i in range(n):
        here = min(ahead.pop(i, far), *spans)
        offers = []
        for size in lengths:
            if i + size > n:
                break
            if (cost := rank.get(plain[i : i + size])) is not None:
                part = value[i : i + size]
                cost += 0 if part == part.lower() else log10(2) if part.istitle() or part.isupper() else log10(2**size)
                offers.append((i + size, cost + (log10(2 * size) if plain[i : i + size] != low[i : i + size] else 0)))
        if m := DATE.match(value, i):
            offers.append((m.end(), log10(120 * (366 if m.end() - i > 4 else 1) * 4)))
        while run and run[0] == i:
            offers.append(run[1:])
            run = next(runs, None)
        for end, cost in offers:
            ahead[end] = min(ahead.get(end, far), here + cost + PIECE)
        spans = [min(x, here + PIECE) + log10(size) if holds(value[i]) else far for x, (holds, size) in zip(spans, ALPHABETS, strict=True)]
    return min(ahead.get(n, far), *spans) if n else 0.0


_short_cost = lru_cache(maxsize=KEPT)(_cost)


def _assigned(m: re.Match) -> bool:
    """Whether the value follows ``:`` or ``=``, or stands in an address; else it stands in prose."""
    return m.re is ADDRESS or m[0][: m.start(1) - m.start()].rstrip(" \"'")[-1] in ":="


def scan(text: str | None, guesses: float = GUESSES) -> list[tuple[str, int, int, float]]:
    """Secrets of a text as (kind, start, end, guess cost), by start, then kind as listed."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass").lower()
    out = []
    if any(w in raw for w in _ASSIGN_WORDS):
        out += [("assign", *m.span(), guess_cost(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in raw:
        out += [("access", *m.span(), guess_cost(m[0])) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span(), guess_cost(m[0])) for m in HEX.finditer(text)]
    base = list(out)
    if any(w in raw for w in _KEYWORDS) or b"://" in raw:
        more = [m for p in (CONTEXT, ADDRESS) for m in p.finditer(text)]
        taken = _Cover(base)
        for m in sorted(more, key=lambda m: m.span(1)):
            value, (start, end) = m[1], m.span(1)
            least = guesses if _assigned(m) else max(guesses, PROSE_GUESSES)
            if not taken.meets(start, end) and (cost := guess_cost(value.rstrip(".:!?)"))) >= least:
                out.append(("guess", start, end, cost))
                taken.add(start, end)
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


class _Cover:
    """Spans met from left to right; tells whether a new one meets one of them."""

    def __init__(self, spans: list[tuple]):
        self.spans = sorted((s, e) for _, s, e, _ in spans)
        self.i, self.end = 0, -1

    def meets(self, start: int, end: int) -> bool:
        while self.i < len(self.spans) and self.spans[self.i][0] < end:
            self.end = max(self.end, self.spans[self.i][1])
            self.i += 1
        return self.end > start

    def add(self, start: int, end: int) -> None:
        self.end = max(self.end, end)


def redacted(text: str | None, spans: list[tuple]) -> str | None:
    """The text with every span, overlapping ones together, replaced by ``[SECRET]``."""
    if not spans:
        return text
    out, at, start, end = [], 0, spans[0][1], spans[0][2]
    for _, s, e, _ in [*spans[1:], ("", len(text) + 1, len(text) + 1, 0.0)]:
        if s <= end:
            end = max(end, e)
        else:
            out += [text[at:start], "[SECRET]"]
            at, start, end = end, s, e
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int,log10_guesses:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("log10_guesses", pa.float64())]))


def _forget() -> None:
    _short_cost.cache_clear()
    ranks.cache_clear()


def _scanned(guesses: float, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("secret_scans", _forget)
        for b in batches:
            texts = b.column("text")
            found = [scan(t.as_py(), guesses) for t in texts]
            spans = pa.array([[dict(zip(("kind", "start", "end", "log10_guesses"), s, strict=True)) for s in f] for f in found], _SPANS)
            names = [n for n in b.schema.names if n != "text" or not redact]
            cols = [b.column(n) for n in names] + [spans]
            if redact:
                cols.append(pa.array([redacted(t.as_py(), f) for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*names, "spans", *["text"] * redact])

    return run


def find_secrets(docs: DataFrame, guesses: float = GUESSES) -> DataFrame:
    """``doc_id, spans`` for each row of ``docs(doc_id, text)``; spans of kinds assign, access, hex (fixed patterns) and guess.

    Starts and ends are code points of the whole text, end exclusive. Null and
    empty texts have no spans; ids may be null, and repeated rows each keep their own;
    other columns are ignored, whatever their names. An empty table gives an
    empty result. Values of a ``guess`` span stand in a credential context, meet no other
    span and cost at least 10**guesses, and 10**PROSE_GUESSES in prose.
    """
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run = _scanned(guesses, False)
    return given.mapInArrow(lambda batches: (b.select(["doc_id", "spans"]) for b in run(batches)), f"doc_id bigint, spans {SPANS}")


def redact_secrets(docs: DataFrame, guesses: float = GUESSES) -> DataFrame:
    """The rows and columns of ``docs`` with every secret in ``text`` replaced by ``[SECRET]``.

    Null and empty texts stay as they are, repeated rows each stay, columns of any
    name stay, and an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    others = [c for c in docs.columns if c.lower() != "text"] or [F.lit(None).cast("int").alias("none")]
    given = docs.select(F.struct(*others).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([given.schema["row"], *T._parse_datatype_string(f"spans {SPANS}, text string").fields])
    out = given.mapInArrow(_scanned(guesses, True), schema)
    return out.select(*(F.col("text") if c.lower() == "text" else F.col("row")[c].alias(c) for c in docs.columns))
