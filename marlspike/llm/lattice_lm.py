"""LM scoring: the probability of a text under a unigram model of subword pieces, over all its segmentations.

Pieces are those of a public vocabulary. Their weights start from the scores that
it has and are refined by the expected counts of pieces in training words, which
are found with the same recursion. Pieces never cross words, so a text's
probability is the product of its words' and the end's.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import Scratch, bounded_batches
from marlspike.llm.tokens import public_path

#: Training words that every worker holds with their counts and scores: the most frequent ones, at most so many (some 100 MB).
WORDS_HELD = 400_000
#: Words whose scores a worker keeps besides, and bytes of the longest word that it keeps or holds.
KEPT, LONGEST = 300_000, 48
#: Words that a worker counts, or bytes of text that it has read, before it hands on their sums.
HELD, HELD_BYTES = 400_000, 64 << 20
#: Passes of expectation over the training words, and the weight of the vocabulary's own scores beside their counts.
ROUNDS, PRIOR = 1, 32_000.0
#: Words that a task takes through the lattice.
WORDS_DEALT = 20_000
#: Bytes of words that go through the lattice side by side, and distinct words of documents that are looked up together.
STACKED, WORDS_TOGETHER = 1 << 16, 400_000
#: Expected counts are summed in these fractions, as whole numbers, so that sums do not depend on their order.
FRACTION = 1 << 16
#: The mark that pieces have before a word.
MARK = "▁".encode()
END = "</s>"


def learned(doc_id: Column) -> Column:
    """Whether a document is learned from: crc32 of its id as text does not leave 2 when divided by 7. A null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], int, np.ndarray]:
    """Pieces that can stand in a word, as bytes; the number of the end; and the share of each number by the vocabulary's scores.

    The scores of this vocabulary are ranks of merges, 0 downward, so a share falls with the
    rank as that of words does. A piece that stands for one byte has the least share.
    """
    from sentencepiece import SentencePieceProcessor

    v = SentencePieceProcessor(model_file=path or public_path("piece_bpe_32k.model"))
    pieces, share = {}, np.zeros(v.get_piece_size())
    for i in range(v.get_piece_size()):
        text = v.id_to_piece(i)
        if v.is_byte(i):
            pieces.setdefault(bytes([int(text[3:5], 16)]), i)
            share[i] = 1 / v.get_piece_size()
        elif not (v.is_control(i) or v.is_unknown(i) or "▁" in text[1:]):
            pieces[text.encode()] = i
            share[i] = 1 / (1 - v.get_score(i))
    end = v.piece_to_id(END)
    share[end] = 1.0
    return pieces, end, share / share.sum()


class Lattice:
    """All segmentations of words into pieces with natural logarithms of their probabilities.

    Pieces that start at a place are met along a tree of their bytes, a row of next nodes
    for each node that has any. Words of one length go through it side by side.
    """

    def __init__(self, pieces: dict[bytes, int], logs: list[float]):
        follow: list[dict[int, int]] = [{}]
        ids = [-1]
        for p, i in pieces.items():
            at = 0
            for c in p:
                if c not in follow[at]:
                    follow[at][c] = len(follow)
                    follow.append({})
                    ids.append(-1)
                at = follow[at][c]
            if logs[i] > -math.inf:
                ids[at] = i
        # nodes with next ones first, so that only these have rows; the last number is that of no node
        order = sorted(range(len(follow)), key=lambda n: not follow[n])
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.inner, self.none = sum(bool(f) for f in follow), len(follow)
        self.next = np.full((self.inner, 256), self.none, np.int32)
        for n in order[: self.inner]:
            self.next[place[n], list(follow[n])] = place[list(follow[n].values())]
        self.ids = np.array([ids[n] for n in order] + [-1])
        self.logs = np.where(self.ids >= 0, np.append(logs, 0.0)[self.ids], -np.inf)

    def _forward(self, s: np.ndarray, arcs: list | None = None) -> np.ndarray:
        """For rows of bytes the logarithms of the probability of all segmentations of each prefix; arcs ``(from, to, rows, node)`` go into a list if one is given."""
        n, every = s.shape[1], np.arange(len(s))
        out = np.full((n + 1, len(s)), -np.inf)
        out[0] = 0.0
        for i in range(n):
            rows = every[out[i] > -np.inf]
            node = np.zeros(len(rows), np.int32)
            for j in range(i, n):
                node = self.next[node, s[rows, j]]
                x = self.logs[node] if len(node) else node
                at = np.flatnonzero(x > -np.inf) if len(node) else at[:0]
                if len(at):
                    to = rows[at]
                    out[j + 1, to] = np.logaddexp(out[j + 1, to], out[i, to] + x[at])
                    if arcs is not None:
                        arcs.append((i, j + 1, to, node[at]))
                more = node < self.inner
                if not more.any():
                    break
                rows, node = rows[more], node[more]
        return out

    def scores(self, words: list[bytes]) -> list[float]:
        """Logarithms of the probabilities of words, whatever their segmentation."""
        out = np.empty(len(words))
        for at, s in self._stacks(words):
            out[at] = self._forward(s)[-1]
        return out.tolist()

    def expected(self, words: list[bytes], counts: list[int]) -> np.ndarray:
        """How often each piece stands in the segmentations of words that occur so often, on average, in fractions: whole numbers, so that sums do not depend on their order."""
        sums, c = np.zeros(int(self.ids.max()) + 1, np.int64), np.array(counts, np.int64)
        for at, s in self._stacks(words):
            arcs: list = []
            ahead = self._forward(s, arcs)
            back = np.full(ahead.shape, -np.inf)
            back[-1] = 0.0
            for i, j, rows, node in reversed(arcs):  # arcs come by their start, so what follows a place is known before it is met
                x = self.logs[node] + back[j, rows]
                share = np.rint(FRACTION * np.exp(ahead[i, rows] + x - ahead[-1, rows])).astype(np.int64)
                np.add.at(sums, self.ids[node], share * c[at[rows]])
                back[i, rows] = np.logaddexp(back[i, rows], x)
        return sums

    def _stacks(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length, with the mark before them, as rows of bytes, ``STACKED`` bytes at a time."""
        sizes = np.array([len(w) for w in words], np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            step = max(1, STACKED // (int(size) + len(MARK)))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                yield part, np.frombuffer(b"".join(MARK + words[i] for i in part), np.uint8).reshape(len(part), -1)


def _words(raw: bytes | None) -> Counter:
    """Words of a text and how often they occur, A-Z lower-cased."""
    return Counter(raw.lower().split()) if raw else Counter()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    size = 0
    for b in batches:
        for raw in b.columns[0]:
            text = raw.as_py() or b""
            held.update(_words(text))
            size += len(text)
            if len(held) > HELD or size > HELD_BYTES:
                size = 0
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
                held.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])


class Model:
    """Logarithms of piece shares; the lattice is made once in each worker."""

    made: dict[tuple, Lattice] = {}

    def __init__(self, path: str | None, logs: list[float], end: int):
        self.path, self.logs, self.end = path, logs, end
        self.key = (path, hash(tuple(logs)))

    def lattice(self) -> Lattice:
        if self.key not in Model.made:
            Model.made.clear()
            Model.made[self.key] = Lattice(vocabulary(self.path)[0], self.logs)
        return Model.made[self.key]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Words and counts of several batches, so that many words of one length are met together."""
    words: list[bytes] = []
    counts: list[int] = []
    for b in batches:
        words += b.columns[0].to_pylist()
        counts += b.columns[1].to_pylist()
        if len(words) > 2 * WORDS_DEALT:
            yield words, counts
            words, counts = [], []
    if words:
        yield words, counts


def _expected(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = sent.value.lattice()
        for words, counts in _gathered(batches):
            sums = lattice.expected(words, counts)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["piece", "n"])

    return run


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = sent.value.lattice()
        for words, counts in _gathered(batches):
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64()), pa.array(lattice.scores(words), pa.float64())], ["word", "c", "log"])

    return run


class Held:
    """Frequent training words with what they add to the sums."""

    made: dict[str, dict[bytes, tuple[float, float]]] = {}

    def __init__(self, name: str, table: pa.Table):
        self.name, self.words, self.counts, self.logs = name, table["word"].to_pylist(), table["c"].to_numpy(), table["log"].to_numpy()

    def by_word(self) -> dict[bytes, tuple[float, float]]:
        if self.name not in Held.made:
            Held.made.clear()
            base = np.log10(self.counts + 1.0).tolist()
            Held.made[self.name] = dict(zip(self.words, zip(base, self.logs.tolist(), strict=True), strict=True))
        return Held.made[self.name]


#: What a task hands on for each row; ``rare`` are words that may be known but are not held.
_ROW = "row_id bigint, doc_id bigint, n_words bigint, n_held bigint, base double, log double, rare array<struct<word: binary, n: bigint>>"


def _documents(model, held, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lattice, known, fresh = model.value.lattice(), held.value.by_word(), {}
        row = TaskContext.get().partitionId() << 33
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), rare_type]
        names = ["row_id", "doc_id", "n_words", "n_held", "base", "log", "rare"]
        def rows(docs: list, texts: list[Counter]) -> Iterator[tuple]:
            nonlocal row, fresh
            new = list({w for t in texts for w in t if w not in known and w not in fresh})
            if len(fresh) > KEPT:
                fresh = {}
                new = list({w for t in texts for w in t if w not in known})
            met = dict(zip(new, lattice.scores(new), strict=True))
            for doc, t in zip(docs, texts, strict=True):
                base, logs, n_held, rare = [], [], 0, []
                for w, n in t.items():
                    have = known.get(w)
                    if have is not None:
                        base.append(n * have[0])
                        logs.append(n * have[1])
                        n_held += n
                        continue
                    x = met.get(w)
                    logs.append(n * (fresh[w] if x is None else x))
                    if not whole:
                        rare.append({"word": w, "n": n})
                yield row, doc, t.total(), n_held, math.fsum(base), math.fsum(logs), rare
                row += 1
            fresh.update((w, x) for w, x in met.items() if len(w) <= LONGEST)

        for b in batches:
            found, docs, texts, size, read = [], [], [], 0, 0
            for doc, raw in zip(b.columns[0].to_pylist(), b.columns[1], strict=True):
                docs.append(doc)
                texts.append(_words(text := raw.as_py()))
                size, read = size + len(texts[-1]), read + len(text or b"")
                if size > WORDS_TOGETHER or read > HELD_BYTES:
                    found += rows(docs, texts)
                    docs, texts, size, read = [], [], 0, 0
            found += rows(docs, texts)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names)

    return run


def score_texts(
    docs: DataFrame, training: DataFrame | None = None, words_held: int = WORDS_HELD, rounds: int = ROUNDS, prior: float = PRIOR, path: str | None = None
) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text)``, learned from ``training(text)``.

    Tokens of a text are its words (A-Z lower-cased) and one end. ``base_score``
    is log10 of the text's probability by words: counts in the training texts
    with one added, over all tokens and distinct tokens and one. ``score`` is log10 of
    its probability by pieces: the sum over all segmentations of all its words,
    times that of the end.

    Null and empty texts are the end alone. Every row is scored, repeated rows
    and null ids too. Without training texts the vocabulary's own scores weight
    the pieces and the base is 0. A word of any length is scored whole; a
    byte that no piece has is a piece by itself. An empty table gives an empty
    result; other columns are ignored, whatever their names.

    Counts of all training words stay in a table. Only those of the most
    frequent words, ``words_held`` at most, go to every worker; the other words
    of a document meet their counts in a join, which skew does not trouble, as
    a frequent word is no key of it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "lattice")
    sc = spark.sparkContext
    training = docs.limit(0) if training is None else training
    texts = training.select(F.col("text").cast("string").cast("binary").alias("text"))
    counts = scratch.save(texts.mapInArrow(_counted, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")))
    n_docs = texts.count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = words + n_docs, distinct + (n_docs > 0)

    pieces, end, share = vocabulary(path)
    with np.errstate(divide="ignore"):
        logs = np.log(share).tolist()
    dealt = counts.repartition(distinct // WORDS_DEALT + 1)  # few bytes, much work
    for _ in range(rounds):
        sent = sc.broadcast(Model(path, logs, end))
        sums = dealt.mapInArrow(_expected(sent), "piece bigint, n bigint").groupBy("piece")
        sums = sums.agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()  # a row for each piece at most
        sent.destroy()
        exact = {r["piece"]: int(r["n"]) for r in sums}
        expected = np.array([exact.get(i, 0) / FRACTION for i in range(len(share))])
        expected[end] = n_docs
        with np.errstate(divide="ignore"):
            logs = np.log((expected + prior * share) / (expected.sum() + prior)).tolist()

    # the least power of two from which on there are no more words than are held
    short = F.length("word") <= LONGEST
    sizes = counts.filter(short).groupBy(F.floor(F.log2("c")).cast("int").alias("b")).agg(F.count("*").alias("n")).orderBy(F.col("b").desc()).collect()  # 64 rows at most
    bound, n_held = 63, 0
    for r in sizes:
        if n_held + r["n"] > words_held:
            break
        bound, n_held = r["b"], n_held + r["n"]
    whole = n_held == distinct
    model = sc.broadcast(Model(path, logs, end))
    frequent = dealt.filter(short & (F.floor(F.log2("c")).cast("int") >= bound)).mapInArrow(_scored(model), "word binary, c bigint, log double").toArrow()
    held = sc.broadcast(Held(scratch.root, frequent))
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = scratch.save(given.mapInArrow(_documents(model, held, whole), _ROW))
    model.destroy()
    held.destroy()

    n_known, base = F.col("n_held"), F.col("base")
    if not whole:
        rare = found.select("row_id", F.explode("rare").alias("r")).select("row_id", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
        met = rare.join(counts, "word").groupBy("row_id").agg(F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("base_rare"))
        found = found.join(met, "row_id", "left")
        n_known, base = n_known + F.coalesce("n_rare", F.lit(0)), base + F.coalesce("base_rare", F.lit(0.0))
    n_tokens = F.col("n_words") + 1
    base = base + F.lit(math.log10(n_docs + 1)) - n_tokens * F.lit(math.log10(total + kinds + 1))
    return found.select(
        "doc_id",
        n_tokens.alias("n_tokens"),
        (n_known + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        ((F.col("log") + F.lit(logs[end])) / F.lit(math.log(10))).alias("score"),
    )
