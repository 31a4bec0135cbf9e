"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary's merges run as an agenda: of all neighbouring symbols that make
a piece, the best-scored and leftmost pair merges next. A candidate is skipped
for good when a keyed hash of (seed, document, place of the chunk, where the pair
starts, meets and ends) falls below the dropout rate. So each occurrence of a word
is cut in its own way, the same way in every run. Where no merge of the cut without
dropout is skipped, that cut stands, and is made once for all such occurrences:
other skipped candidates would not have merged.

No piece of the vocabulary crosses from other characters to a space, or holds a
line feed, so text is cut there first (checked when the file is read). Chunks of
one length run through the agenda side by side, in numpy; long ones by a heap.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from marlspike.llm.common import bounded_batches
from marlspike.llm.tokens import public_path

#: Characters up to which a chunk goes side by side with others of its length.
SIDE_BY_SIDE = 48
#: Slots of the table of pairs, a power of two.
SLOTS = 1 << 20
#: Rows that go side by side at once.
ROWS = 4096
#: Occurrences whose skips are looked up at once.
OCCURRENCES = 1 << 16
#: Characters encoded together.
TOGETHER = 4 << 20
SPACE, LITERAL = "▁", "▁".encode()
_CHUNKS = re.compile(" *[^ \n]+|\n| +")
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


class _Cuts:
    """Ids of many chunks, as they come: blocks of rows of one length, laid end to end at last."""

    def __init__(self, n: int):
        self.sizes = np.zeros(n, np.int64)
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, ids: np.ndarray) -> None:
        self.sizes[rows] = ids.shape[1]
        self.blocks.append((rows, ids))

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each chunk's ids start, and all ids."""
        starts = np.cumsum(self.sizes) - self.sizes
        out = np.empty(int(self.sizes.sum()), "<u4")
        for rows, ids in self.blocks:
            out[starts[rows][:, None] + np.arange(ids.shape[1])] = ids
        return starts, out


def _without(x: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rows without their element j."""
    n, width = x.shape
    keep = np.ones(x.shape, bool)
    keep[np.arange(n), j] = False
    return x[keep].reshape(n, width - 1)


class PieceEncoder:
    """Encoder and decoder for one vocabulary, dropout rate and seed."""

    def __init__(self, path: str, dropout: float = 0.1, seed: int = 1):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {i: bytes([int(p[3:5], 16)]) for i, p in enumerate(pieces) if sp.is_byte(i)}
        plain = {p: i for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        assert not any("\n" in p or SPACE in p.lstrip(SPACE) for p in plain), "a piece crosses a bound between chunks"
        self.byte_ids = np.zeros(256, np.int64)
        for i, b in self.bytes.items():
            self.byte_ids[b[0]] = i
        self.size, self.seed, self.dropout = n, seed, dropout
        self.skip_below = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[32], self.of_char[ord(SPACE)] = self.of_char[ord(SPACE)], -1
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                if (a := plain.get(p[:k])) is not None and (b := plain.get(p[k:])) is not None:
                    pairs[a * n + b] = i
        self.pairs = pairs
        # pairs by hash, with the next free slot where two meet: one or two reads where a search would take seventeen
        self.keys, self.made = np.full(SLOTS, -1, np.int64), np.full(SLOTS, -1, np.int32)
        for k, i in pairs.items():
            at = int(self._slot(np.array([k]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) % SLOTS
            self.keys[at], self.made[at] = k, i
        self.scores = np.array([sp.get_score(i) for i in range(n)], np.float32)
        self.text = [self.bytes.get(i) or pieces[i].replace(SPACE, " ").encode() if i in self.bytes or pieces[i] in plain else b"" for i in range(n)]

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * _K1) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def _skipped(self, key, start, middle, end):
        return _mix(_mix(key + start * _K1) + middle * _K2 + end * _K3) < self.skip_below

    def _candidates(self, left, right, key, start, middle, end) -> tuple[np.ndarray, np.ndarray]:
        """What each pair makes (-1: nothing, or skipped) and its score."""
        want = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -1)
        at = self._slot(want)
        held = self.keys[at]
        ok = (held == want) & (want >= 0)
        open_ = np.nonzero((held >= 0) & ~ok & (want >= 0))
        while len(open_[0]):
            step = (at[open_] + 1) % SLOTS
            at[open_] = step
            held = self.keys[step]
            ok[open_] = held == want[open_]
            more = (held >= 0) & (held != want[open_])
            open_ = tuple(x[more] for x in open_)
        if key is not None:
            ok &= ~self._skipped(key, start.astype(np.uint64), middle.astype(np.uint64), end.astype(np.uint64))
        made = np.where(ok, self.made[at], -1)
        return made, np.where(ok, self.scores[made], -np.inf).astype(np.float32)

    def _side_by_side(self, chars: np.ndarray, keys: np.ndarray | None, rows: np.ndarray, cuts: _Cuts, merges: list | None = None) -> None:
        """Adds the ids of chunks of one length (lines of code points) to ``cuts`` as ``rows``. Every line that is still at work merges one pair a round.

        Without keys nothing is skipped. What merges is added to ``merges`` as (row, start, middle, end).
        """
        n, width = chars.shape
        ids = self.of_char[chars]
        ids = np.where(ids < 0, -2 - chars.astype(np.int32), ids)
        ends = np.broadcast_to(np.arange(1, width + 1, dtype=np.int8), (n, width))
        made = score = None
        if width > 1:
            starts = np.broadcast_to(np.arange(width - 1, dtype=np.int8), (n, width - 1))
            made, score = self._candidates(ids[:, :-1], ids[:, 1:], None if keys is None else keys[:, None], starts, ends[:, :-1], ends[:, 1:])
        while len(rows):
            line = np.arange(len(rows))
            if width > 1:
                j = score.argmax(1)
                live = score[line, j] > -np.inf
            else:
                live = np.zeros(len(rows), bool)
            if not live.all():
                self._finished(rows[~live], ids[~live], cuts)
                rows, ids, ends, keys = rows[live], ids[live], ends[live], None if keys is None else keys[live]
                if not len(rows):
                    break
                made, score, j = made[live], score[live], j[live]
                line = np.arange(len(rows))
            if merges is not None:
                merges.append((rows, np.where(j > 0, ends[line, j - 1], 0), ends[line, j], ends[line, j + 1]))
            ids[line, j] = made[line, j]
            # the symbol at j + 1 goes, with the end of the one at j and the pair at j: what is right of them moves up
            width -= 1
            ids, ends = _without(ids, j + 1), _without(ends, j)
            made, score = _without(made, j), _without(score, j)
            for at in (j - 1, j):
                can = (at >= 0) & (at + 1 < width)
                r, a = line[can], at[can]
                start = np.where(a > 0, ends[r, a - 1], 0)
                made[r, a], score[r, a] = self._candidates(ids[r, a], ids[r, a + 1], None if keys is None else keys[r], start, ends[r, a], ends[r, a + 1])

    def _finished(self, rows: np.ndarray, ids: np.ndarray, cuts: _Cuts) -> None:
        odd = (ids < 0).any(1)
        if odd.any():
            for row, symbols in zip(rows[odd], ids[odd], strict=True):
                cuts.add(row[None], self._raw(symbols)[None])
            rows, ids = rows[~odd], ids[~odd]
        cuts.add(rows, ids)

    def _by_heap(self, chunk: str, key: np.uint64 | None) -> np.ndarray:
        """The same for one chunk of any length, in n log n steps."""
        cp = np.frombuffer(chunk.encode("utf-32-le"), np.uint32).astype(np.int64)
        first = self.of_char[cp]
        ids = np.where(first < 0, -2 - cp, first).tolist()
        n = len(ids)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list = []
        k = None if key is None else np.array([key], np.uint64)

        def offer(i: int) -> None:
            j = after[i]
            if j >= n or ids[i] < 0 or ids[j] < 0 or (m := self.pairs.get(ids[i] * self.size + ids[j])) is None:
                return
            if k is not None and self._skipped(k, np.array([i], np.uint64), np.array([end[i]], np.uint64), np.array([end[j]], np.uint64))[0]:
                return
            heapq.heappush(agenda, (-float(self.scores[m]), i, end[i], end[j], m))

        for i in range(n - 1):
            offer(i)
        gone = bytearray(n)
        while agenda:
            _, i, middle, last, m = heapq.heappop(agenda)
            j = after[i]
            if gone[i] or end[i] != middle or j >= n or end[j] != last:
                continue
            ids[i], end[i], after[i], gone[j] = m, last, after[j], 1
            if after[i] < n:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for i, x in enumerate(ids) if not gone[i]], np.int64)

    def _raw(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols, those that are no piece in bytes."""
        if symbols.min() >= 0:
            return symbols
        out: list = []
        for s in symbols.tolist():
            out += [s] if s >= 0 else self.byte_ids[list(chr(-2 - s).encode("utf-8", "surrogatepass"))].tolist()
        return np.array(out, np.int64)

    def _cut_up(self, chunks: list[str], keys: np.ndarray | None, rows: np.ndarray, cuts: _Cuts, merges: list | None = None) -> None:
        """Adds the ids of each chunk under its key to ``cuts`` as ``rows``; ``merges`` as in ``_side_by_side``, of chunks that go there."""
        if not chunks:
            return
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(sizes, kind="stable")
        counts = np.bincount(sizes)
        for size, at in zip(np.flatnonzero(counts).tolist(), np.split(order, np.cumsum(counts[counts > 0])[:-1]), strict=True):
            if size > SIDE_BY_SIDE:
                for i in at.tolist():
                    cuts.add(rows[i : i + 1], self._raw(self._by_heap(chunks[i], None if keys is None else keys[i]))[None])
                continue
            for part in np.array_split(at, -(-len(at) // ROWS)):
                chars = np.frombuffer("".join([chunks[i] for i in part.tolist()]).encode("utf-32-le"), np.int32).reshape(-1, size)
                self._side_by_side(chars, None if keys is None else keys[part], rows[part], cuts, merges)

    def _touched(self, which: np.ndarray, keys: np.ndarray, n: int, merges: list) -> np.ndarray:
        """Which occurrences (of chunks ``which``, of n, under ``keys``) skip one of their chunk's ``merges``."""
        out = np.zeros(len(which), bool)
        if not merges:
            return out
        of = np.concatenate([m[0] for m in merges])
        order = np.argsort(of, kind="stable")
        first = np.searchsorted(of[order], np.arange(n + 1))
        start, middle, end = (np.concatenate([m[k] for m in merges])[order].astype(np.uint8) for k in (1, 2, 3))
        for i in range(0, len(which), OCCURRENCES):
            chunk = which[i : i + OCCURRENCES]
            size = first[chunk + 1] - first[chunk]
            row = np.repeat(np.arange(len(chunk)), size)
            at = np.arange(len(row)) + np.repeat(first[chunk] - np.cumsum(size) + size, size)
            where = (x[at].astype(np.uint64) for x in (start, middle, end))
            out[i + row[self._skipped(keys[i : i + OCCURRENCES][row], *where)]] = True
        return out

    def encode(self, texts: list[str | None], ids: list) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; ``ids`` and places in the text decide what is skipped."""
        number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        cuts = [_CHUNKS.findall(" " + t) if t else [] for t in texts]
        ends = np.cumsum([0, *map(len, cuts)])
        at = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(cuts)), np.int64, ends[-1])
        del cuts
        chunks = list(number)
        if not self.dropout:
            cuts = _Cuts(len(chunks))
            self._cut_up(chunks, None, np.arange(len(chunks)), cuts)
        else:
            keys = np.empty(len(at), np.uint64)
            for doc, (a, b) in zip(ids, itertools.pairwise(ends.tolist()), strict=True):
                base = np.uint64(xxh3_64_intdigest(str(doc).encode(), seed=self.seed % 2**64))
                keys[a:b] = _mix(np.arange(b - a, dtype=np.uint64) * _K1 + base)
            long = np.fromiter((len(c) > SIDE_BY_SIDE for c in chunks), bool, len(chunks))
            merges: list = []
            # long chunks hardly ever stay whole: they go by themselves below
            whole = _Cuts(len(chunks))
            short = np.flatnonzero(~long)
            self._cut_up([chunks[i] for i in short.tolist()], None, short, whole, merges)
            own = np.flatnonzero(long[at] | self._touched(at, keys, len(chunks), merges))
            cuts = _Cuts(len(chunks) + len(own))
            cuts.sizes[: len(chunks)], cuts.blocks = whole.sizes, whole.blocks
            self._cut_up([chunks[i] for i in at[own].tolist()], keys[own], len(chunks) + np.arange(len(own)), cuts)
            at[own] = len(chunks) + np.arange(len(own))
        starts, flat = cuts.flat()
        out = []
        for a, b in itertools.pairwise(ends.tolist()):  # a text at a time, so that indexes stay small
            size = cuts.sizes[at[a:b]]
            after = np.cumsum(size)
            out.append(flat[np.arange(after[-1] if len(after) else 0) + np.repeat(starts[at[a:b]] - after + size, size)].tobytes())
        return out

    def decode(self, raw: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, which ids of ``encode`` never need."""
        text = self.text
        return b"".join([text[i] for i in np.frombuffer(raw, "<u4").tolist()])[1:].decode("utf-8", "replace")


_WORKERS: dict[tuple, PieceEncoder] = {}


def _encoder(name: str, path: str | None, dropout: float, seed: int) -> PieceEncoder:
    key = (name, path, dropout, seed)
    if key not in _WORKERS:
        _WORKERS[key] = PieceEncoder(path or public_path(name), dropout, seed)
    return _WORKERS[key]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch with a bounded number of characters (one text at least), and their last column."""
    for b in batches:
        column, at = b.columns[-1], 0
        while at < len(column):
            size, stop = 0, at
            held = []
            while stop < len(column) and (size < TOGETHER or stop == at):
                held.append(column[stop].as_py())
                size += len(held[-1] or "")
                stop += 1
            yield b.slice(at, stop - at), held
            at = stop


def encode(docs: DataFrame, dropout: float = 0.1, seed: int = 1, vocabulary: str = "piece_bpe_32k.model", path: str | None = None) -> DataFrame:
    """``doc_id, text, ids`` for every row of ``docs(doc_id, text)``; ids are a binary of little-endian unsigned 32-bit numbers.

    Null and empty texts have no ids. A character U+2581 of the text itself is
    spelt in bytes, so that it does not decode to a space. Rows with one doc_id
    and one text have the same ids. Other columns are ignored. A text of any
    length is encoded a stretch at a time; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, path, dropout, seed)
        for b, texts in _pieces(batches):
            ids = encoder.encode(texts, b.columns[0].to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], ["doc_id", "text", "ids"])

    bounded_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id bigint, text string, ids binary")


def decode(encoded: DataFrame, vocabulary: str = "piece_bpe_32k.model", path: str | None = None) -> DataFrame:
    """The rows and columns of ``encoded(ids, ...)`` with ``decoded``, the text of their ids, in place of a column so named.

    Null ids decode to null and empty ones to an empty text; ids of any length are
    decoded whole; repeated rows each stay; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, path, 0.0, 0)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [None if x is None else encoder.decode(x) for x in part.columns[1].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["row", "ids", "decoded"])

    names = [c for c in encoded.columns if c.lower() not in ("ids", "decoded")]
    row = F.struct(*(encoded[f"`{c}`"] for c in names)) if names else F.struct(F.lit(None).cast("int").alias("none"))
    given = encoded.select(row.alias("row"), encoded["ids"].cast("binary").alias("ids"))
    out = given.mapInArrow(run, T.StructType([*given.schema.fields, T.StructField("decoded", T.StringType())]))
    kept = [F.col("ids") if c.lower() == "ids" else F.col("row")[c].alias(c) for c in encoded.columns if c.lower() != "decoded"]
    return out.select(*kept, "decoded")
