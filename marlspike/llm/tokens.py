"""Tokenising whole texts with the public vocabularies, a chunk at a time.

Tokens of these vocabularies never cross certain boundaries, so a text's ids are
those of its chunks in order. Chunks repeat far more often than they are new;
each worker keeps the ids of those it has met, up to a fixed number.
"""

from __future__ import annotations

import base64
import re
from itertools import accumulate, chain, pairwise

import numpy as np

from marlspike.llm.common import begins

#: Chunks whose ids a worker keeps, and the longest that it keeps; beyond, they are encoded again.
KEPT, LONGEST = 1_000_000, 48
_WORKERS: dict[tuple, object] = {}


#: Latin letters, and marks behind them, that the splitter takes as one or two pieces and the normaliser leaves apart (U+0130 lower-cases to two characters).
_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]{1,512}[.,;:!?]*").fullmatch


class WordEncoder:
    """Ids of ``word_bpe_49k.json`` as little-endian unsigned 32-bit numbers.

    Its normaliser and splitter treat each run between white space by itself, so
    the runs between ASCII white space are the chunks. The strings of special
    tokens count as such, as the library does unless told otherwise.
    """

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)  # for what is lower case and composed already; the tables are held once
        self.plain.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.plain.add_special_tokens([t for _, t in sorted(self.tokenizer.get_added_tokens_decoder().items())])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.kept = kept

    def _plain(self, chunk: bytes) -> bytes:
        ids = self.tokenizer.encode(chunk.decode("utf-8"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _fresh(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks, a few thousand at a time. Each piece that the splitter makes ends in one token with a word end.

        A chunk of Latin letters is one such piece, and one more if marks follow; of other chunks nothing is foreseen.
        """
        if not chunks:
            return []
        texts = b" ".join(chunks).decode("utf-8").split(" ")
        words = [bool(_LATIN(t)) for t in texts]
        out = [b"" if w else self._plain(c) for w, c in zip(words, chunks, strict=True)]
        at = [i for i, w in enumerate(words) if w]
        for i in range(0, len(at), 4000):
            part = at[i : i + 4000]
            got = np.array(self.plain.encode_batch_fast([" ".join([texts[j] for j in part]).lower()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[got]) + 1
            pieces = np.cumsum([1 if texts[j][-1].isalpha() else 2 for j in part])
            if len(ends) != pieces[-1]:  # a chunk was split in a way that was not foreseen
                for j in part:
                    out[j] = self._plain(chunks[j])
                continue
            raw, start = got.tobytes(), 0
            for j, end in zip(part, (4 * ends[pieces - 1]).tolist(), strict=True):
                out[j] = raw[start:end]
                start = end
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        # A-Z may be lower-cased before the rest where nothing can compose with them
        chunks = [(t.encode("utf-8").lower() if t.isascii() and "<|" not in t else t.encode("utf-8")).split() if t else [] for t in texts]
        if len(self.known) > self.kept:
            self.known.clear()
        ids, every = self.known, list(chain.from_iterable(chunks))
        got = list(map(ids.get, every))
        at = [i for i, x in enumerate(got) if x is None]
        new = list({every[i] for i in at})
        ids.update(zip(new, self._fresh(new), strict=True))
        for i in at:
            got[i] = ids[every[i]]
        for c in new:
            if len(c) > LONGEST:
                del ids[c]
        ends = list(accumulate(map(len, chunks), initial=0))
        return [b"".join(got[a:b]) for a, b in pairwise(ends)]


#: Bounds between chunks of the byte-level vocabulary: before a single space between two runs of other characters.
_BEFORE = re.compile(r"(?<=\S)(?= \S)")


class ByteCounter:
    """Numbers of tokens of ``byte_bpe_50k.tiktoken``; the text's own special strings are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        known, n = self.known, 0
        for c in _BEFORE.split(text or ""):
            k = known.get(c)
            if k is None:
                k = len(self.encoding.encode_ordinary(c))
                if len(c) <= LONGEST:
                    if len(known) > KEPT:
                        known.clear()
                    known[c] = k
            n += k
        return n


def worker(kind, path: str, *more):
    """This worker's one encoder of a kind and a file, until a task of another operator begins here."""
    begins(kind.__name__, _WORKERS.clear)
    key = (kind.__name__, path, *more)
    if key not in _WORKERS:
        _WORKERS[key] = kind(path, *more)
    return _WORKERS[key]


def public_path(name: str) -> str:
    """The place of a public vocabulary on this machine; each worker looks for its own."""
    import public_tokenizers

    return public_tokenizers.path(name)
