"""Language ID by a byte convolutional network written in numpy.

Bytes are embedded; filters of several widths run over them; each filter's largest
response in a window of a fixed length feeds a softmax. Whole texts are cut
into such windows and a text's answer is the mean over its windows, weighted by
their letters.

Responses are sums over the bytes under a filter, so for a trained network they
are read from tables by byte pair, which is also how training runs forward.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import bounded_batches

#: Bytes in a window, and bytes by which windows overlap (one less than the widest filter).
WINDOW, OVERLAP = 512, 3
#: Filters of each width in bytes.
WIDTHS = {2: 8, 3: 8, 4: 16}
EMBEDDING = 6
#: Bound of the sample that the network is fitted on: documents, and windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 12_000, 4
EPOCHS, STEP, BATCH = 12, 0.02, 256
#: Mean cross entropy of an epoch from which on training is done.
ENOUGH = 0.01
#: Windows that go through the tables together.
TOGETHER = 64
UNDETERMINED = "und"


@dataclass
class Network:
    """Weights; filters narrower than four bytes have zeros behind them."""

    langs: list[str]
    embed: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # 4 x EMBEDDING x filters
    bias: np.ndarray
    dense: np.ndarray  # filters x langs
    shift: np.ndarray
    _tables: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": []}

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses by byte pair: to the first two bytes under the filters, and to the last two."""
        if not self._tables:
            t = [self.embed @ w for w in self.filters]
            self._tables = [(t[i + 1][:, None] + t[i][None]).reshape(65536, -1).astype(np.float32) for i in (0, 2)]
        return self._tables

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each row of bytes, and where it is."""
        pairs = windows[:, :-1].astype(np.uint16) | windows[:, 1:].astype(np.uint16) << np.uint16(8)
        first, last = self.tables()
        r = first[pairs[:, :-2]]
        r += last[pairs[:, 2:]]
        at = r.argmax(1)
        return np.take_along_axis(r, at[:, None], 1)[:, 0] + self.bias, at

    def largest(self, windows: np.ndarray) -> np.ndarray:
        pairs = windows[:, :-1].astype(np.uint16) | windows[:, 1:].astype(np.uint16) << np.uint16(8)
        first, last = self.tables()
        out = np.empty((len(windows), len(self.bias)), np.float32)
        for i, p in enumerate(pairs):
            r = first[p[:-2]]
            r += last[p[2:]]
            r.max(0, out=out[i])
        return out + self.bias

    def softmax(self, windows: np.ndarray) -> np.ndarray:
        z = np.maximum(self.largest(windows), 0) @ self.dense + self.shift
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(windows: np.ndarray, labels: list[str], seed: int = 7) -> Network:
    """A network for rows of ``WINDOW`` bytes and their languages, by Adam on the cross entropy; the same for the same rows."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    weight = 1 / np.sqrt(np.bincount(y, minlength=len(langs)))[y]
    weight = weight / weight.mean()
    rng = np.random.default_rng(seed)
    n = sum(WIDTHS.values())
    mask = np.concatenate([np.repeat((np.arange(4) < w)[:, None], k, 1) for w, k in WIDTHS.items()], 1)[:, None].astype(np.float64)
    p = [rng.normal(0, 0.5, (256, EMBEDDING)), rng.normal(0, 0.5, (4, EMBEDDING, n)) * mask, np.zeros(n), rng.normal(0, 0.3, (n, len(langs))), np.zeros(len(langs))]
    m, v, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        step, loss = STEP * (1 - epoch / EPOCHS), 0.0
        for i in range(0, len(y), BATCH):
            b = order[i : i + BATCH]
            start = int(rng.integers(0, WINDOW // 2))
            x = windows[b, start : start + WINDOW // 2]
            net = Network(langs, *p)
            r, at = net.pooled(x)
            h = np.maximum(r, 0)
            z = h @ p[3] + p[4]
            e = np.exp(z - z.max(1, keepdims=True))
            e /= e.sum(1, keepdims=True)
            loss -= float(np.log(e[np.arange(len(b)), y[b]] + 1e-12).sum())
            e[np.arange(len(b)), y[b]] -= 1
            e *= weight[b, None] / len(b)
            dh = (e @ p[3].T) * (r > 0)
            g = [np.zeros_like(p[0]), np.zeros_like(p[1]), dh.sum(0), h.T @ e, e.sum(0)]
            for k in range(4):  # only the bytes under each largest response have a gradient
                under = np.take_along_axis(x, at + k, 1)
                g[1][k] = np.einsum("bf,bfe->ef", dh, p[0][under]) * mask[k]
                np.add.at(g[0], under.ravel(), (dh[:, :, None] * p[1][k].T[None]).reshape(-1, EMBEDDING))
            t += 1
            for j in range(5):
                m[j] += 0.1 * (g[j] - m[j])
                v[j] += 0.001 * (g[j] ** 2 - v[j])
                p[j] = p[j] - step * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        if loss < ENOUGH * len(y):
            break
    return Network(langs, *p)


def cut(raw: bytes) -> np.ndarray:
    """Windows over all of a text: rows of ``WINDOW`` bytes, the last one ending with the text; short texts are filled up with spaces."""
    if len(raw) < WINDOW:
        return np.frombuffer(raw.ljust(WINDOW), np.uint8)[None]
    a = np.frombuffer(raw, np.uint8)
    starts = np.arange(0, len(a) - OVERLAP, WINDOW - OVERLAP)
    starts[-1] = min(starts[-1], len(a) - WINDOW)
    starts = np.minimum(starts, len(a) - WINDOW)
    return a[starts[:, None] + np.arange(WINDOW)]


_LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            w = cut((text or "").encode("utf-8", "surrogatepass"))
            for i in sorted({round(i) for i in np.linspace(0, len(w) - 1, SAMPLE_WINDOWS)}):
                rows.append((doc, lang, i, w[i].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.string(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "lang", "i", "window"])


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """A network fitted on windows of at most ``sample_docs`` rows of ``docs(doc_id, text, lang)``; None without labelled letters.

    The rows are those of the least hashes of doc_id, so they depend on the ids
    alone; windows are spread over each whole text. Where an id has several rows,
    windows are taken in the order of the ids' hashes, places, languages and
    bytes until there are enough, so repeated rows give the same network in
    every run. Other columns are ignored, whatever their names.
    """
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    given = given.filter("lang is not null and doc_id is not null and length(text) > 0")
    ids = given.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    chosen = given.join(F.broadcast(ids), "doc_id", "left_semi")  # at most sample_docs longs
    rows = chosen.mapInArrow(_samples, "doc_id bigint, lang string, i int, window binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "i", "lang", "window").limit(sample_docs * SAMPLE_WINDOWS).toPandas()
    rows = rows.sort_values(["doc_id", "i", "lang", "window"])
    if rows.empty:
        return None
    return fit(np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, WINDOW), rows["lang"].tolist())


def predict_text(net: Network | None, text: str | None) -> tuple[str, float]:
    if net is None or not text or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0
    total, weight = np.zeros(len(net.langs)), 0.0
    windows = cut(text.encode("utf-8", "surrogatepass"))
    for i in range(0, len(windows), TOGETHER):
        w = windows[i : i + TOGETHER]
        k = _LETTER[w].sum(1)
        if k.any():
            w, k = w[k > 0], k[k > 0]
            total += k @ net.softmax(w)
            weight += k.sum()
    best = int(total.argmax())
    return net.langs[best], float(min(1.0, total[best] / weight))


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for b in batches:
            ids, texts = b.columns
            got = [predict_text(net, t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs(doc_id, text)``, from the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text where nothing could be learned. Of languages that tie, the first by name
    is taken. Rows may repeat; other columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(net)
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_predicted(model), "doc_id bigint, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
