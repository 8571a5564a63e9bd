"""Language identification by a byte convolutional network, trained in numpy.

Bytes fold into 64 classes with an embedding each; filters of widths 2, 3 and 4 slide over fixed windows of
``WINDOW`` bytes, are max-pooled, and feed a softmax. A document is cut into windows to its end, and the windows'
probabilities are averaged by their letters. For scoring, embedding and filters compile into tables of
byte pairs, so a filter bank costs a lookup a position.

Null texts and texts without a letter are ``und`` with score 0; without any labelled row everything is. A null
doc_id is never held out and never learned from. Repeated rows are scored alike. Only ``text`` reaches the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, stratified
from .textkit import LOWER, buffers, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
CLASSES = 64
#: Bounds of the training sample: documents a language, windows a document.
DOCS_PER_LANGUAGE = 1500
WINDOWS_PER_DOC = 3

FOLD = np.ones(256, np.uint8)
FOLD[97:123] = np.arange(2, 28)
FOLD[48:58] = 28
FOLD[[33, 44, 46, 63]] = 29
FOLD[128:] = 32 + (np.arange(128, 256) & 31)
FOLD = FOLD[LOWER]
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
ASCII_LETTER = LETTER.copy()
ASCII_LETTER[128:] = False


def _windows(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class codes (windows x WINDOW, 0 where padded), document of each window, letters in it."""
    raw = data[offsets[lo] : offsets[hi]]
    start = offsets[lo : hi + 1] - offsets[lo]
    size = np.diff(start)
    count = -(-size // WINDOW)
    base = np.concatenate([[0], np.cumsum(count)]) * WINDOW
    codes = np.zeros(base[-1], np.uint8)
    letters = np.zeros(base[-1], bool)
    at = np.arange(len(raw)) + np.repeat(base[:-1] - start[:-1], size)
    codes[at] = FOLD[raw]
    letters[at] = LETTER[raw]
    return codes.reshape(-1, WINDOW), np.repeat(np.arange(hi - lo), count), letters.reshape(-1, WINDOW).sum(1)


class ByteConvNet:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        f32 = np.float32
        self.labels = labels
        self.embed = rng.normal(0, 0.5, (CLASSES, EMBED)).astype(f32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(f32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, f32)
        self.dense = np.zeros((len(WIDTHS) * FILTERS, len(labels)), f32)
        self.out = np.zeros(len(labels), f32)

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.dense, self.out]

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max-pooled responses before bias, and where each maximum lies. For training."""
        values, where = [], []
        for bank, w in zip(self.filters, WIDTHS):
            m = codes.shape[1] - w + 1
            r = sum((self.embed @ bank[j])[codes[:, j : j + m]] for j in range(w))
            at = r.argmax(1)
            where.append(at)
            values.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
        return np.concatenate(values, 1), where

    def train(self, codes: np.ndarray, target: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on cross entropy. Only the positions that won the pooling receive gradients."""
        rng = np.random.default_rng(seed)
        m = [np.zeros_like(p) for p in self.params()]
        v = [np.zeros_like(p) for p in self.params()]
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(codes))
            for k in range(0, len(order), batch):
                pick = order[k : k + batch]
                c = codes[pick].copy()
                keep = np.where(rng.random(len(pick)) < 0.3, rng.integers(12, WINDOW, len(pick)), WINDOW)
                c[np.arange(WINDOW)[None] >= keep[:, None]] = 0
                value, where = self.pooled(c)
                hidden = np.maximum(value + self.bias, 0)
                p = _softmax(hidden @ self.dense + self.out)
                p[np.arange(len(pick)), target[pick]] -= 1
                p /= len(pick)
                grad = [np.zeros_like(x) for x in self.params()]
                grad[-1] += p.sum(0)
                grad[-2] += hidden.T @ p
                dh = (p @ self.dense.T) * (hidden > 0)
                grad[-3] += dh.sum(0)
                rows = np.arange(len(pick))[:, None]
                for i, w in enumerate(WIDTHS):
                    d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(w):
                        sym = c[rows, where[i] + j]
                        grad[1 + i][j] += np.einsum("bfe,bf->ef", self.embed[sym], d)
                        np.add.at(grad[0], sym, d[:, :, None] * self.filters[i][j].T[None])
                t += 1
                lr = rate / (1 + epoch)
                for q, g, a, b in zip(self.params(), grad, m, v):
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    q -= lr * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def compile(self) -> None:
        """Tables of byte pairs for each bank: a width of 4 is two lookups, of 3 a pair and a single."""
        self.tables = []
        for bank, w in zip(self.filters, WIDTHS):
            one = [self.embed @ bank[j] for j in range(w)]
            pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
            self.tables.append([(j, pair(one[j], one[j + 1]), True) if j + 1 < w else (j, one[j], False) for j in range(0, w, 2)])

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        flat = codes.ravel()
        pairs = flat[:-1].astype(np.intp) * CLASSES + flat[1:]
        n, pooled = len(codes), np.empty((len(codes), len(WIDTHS) * FILTERS), np.float32)
        step = 32
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            size = (hi - lo) * WINDOW
            for i, (w, parts) in enumerate(zip(WIDTHS, self.tables)):
                r = None
                for j, table, double in parts:
                    index = pairs[lo * WINDOW + j : lo * WINDOW + size - w + 1 + j] if double else flat[lo * WINDOW + j : lo * WINDOW + size - w + 1 + j]
                    got = table.take(index, 0)
                    r = got if r is None else np.add(r, got, out=r)
                full = np.empty((size, FILTERS), np.float32)
                full[: len(r)] = r
                pooled[lo:hi, i * FILTERS : (i + 1) * FILTERS] = full.reshape(hi - lo, WINDOW, FILTERS)[:, : WINDOW - w + 1].max(1)
        return _softmax(np.maximum(pooled + self.bias, 0) @ self.dense + self.out)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _sampled_windows(batches):
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        for k in range(batch.num_rows):
            codes, _, letters = _windows(data, offsets, k, k + 1)
            good = np.flatnonzero(letters >= 4)
            if not len(good):
                continue
            turn = np.random.default_rng(batch.column(0)[k].as_py() & ((1 << 63) - 1)).permutation(good)[:WINDOWS_PER_DOC]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0)[k].as_py()] * len(turn)), pa.array([batch.column(1)[k].as_py()] * len(turn)), pa.array([codes[w].tobytes() for w in turn], pa.binary())],
                names=["doc_id", "lang", "codes"],
            )


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> ByteConvNet | None:
    """A network learned from rows that are not held out; None if no such row has a language and a letter."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").filter((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = stratified(rows, "lang", "text", per_language).mapInArrow(_sampled_windows, "doc_id long, lang string, codes binary").toArrow()
    if not sample.num_rows:
        return None
    table = sample.to_pandas().sort_values(["doc_id", "codes"], kind="stable")
    labels = sorted(table.lang.unique())
    codes = np.frombuffer(b"".join(table.codes), np.uint8).reshape(-1, WINDOW)
    target = np.searchsorted(np.array(labels, object), table.lang.to_numpy(object))
    net = ByteConvNet(labels)
    net.train(codes, target)
    return net


def predictor(net: ByteConvNet | None):
    def predict(batches):
        if net is not None:
            net.compile()
        names = np.array([*(net.labels if net else []), "und"], object)
        for batch in batches:
            text = batch.column(1)
            data, offsets = buffers(text)
            size = batch.num_rows
            pred, score = np.full(size, len(names) - 1), np.zeros(size)
            if net is not None:
                for lo, hi in slices(offsets):
                    codes, doc, letters = _windows(data, offsets, lo, hi)
                    if not len(codes):
                        continue
                    p = net.probabilities(codes).astype(np.float64) * (letters + 1e-3)[:, None]
                    total = np.stack([np.bincount(doc, p[:, c], hi - lo) for c in range(p.shape[1])], 1)
                    mass = total.sum(1)
                    plain = np.bincount(doc, _ascii_letters(data, offsets, lo, hi, doc), hi - lo) > 0
                    for k in np.flatnonzero(~plain & (mass > 0)):
                        plain[k] = any(map(str.isalpha, text[lo + int(k)].as_py() or ""))
                    best = total.argmax(1)
                    pred[lo:hi] = np.where(plain, best, len(names) - 1)
                    score[lo:hi] = np.where(plain, total[np.arange(hi - lo), best] / np.maximum(mass, 1e-300), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names[pred], pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])

    return predict


def _ascii_letters(data, offsets, lo, hi, doc):
    """Per window a count that is positive if its document has an ASCII letter: placed on the document's first window."""
    raw = ASCII_LETTER[data[offsets[lo] : offsets[hi]]]
    c = np.concatenate([[0], np.cumsum(raw)])
    start = offsets[lo : hi + 1] - offsets[lo]
    per = c[start[1:]] - c[start[:-1]]
    out = np.zeros(len(doc))
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    out[first] = per[doc[first]]
    return out


def identify(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs(doc_id, text)``; a pass without a shuffle."""
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    return rows.mapInArrow(predictor(net), "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
