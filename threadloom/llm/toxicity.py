"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the words of a text; all terms of the examples are indexed, and every text with any of them has exact
neighbours. A term weighs (1 + log of its frequency) * idf * relevance: document frequencies are counted over all
documents, and relevance, which is never 0, grows with the chi-square of the term and the labels up to ``SURE``, so that a
long text is compared by what tells labels apart before anything else. A bounded sample of labelled rows (``PER_CLASS`` of
each label) gives the examples; equal texts are one example with the share of toxic labels among them.

Postings of rare terms are lists that are added up as they are. Frequent terms (at most ``FREQUENT``, each in over 1/64 of the examples) have
their postings in blocks of ``BLOCK`` examples, with the largest weight of each term and block; a block is opened only if
that bound, and what its rare terms add, reach the query's k-th best cosine, so neighbours are exact. Votes are
weighted by distance and by the documents that an example stands for, and calibrated by a logistic curve fitted to
leave-one-out votes, at the class rates of all labelled rows. A document without any known term gets the rate of all.

Null and empty texts have no term. Rows whose crc32(doc_id) mod 5 is 0 are never learned from; a null id neither, and
is not held out. A document labelled more than once counts as toxic if any label says so; null labels are dropped.
Without labelled rows every score is 0. Repeated rows are scored alike; ``text`` alone reaches a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, stage, stratified
from .textkit import U64, Slice, buffers, signed, slices, tidy

PER_CLASS = 3000
#: Chi-square (one degree) from which on a term weighs in full.
SURE = 20.0
NEIGHBOURS = 32
BLOCK = 128
FREQUENT = 1024
#: Queries that are searched at a time.
QUERIES = 128
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_NOT_SPACE = np.where(_WORD, np.arange(256), 32).astype(np.uint8)
_LOW = U64((1 << 32) - 1)


def terms(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every word."""
    s = Slice(data, offsets, lo, hi)
    s.bytes = _NOT_SPACE[s.bytes]
    s.words()
    return (s.doc, s.span_hashes(s.starts, s.ends)) if len(s.starts) else (np.zeros(0, np.int64), np.zeros(0, U64))


def counted(doc: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, number), both below 2**32, in order, and how often each occurs."""
    key = (doc.astype(U64) << U64(32)) | number.astype(U64)
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[at] >> U64(32)).astype(np.int64), (key[at] & _LOW).astype(np.int64), np.diff(np.append(at, len(key)))


def frequencies(vocabulary: np.ndarray, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (from ``lo``), term number and frequency of known terms; ``vocabulary`` has sorted hashes."""
    doc, h = terms(data, offsets, lo, hi)
    if not len(h) or not len(vocabulary):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    good = vocabulary[at] == h
    return counted(doc[good], at[good])


def unit_rows(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, worth: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF weights of unit length for each document; ``worth`` is idf * relevance."""
    w = (1 + np.log(tf)) * worth[term]
    norm = np.sqrt(np.bincount(doc, w * w, n))
    return w / np.maximum(norm[doc], 1e-12)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each of the ranges."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


class BlockMaxIndex:
    """Postings of examples; ``search`` returns the exact nearest ones of many queries."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int):
        top = np.zeros(n, np.int64)
        order = np.lexsort((weight, doc))
        top[doc[order]] = term[order]
        self.rank = np.argsort(top, kind="stable")  # alike examples share blocks, which keeps bounds low
        place = np.empty(n, np.int64)
        place[self.rank] = np.arange(n)
        self.n, self.blocks = n, -(-n // BLOCK)
        size = np.bincount(term, minlength=n_terms)
        frequent = np.flatnonzero(size > n / 64)
        frequent = np.sort(frequent[np.argsort(-size[frequent], kind="stable")][:FREQUENT])
        self.dense = np.full(n_terms, -1)
        self.dense[frequent] = np.arange(len(frequent))
        often = self.dense[term] >= 0
        self.postings = np.zeros((self.blocks, len(frequent), BLOCK), np.float32)
        at = place[doc[often]]
        self.postings[at // BLOCK, self.dense[term[often]], at % BLOCK] = weight[often]
        self.bound = np.ascontiguousarray(self.postings.max(2).T) if self.blocks else np.zeros((len(frequent), 0), np.float32)
        order = np.flatnonzero(~often)
        order = order[np.argsort(term[order], kind="stable")]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.place, self.weight = place[doc[order]].astype(np.int32), weight[order].astype(np.float32)

    def search(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and example numbers (n x k, best first; ties by number); cosine 0 and -1 where there are fewer."""
        first = np.searchsorted(doc, np.arange(n + 1))
        best, which = np.zeros((n, k), np.float32), np.full((n, k), -1)
        full = np.flatnonzero(first[1:] > first[:-1])
        for lo in range(0, len(full) if self.n else 0, QUERIES):
            rows = full[lo : lo + QUERIES]
            count = first[rows + 1] - first[rows]
            at = _spread(first[rows], count)
            self._search(np.repeat(np.arange(len(rows)), count), term[at], weight[at], rows, k, best, which)
        return best, which

    def _search(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: np.ndarray, k: int, best: np.ndarray, which: np.ndarray) -> None:
        n, width = len(rows), self.blocks * BLOCK
        often = self.dense[term] >= 0
        query = np.zeros((n, len(self.bound)), np.float32)
        query[row[often], self.dense[term[often]]] = weight[often]
        row, term, weight = row[~often], term[~often], weight[~often].astype(np.float32)
        size = self.first[term + 1] - self.first[term]
        at = _spread(self.first[term], size)
        cosine = np.bincount(np.repeat(row * width, size) + self.place[at], np.repeat(weight, size) * self.weight[at], n * width).astype(np.float32).reshape(n, self.blocks, BLOCK)
        bound = (query @ self.bound + cosine.max(2)) * np.float32(1.0001) + np.float32(1e-6)
        done = np.zeros((n, self.blocks), bool)

        def visit(block: int, some: np.ndarray) -> None:
            cosine[some, block] += query[some] @ self.postings[block]
            done[some, block] = True

        least = np.zeros(n, np.float32)
        for _ in range(3):  # each query's most promising blocks first, for a threshold
            pick = np.where(done, -1, bound).argmax(1)
            for block in np.unique(pick):
                visit(block, np.flatnonzero((pick == block) & ~done[:, block]))
        seen = np.where(done[:, :, None], cosine, 0).reshape(n, -1)
        least = np.partition(seen, width - k, axis=1)[:, width - k] if width > k else least
        for block in range(self.blocks):
            some = np.flatnonzero((bound[:, block] >= least) & (bound[:, block] > 1e-6) & ~done[:, block])
            if len(some):
                visit(block, some)
        cosine = np.where(done[:, :, None], cosine, 0).reshape(n, -1)
        least = np.partition(cosine, width - k, axis=1)[:, width - k] if width > k else least
        q, at = np.nonzero((cosine >= least[:, None]) & (cosine > 0))
        value, number = cosine[q, at], self.rank[at]
        order = np.lexsort((number, -value, q))
        q, value, number = q[order], value[order], number[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        top = nth < k
        best[rows[q[top]], nth[top]], which[rows[q[top]], nth[top]] = value[top], number[top]


@dataclass
class Scorer:
    vocabulary: np.ndarray
    worth: np.ndarray
    example: tuple  # doc, term, weight, number of examples
    label: np.ndarray
    mass: np.ndarray  # labelled documents that an example stands for
    prior: float  # of documents without a neighbour
    curve: np.ndarray
    index: BlockMaxIndex | None = None

    def ready(self) -> Scorer:
        if self.index is None:
            self.index = BlockMaxIndex(*self.example, len(self.vocabulary))
        return self

    def nearest(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of the nearest examples of every text."""
        data, offsets = buffers(texts)
        best, which = np.zeros((len(texts), NEIGHBOURS), np.float32), np.full((len(texts), NEIGHBOURS), -1)
        for lo, hi in slices(offsets):
            doc, term, tf = frequencies(self.vocabulary, data, offsets, lo, hi)
            best[lo:hi], which[lo:hi] = self.ready().index.search(doc, term, unit_rows(doc, term, tf, self.worth, hi - lo), hi - lo, NEIGHBOURS)
        return best, which

    def probability(self, best: np.ndarray, which: np.ndarray) -> np.ndarray:
        z = self.evidence(best, which) @ self.curve
        return np.where(which[:, 0] >= 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), self.prior)

    def evidence(self, best: np.ndarray, which: np.ndarray) -> np.ndarray:
        """What the curve weighs: the vote, how near the neighbours are, and both at once (a far vote says little)."""
        vote, near = self.votes(best, which), np.log(np.where(which >= 0, best, 0).mean(1) + 0.01)
        top = np.log(best[:, 0] + 0.01)
        return np.stack([vote, near, top, vote * near, np.ones(len(vote))], 1)

    def votes(self, best: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Distance-weighted share of toxic neighbours, as log odds."""
        w = np.where(which >= 0, self.mass[np.maximum(which, 0)] / (1.02 - np.clip(best, 0, 1)), 0)
        share = (w * self.label[np.maximum(which, 0)]).sum(1) / np.maximum(w.sum(1), 1e-12)
        return np.log((NEIGHBOURS * share + 0.5) / (NEIGHBOURS * (1 - share) + 0.5))


def _logistic(a: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients by Newton's method with a little ridge."""
    beta = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (weight * (y - p)) - 0.05 * beta
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(beta))
        beta = beta + np.clip(np.linalg.solve(h, g), -2, 2)
    return beta


def _occurrences(batches):
    """Known words of the examples: number of the example, hash and frequency."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for lo, hi in slices(offsets):
            doc, h = terms(data, offsets, lo, hi)
            value, back = np.unique(h, return_inverse=True)
            doc, number, tf = counted(doc, back)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + lo)), pa.array(signed(value[number])), pa.array(tf)], names=["key", "term", "tf"])


def _document_counts(vocabulary: np.ndarray):
    def run(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for lo, hi in slices(offsets):
                np.add.at(total, frequencies(vocabulary, data, offsets, lo, hi)[1], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["term", "df"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Scorer | None:
    """A scorer from labelled rows outside the held-out fifth; None where there is none with text."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter((crc_mod("doc_id", 5) != 0) & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    rate = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = stratified(known, "toxic", "doc_id", per_class).select(F.col("doc_id").alias("key"), "toxic")  # at most 2 x per_class rows: safe to broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    texts = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("key")).groupBy("text").agg(F.min("doc_id").alias("key"), F.sum("toxic").alias("n1"), F.count(F.lit(1)).alias("n"))
    texts = stage(texts.select("key", "text", "n1", "n"), "examples")
    listed = texts.select("key", "n1", "n").toArrow().sort_by([("key", "ascending")])  # texts of one key all count; its number is the first's
    if not (n := listed.num_rows):
        return None
    keys, n1, size = (listed[c].to_numpy().astype(np.float64 if c != "key" else np.int64) for c in ("key", "n1", "n"))
    found = texts.mapInArrow(_occurrences, "key long, term long, tf long").toArrow()
    vocabulary, term = np.unique(np.ascontiguousarray(found["term"].to_numpy()).view(U64), return_inverse=True)
    doc = np.searchsorted(keys, found["key"].to_numpy()).astype(np.int32)
    order = np.argsort((doc.astype(np.int64) << 32) | term)
    doc, term, tf = doc[order], term[order].astype(np.int32), found["tf"].to_numpy()[order]
    del found, order
    df = np.zeros(len(vocabulary))
    counts = docs.select("text").mapInArrow(_document_counts(vocabulary), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    idf = np.log((1 + docs.count()) / (1 + df)) + 1
    toxic = np.where(size > 0, n1 / size, 0)
    p, q = (np.bincount(term, x[doc], len(vocabulary)) / max(x.sum(), 1e-9) for x in (toxic, 1 - toxic))
    share = np.bincount(term, minlength=len(vocabulary)) / n
    chi = (p - q) ** 2 / (share * (1 - share) + 1e-6) * (toxic.sum() * (1 - toxic).sum() / n)
    worth = idf * np.minimum(1, (chi + 0.05) / SURE) ** 1.5
    weight = size * np.where(toxic > 0.5, rate.get(1, 0) / max(toxic.sum(), 1e-9), rate.get(0, 0) / max((1 - toxic).sum(), 1e-9))
    scorer = Scorer(vocabulary, worth, (doc, term, unit_rows(doc, term, tf, worth, n).astype(np.float32), n), toxic, weight, float(rate.get(1, 0) / max(1, sum(rate.values()))), np.array([1.0, 0, 0, 0, 0]))
    best, which = scorer.ready().index.search(*scorer.example, NEIGHBOURS + 1)
    own = which == np.arange(n)[:, None]
    own[~own.any(1), -1] = True
    drop = np.argsort(own, axis=1, kind="stable")[:, :-1]
    best, which = np.take_along_axis(best, drop, 1), np.take_along_axis(which, drop, 1)
    has = which[:, 0] >= 0
    if has.any():
        scorer.curve = _logistic(scorer.evidence(best[has], which[has]), toxic[has], weight[has] / weight[has].mean())
    scorer.index = None
    tidy()
    return scorer


def _score(scorer: Scorer | None):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            score, near, cosine = np.zeros(n), np.full(n, -1), np.zeros(n)
            if scorer is not None:
                best, which = scorer.nearest(batch.column(1))
                score, near, cosine = np.clip(scorer.probability(best, which), 0, 1), which[:, 0], best[:, 0].astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(near), pa.array(cosine)],
                names=["doc_id", "held_out", "score", "predicted", "nearest", "cosine"],
            )
            del batch
        tidy()

    return run


def score_toxicity(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the evidence: the nearest example's number and cosine. A pass without a shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_score(scorer), "doc_id long, held_out boolean, score double, predicted int, nearest long, cosine double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_toxic(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """The rows of ``docs``, all their columns, that the scorer does not call toxic; filtered batch by batch."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if scorer is None or not batch.num_rows:
                yield batch
                continue
            kept = batch.filter(pa.array(scorer.probability(*scorer.nearest(batch.column(at))) < 0.5))
            del batch
            yield kept
            del kept
        tidy()

    return docs.mapInArrow(run, docs.schema)
