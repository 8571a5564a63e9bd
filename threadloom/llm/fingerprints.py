"""Document fingerprints: an invertible Bloom lookup table of hashed paragraphs.

A text is cut into paragraphs at line breaks, and inside a line after words that a hash picks (one in 8), so
cuts depend on content alone. Each paragraph's digest (with its occurrence number, where it repeats) goes into one cell
of each of three subtables: a count, a sum of digests, a sum of checks. Fingerprints of two versions subtract cell
by cell, and peeling cells of one digest recovers those that differ; where peeling gets stuck, both texts are
sketched again four times larger, until it succeeds. Likeness is the Jaccard similarity of paragraph sets that follows.

A null text counts as empty and two empty texts are alike (1). Repeated rows follow one another in the order of
documents; ties of doc_id are ordered by the text's hash, null ids come last. One row's next document is itself.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LANE, U64, Slice, mix, seg_starts

CELLS = 24
GROWTH = 4
_KEY = LANE[50]
CHUNK = 1 << 19
#: Bytes of text in a range of documents, on average.
RANGE_BYTES = 1 << 26


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and digest of every paragraph, as a set: repeats get a digest of their own."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    s = Slice(np.frombuffer(b"".join(raw), np.uint8), offsets, 0, len(raw), lower=False)
    s.words()
    if not len(s.starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    prefix = s.prefix_hash()
    word = s.span_hashes(s.starts, s.ends, prefix)
    lines = np.concatenate([[0], np.cumsum(s.bytes == 10)])
    cut = (word >> U64(61)) == 0
    cut[:-1] |= (lines[s.starts[1:]] > lines[s.ends[:-1]]) | (s.doc[1:] != s.doc[:-1])
    cut[-1] = True
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    doc, digest = s.doc[first], s.span_hashes(s.starts[first], s.ends[last], prefix)
    order = np.lexsort((digest, doc))
    doc, digest = doc[order], digest[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])])
    at = np.flatnonzero(new)
    rank = np.arange(len(doc)) - np.repeat(at, np.diff(np.append(at, len(doc))))
    return doc, np.where(rank > 0, mix(digest + rank.astype(U64) * LANE[51]), digest)


def places(doc: np.ndarray, digest: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each digest, numbered over all tables."""
    third = cells // 3
    return np.stack([doc * cells + k * third + ((mix(digest * LANE[52 + k]) >> U64(33)) % U64(third)).astype(np.int64) for k in range(3)])


def tables(doc: np.ndarray, digest: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest sums and check sums of ``n`` tables."""
    at = places(doc, digest, cells).ravel()
    count = np.bincount(at, minlength=n * cells).astype(np.int64)
    keys, checks = np.zeros(n * cells, U64), np.zeros(n * cells, U64)
    np.add.at(keys, at, np.tile(digest, 3))
    np.add.at(checks, at, np.tile(mix(digest * _KEY), 3))
    return count, keys, checks


def peel(count: np.ndarray, keys: np.ndarray, checks: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Recovers the digests of ``n`` difference tables: table, digest, sign of each, and whether each table emptied."""
    found = []
    look = np.arange(len(count))
    while len(look):
        look = look[np.abs(count[look]) == 1]
        sign = count[look]
        key = np.where(sign > 0, keys[look], U64(0) - keys[look])
        pure = mix(key * _KEY) == np.where(sign > 0, checks[look], U64(0) - checks[look])
        look, key, sign = look[pure], key[pure], sign[pure]
        if not len(look):
            break
        doc = look // cells
        order = np.lexsort((key, doc))
        doc, key, sign = doc[order], key[order], sign[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
        doc, key, sign = doc[new], key[new], sign[new]
        found.append((doc, key, sign))
        at = places(doc, key, cells).ravel()
        minus = np.tile(np.where(sign > 0, U64(0) - key, key), 3)
        check = mix(key * _KEY)
        np.add.at(count, at, -np.tile(sign, 3))
        np.add.at(keys, at, minus)
        np.add.at(checks, at, np.tile(np.where(sign > 0, U64(0) - check, check), 3))
        look = np.unique(at)
    whole = ~((count != 0) | (keys != 0) | (checks != 0)).reshape(n, cells).any(1)
    parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)]
    return *parts, whole


def differences(a: tuple, b: tuple, n: int) -> np.ndarray:
    """How many digests differ between set k of ``a`` and set k of ``b``, for k below ``n``."""
    (da, ka), (db, kb) = a, b
    na, nb = np.bincount(da, minlength=n), np.bincount(db, minlength=n)
    out, todo = np.zeros(n, np.int64), np.arange(n)
    cells = CELLS
    while len(todo):
        slot = np.full(n, -1)
        now = todo[np.abs(na[todo] - nb[todo]) < cells]  # more differences than cells can't be recovered
        slot[now] = np.arange(len(now))
        ia, ib = slot[da] >= 0, slot[db] >= 0
        ta, tb = tables(slot[da[ia]], ka[ia], len(now), cells), tables(slot[db[ib]], kb[ib], len(now), cells)
        doc, _, _, whole = peel(*(x - y for x, y in zip(ta, tb)), len(now), cells)
        d = np.bincount(doc, minlength=len(now))
        out[now[whole]] = d[whole]
        todo = np.setdiff1d(todo, now[whole], assume_unique=True)
        cells *= GROWTH
    return out


def likeness(na: np.ndarray, nb: np.ndarray, differ: np.ndarray) -> np.ndarray:
    return np.where(na + nb + differ > 0, (na + nb - differ) / np.maximum(na + nb + differ, 1), 1.0)


def encoded(sets: tuple, n: int) -> list[str]:
    """Fingerprints as text: paragraphs, cells, and the cells in base64."""
    doc, digest = sets
    count, keys, checks = tables(doc, digest, n, CELLS)
    cell = np.zeros(n * CELLS, [("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
    cell["count"], cell["key"], cell["check"] = count, keys, (checks & U64(0xFFFFFFFF)).astype(np.uint32)
    blob, size, total = cell.tobytes(), CELLS * 16, np.bincount(doc, minlength=n)
    return [f"{total[k]}:{CELLS}:{base64.b64encode(blob[k * size : (k + 1) * size]).decode()}" for k in range(n)]


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _emit(ids: list, texts: list[str]):
    """Rows of all but the last document, each against the one after it."""
    n = len(texts) - 1
    own = digests(texts)
    edits = [_edited(a, b) for a, b in zip(texts, texts[1:])]
    other = digests(edits)
    before, after = own[0] < n, own[0] > 0
    a, b = (own[0][before], own[1][before]), (own[0][after] - 1, own[1][after])
    na, nb, ne = (np.bincount(x[0], minlength=n) for x in (a, b, other))
    near_edited, near_next = likeness(na, ne, differences(a, other, n)), likeness(na, nb, differences(a, b, n))
    sha = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array(sha, pa.string()), pa.array(encoded(a, n), pa.string()), pa.array(encoded(other, n), pa.string()), pa.array(near_edited), pa.array(near_next)],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _pairs(batches):
    """Rows come ordered within their range; the row after the last one of a range is a copy of the next range's first."""
    run, ids, texts, size = None, [], [], 0
    for batch in batches:
        for bucket, copy, doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3))):
            if bucket != run:
                run, ids, texts, size = bucket, [], [], 0
            if ids is None:  # further copies of the same first id
                continue
            ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if len(texts) > 1 and (copy or size > CHUNK):
                yield _emit(ids, texts)
                ids, texts, size = (None, None, 0) if copy else (ids[-1:], texts[-1:], len(texts[-1]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs(doc_id, text)``, against its edited text and the next document.

    Ranges of doc_id, as many as the counted bytes ask for, are bounded by quantiles of that column, and texts move once. The first row of a range is
    also sent to the range before it; their ids, one a range, are all that the driver sees.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    least = -(1 << 63)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("k"))
    known = ids.filter(F.col("k") > least)
    bounds = sorted({int(x) for x in known.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges)}) if ranges > 1 else []

    @F.pandas_udf("int")
    def bucket(k):
        import pandas as pd

        return pd.Series(np.searchsorted(np.array(bounds, np.int64), k.to_numpy(np.int64), "left").astype(np.int32))

    tops = {r["b"]: r["top"] for r in ids.select("k", bucket("k").alias("b")).groupBy("b").agg(F.max("k").alias("top")).collect()}
    order = sorted(tops)
    halo = spark.createDataFrame([(order[i], tops[order[i - 1]]) for i in range(len(order))], "b int, top long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("k", F.coalesce("doc_id", F.lit(least))).withColumn("h", F.xxhash64("text"))
    own = rows.select(bucket("k").alias("b"), F.lit(0).alias("copy"), "doc_id", "text", "k", "h")
    copies = rows.join(F.broadcast(halo), F.col("k") == F.col("top")).select("b", F.lit(1).alias("copy"), "doc_id", "text", "k", "h")
    moved = own.union(copies).repartition(ranges, "b").sortWithinPartitions("b", "copy", F.col("k").desc(), "h", F.col("text").isNull())
    return moved.select("b", "copy", "doc_id", "text").mapInArrow(_pairs, OUT)


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
