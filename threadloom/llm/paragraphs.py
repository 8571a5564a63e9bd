"""Substring deduplication by MinHash banding of paragraphs.

A paragraph is a line, cut further after words that end a sentence (. ! ?) and after one word in 64 that its hash picks,
so that a passage pasted into another text has the same paragraphs there.
Bands over word trigrams of paragraphs of at least ``WORDS`` words are tuned for recall: a pair of Jaccard 0.7 collides
with probability 0.997, of 0.8 with 0.9999, equal ones surely. A shorter paragraph says little by itself and is taken
with its neighbours: the ``WORDS`` words from its first on and those up to its last, across lines, are keys of one exact
hash each, and a shared one takes all paragraphs that lie wholly in it. Lines and texts below ``WORDS`` words are exact keys
as a whole. So every word lies in a candidate, and of a repeated passage of ``WORDS`` words that begins and ends with
paragraphs every short paragraph is found. Band keys first travel packed, 6 bytes each, and only paragraphs with a key that another
document shares become rows; colliding paragraphs come together by bucket, are joined by exact Jaccard in place, and are grouped by connected
components; exact keys only with their equals. Of a component, the document of least doc_id keeps its paragraphs, and all others lose them.

Null and empty texts have no paragraph. Repeated rows of one doc_id are one document and don't remove each other. A null
doc_id counts as greater than all others. Texts keep all bytes outside removed paragraphs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lsh import VALUE, Banding, band_keys, distinct, linked_in_buckets, minima
from .near_dedup import shingle_keys
from .repeats import _MAIL_SQL, LAST_ID, _mail, _mark_buckets, _ranges, _six, part_of, segmented
from .shared import stage
from .textkit import LANE, U64, Slice, buffers, mix, run_hashes, seg_starts, signed, slices

WORDS = 8
SHINGLE = 3
BANDING = Banding(lanes=64, rows=3, bands=14, num=70, den=100)
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


class Paragraphs:
    """Paragraphs of the documents of one segment: row, number in its document, bytes from and to; of those at
    positions ``long`` their trigrams; and exact keys: position of the first and last paragraph taken, and hash."""

    def __init__(self, table: pa.Table):
        column = table["text"].combine_chunks()
        self.column = column
        self.data, self.bounds = buffers(column)
        self.ids = table["doc_id"].combine_chunks().fill_null(LAST_ID).to_numpy()
        parts = [self._cut(lo, hi) for lo, hi in slices(self.bounds)]
        parts = [p for p in parts if len(p[0])]
        cols = [np.concatenate(x) for x in zip(*(p[:4] for p in parts))] if parts else [np.zeros(0, np.int64)] * 4
        self.row, self.number, self.start, self.end = cols
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        shifted = lambda k: np.concatenate([p[k] + at for p, at in zip(parts, base)]) if parts else np.zeros(0, np.int64)
        self.long, self.first, self.last = shifted(4), shifted(5), shifted(6)
        self.exact = np.concatenate([p[7] for p in parts]) if parts else np.zeros(0, U64)
        self.keys = [k for p in parts for k in p[8]]

    def _cut(self, lo: int, hi: int):
        s = Slice(self.data, self.bounds, lo, hi)
        s.words()
        if not len(s.starts):
            return (np.zeros(0, np.int64),) * 7 + (np.zeros(0, U64), [])
        w = s.span_hashes(s.starts, s.ends)
        lines = np.concatenate([[0], np.cumsum(s.bytes == 10)])
        broken = np.ones(len(w), bool)
        broken[:-1] = (lines[s.starts[1:]] > lines[s.ends[:-1]]) | (s.doc[1:] != s.doc[:-1])
        last = np.flatnonzero(broken | _STOP[s.bytes[s.ends - 1]] | ((w >> U64(58)) == 0))
        first = np.concatenate([[0], last[:-1] + 1])
        doc = s.doc[first]
        number = np.arange(len(first)) - np.searchsorted(doc, np.arange(s.docs))[doc]
        long = np.flatnonzero(last - first + 1 >= WORDS)
        runs, keys = run_hashes(w, SHINGLE), []
        for a in range(0, len(long), 4096):
            pick = long[a : a + 4096]
            f, n = first[pick], (last - first)[pick] + 2 - SHINGLE
            at = np.repeat(f - np.cumsum(n) + n, n) + np.arange(n.sum())
            keys.append(distinct(np.repeat(np.arange(len(f)), n), runs[at]))
        exact = _exact(w, s.first, first, last, doc, broken)
        return doc + lo, number, s.starts[first] + self.bounds[lo], s.ends[last] + self.bounds[lo], long, *exact, keys

    def bands(self) -> np.ndarray:
        parts = []
        for key in self.keys:
            at = seg_starts(key >> U64(52))
            parts.append(band_keys(minima(key & VALUE, at, BANDING.rows * BANDING.bands), BANDING))
        return np.concatenate(parts) if parts else np.zeros((0, BANDING.bands), U64)


def _exact(w: np.ndarray, edge: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray, broken: np.ndarray):
    """First and last paragraph and hash of the exact keys, from word hashes, first words of documents, and words that end a line."""
    short = np.flatnonzero(last - first + 1 < WORDS)
    ahead, back = first[short], last[short] + 1 - WORDS
    begin = np.unique(np.concatenate([ahead[ahead + WORDS <= edge[doc[short] + 1]], back[back >= edge[doc[short]]]]))
    stop = begin + WORDS
    h = run_hashes(w, WORDS)[begin] if len(begin) else np.zeros(0, U64)
    end = np.flatnonzero(broken)
    lines = np.stack([np.concatenate([[0], end[:-1] + 1]), end + 1])
    texts = np.stack([edge[:-1], edge[1:]])
    whole = np.concatenate([lines, texts], 1)
    size = whole[1] - whole[0]
    whole = np.unique(whole[:, (size > 0) & (size < WORDS)], axis=1)
    size = whole[1] - whole[0]
    total = size.astype(U64) * LANE[50]
    for k in range(WORDS - 1):
        more = size > k
        total[more] += w[whole[0][more] + k] * LANE[40 + k]
    begin, stop, h = np.concatenate([begin, whole[0]]), np.concatenate([stop, whole[1]]), np.concatenate([h, mix(total)])
    return np.searchsorted(first, begin), np.searchsorted(last, stop) - 1, h


def _distinct_bands(p: Paragraphs, bands: np.ndarray):
    """Distinct keys (of bands, then exact ones), the one of each, and whether two documents here share it."""
    value, back = np.unique(np.concatenate([bands.ravel(), p.exact]), return_inverse=True)
    lo, hi = np.full(len(value), LAST_ID), np.full(len(value), -LAST_ID)
    ids = p.ids[np.concatenate([np.repeat(p.row[p.long], BANDING.bands), p.row[p.first]])]
    np.minimum.at(lo, back, ids)
    np.maximum.at(hi, back, ids)
    return value, back, lo < hi


def _send(parts: int):
    def run(key, table):
        p = Paragraphs(table)
        value, _, several = _distinct_bands(p, p.bands())
        seg = key[0].as_py()
        return _mail([(seg, q, "bands", len(value[lo:hi]).to_bytes(4, "little") + _six(value[lo:hi]) + np.packbits(several[lo:hi]).tobytes()) for q, lo, hi in _ranges(part_of(value, parts))])

    return run


SHARED = "seg long, doc_id long, text_hash binary, number int, last int, id long, bands array<long>, text string"
_NAMES = ["seg", "doc_id", "text_hash", "number", "last", "id", "bands", "text"]


def _hashes(p: Paragraphs, rows: np.ndarray) -> dict[int, bytes]:
    return {int(k): hashlib.blake2b(p.data[p.bounds[k] : p.bounds[k + 1]].tobytes(), digest_size=12).digest() for k in np.unique(rows)}


def _collect_shared(parts: int):
    def run(key, table, mail):
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        p = Paragraphs(table) if table.num_rows else None
        if p is None or not len(p.row):
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=_NAMES)
        bands = p.bands()
        value, back, _ = _distinct_bands(p, bands)
        masks = {r["part"]: r["blob"] for r in mail.to_pylist()}
        shared = np.zeros(len(value), bool)
        for q, lo, hi in _ranges(part_of(value, parts)):
            shared[lo:hi] = np.unpackbits(np.frombuffer(masks[q], np.uint8), count=hi - lo).astype(bool)
        shared = shared[back]
        equal = np.flatnonzero(shared[bands.size :])
        shared = shared[: bands.size].reshape(-1, BANDING.bands)
        pick = np.flatnonzero(shared.any(1))
        first = np.concatenate([np.zeros(0, U64), *(np.add.reduceat(mix((k & VALUE) * LANE[40]), seg_starts(k >> U64(52))) for k in p.keys)])[pick]
        kept, long = shared[pick], p.long[pick]
        head, tail = np.concatenate([long, p.first[equal]]), np.concatenate([long, p.last[equal]])
        digest = _hashes(p, p.row[head])
        texts = [p.data[a:b].tobytes().decode() for a, b in zip(p.start[long], p.end[long])] + [None] * len(equal)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate([kept.sum(1), np.zeros(len(equal), np.int64)]))]).astype(np.int32)), pa.array(signed(bands[pick][kept])))
        cols = [
            np.full(len(head), key[0].as_py()), p.ids[p.row[head]], [digest[int(r)] for r in p.row[head]], p.number[head].astype(np.int32), p.number[tail].astype(np.int32),
            signed(np.concatenate([first, p.exact[equal]])), lists, texts,
        ]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)], names=_NAMES)

    return run


OUT = "doc_id long, n_paragraphs long, n_removed long, n_bytes_removed long, kept_sha256 string, removed string"


def _apply(key, table, gone):
    names, types = ["doc_id", "n_paragraphs", "n_removed", "n_bytes_removed", "kept_sha256", "removed"], [pa.int64()] * 4 + [pa.string()] * 2
    if not table.num_rows:
        return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
    p = Paragraphs(table)
    listed: dict[tuple, set] = {}
    for i, h, first, last in zip(*(gone[c].to_pylist() for c in ("doc_id", "text_hash", "number", "last"))):
        listed.setdefault((i, h), set()).update(range(first, last + 1))
    rows = []
    edge = np.searchsorted(p.row, np.arange(table.num_rows + 1))
    some = {i for i, _ in listed}
    for k in range(table.num_rows):
        lo, hi = int(p.bounds[k]), int(p.bounds[k + 1])
        text = p.data[lo:hi].tobytes()
        spans = []
        if int(p.ids[k]) in some:
            out = listed.get((int(p.ids[k]), hashlib.blake2b(text, digest_size=12).digest()), ())
            spans = [(int(p.start[j]) - lo, int(p.end[j]) - lo) for j in range(edge[k], edge[k + 1]) if int(p.number[j]) in out]
        parts, last = [], 0
        for a, b in spans:
            parts.append(text[last:a])
            last = b
        parts.append(text[last:])
        rows.append((int(edge[k + 1] - edge[k]), len(spans), sum(b - a for a, b in spans), hashlib.sha256(b"".join(parts)).hexdigest(), ",".join(f"{a}:{b}" for a, b in spans)))
    cols = list(zip(*rows))
    return pa.Table.from_arrays([table["doc_id"].combine_chunks(), *(pa.array(c, t) for c, t in zip(cols, types[1:]))], names=names)


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_paragraphs, n_removed, n_bytes_removed, kept_sha256, removed`` for every row; ``removed`` lists byte spans."""
    texts, buckets, _ = segmented(docs)
    marked = stage(texts.groupBy("seg").applyInArrow(_send(buckets), _MAIL_SQL).repartition(buckets, "part").groupBy("part").applyInArrow(_mark_buckets, _MAIL_SQL), "bands")
    shared = stage(texts.groupBy("seg").cogroup(marked.groupBy("seg")).applyInArrow(_collect_shared(buckets), SHARED), "shared")
    near = shared.filter("text is not null")
    classes = stage(near.select("id", "bands").dropDuplicates(["id"]), "classes")
    label = linked_in_buckets(classes, near.select("id", "text"), _trigrams, BANDING)
    spans = shared.groupBy("id").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spans = stage(spans, "spans")
    owner = spans.groupBy("component").agg(F.min("lo").alias("owner"), F.max("hi").alias("last")).filter("owner < last").select("component", "owner")
    late = spans.join(owner, "component").select("id", "owner")
    gone = stage(shared.join(late, "id").filter("doc_id > owner").select("seg", "doc_id", "text_hash", "number", "last"), "gone")
    return texts.groupBy("seg").cogroup(gone.groupBy("seg")).applyInArrow(_apply, OUT)


def _trigrams(data, offsets, lo, hi):
    return shingle_keys(data, offsets, lo, hi, SHINGLE)


def op9_paragraphs(spark, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
