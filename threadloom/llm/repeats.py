"""Substring deduplication on a sampled suffix array, by bucket-pointer refinement.

A byte goes if a 50-byte string over it also starts in a document of a smaller doc_id. Windows meet where their least
16-gram hash does; a hash that no second document has settles its windows at once, which is most of a corpus. The
rest are sorted: suffixes fall into buckets by their first 5 bytes, and each knows its bucket by a pointer. Buckets of
several are refined by sorting on (own pointer, pointer of the suffix at a later offset), which splits them by 10, 20, 40 and
last 50 bytes; a round reuses the pointers that the round before updated, and a bucket of one is never sorted again. Bytes
are compared, not fingerprints: two windows share their last bucket only if all 50 bytes are equal.

Work is exchanged between *segments* (documents that one task read, a table bucketed by segment, so texts never
move again) and *parts* (ranges of window hashes, as many as the counted bytes ask for). A segment sends each distinct
string once, with its least doc_id, so a passage in a third of all documents costs a part one entry a segment, and no
group is collected whole.

Null and empty texts have 0 bytes; texts below 50 bytes lose nothing. Repeated rows of one doc_id don't remove each
other. A null doc_id counts as greater than all others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, stage
from .textkit import BYTE_CODE, LANE, U64, buffers, mix, powers, slices

LENGTH = 50
Q = 16
SPAN = LENGTH - Q + 1
LOW = U64((1 << 48) - 1)
LAST_ID = (1 << 63) - 1
#: Bytes that the first sort looks at, and the rounds after it: offset of the other pointer, bytes that are equal then.
FIRST = 5
ROUNDS = ((5, 10), (10, 20), (20, 40), (10, 50))
SEGMENTS_PER_TASK = 16
#: Bytes of text in a bucket of segments, which one task reads, segment by segment.
BUCKET_BYTES = 1 << 26
#: Parts are sorted one at a time in a task's memory. A part has the repeated strings among so many bytes of text at most, on average.
PARTS_PER_BUCKET = 6
PART_BYTES = 1 << 21


def grams(data: np.ndarray) -> np.ndarray:
    """Identifiers of all 16-byte strings."""
    n = len(data)
    if n < Q:
        return np.zeros(0, U64)
    p, inverse = powers(n + 1)
    s = np.zeros(n + 1, U64)
    np.cumsum(BYTE_CODE[data] * p[:n], out=s[1:])
    return mix((s[Q:] - s[:-Q]) * inverse[: n - Q + 1])


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys below 2 ** ``bits``, and the keys in it. Where a key and its place fit 64 bits they are sorted as one number, several times faster than an indirect sort."""
    place = max(1, (len(key) - 1).bit_length())
    if bits + place <= 64:
        packed = (key << U64(place)) | np.arange(len(key), dtype=U64)
        packed.sort()
        return (packed & U64((1 << place) - 1)).astype(np.int64), packed >> U64(place)
    order = np.argsort(key)
    return order, key[order]


def repeated_windows(text: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A mark on the start of every window of ``LENGTH`` bytes that also starts in a string of a lesser owner.

    ``text`` holds strings of the given sizes one after another; no window crosses them.
    """
    n = len(text)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(n)
    marks = np.zeros(n, bool)
    raw = np.concatenate([text, np.zeros(8, np.uint8)])
    wide = n.bit_length()
    pointer = np.zeros(n, np.int64)
    at = np.flatnonzero(left >= FIRST)
    key, bits = np.ndarray((n,), ">u8", raw, strides=(1,))[at].astype(U64) >> U64(64 - 8 * FIRST), 8 * FIRST
    for offset, depth in ((0, FIRST), *ROUNDS):
        if offset:
            at = at[left[at] >= depth]
            key, bits = (pointer[at].astype(U64) << U64(wide)) | pointer[at + offset].astype(U64), 2 * wide
        if not len(at):
            return marks
        order, key = _ordered(key, bits)
        at = at[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(edge, len(key)))
        if offset:  # within the range of the old bucket, so that pointers of different buckets never meet
            old = pointer[at[edge]]
            first = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
            base = np.repeat(edge[first], np.diff(np.append(first, len(edge))))
            pointer[at] = np.repeat(old + edge - base, count)
        else:
            pointer[at] = np.repeat(edge, count)
        several = np.repeat(count > 1, count)
        at = at[several]
        count = count[count > 1]
    if len(at):
        string = np.searchsorted(ends, at, "right")
        least = np.minimum.reduceat(owner[string], np.cumsum(count) - count)
        marks[at] = np.repeat(least, count) < owner[string]
    return marks


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


class Segment:
    """Documents with their runs: consecutive window starts whose least 16-gram is the same.

    Least hashes crowd near zero; mixed once more, they fill the parts evenly.
    """

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        column = table["text"]
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.data, self.bounds = buffers(column)
        self.given = table["doc_id"]
        self.ids = table["doc_id"].fill_null(LAST_ID).to_numpy()
        parts = []
        for lo, hi in slices(self.bounds):
            base = self.bounds[lo]
            data = self.data[base : self.bounds[hi]]
            if len(data) < LENGTH:
                continue
            least = _least(grams(data), SPAN)
            size = np.diff(self.bounds[lo : hi + 1])
            ends = self.bounds[lo + 1 : hi + 1] - base
            off = np.zeros(len(data) + 1, np.int32)
            np.add.at(off, ends - np.minimum(size, LENGTH - 1), 1)
            np.add.at(off, ends, -1)
            good = np.cumsum(off)[: len(least)] == 0
            edge = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (good[1:] != good[:-1])]))
            count = np.diff(np.append(edge, len(least)))
            keep = good[edge]
            start = edge[keep]
            parts.append((start + base, count[keep], mix(least[start]), lo + np.searchsorted(ends, start, "right")))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))
        self.start, self.count, self.least, self.doc = (np.concatenate(x) for x in zip(*parts)) if parts else empty

    def buckets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bucket hashes in order, the one of each run, and whether two documents here share it."""
        value, back = np.unique(self.least, return_inverse=True)
        lo, hi = np.full(len(value), LAST_ID), np.full(len(value), -LAST_ID)
        ids = self.ids[self.doc]
        np.minimum.at(lo, back, ids)
        np.maximum.at(hi, back, ids)
        return value, back, lo < hi

    def strings(self, shared: np.ndarray) -> None:
        """Keeps the runs of shared buckets, and lists distinct run strings by (bucket hash, content): sets run, kind, of, first and least id."""
        self.run = np.flatnonzero(shared)
        start, count = self.start[self.run], self.count[self.run]
        content = np.zeros(len(self.run), U64)
        for lo, hi in _groups(count + LENGTH - 1):
            size = count[lo:hi] + LENGTH - 1
            base = np.cumsum(size) - size
            data = self.data[np.repeat(start[lo:hi] - base, size) + np.arange(size.sum())]
            n = len(data)
            p, inverse = powers(n + 1)
            s = np.zeros(n + 1, U64)
            np.cumsum(BYTE_CODE[data] * p[:n], out=s[1:])
            content[lo:hi] = mix((s[base + size] - s[base]) * inverse[base] + size.astype(U64) * LANE[5])
        while True:
            order = np.lexsort((content, self.least[self.run]))
            c, b = content[order], self.least[self.run][order]
            new = np.concatenate([[True], (c[1:] != c[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.zeros(0, bool)
            self.of = np.empty(len(order), np.int64)
            self.of[order] = np.cumsum(new) - 1
            self.first = self.run[order[new]]
            if not len(false := self._differing()):
                break
            content[false] = mix(false.astype(U64) * LANE[6] + LANE[7])  # equal hashes of unequal strings: each stands alone
        self.least_id = np.full(len(self.first), LAST_ID)
        np.minimum.at(self.least_id, self.of, self.ids[self.doc[self.run]])

    def _differing(self) -> np.ndarray:
        """Runs (positions in ``run``) whose bytes are not those of the string that stands for them."""
        head = self.first[self.of]
        other = np.flatnonzero(head != self.run)
        bad = [other[self.count[head[other]] != self.count[self.run[other]]]]
        other = other[self.count[head[other]] == self.count[self.run[other]]]
        for lo, hi in _groups(self.count[self.run[other]] + LENGTH - 1):
            pick = other[lo:hi]
            size = self.count[self.run[pick]] + LENGTH - 1
            base = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(base, size)
            unequal = self.data[np.repeat(self.start[self.run[pick]], size) + step] != self.data[np.repeat(self.start[head[pick]], size) + step]
            bad.append(pick[np.logical_or.reduceat(unequal, base)])
        return np.concatenate(bad)


def _groups(sizes: np.ndarray, most: int = 1 << 18):
    """Ranges of entries of about ``most`` bytes."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes, so an order by hash is an order by part."""
    return (((h >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def _ranges(part: np.ndarray):
    """``part, lo, hi`` of each run of a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    for lo, hi in zip(at, np.append(at[1:], len(part))):
        yield int(part[lo]), int(lo), int(hi)


def _six(a: np.ndarray) -> bytes:
    return np.ascontiguousarray((a & LOW).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(U64)[:, 0]


_MAIL = pa.schema([("seg", pa.int64()), ("part", pa.int64()), ("kind", pa.string()), ("blob", pa.binary())])
_MAIL_SQL = "seg long, part long, kind string, blob binary"


def _mail(rows: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_MAIL)], schema=_MAIL)


def _send_buckets(parts: int):
    def run(key, table):
        s = Segment(table)
        value, _, several = s.buckets()
        seg = key[0].as_py()
        return _mail([(seg, p, "buckets", len(value[lo:hi]).to_bytes(4, "little") + _six(value[lo:hi]) + np.packbits(several[lo:hi]).tobytes()) for p, lo, hi in _ranges(part_of(value, parts))])

    return run


def _mark_buckets(key, table):
    """Of one part: for each segment, which of its buckets another document shares."""
    values, flags = [], []
    for blob in table["blob"].to_pylist():
        n = int.from_bytes(blob[:4], "little")
        values.append(_from_six(blob[4 : 4 + 6 * n]))
        flags.append(np.unpackbits(np.frombuffer(blob, np.uint8, offset=4 + 6 * n), count=n).astype(bool))
    value, back, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = count > 1
    shared[back[np.concatenate(flags)]] = True
    ends = np.cumsum([len(v) for v in values])
    return _mail([(seg, key[0].as_py(), "shared", np.packbits(shared[back[e - len(v) : e]]).tobytes()) for seg, v, e in zip(table["seg"].to_pylist(), values, ends)])


def _shared_runs(s: Segment, mail: pa.Table, parts: int) -> np.ndarray:
    value, back, _ = s.buckets()
    masks = {r["part"]: r["blob"] for r in mail.to_pylist() if r["kind"] == "shared"}
    shared = np.zeros(len(value), bool)
    for p, lo, hi in _ranges(part_of(value, parts)):
        shared[lo:hi] = np.unpackbits(np.frombuffer(masks[p], np.uint8), count=hi - lo).astype(bool)
    return shared[back]


def _send_strings(parts: int):
    def run(key, table, mail):
        if not table.num_rows:
            return _mail([])
        s = Segment(table)
        s.strings(_shared_runs(s, mail, parts))
        rows, seg, pack = [], key[0].as_py(), zstandard.ZstdCompressor(3)
        for p, lo, hi in _ranges(part_of(s.least[s.first], parts)):
            start, count = s.start[s.first[lo:hi]], s.count[s.first[lo:hi]]
            size = count + LENGTH - 1
            text = s.data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
            rows.append((seg, p, "strings", pack.compress((hi - lo).to_bytes(4, "little") + count.astype("<i4").tobytes() + s.least_id[lo:hi].astype("<i8").tobytes() + text.tobytes())))
        return _mail(rows)

    return run


def _mark_strings(key, table):
    """Of one part: for each segment, which of its windows start in a document smaller than the least it has itself."""
    texts, counts, owners, tool = [], [], [], zstandard.ZstdDecompressor()
    for blob in table["blob"].to_pylist():
        raw = tool.decompress(blob)
        n = int.from_bytes(raw[:4], "little")
        counts.append(np.frombuffer(raw, "<i4", n, 4).astype(np.int64))
        owners.append(np.frombuffer(raw, "<i8", n, 4 + 4 * n))
        texts.append(np.frombuffer(raw, np.uint8, offset=4 + 12 * n))
    size, text, owner = np.concatenate(counts) + LENGTH - 1, np.concatenate(texts), np.concatenate(owners)
    place, least = _distinct(text, size, owner)
    first = np.unique(place, return_index=True)[1]
    base = np.cumsum(size) - size
    marks = repeated_windows(text[_spread(base[first], size[first])], size[first], least)
    base = (np.cumsum(size[first]) - size[first])[place]
    rows, at = [], 0
    for seg, count in zip(table["seg"].to_pylist(), counts):
        mine = slice(at, at + len(count))
        at += len(count)
        late = owner[mine] > least[place[mine]]  # all its windows start in the least owner of an equal string
        rows.append((seg, key[0].as_py(), "windows", np.packbits(marks[_spread(base[mine], count)] | np.repeat(late, count)).tobytes()))
    return _mail(rows)


def _distinct(text: np.ndarray, size: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each string among the distinct ones, in order of appearance, and the least owner of each of these."""
    raw, known, place = text.tobytes(), {}, np.empty(len(size), np.int64)
    lo = 0
    for k, n in enumerate(size.tolist()):
        place[k] = known.setdefault(raw[lo : lo + n], len(known))
        lo += n
    least = np.full(len(known), LAST_ID)
    np.minimum.at(least, place, owner)
    return place, least


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each of the ranges."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_bytes(s: Segment, mail: pa.Table, parts: int) -> np.ndarray:
    """A mark on every byte of the segment that goes."""
    s.strings(_shared_runs(s, mail, parts))
    masks = {r["part"]: r["blob"] for r in mail.to_pylist() if r["kind"] == "windows"}
    size = s.count[s.first]
    place = np.concatenate([[0], np.cumsum(size)])
    flag = np.zeros(place[-1], bool)
    for p, lo, hi in _ranges(part_of(s.least[s.first], parts)):
        flag[place[lo] : place[hi]] = np.unpackbits(np.frombuffer(masks[p], np.uint8), count=place[hi] - place[lo]).astype(bool)
    total = len(s.data)
    delta = np.zeros(total + 1, np.int32)
    for lo, hi in _groups(s.count[s.run]):
        run, of = s.run[lo:hi], s.of[lo:hi]
        c = s.count[run]
        step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        hit = flag[np.repeat(place[of], c) + step] | np.repeat(s.ids[s.doc[run]] > s.least_id[of], c)
        at = (np.repeat(s.start[run], c) + step)[hit]
        np.add.at(delta, at, 1)
        np.add.at(delta, at + LENGTH, -1)
    return np.cumsum(delta[:-1]) > 0


def _report(parts: int):
    def run(key, table, mail):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        types = [pa.int64()] * 4 + [pa.string()]
        if not table.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        s = Segment(table)
        gone = removed_bytes(s, mail, parts)
        rows = []
        for k in range(table.num_rows):
            lo, hi = s.bounds[k], s.bounds[k + 1]
            g = gone[lo:hi]
            n = int(g.sum())
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
            rows.append((int(hi - lo), n, spans, hashlib.sha256((s.data[lo:hi][~g] if n else s.data[lo:hi]).tobytes()).hexdigest()))
        cols = list(zip(*rows))
        return pa.Table.from_arrays([table["doc_id"].combine_chunks(), *(pa.array(c, t) for c, t in zip(cols, types[1:]))], names=names)

    return run


def segmented(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """``seg, doc_id, text`` as a table in the shared folder, bucketed by segment, the number of buckets, and bytes of text: read by segment, it needs no shuffle."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    seg = F.spark_partition_id().cast("long") * SEGMENTS_PER_TASK + F.pmod(F.xxhash64("text"), F.lit(SEGMENTS_PER_TASK))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(seg.alias("seg"), "doc_id", "text")
    name = f"segments_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "seg").sortBy("seg").saveAsTable(name)
    table = spark.table(name).select("seg", "doc_id", "text")
    table.schema  # resolved to files here, so the catalog needs the name no longer
    spark.sql(f"DROP TABLE {name}")
    return table, buckets, total


def repeated_substrings(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs(doc_id, text)``."""
    texts, buckets, total = segmented(docs)
    parts = max(PARTS_PER_BUCKET * buckets, -(-total // PART_BYTES))
    by_part = lambda mail: mail.repartition(parts, "part").groupBy("part")
    marked = stage(by_part(texts.groupBy("seg").applyInArrow(_send_buckets(parts), _MAIL_SQL)).applyInArrow(_mark_buckets, _MAIL_SQL), "buckets")
    sent = texts.groupBy("seg").cogroup(marked.groupBy("seg")).applyInArrow(_send_strings(parts), _MAIL_SQL)
    windows = stage(by_part(sent).applyInArrow(_mark_strings, _MAIL_SQL), "windows")
    return texts.groupBy("seg").cogroup(marked.union(windows).groupBy("seg")).applyInArrow(_report(parts), OUT)


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    return repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
