"""b-bit MinHash: signatures, band candidates, collision-corrected estimates and verified components.

Sets are kept as 52-bit fingerprints of their members. A signature has ``LANES`` minima; groups
of four form band keys, and the low four bits of every minimum are packed as bit planes, 64 bytes a set.
Two lanes agree by chance with probability 1/16, so the estimate is (share - 1/16) / (15/16).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import sieved, stage
from .textkit import LANE, U64, buffers, mix, seg_starts, signed, slices, tidy

BITS = 4
DOC_BITS = U64(12)
VALUE = U64((1 << 52) - 1)
PLANES = [f"s{k}" for k in range(8)]


@dataclass(frozen=True)
class Banding:
    """``lanes`` (64 or 128) minima, of which ``bands`` bands of ``rows`` make keys; sets link at Jaccard >= ``num`` / ``den``."""

    lanes: int = 128
    rows: int = 4
    bands: int = 32
    num: int = 70
    den: int = 100

    @property
    def least_equal(self) -> int:
        """Equal lanes below which a linked pair is 4.5 standard deviations away."""
        p = self.num / self.den
        p += (1 - p) / (1 << BITS)
        return int(self.lanes * p - 4.5 * (self.lanes * p * (1 - p)) ** 0.5)


_rng = np.random.default_rng(4142)
_MUL = (_rng.integers(0, 1 << 31, 128).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, 128, dtype=np.uint64).astype(np.uint32)


def distinct(doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sorted distinct keys, document in the top 12 bits and the value's low 52 bits below."""
    key = (doc.astype(U64) << U64(52)) | (values & VALUE)
    key.sort()
    return key[seg_starts(key)]


def minima(value: np.ndarray, at: np.ndarray, lanes: int) -> np.ndarray:
    """Least permuted value of each set (members from ``at``) in every lane."""
    x = (value ^ (value >> U64(20))).astype(np.uint32)
    low = np.empty((len(at), lanes), np.uint32)
    work = np.empty(len(x), np.uint32)
    for k in range(lanes):
        np.multiply(x, _MUL[k], out=work)
        np.add(work, _ADD[k], out=work)
        low[:, k] = np.minimum.reduceat(work, at)
    return low


def band_keys(low: np.ndarray, banding: Banding) -> np.ndarray:
    """Keys of the bands; a band's number is part of its key."""
    keys = np.zeros((len(low), banding.bands), U64)
    for r in range(banding.rows):
        keys += low[:, r : banding.rows * banding.bands : banding.rows].astype(U64) * LANE[r]
    return mix(keys + LANE[8 : 8 + banding.bands])


def signatures(key: np.ndarray, banding: Banding) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ``distinct`` keys: documents that have any, set sizes, set hashes (2), band keys, bit planes."""
    doc = (key >> U64(52)).astype(np.int64)
    at = seg_starts(doc)
    docs, sizes = doc[at], np.diff(np.append(at, len(doc)))
    value = key & VALUE
    hashes = np.stack([np.add.reduceat(mix(value * lane), at) for lane in LANE[40:42]], 1)
    low = minima(value, at, banding.lanes)
    bands = band_keys(low, banding)
    planes = np.zeros((len(at), len(PLANES)), U64)
    for w in range(banding.lanes // 64):
        for b in range(BITS):
            bit = ((low[:, 64 * w : 64 * w + 64] >> np.uint32(b)) & np.uint32(1)).astype(np.uint8)
            planes[:, 4 * w + b] = np.packbits(bit, axis=1, bitorder="little").view(U64)[:, 0]
    return docs, sizes, hashes, bands, planes


def equal_lanes(x: str, y: str, banding: Banding) -> Column:
    """Lanes whose low bits agree, by bit counts in the JVM."""
    total = F.lit(banding.lanes)
    for w in range(banding.lanes // 64):
        differ = None
        for b in range(BITS):
            d = F.col(f"{x}.s{4 * w + b}").bitwiseXOR(F.col(f"{y}.s{4 * w + b}"))
            differ = d if differ is None else differ.bitwiseOR(d)
        total = total - F.bit_count(differ)
    return total


def may_link(x: str, y: str, banding: Banding) -> Column:
    """Sizes and estimate that a linked pair can have."""
    a, b = F.col(f"{x}.n").cast("long"), F.col(f"{y}.n").cast("long")
    return (F.least(a, b) * banding.den >= F.greatest(a, b) * banding.num) & (equal_lanes(x, y, banding) >= banding.least_equal)


BLOCK = 256


def linked_components(classes: DataFrame, verify: Callable[[DataFrame], DataFrame], banding: Banding) -> DataFrame:
    """``id, component`` of all ``classes(id, n, bands, s0..s7)`` that link with any other.

    1. In each band bucket all members are compared with the least one. 2. After the components of these
    links, buckets that still hold several components are compared across components, in blocks of about
    ``BLOCK`` members, the estimate being part of the join's condition. Members of one component
    need no further pair, so a group of thousands of copies costs one link each, and no link between two
    components is lost. ``verify`` keeps those pairs (a, b) that link on full sets.
    """
    member = classes.select("id", F.explode("bands").alias("band"))
    head = member.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("last")).filter("head < last")
    hits = stage(member.join(head, "band").select("band", "head", "id"), "hits")  # all that later rounds need of the buckets
    pairs = hits.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    lean = classes.select("id", "n", *PLANES)
    first = stage(
        pairs.join(lean.alias("x"), F.col("a") == F.col("x.id")).join(lean.alias("y"), F.col("b") == F.col("y.id")).filter(may_link("x", "y", banding)).select("a", "b"), "pairs"
    )
    edges = stage(verify(first), "links")
    label = components(edges)
    rich = hits.join(label, "id", "left").select("band", "id", F.coalesce("component", "id").alias("comp"))
    mixed = (
        rich.groupBy("band")
        .agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("c")).filter("c0 < c1").select("band", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    )
    cells = (
        rich.join(mixed, "band")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("cell", F.struct("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")))
    )
    cells = stage(cells.select("cell", "id", "comp").join(lean, "id"), "cells")
    x, y = cells.alias("x"), cells.alias("y")
    second = (
        x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp")) & may_link("x", "y", banding))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    )
    second = stage(second, "pairs")
    if second.isEmpty():
        return label
    return components(edges.union(verify(second)))


#: Members of a bucket that meet in one task's memory; a greater bucket is compared block against block.
CELL = 4096
#: Shared members that pairs are made of, and words that are looked up, at a time.
PAIRS = 1 << 19


def _set_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least member of each component) after the links (a, b)."""
    while (label[a] != label[b]).any():
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while ((up := label[label]) != label).any():
            label = up
    return label


def prefix_components(cell: np.ndarray, member: np.ndarray, value: np.ndarray, banding: Banding) -> tuple[np.ndarray, int]:
    """The least linked member of each of ``len(cell)`` members, each compared with those of its cell, and how many pairs were looked at.

    ``member`` and ``value`` are the distinct elements of the sets; ``cell`` has numbers below 4096. Elements are ordered by
    how few members of the cell have them. Sets that link share at least ``num`` / ``den`` of the larger one, so they share one of the
    first elements of both, as many as may be missing and one more: what is common to a whole cell makes no pair.
    Of the members with such an element all are compared with the first, and then only those of different components.
    """
    n = len(cell)
    label = np.arange(n)
    _, token, count = np.unique((cell[member].astype(U64) << U64(52)) | value, return_inverse=True, return_counts=True)
    order = np.argsort(count, kind="stable")
    rank = np.empty(len(count), U64)
    rank[order] = np.arange(len(count))
    packed = (member.astype(U64) << U64(32)) | rank[token]
    packed.sort()
    member, term = (packed >> U64(32)).astype(np.int64), (packed & U64((1 << 32) - 1)).astype(np.int64)
    first = np.searchsorted(member, np.arange(n + 1))
    size = np.diff(first)
    lead = (np.arange(len(member)) - first[member] < (size + (-banding.num * size) // banding.den + 1)[member]) & (count[order][term] > 1)
    lists = (term[lead].astype(U64) << U64(32)) | member[lead].astype(U64)
    lists.sort()
    who, at = (lists & U64((1 << 32) - 1)).astype(np.int64), seg_starts(lists >> U64(32))
    if not len(at):
        return label, 0
    length = np.diff(np.append(at, len(who)))
    seen = 0

    def link(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal label, seen
        good = (label[x] != label[y]) & (np.minimum(size[x], size[y]) * banding.den >= np.maximum(size[x], size[y]) * banding.num)
        pair = np.unique((x[good].astype(U64) << U64(32)) | y[good].astype(U64))
        x, y = (pair >> U64(32)).astype(np.int64), (pair & U64((1 << 32) - 1)).astype(np.int64)
        seen += len(x)
        total = np.concatenate([[0], np.cumsum(size[x])])
        lo = 0
        while lo < len(x):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
            a, b = x[lo:hi], y[lo:hi]
            of = np.repeat(np.arange(hi - lo), size[a])
            key = (b.astype(U64) << U64(32))[of] | term[np.arange(len(of)) + np.repeat(first[a] - (total[lo:hi] - total[lo]), size[a])].astype(U64)
            inter = np.bincount(of, packed[np.minimum(np.searchsorted(packed, key), len(packed) - 1)] == key, hi - lo).astype(np.int64)
            same = (inter > 0) & (banding.den * inter >= banding.num * (size[a] + size[b] - inter))
            label = _set_labels(label, a[same], b[same])
            lo = hi

    head = np.repeat(who[at], length)
    link(head[head != who], who[head != who])
    mixed = np.repeat(np.minimum.reduceat(label[who], at) != np.maximum.reduceat(label[who], at), length)
    who, of = who[mixed], np.repeat(np.arange(len(at)), length)[mixed]
    if not len(who):
        return label, seen
    order = np.lexsort((who, label[who], of))
    who, of = who[order], of[order]
    last = np.searchsorted(of, of, "right")
    group = seg_starts((of.astype(U64) << U64(32)) | label[who].astype(U64))
    other = np.repeat(np.append(group[1:], len(who)), np.diff(np.append(group, len(who))))  # where the next component begins
    total, lo = np.concatenate([[0], np.cumsum(last - other)]), 0
    while lo < len(who):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
        x = np.repeat(np.arange(lo, hi), (last - other)[lo:hi])
        y = np.repeat(other[lo:hi] - (total[lo:hi] - total[lo]), (last - other)[lo:hi]) + np.arange(len(x))
        link(np.minimum(who[x], who[y]), np.maximum(who[x], who[y]))
        lo = hi
    return label, seen


def _edges(table: pa.Table) -> np.ndarray:
    """Where each cell of rows sorted by cell begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in range(3):
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _whole_cells(batches):
    """Tables of whole cells, of ``CELL`` rows at most unless one cell has more, from rows that are sorted by cell."""

    def cut(table: pa.Table, edge: np.ndarray):
        lo = 0
        while lo < len(edge) - 1:
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + CELL, "right")) - 1)
            yield table.slice(edge[lo], edge[hi] - edge[lo]).combine_chunks()
            lo = hi

    rest: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(pa.Table.from_batches([batch]))
        if rest[0].slice(0, 1).select([0, 1, 2]).to_pylist() == rest[-1].slice(batch.num_rows - 1).select([0, 1, 2]).to_pylist():
            continue  # still the same cell
        table = pa.concat_tables(rest)
        edge = _edges(table)
        yield from cut(table, edge)
        rest = [table.slice(edge[-1])]
    if rest:
        table = pa.concat_tables(rest)
        yield from cut(table, np.append(_edges(table), table.num_rows))


def linked_in_buckets(classes: DataFrame, texts: DataFrame, keys: Callable, banding: Banding) -> DataFrame:
    """``id, component`` of all ``classes(id, bands)`` that link with any other, for short texts (``texts(id, text)``, an id may have many equal rows).

    The texts of a bucket of several ids come together, and its members' full sets, made by ``keys``, are joined in place
    (``prefix_components``), so no pair becomes a row; what leaves a bucket is one link for each member that has any. A
    bucket of more than ``CELL`` members is compared block against block: no link is lost.
    """
    bucket = Window.partitionBy("band")
    member = classes.select("id", F.explode("bands").alias("band"))
    counted = member.select("band", "id", F.min("id").over(bucket).alias("lo"), F.max("id").over(bucket).alias("hi"), F.count(F.lit(1)).over(bucket).alias("c"))
    hits = stage(counted.filter("lo < hi").select("band", "id", F.ceil(F.col("c") / CELL).cast("int").alias("blocks")), "hits")
    used = sieved(texts, ["id"], hits, ["id"]).dropDuplicates(["id"])
    cells = (
        hits.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id")
        .join(used, "id").select("band", "lo", "hi", "id", "text")
        .repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    )

    def run(batches):
        for table in _whole_cells(batches):
            edge = _edges(table)
            cell = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, table.num_rows)))
            ids = table["id"].to_numpy()
            data, offsets = buffers(table["text"].combine_chunks())
            found = [(lo, keys(data, offsets, lo, hi)) for lo, hi in slices(offsets)]
            member = np.concatenate([(k >> U64(52)).astype(np.int64) + lo for lo, k in found])
            label, _ = prefix_components(cell, member, np.concatenate([k & VALUE for _, k in found]), banding)
            some = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[some]]), pa.array(ids[some])], names=["a", "b"])
        tidy()

    return components(stage(cells.mapInArrow(run, "a long, b long").distinct(), "links"))


#: Members that one copy of a head's text serves.
MEMBERS = 1024


def sets_match(pairs: DataFrame, texts: DataFrame, keys: Callable, banding: Banding, repeats: bool = False) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets, made by ``keys`` from ``texts(id, text)``, link exactly.

    Only texts that a bounded sieve of the ids lets through are moved. The text of a head ``a`` meets its members in
    place: it is sent once for every ``MEMBERS`` of them, so the pairs of a hot head spread over tasks. With ``repeats`` an
    id may have many rows, of which one is taken after that selection.
    """
    ids = stage(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    used = sieved(texts, ["id"], ids, ["id"])
    used = used.dropDuplicates(["id"]) if repeats else used
    heads = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("copies"))
    members = (
        pairs.join(heads, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).select("a", "b", "copy")
        .join(used.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    )
    sent = used.select(F.col("id").alias("a"), F.col("text").alias("ta")).join(heads, "a").select("a", "ta", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    both = members.join(sent, ["a", "copy"]).select("a", "b", "ta", "tb")
    num, den = U64(banding.num), U64(banding.den)

    def check(batches):
        for batch in batches:
            da, oa = buffers(batch.column(2))
            db, ob = buffers(batch.column(3))
            good = np.zeros(batch.num_rows, bool)
            for lo, hi in slices(oa + ob):
                ka, kb = keys(da, oa, lo, hi), keys(db, ob, lo, hi)
                size = [np.bincount((k >> U64(52)).astype(np.int64), minlength=hi - lo).astype(U64) for k in (ka, kb)]
                every = np.concatenate([ka, kb])
                every.sort()
                same = every[1:][every[1:] == every[:-1]]
                inter = np.bincount((same >> U64(52)).astype(np.int64), minlength=hi - lo).astype(U64)
                good[lo:hi] = (inter > 0) & (den * inter >= num * (size[0] + size[1] - inter))
            yield batch.select([0, 1]).filter(pa.array(good))

    return both.mapInArrow(check, "a long, b long")


__all__ = ["Banding", "distinct", "linked_components", "linked_in_buckets", "prefix_components", "sets_match", "signatures", "signed"]
