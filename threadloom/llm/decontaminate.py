"""Benchmark decontamination by spaced seeds.

Test items and training texts are token sequences (runs of letters and digits, A-Z lowered). Each mask hashes the tokens at
its ones and ignores those at its zeros, so a substitution under a zero keeps the seed. Test hashes and training
hashes are joined on the seed; of the training side only hashes that a bit table of the test side lets through become rows.
The table is bounded (``SIEVE_BITS``): with a very large benchmark it lets more rows through, and the join stays exact.
A text and an item that share a seed meet once, and on each diagonal that a seed supports the overlap is verified token
by token, matches scoring +1 and substitutions -2. It counts with ``LEAST_TOKENS`` equal tokens, or
``LEAST_SHARE`` of a shorter item. Items of fewer tokens than a mask spans are sought whole.

Equal texts are searched once. Diagonals of repeated tokens are marked by runs, not pair by pair. Null or empty
texts and items match nothing; repeated rows are judged alike, and a null doc_id is no obstacle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, sieved, small, stage
from .textkit import LANE, U64, Slice, buffers, mix, signed, slices

MASKS = ("11111", "110111", "1101011", "10110011", "11001011")
SHORTEST = min(map(len, MASKS))
LEAST_TOKENS = 12
LEAST_SHARE = 0.8
#: Bits of the table of test seeds that documents are held against.
SIEVE_BITS = 26
#: Items that are verified beside one copy of a text.
ITEMS = 256
_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_FOLD = np.where(_TOKEN, np.arange(256), 32).astype(np.uint8)


def tokens(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, Slice]:
    """Token hashes, the first token of each document (and the end), and the slice."""
    s = Slice(data, offsets, lo, hi)
    s.bytes = _FOLD[s.bytes]
    s.words()
    return (s.span_hashes(s.starts, s.ends) if len(s.starts) else np.zeros(0, U64)), s.first, s


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked tokens at every start; whether a start stays in its document is the caller's concern."""
    m = len(hashes) - len(mask) + 1
    out = np.full(max(0, m), LANE[len(mask)])
    for k, bit in enumerate(mask):
        if bit == "1" and m > 0:
            out += hashes[k : k + m] * LANE[16 + k]
    return mix(out)


def _inside(hashes: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Starts of ``width`` tokens that end in their own text; ``ends`` has the end of the text of each token."""
    return np.flatnonzero(np.arange(max(0, len(hashes) - width + 1)) + width <= ends[: max(0, len(hashes) - width + 1)])


def _item_seeds(batches):
    """``seed, size`` and the item's key: of a short item its only seed."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for lo, hi in slices(offsets):
            hashes, first, s = tokens(data, offsets, lo, hi)
            size = np.diff(first)
            ends = first[1:][s.doc] if len(hashes) else first[:0]
            seed, item = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for mask in (*MASKS, *("1" * k for k in range(1, SHORTEST))):
                at = _inside(hashes, ends, len(mask))
                if len(mask) < SHORTEST:
                    at = at[size[s.doc[at]] == len(mask)]
                seed.append(seeds(hashes, mask)[at])
                item.append(s.doc[at])
            seed, item = np.concatenate(seed), np.concatenate(item)
            yield pa.RecordBatch.from_arrays([pa.array(signed(seed)), batch.column(0).take(pa.array(item + lo)), pa.array(size[item].astype(np.int32))], names=["seed", "item", "size"])


def _spots(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return seed >> U64(64 - bits), (seed >> U64(8)) & U64((1 << bits) - 1)


def _bit_table(test: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a table with two bits set for each seed; merged in the cluster, so at most 2 ** bits / 64 rows come here."""
    spots = test.select(F.explode(F.array(F.shiftrightunsigned("seed", 64 - bits), F.shiftrightunsigned("seed", 8).bitwiseAND(F.lit((1 << bits) - 1)))).alias("spot"))
    words = spots.groupBy(F.expr("spot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("bits")).toArrow()
    table = np.zeros(max(1, (1 << bits) // 64), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint8)


def _document_seeds(table, bits: int, shorter: list[int]):
    """``h, n, seed`` of every text's seeds that the table knows, without repeats in a slice."""

    def run(batches):
        known = table.value
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for lo, hi in slices(offsets):
                hashes, first, s = tokens(data, offsets, lo, hi)
                if not len(hashes):
                    continue
                ends, found = first[1:][s.doc], []
                for mask in (*MASKS, *("1" * k for k in shorter)):
                    h = seeds(hashes, mask)
                    a, b = _spots(h, bits)
                    look = np.flatnonzero((known[a >> U64(3)] >> (a & U64(7)).astype(np.uint8)) & 1)
                    look = look[(known[b[look] >> U64(3)] >> (b[look] & U64(7)).astype(np.uint8)) & 1 > 0]
                    look = look[look + len(mask) <= ends[look]]
                    found.append(np.stack([s.doc[look].astype(U64), h[look]], 1))
                found = np.unique(np.concatenate(found), axis=0)
                row = pa.array(found[:, 0].astype(np.int64) + lo)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(row), batch.column(2).take(row), pa.array(signed(found[:, 1]))], names=["h", "n", "seed"])

    return run


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    edge = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate([[0], edge + 1])], at[np.concatenate([edge, [len(at) - 1]])]


class Tokens:
    """Token hashes of a text or item, and its seeds in order, made once for each mask that is asked for."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self._seeds: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def seeds(self, mask: str) -> tuple[np.ndarray, np.ndarray]:
        if mask not in self._seeds:
            h = seeds(self.hashes, mask)
            order = np.argsort(h, kind="stable")
            self._seeds[mask] = h[order], order
        return self._seeds[mask]


def diagonals(text: Tokens, item: Tokens, masks: list[str]) -> np.ndarray:
    """Offsets of the item in the text at which some seed agrees, in order.

    Where seeds repeat, their positions are taken by runs: one of a in the text and one of b in the item support a + b - 1
    offsets in a row.
    """
    n, m = len(text.hashes), len(item.hashes)
    found, change = [], None
    for mask in masks:
        (sx, ox), (sy, oy) = text.seeds(mask), item.seeds(mask)
        lo, hi = np.searchsorted(sx, sy), np.searchsorted(sx, sy, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        size = (hi - lo)[hit]
        if size.sum() <= n + m:
            at = np.repeat(lo[hit] - np.cumsum(size) + size, size) + np.arange(size.sum())
            found.append(ox[at] - np.repeat(oy[hit], size))
            continue
        change = np.zeros(n + m + 2, np.int64) if change is None else change
        for value in np.unique(sy[hit]):
            a0, a1 = _runs(ox[np.searchsorted(sx, value) : np.searchsorted(sx, value, "right")])
            b0, b1 = _runs(oy[np.searchsorted(sy, value) : np.searchsorted(sy, value, "right")])
            step = max(1, (1 << 20) // len(b0))
            for k in range(0, len(a0), step):
                np.add.at(change, (a0[k : k + step, None] - b1[None] + m).ravel(), 1)
                np.add.at(change, (a1[k : k + step, None] - b0[None] + m + 1).ravel(), -1)
    if change is not None:
        found.append(np.flatnonzero(np.cumsum(change) > 0) - m)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def overlap(text: Tokens, item: Tokens) -> tuple[int, int, int] | None:
    """Equal tokens, first and end token of the largest verified overlap over all seeded diagonals (ties: the first); None if all are too small."""
    a, b = text.hashes, item.hashes
    n = len(b)
    masks = list(MASKS) if n >= SHORTEST else ["1" * n]
    need = LEAST_TOKENS if n > LEAST_TOKENS else max(1, math.ceil(LEAST_SHARE * n))
    best = None
    for diagonal in diagonals(text, item, masks).tolist():
        s, e = max(0, diagonal), min(len(a), diagonal + n)
        if e - s < need or best is not None and e - s <= best[0]:
            continue
        same = a[s:e] == b[s - diagonal : e - diagonal]
        if np.count_nonzero(same) < (need if best is None else best[0] + 1):
            continue
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
        floor = np.minimum.accumulate(total)
        end = int(np.argmax(total - floor))
        start = int(np.argmax(total[: end + 1] == floor[end]))
        equal = int(same[start:end].sum())
        if equal >= need and (best is None or equal > best[0]):
            best = (equal, s + start, s + end)
    return best


FOUND = "h long, n long, item_id long, equal int, first_char int, end_char int"


def _verify(batches):
    """The overlap of each text (column 2) with each of its candidates (column 3, structs of id and text)."""
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        rows = []
        flat = batch.column(3).flatten()
        ids, (item_data, item_offsets) = flat.field("item_id").to_pylist(), buffers(flat.field("text"))
        items, item_first, _ = tokens(item_data, item_offsets, 0, len(ids))
        edge = np.cumsum([0, *(len(x) for x in batch.column(3))])
        made: dict[bytes, Tokens] = {}  # items come again and again
        item_of = lambda k: made.setdefault((h := items[item_first[k] : item_first[k + 1]]).tobytes(), Tokens(h))
        for lo, hi in slices(offsets):
            hashes, first, s = tokens(data, offsets, lo, hi)
            for doc in range(hi - lo):
                text = Tokens(hashes[first[doc] : first[doc + 1]])
                for k in range(edge[lo + doc], edge[lo + doc + 1]):
                    if (r := overlap(text, item_of(k))) is not None:
                        base = s.bounds[doc]
                        rows.append((lo + doc, ids[k], r[0], int(s.starts[first[doc] + r[1]] - base), int(s.ends[first[doc] + r[2] - 1] - base)))
        at = pa.array([r[0] for r in rows], pa.int64())
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), *(pa.array([r[1 + k] for r in rows], t) for k, t in enumerate(kinds))],
            names=["h", "n", "item_id", "equal", "first_char", "end_char"],
        )


def _text_key() -> list:
    """Hash and length of a text: rows of equal texts share them."""
    return [F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n")]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``h, n, item_id, equal, first_char, end_char`` (bytes): the largest verified overlap of every text, by hash and length, with every item. Staged."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and text <> ''").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    test = stage(items.select("item", "text").mapInArrow(_item_seeds, "seed long, item long, size int").distinct(), "seeds")
    count = test.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("size") < SHORTEST, F.col("size"))).alias("short")).first()
    bits = min(SIEVE_BITS, max(16, int(128 * (count["n"] + 1)).bit_length()))
    table = sc.broadcast(_bit_table(test, bits))
    rows = docs.filter("text is not null and text <> ''").select("text", *_text_key())
    train = rows.mapInArrow(_document_seeds(table, bits, sorted(count["short"])), "h long, n long, seed long").distinct()
    pairs = stage(train.join(small(test.select("seed", "item"), count["n"]), "seed").select("h", "n", "item").distinct(), "candidates")
    wanted = pairs.groupBy("h", "n").agg(F.ceil(F.count(F.lit(1)) / ITEMS).cast("int").alias("chunks"))
    beside = pairs.join(wanted, ["h", "n"]).withColumn("chunk", F.pmod("item", "chunks")).join(items, "item").groupBy("h", "n", "chunk").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    texts = sieved(rows, ["h", "n"], wanted, ["h", "n"]).dropDuplicates(["h", "n"])
    return stage(beside.join(texts, ["h", "n"]).select("h", "n", "text", "items").mapInArrow(_verify, FOUND), "overlaps")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: whether any item leaks into it, how many do, and the largest overlap (ties: least item)."""
    best = overlaps(docs, benchmark).groupBy("h", "n").agg(
        F.countDistinct("item_id").alias("n_items"), F.min(F.struct(-F.col("equal"), "item_id", "first_char", "end_char")).alias("best")
    )
    best = stage(best, "leaks")
    best = small(best, best.count())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_key())
    return rows.join(best, ["h", "n"], "left").select(
        "doc_id", F.col("best").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("best.item_id").alias("item_id"),
        F.coalesce(-F.col("best.col1"), F.lit(0)).alias("equal_tokens"), F.col("best.first_char").alias("first_byte"), F.col("best.end_char").alias("end_byte"),
    )


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, into which no item of the benchmark leaks. Only rows that the leaks' sieve lets through are compared with them, and moved where leaks are many."""
    leaks = stage(overlaps(docs, benchmark).select(F.col("h").alias("_leak_hash"), F.col("n").alias("_leak_size")).distinct(), "leaks")
    if leaks.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(leaks), _same_text(), "left_anti").select(*docs.columns)
    h, size = _text_key()
    clean, other = (sieved(docs, [h, size], leaks, ["_leak_hash", "_leak_size"], inside) for inside in (False, True))
    return clean.union(other.join(leaks, _same_text(), "left_anti").select(*docs.columns))


def _same_text():
    h, size = _text_key()
    return (h == F.col("_leak_hash")) & (size == F.col("_leak_size"))
