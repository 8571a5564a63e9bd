"""Near-duplicate documents: b-bit MinHash over word shingles, confirmed on full sets.

Null and empty texts have an empty set and link with nothing; rows without doc_id keep to themselves
(null component, kept). Repeated rows fall into the class of their set and all are returned. Columns beside
``doc_id`` and ``text`` are neither read nor needed, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lsh import PLANES, Banding, distinct, linked_components, sets_match, signatures
from .shared import small, stage
from .textkit import LANE, U64, Slice, buffers, mix, run_hashes, signed, slices, tidy

SHINGLE = 5
BANDING = Banding()


def shingle_keys(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, width: int = SHINGLE) -> np.ndarray:
    """Distinct shingles of documents lo..hi as ``lsh.distinct`` keys; fewer words than ``width`` form one shingle."""
    s = Slice(data, offsets, lo, hi)
    s.words()
    if not len(s.starts):
        return np.zeros(0, U64)
    w = s.span_hashes(s.starts, s.ends)
    runs = run_hashes(w, width)
    inside = s.doc[: len(runs)] == s.doc[width - 1 :] if len(runs) else np.zeros(0, bool)
    doc, value = s.doc[: len(runs)][inside], runs[inside]
    few = np.flatnonzero((s.counts > 0) & (s.counts < width))
    if len(few):
        is_few = (s.counts < width)[s.doc]
        place = np.arange(len(w)) - s.first[s.doc]
        at = np.flatnonzero(is_few)
        total = np.zeros(hi - lo, U64)
        np.add.at(total, s.doc[at], w[at] * LANE[20 + place[at]])
        doc, value = np.concatenate([doc, few]), np.concatenate([value, mix(total[few] + LANE[30 + s.counts[few]])])
    return distinct(doc, value)


SIGNATURE = "doc_id long, n int, h0 long, h1 long, bands array<long>, " + ", ".join(f"{p} long" for p in PLANES)


def _signed_batches(batches):
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for lo, hi in slices(offsets):
            key = shingle_keys(data, offsets, lo, hi)
            n = hi - lo
            size, hashes = np.zeros(n, np.int32), np.zeros((n, 2), U64)
            bands, planes, has = np.zeros((0, 1), U64), np.zeros((n, len(PLANES)), U64), np.zeros(n, np.int64)
            if len(key):
                docs, sizes, h, bands, p = signatures(key, BANDING)
                size[docs], hashes[docs], planes[docs], has[docs] = sizes, h, p, bands.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, n), pa.array(size), pa.array(signed(hashes[:, 0])), pa.array(signed(hashes[:, 1])),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has)]).astype(np.int32)), pa.array(signed(bands).ravel())),
                    *(pa.array(signed(planes[:, k])) for k in range(len(PLANES))),
                ],
                names=["doc_id", "n", "h0", "h1", "bands", *PLANES],
            )
        del batch, data, offsets  # before the next batch arrives
    tidy()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Equal sets collapse to one class before any candidate is made; hot classes are pre-aggregated.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = stage(docs.mapInArrow(_signed_batches, SIGNATURE), "signatures")
    linkable = sig.filter("n > 0 and doc_id is not null")
    by_set = linkable.groupBy("h0", "h1").agg(F.min("doc_id").alias("id"))
    classes = stage(linkable.join(by_set.select("id", F.col("h0").alias("g0"), F.col("h1").alias("g1")), (F.col("doc_id") == F.col("id")) & (F.col("h0") == F.col("g0")) & (F.col("h1") == F.col("g1")))
                    .select("id", "n", "h0", "h1", "bands", *PLANES).dropDuplicates(["id", "h0", "h1"]), "classes")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    label = linked_components(classes, lambda pairs: sets_match(pairs, texts, shingle_keys, BANDING), BANDING)
    comp = classes.select("id", "h0", "h1").join(label, "id", "left").groupBy("h0", "h1").agg(F.min(F.coalesce("component", "id")).alias("component"))
    return (
        sig.select("doc_id", "n", "h0", "h1").join(comp, ["h0", "h1"], "left")
        .select(
            "doc_id", F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, that near-duplicate grouping keeps: one of each group, the least doc_id.

    Rows that repeat a doc_id are one document; of these the least text stays. Ids are compared, texts stay where they are.
    """
    verdict = stage(near_duplicates(docs).select("doc_id", "kept"), "verdicts")
    gone = stage(verdict.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    left = docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
    twice = stage(verdict.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    if not (n := twice.count()):
        return left
    once = left.join(small(twice, n), "doc_id", "left_anti").select(*docs.columns)
    least = Window.partitionBy("doc_id").orderBy(*[F.col(c) for c in ("text", *(c for c in docs.columns if c not in ("doc_id", "text")))])
    again = left.join(small(twice, n), "doc_id", "left_semi").withColumn("_least_rank", F.row_number().over(least)).filter("_least_rank = 1").select(*docs.columns)
    return once.union(again)
