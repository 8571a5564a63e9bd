"""Mixing sources to target weights by the cube method.

A source's target over its size is a multiplicity m <= 3. Every document is taken floor(m) times, and
once more if the cube method picks it: inclusion probabilities, all equal to the fraction of m, move in the null
space of two constraints (tokens, documents) of the source, three documents at a time, until each is 0 or 1. Blocks of
about ``BLOCK`` documents of one source run in parallel. ``RESERVE`` documents of a block keep their probabilities; they and the two
or fewer others that it leaves open meet in the next round, so a source of any size ends with one block. There the
landing takes the subset of what is open that comes nearest to the expected tokens and documents, by enumeration.

A null text has size 0; a null source is a source, listed last. Repeated rows are documents of their own. Draws
hash the source, block and seed, so reruns agree. Without any word every target is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, stage
from .textkit import Slice, buffers, slices, tidy

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK = 2048
RESERVE = 12
SEED = 17
EPS = 1e-9


def _sizes(batches):
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        size = np.zeros(batch.num_rows, np.int64)
        for lo, hi in slices(offsets):
            s = Slice(data, offsets, lo, hi)
            s.words()
            size[lo:hi] = s.counts
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size)], names=["doc_id", "source", "size"])
        del batch, data, offsets
        yield out
    tidy()


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` with the number of words of whole texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(_sizes, "doc_id long, source string, size long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """``source, source_size, docs, target``: one row a source.

    Ranks come from a range-partitioned sort with counts of each partition, and the level of the uncapped
    targets from rounds of aggregates, so any number of sources will do.
    """
    table = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "sources")
    part = stage(table.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    rows = part.groupBy("part").count().collect()
    before, total = {}, 0
    for r in sorted(rows, key=lambda r: r["part"]):
        before[r["part"]] = total
        total += r["count"]
    if not total:
        return table.withColumn("target", F.lit(0.0))
    starts = part.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod(rank, F.lit(len(weights))).cast("int")]
    table = stage(part.join(F.broadcast(starts), "part").withColumn("weight", weight).drop("part", "before"), "sources")
    words, cap = float(table.agg(F.sum("source_size")).first()[0] or 0) * share, F.col("source_size") * most
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * level > cap
        full, rest = table.agg(F.sum(F.when(capped, cap).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        new = (words - full) / rest if rest else 0.0
        if level is not None and new <= level * (1 + 1e-15):
            break
        level = new
    return table.select("source", "source_size", "docs", F.least(F.col("weight") * level, cap).alias("target"))


def _reserve(queue: list[int]) -> list[int]:
    """``RESERVE`` of the documents, which come by falling size: at places that double, so that each is about half as long as the one before and their subsets come near any total."""
    if not queue:
        return []
    places = {int(round(x)) - 1 for x in np.geomspace(1, len(queue), RESERVE)}
    for k in range(0, len(queue), -(-len(queue) // RESERVE)):
        if len(places) < RESERVE:
            places.add(k)
    return [queue[k] for k in sorted(places)]


def flight(pi: np.ndarray, size: np.ndarray, draw, landing: bool, reserve: bool = False) -> None:
    """Moves ``pi`` in place. Sizes are constraint one, the count is constraint two; at most two stay open, beside those in ``reserve``, and none after a ``landing``."""
    queue = [int(k) for k in np.flatnonzero((pi > EPS) & (pi < 1 - EPS))]
    p, s = pi.tolist(), size.astype(float).tolist()
    hold: list[int] = []
    kept = _reserve(queue) if landing or reserve else []
    queue = [k for k in queue if k not in kept]

    def move(units: list[int], u: list[float]) -> list[int]:
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(units, u) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(units, u) if x)
        step = up if draw() * (up + down) < down else -down
        for k, x in zip(units, u):
            p[k] += step * x
            if p[k] < EPS:
                p[k] = 0.0
            elif p[k] > 1 - EPS:
                p[k] = 1.0
        return [k for k in units if 0.0 < p[k] < 1.0]

    for k in queue:
        hold.append(k)
        while True:
            same = next(((a, b) for i, a in enumerate(hold) for b in hold[i + 1 :] if s[a] == s[b]), None)
            if same:
                u = [1.0 if h == same[0] else -1.0 if h == same[1] else 0.0 for h in hold]
            elif len(hold) == 3:
                a, b, c = (s[h] for h in hold)
                top = max(abs(b - c), abs(c - a), abs(a - b))
                u = [(b - c) / top, (c - a) / top, (a - b) / top]
            else:
                break
            hold = move(hold, u)
    if landing:
        left = np.array(sorted(hold + kept), int)
        if len(left):
            pick = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
            have, weigh = np.array([p[k] for k in left]), np.array([s[k] for k in left])
            miss = np.abs(pick @ weigh - have @ weigh) + 0.05 * max(1.0, weigh.mean()) * np.abs(pick.sum(1) - have.sum())
            best = pick[np.argmin(miss + 1e-6 * draw() * pick[:, 0])]
            for k, x in zip(left, best):
                p[k] = float(x)
    pi[:] = p


_STATE = "doc_id long, source string, size long, source_size long, target double, pi double"


def _round(landing: bool, number: int):
    def run(key, table):
        source, block = (k.as_py() for k in key)
        t = table.select(["doc_id", "source", "size", "source_size", "target", "pi"]).sort_by([("size", "descending"), ("doc_id", "ascending"), ("pi", "ascending")])
        salt = int.from_bytes(__import__("hashlib").sha256(f"{SEED}|{number}|{source!r}|{block}".encode()).digest()[:8], "little")
        rng = np.random.default_rng(salt)
        pi = t["pi"].to_numpy().copy()
        flight(pi, t["size"].to_numpy(), iter(rng.random, 2.0).__next__, landing, reserve=True)
        return t.set_column(5, "pi", pa.array(pi))

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row; ``taken`` counts the words that the mix takes, repeats included."""
    sized = stage(sizes(docs), "sizes")
    goal = stage(targets(sized, weights, most, share), "targets")
    n = goal.count()
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    g = goal.select(F.col("source").alias("g"), "source_size", "target", F.col("docs"))
    state = sized.join(small(g, n), F.col("source").eqNullSafe(F.col("g"))).withColumn("ratio", ratio).withColumn("whole", F.floor(F.col("ratio") + EPS))
    state = state.withColumn("pi", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
    done, number = [], 0
    open_rows = state.select("doc_id", "source", "size", "source_size", "target", "pi", F.ceil(F.col("docs") / BLOCK).cast("long").alias("blocks"))
    most_blocks = goal.agg(F.max(F.ceil(F.col("docs") / BLOCK))).first()[0] or 0
    while True:
        landing = most_blocks <= 1
        cell = F.pmod(F.xxhash64("doc_id", "size", F.lit(number)), F.greatest(F.col("blocks"), F.lit(1))).alias("block")
        moved = stage(open_rows.select("doc_id", "source", "size", "source_size", "target", "pi", cell).groupBy("source", "block").applyInArrow(_round(landing, number), _STATE), "mix")
        done.append(moved.filter("pi = 0 or pi = 1") if not landing else moved)
        if landing:
            break
        left = moved.filter("pi > 0 and pi < 1")
        count = stage(left.groupBy(F.col("source").alias("g")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")), "open")
        most_blocks = count.agg(F.max("blocks")).first()[0] or 0
        open_rows, number = left.join(small(count, n), F.col("source").eqNullSafe(F.col("g"))).drop("g"), number + 1
    every = done[0]
    for d in done[1:]:
        every = every.union(d)
    whole = F.floor(F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0) + EPS)
    return every.select("doc_id", "size", "source_size", "target", (F.col("size") * (whole + F.round("pi"))).cast("long").alias("taken"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
