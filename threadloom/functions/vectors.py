"""Vector expressions, and similarity of rows to a stated query set by matrix products on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Vectors of a query set that a task holds at a time; larger sets are met in blocks.
BLOCK = 4096
#: Pairs that a task holds at a time, and pairs for which a stage gets a further task.
ROWS, SPREAD = 1 << 17, 1 << 24


def spread(pairs: int) -> int:
    """Tasks for so many pairs."""
    return min(10_000, max(1, -(-pairs // SPREAD)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths as a float64 matrix; a null row is zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        width = max((len(x) for x in column.to_pylist() if x is not None), default=0)
        return np.array([x or [0.0] * width for x in column.to_pylist()], np.float64).reshape(len(column), width)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay zero."""
    norm = np.sqrt((m * m).sum(1, keepdims=True)) if m.size else np.ones((len(m), 1))
    return m / np.where(norm == 0, 1, norm)


def query_blocks(queries: DataFrame, block: int = BLOCK) -> Iterator[tuple[list, np.ndarray]]:
    """``(id, vector)`` rows of a query set, in blocks of about ``block`` rows that are collected one at a time."""
    key, vector = queries.columns
    n = queries.count()
    blocks = max(1, -(-n // block))
    for k in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)
        table = part.orderBy(key).toArrow()
        yield table[key].to_pylist(), matrix(table[vector])


def top_rows(rows: DataFrame, queries: DataFrame, k: int, key_type: str = "long", id_type: str = "long") -> DataFrame:
    """``query_id, id, cosine`` of the k rows nearest to each query (ties: smaller id), exact.

    A task meets its rows ``ROWS`` pairs at a time and holds what may still be among the k best of each query; it sends those
    once, at its end, so what is shuffled depends on queries and tasks, not on rows.
    """
    id_name, vector = rows.columns

    def nearest(ids: list, m: np.ndarray):
        u = unit(m)

        def best(held: list, floor: np.ndarray) -> list:
            q, own, score = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((own, -score, q))
            q, own, score = q[order], own[order], score[order]
            start = np.searchsorted(q, q)
            nth = np.arange(len(q)) - start
            floor[q[nth == k - 1]] = score[nth == k - 1]
            return [(q[nth < k], own[nth < k], score[nth < k])]

        def run(batches):
            held, floor, size = [], np.full(len(ids), -np.inf), 0
            for batch in batches:
                own, v = np.array(batch.column(0).to_pylist()), unit(matrix(batch.column(1)))
                step = max(1, ROWS // max(1, len(ids)))
                for at in range(0, len(own) if ids else 0, step):
                    score = v[at : at + step] @ u.T
                    r, q = np.nonzero(score >= floor - 1e-8)
                    score = np.round(score[r, q], 9)
                    keep = score >= floor[q]
                    held.append((q[keep], own[at + r[keep]], score[keep]))
                    size += int(keep.sum())
                    if size > 4 * ROWS + 2 * k * len(ids):
                        held = best(held, floor)
                        size = len(held[0][0])
            for q, own, score in best(held, floor) if held else ():
                for at in range(0, len(q), ROWS):
                    part = slice(at, at + ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q[part]]), pa.array(own[part].tolist()), pa.array(score[part])], names=["query_id", "id", "cosine"])

        return run

    found = None
    for ids, m in query_blocks(queries):
        one = rows.mapInArrow(nearest(ids, m), f"query_id {key_type}, id {id_type}, cosine double")
        found = one if found is None else found.union(one)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def cosines(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, <id>, cosine`` of every row with every query, made where the row is: rows are spread over tasks by the number of pairs, which leave a task in batches of about ``ROWS``."""
    id_name, vector = rows.columns
    key = queries.columns[0]
    rows = rows.repartition(spread(rows.count() * queries.count()))
    kind = queries.schema[key].dataType

    def run(ids: pa.Array, m: np.ndarray):
        u = unit(m)

        def made(batches):
            for batch in batches:
                own = unit(matrix(batch.column(1)))
                step = max(1, ROWS // max(1, len(own)))
                for k in range(0, len(ids) if len(own) else 0, step):
                    part = u[k : k + step]
                    who, row = np.repeat(np.arange(k, k + len(part)), len(own)), np.tile(np.arange(len(own)), len(part))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), batch.column(0).take(pa.array(row)), pa.array((part @ own.T).ravel())], names=["query_id", id_name, "cosine"])

        return made

    found = None
    for ids, m in query_blocks(queries):
        one = rows.mapInArrow(run(pa.array(ids, to_arrow_type(kind)), m), f"query_id {kind.simpleString()}, {id_name} {rows.schema[id_name].dataType.simpleString()}, cosine double")
        found = one if found is None else found.union(one)
    return found
