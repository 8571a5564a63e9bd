"""A vector table on Parquet: upsert, nearest neighbours, and the providers that make vectors."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hashed_embedding
from ..functions.vectors import top_rows
from .staging import file_system


class EmbeddingProvider(ABC):
    """Texts to vectors; a table of chunks optionally lives with the provider."""

    #: Whether ``upsert_chunks`` and ``query_chunks`` work, and whether ``embed`` does.
    stores = False
    embeds = True

    def upsert_chunks(self, chunks: DataFrame) -> None:
        """Inserts or replaces rows ``chunk_id, text, ...`` by their id."""
        raise NotImplementedError("this provider keeps no chunks")

    def query_chunks(self, queries: DataFrame, k: int, where: str | None = None) -> DataFrame:
        """``query_id, id, cosine, rank, score`` of the k nearest stored chunks of each of ``queries(query_id, text)``."""
        raise NotImplementedError("this provider keeps no chunks")

    @abstractmethod
    def embed(self, rows: DataFrame, text: str = "text", output: str = "v") -> DataFrame:
        """``rows`` with a vector column."""


class HashingProvider(EmbeddingProvider):
    def __init__(self, dim: int = 16):
        self.dim = dim

    def embed(self, rows: DataFrame, text: str = "text", output: str = "v") -> DataFrame:
        return rows.withColumn(output, hashed_embedding(F.col(text), self.dim))


class NoProvider(EmbeddingProvider):
    """For an index without a model: queries start from a uniform prior and nothing is reranked by similarity."""

    embeds = False

    def embed(self, rows: DataFrame, text: str = "text", output: str = "v") -> DataFrame:
        return rows.withColumn(output, F.lit(None).cast("array<double>"))


class BatchModelProvider(EmbeddingProvider):
    """A model behind ``predict(texts) -> vectors``, called on Arrow batches."""

    def __init__(self, predict):
        self.predict = predict

    def embed(self, rows: DataFrame, text: str = "text", output: str = "v") -> DataFrame:
        predict = self.predict

        @F.pandas_udf("array<double>")
        def call(texts):
            import pandas as pd

            return pd.Series([list(map(float, v)) for v in predict(texts.fillna("").tolist())])

        return rows.withColumn(output, call(text))


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key. Of repeated keys in ``new`` the row of greatest ``order`` stays, ties and the rest by the other columns."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(latest(new, key, order))


def latest(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row of each key: of greatest ``order``, then by the other columns, so that reruns agree."""
    by = [F.col(order).desc()] if order else []
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*by, *[F.col(c).desc() for c in rows.columns if c not in (key, order)] or [F.lit(1)]))
    return rows.withColumn("_nth", rank).filter("_nth = 1").drop("_nth")


def nearest(rows: DataFrame, queries: DataFrame, k: int, where: str | None = None, key: str = "id", vector: str = "v") -> DataFrame:
    """``query_id, id, cosine, rank`` of the k nearest rows, filtered before anything is compared."""
    if where:
        rows = rows.filter(where)
    kinds = (queries.schema[queries.columns[0]].dataType.simpleString().replace("bigint", "long"), rows.schema[key].dataType.simpleString().replace("bigint", "long"))
    return top_rows(rows.select(F.col(key).alias("id"), F.col(vector).alias("v")), queries, max(1, k), *kinds)


class VectorTable:
    """Vectors with metadata in one folder of any store. Generations alternate: an upsert writes a new one and never touches what it reads; the last complete one counts, and the one before it stays for readers under way."""

    def __init__(self, spark: SparkSession, path: str):
        if not path:
            raise ValueError("a vector table needs a path")
        self.spark, self.path = spark, path.rstrip("/")

    def _generations(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.path}/gen-*/_SUCCESS")
        found = [re.search(r"/gen-([0-9]+)/_SUCCESS$", s.getPath().toString()) for s in fs.globStatus(at) or ()]
        return sorted(int(m[1]) for m in found if m)

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/gen-{g[-1]}") if (g := self._generations()) else None

    def upsert(self, new: DataFrame, order: str | None = None) -> None:
        """ValueError where a row has no id or no vector, or vectors differ in length among themselves or from the table's."""
        old = self.read()
        check = new.agg(F.count(F.lit(1)).alias("n"), F.count("chunk_id").alias("ids"), F.count("v").alias("vectors"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
        if check["n"] != check["ids"] or check["n"] != check["vectors"]:
            raise ValueError("every row needs a chunk_id and a vector")
        if check["n"] and check["lo"] != check["hi"]:
            raise ValueError(f"vectors of {check['lo']} and of {check['hi']} numbers")
        if check["n"] and old is not None and (first := old.first()) is not None and len(first["v"]) != check["lo"]:
            raise ValueError(f"vectors of {check['lo']} numbers, but the table has {len(first['v'])}")
        table = upsert(old, new, order=order) if old is not None else latest(new, "chunk_id", order)
        gens = self._generations()
        number = (gens[-1] if gens else 0) + 1
        table.write.mode("overwrite").parquet(f"{self.path}/gen-{number}")
        for past in gens[:-1]:
            fs, at = file_system(self.spark, f"{self.path}/gen-{past}")
            fs.delete(at, True)

    def query(self, queries: DataFrame, k: int, where: str | None = None) -> DataFrame:
        """``query_id, id, cosine, rank, score`` for ``queries(query_id, q)``."""
        table = self.read()
        if table is None:
            raise RuntimeError(f"no vectors in {self.path}")
        found = nearest(table, queries, k, where, key="chunk_id")
        return found.withColumn("score", 1 / (1 + (1 - F.col("cosine"))))


class StoredProvider(EmbeddingProvider):
    """A provider whose chunks live in a ``VectorTable``."""

    stores = True

    def __init__(self, inner: EmbeddingProvider, table: VectorTable):
        self.inner, self.table = inner, table

    def embed(self, rows: DataFrame, text: str = "text", output: str = "v") -> DataFrame:
        return self.inner.embed(rows, text, output)

    def upsert_chunks(self, chunks: DataFrame) -> None:
        """Rows without a vector ``v`` get one from the text."""
        self.table.upsert(chunks if "v" in chunks.columns else self.embed(chunks))

    def query_chunks(self, queries: DataFrame, k: int, where: str | None = None) -> DataFrame:
        return self.table.query(self.embed(queries, output="q").select("query_id", "q"), k, where)
