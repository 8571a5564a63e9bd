"""The contract of a topic model, and the model that clusters."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from . import graph, topics


class TopicModel(ABC):
    """What an index needs to know about topics; all of it as tables.

    ``topics`` holds topic_id, label, level, parent_ids, keywords and centroid once the model is fitted.
    """

    topics: DataFrame | None = None

    @abstractmethod
    def fit(self, chunks: DataFrame) -> DataFrame:
        """The topic table of ``chunks(chunk_id, v, text)``; kept in ``topics`` as well."""

    def transform(self, rows: DataFrame) -> DataFrame:
        """``<id>, dist array<struct<topic_id, p>>`` of ``rows(<id>, vector)`` over the leaves."""
        return topics.leaf_distribution(rows, self.leaves())

    def distribution_for_queries(self, queries: DataFrame) -> DataFrame:
        """``query_id, topic_id, p`` of ``queries(query_id, vector)``."""
        return topics.long_form(self.transform(queries))

    def fitted(self) -> DataFrame:
        if self.topics is None:
            raise RuntimeError("the topic model is not fitted")
        return self.topics

    def hierarchy(self) -> DataFrame:
        """``topic_id, child_id``."""
        return graph.children(self.fitted())

    def ids(self) -> DataFrame:
        return self.fitted().select("topic_id")

    def leaves(self) -> DataFrame:
        return graph.leaves(self.fitted())

    def parents(self, topic_id: str) -> list[str]:
        row = self.fitted().filter(F.col("topic_id") == topic_id).first()
        return list(row["parent_ids"]) if row is not None else []

    def centroid(self, topic_id: str) -> list[float] | None:
        row = self.fitted().filter(F.col("topic_id") == topic_id).first()
        return row["centroid"] if row is not None else None

    def coarse_centroid(self, number: int) -> list[float] | None:
        """Of the root topic with that number."""
        return self.centroid(f"t:{number}")

    def keywords(self, topic_id: str, top_k: int = 10) -> list[str]:
        row = self.fitted().filter(F.col("topic_id") == topic_id).select(F.slice("keywords", 1, max(1, top_k)).alias("k")).first()
        return list(row["k"] or []) if row is not None else []


def described(t: DataFrame, chunks: DataFrame) -> DataFrame:
    """The topic table with labels and keywords. Topics are few, so it comes back as local rows."""
    texts = chunks.select(F.col("chunk_id").alias("doc_id"), "text")
    members = topics.keyword_members(chunks.select(F.col("chunk_id").alias("doc_id"), "v"), t).join(texts, "doc_id")
    words = topics.keywords(members).groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    t = t.select("topic_id", "level", "parent_ids", "centroid").join(words, "topic_id", "left").withColumn("label", F.concat(F.lit("Topic "), "topic_id"))
    return t.sparkSession.createDataFrame(t.orderBy("topic_id").collect(), t.schema)


class ClusterModel(TopicModel):
    """A tree of k-means clusters with further parents and keywords."""

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()

    def fit(self, chunks: DataFrame) -> DataFrame:
        s = self.settings
        t = topics.kmeans_tree(chunks.select("chunk_id", "v"), s.n_coarse, s.n_fine, s.hierarchy_max_depth, s.min_cluster_size)
        t = topics.add_dag_parents(t.select("topic_id", "level", "parent_ids", "centroid"), s.dag_tau)
        self.topics = described(t, chunks)
        return self.topics


class GivenModel(TopicModel):
    """A ready topic table; keywords are made where it has none."""

    def __init__(self, table: DataFrame):
        self.table = table

    def fit(self, chunks: DataFrame) -> DataFrame:
        t = self.table.sparkSession.createDataFrame(self.table.orderBy("topic_id").collect(), self.table.schema)
        self.topics = t if {"keywords", "label"} <= set(t.columns) else described(t, chunks)
        return self.topics
