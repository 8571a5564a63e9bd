"""Nodes, edges and the hierarchy, as tables keyed on (src, dst, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add_nodes(nodes: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """The union, where a new row replaces the old one of its id. Of new rows with one id the last by ``order`` stays, then by the other columns."""
    by = [F.col(c).desc() for c in ([order] if order else []) + [c for c in new.columns if c not in ("id", order)]]
    last = new.withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy(*by or [F.lit(1)]))).filter("_nth = 1").drop("_nth", *([order] if order else []))
    return nodes.join(last.select("id"), "id", "left_anti").unionByName(last, allowMissingColumns=True)


def neighbors(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """``src, dst, weight`` of outgoing edges, of one kind or summed over all kinds of a pair."""
    rows = edges.filter(F.col("kind") == kind) if kind else edges
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def edge_kinds(edges: DataFrame) -> DataFrame:
    """``src, dst, kinds``: the kinds that join a pair, in order."""
    return edges.groupBy("src", "dst").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def add_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Weights accumulate for each (src, dst, kind). With ``nodes``, an edge without both endpoints raises KeyError."""
    if nodes is not None:
        ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
        if missing := ends.join(nodes.select("id"), "id", "left_anti").head():
            raise KeyError(missing["id"])
    return edges.groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"))


def normalize_edges(edges: DataFrame) -> DataFrame:
    """Weights of a source sum to 1; sources whose weights don't exceed 0 keep theirs. The total is pre-aggregated, so a hot source is no one task's burden."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("_total"))
    return edges.join(total, "src").withColumn("weight", F.when(F.col("_total") > 0, F.col("weight") / F.col("_total")).otherwise(F.col("weight"))).drop("_total")


def prune_edges(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.filter(F.col("weight") >= threshold)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``what, n``: nodes of each kind, all nodes, all edges."""
    kinds = nodes.groupBy(F.concat(F.lit("node:"), F.col("kind")).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.union(nodes.agg(F.lit("nodes"), F.count(F.lit(1)))).union(edges.agg(F.lit("edges"), F.count(F.lit(1))))


def parents(topics: DataFrame) -> DataFrame:
    """``topic_id, parent_id, nth`` (order of the parent)."""
    return topics.select("topic_id", F.posexplode("parent_ids").alias("nth", "parent_id"))


def subtopic_edges(topics: DataFrame) -> DataFrame:
    return parents(topics).select(F.col("parent_id").alias("src"), F.col("topic_id").alias("dst"), F.lit("topic-subtopic").alias("kind"), F.lit(1.0).alias("weight"))


def children(topics: DataFrame) -> DataFrame:
    return parents(topics).select(F.col("parent_id").alias("topic_id"), F.col("topic_id").alias("child_id")).distinct()


def siblings(topics: DataFrame) -> DataFrame:
    """Distinct topics with a common parent, without the topic itself; roots have none."""
    p = parents(topics)
    q = p.select(F.col("topic_id").alias("sibling_id"), "parent_id")
    return p.join(q, "parent_id").filter("topic_id <> sibling_id").select("topic_id", "sibling_id").distinct()


def leaves(topics: DataFrame) -> DataFrame:
    return topics.join(parents(topics).select(F.col("parent_id").alias("topic_id")).distinct(), "topic_id", "left_anti")


def depth(topics: DataFrame) -> int | None:
    """Hops from the deepest topic to its root where every topic has one parent at most; None in a DAG, where levels don't tell."""
    level, several = topics.agg(F.max("level"), F.max(F.size("parent_ids"))).first()
    return None if several is not None and several > 1 else max(0, (level or 1) - 1)


def ancestors(topics: DataFrame, max_depth: int = 64) -> DataFrame:
    """``topic_id, ancestor_id, hops`` (fewest): the closure upwards, one join a level. In a tree the levels say when to stop, in a DAG the first level without a pair."""
    step = parents(topics).select("topic_id", "parent_id")
    found = level = step.select("topic_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("hops"))
    known = depth(topics)
    for hops in range(2, (max_depth if known is None else known) + 1):
        level = level.alias("l").join(step.alias("s"), F.col("l.ancestor_id") == F.col("s.topic_id")).select(F.col("l.topic_id"), F.col("s.parent_id").alias("ancestor_id"), F.lit(hops).alias("hops")).distinct()
        if known is None:
            level = level.cache()
            if level.isEmpty():
                break
        found = found.union(level)
    return found.groupBy("topic_id", "ancestor_id").agg(F.min("hops").alias("hops"))


def descendants(topics: DataFrame) -> DataFrame:
    """``topic_id, descendant_id``, the topic itself included."""
    up = ancestors(topics)
    return up.select(F.col("ancestor_id").alias("topic_id"), F.col("topic_id").alias("descendant_id")).union(topics.select("topic_id", F.col("topic_id").alias("descendant_id")))


def structural_edges(chunks: DataFrame) -> DataFrame:
    """Both directions between neighbours of one document that share a group >= 0. Needs ``chunk_id, doc_id, position, structural_group``."""
    order = Window.partitionBy("doc_id").orderBy("position")
    near = chunks.select("chunk_id", F.lead("chunk_id").over(order).alias("next_id"), F.col("structural_group").alias("g"), F.lead("structural_group").over(order).alias("h")).filter("g = h and g >= 0")
    forth = near.select(F.col("chunk_id").alias("src"), F.col("next_id").alias("dst"))
    back = near.select(F.col("next_id").alias("src"), F.col("chunk_id").alias("dst"))
    return forth.union(back).select("src", "dst", F.lit("chunk-chunk-structural").alias("kind"), F.lit(1.0).alias("weight"))


def nodes_and_edges(topics: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON-able listing: ``record, key, kind, value``."""
    t = topics.select(F.lit("node").alias("record"), F.col("topic_id").alias("key"), F.lit("topic").alias("kind"), F.col("level").cast("double").alias("value"))
    c = chunks.select(F.lit("node"), F.col("chunk_id").cast("string"), F.lit("chunk"), F.col("position").cast("double"))
    e = edges.select(F.lit("edge"), F.concat_ws("|", "src", "dst"), "kind", "weight")
    return t.union(c).union(e)


def to_records(topics: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """``record, key, kind, fields``: a whole graph as rows, with the fields of each kind as JSON (null ones left out)."""
    given = lambda df, names: F.to_json(F.struct(*[c for c in names if c in df.columns]))
    t = topics.select(F.lit("node").alias("record"), F.col("topic_id").alias("key"), F.lit("topic").alias("kind"), given(topics, ("label", "level", "parent_ids", "keywords")).alias("fields"))
    c = chunks.select(F.lit("node"), F.col("chunk_id").cast("string"), F.lit("chunk"), given(chunks, ("doc_id", "position", "structural_group", "text")))
    e = edges.select(F.lit("edge"), F.concat_ws("|", "src", "dst"), "kind", F.to_json(F.struct("src", "dst", "weight")))
    return t.union(c).union(e)


def from_records(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without id or kind, and edges without endpoints, go; an endpoint nobody lists becomes a topic node."""
    nodes = nodes.filter("id is not null and kind is not null")
    edges = edges.filter("src is not null and dst is not null")
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    extra = ends.join(nodes.select("id"), "id", "left_anti").withColumn("kind", F.lit("topic"))
    return nodes.unionByName(extra, allowMissingColumns=True), edges
