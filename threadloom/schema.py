"""Ids, kinds and table schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_KINDS = ("topic", "chunk", "keyword")
EDGE_KINDS = ("topic-topic", "topic-related", "topic-subtopic", "topic-chunk", "chunk-chunk", "chunk-chunk-structural", "keyword-topic", "keyword-chunk")
INTENTS = ("deepen", "broaden", "compare", "apply", "clarify", "neutral")
RELATIONS = ("parent", "child", "sibling", "semantic_neighbor", "distant_related")

CHUNKS = "chunk_id string, doc_id long, position int, text string, structural_group long"
TOPICS = "topic_id string, label string, level int, parent_ids array<string>, keywords array<string>, centroid array<double>"
EDGES = "src string, dst string, kind string, weight double"
TRANS1 = "j string, k string, cnt double"
TRANS2 = "i string, j string, k string, cnt double"


def topic_id(path: Column) -> Column:
    """``t:`` and the dotted path; an empty path is ``t:``."""
    return F.concat(F.lit("t:"), F.array_join(path.cast("array<string>"), "."))


def topic_path(topic: Column) -> Column:
    """Indices of a topic id; parts that aren't numbers are dropped."""
    return F.filter(F.split(F.substr(topic, F.lit(3)), "[.]"), lambda x: x.rlike("^[0-9]+$")).cast("array<int>")


def topic_depth(topic: Column) -> Column:
    """Length of the path, so a root has depth 1."""
    return F.size(topic_path(topic))


def one_of(value, allowed: tuple[str, ...], what: str) -> str:
    """A valid kind, intent or relation, from a string or an enum member."""
    name = str(getattr(value, "value", value)).lower()
    if name not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}; got {value!r}")
    return name
