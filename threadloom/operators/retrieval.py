"""From walks to ranked context windows: visits, projection, reranking, selection, explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visit_counts(walks: DataFrame) -> DataFrame:
    return walks.select("query_id", F.explode("path").alias("node")).groupBy("query_id", "node").agg(F.count(F.lit(1)).cast("double").alias("score"))


def path_scores(paths: DataFrame) -> DataFrame:
    """``query_id, node, score`` from ``query_id, path, log_prob``: each occurrence weighs max(exp(min(0, log_prob)), 1e-12)."""
    w = F.greatest(F.exp(F.least(F.lit(0.0), F.col("log_prob"))), F.lit(1e-12))
    return paths.select("query_id", F.explode("path").alias("node"), w.alias("w")).groupBy("query_id", "node").agg(F.sum("w").alias("score"))


def project(scores: DataFrame, topic_chunk: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score``: a topic's score spreads over its chunks by weight share. Shares are made once per topic with pre-aggregated totals."""
    total = topic_chunk.groupBy("topic_id").agg(F.sum("weight").alias("total")).filter("total > 0")
    share = topic_chunk.join(total, "topic_id").select(F.col("topic_id").alias("node"), "chunk_id", (F.col("weight") / F.col("total")).alias("share"))
    return scores.join(share, "node").groupBy("query_id", "chunk_id").agg(F.sum(F.col("score") * F.col("share")).alias("score"))


def rerank(scores: DataFrame, cosine: DataFrame | None = None, lexical: DataFrame | None = None, weights: tuple[float, float, float] = (0.6, 0.4, 0.0), mapped: bool = True) -> DataFrame:
    """``query_id, chunk_id, score`` from topic scores over their maximum, cosines ((c + 1) / 2 if ``mapped``, else clamped to [0, 1]) and lexical scores over their maximum."""
    wt, wc, wl = (w / sum(weights) for w in weights) if sum(weights) > 0 else (1.0, 0.0, 0.0)
    top = lambda df, c, name: df.groupBy("query_id").agg(F.max(c).alias(name))  # noqa: E731 - pre-aggregated, so a query's chunks are no one task's burden
    out = scores.join(top(scores, "score", "top"), "query_id").withColumn("s", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0) * wt)
    if sum(weights) <= 0:
        return scores
    if cosine is not None and wc:
        near = cosine.select("query_id", "chunk_id", ((F.col("cosine") + 1) / 2 if mapped else F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cosine")))).alias("c"))
        out = out.join(near, ["query_id", "chunk_id"], "left").withColumn("s", F.col("s") + F.coalesce("c", F.lit(0.0)) * wc)
    if lexical is not None and wl:
        lex = lexical.join(top(lexical, "bm25", "most"), "query_id").withColumn("l", F.col("bm25") / F.col("most")).select("query_id", "chunk_id", "l")
        out = out.join(lex, ["query_id", "chunk_id"], "left").withColumn("s", F.col("s") + F.coalesce("l", F.lit(0.0)) * wl)
    return out.select("query_id", "chunk_id", F.col("s").alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, chunk_id, bm25`` of ``docs(chunk_id, text)`` for ``queries(query_id, text)``.

    Only postings of query terms are made: the terms are sent to the scan when few (one stated set), so the rest of the corpus is counted, not moved.
    """
    from ..functions.text import tokens

    terms = queries.select("query_id", F.explode(tokens(F.lower("text"))).alias("term")).distinct()
    wanted = terms.select("term").distinct()
    n_terms = wanted.count()
    sized = docs.select("chunk_id", tokens(F.lower("text")).alias("t")).withColumn("len", F.size("t"))
    n, total = sized.agg(F.count(F.lit(1)), F.sum("len")).first()
    words = sized.select("chunk_id", "len", F.explode("t").alias("term"))
    words = words.join(F.broadcast(wanted) if n_terms <= 100_000 else wanted, "term", "left_semi")
    tf = words.groupBy("chunk_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = tf.join(df, "term").withColumn("w", idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (max(total or 0, 1) / max(n, 1)))))
    return terms.join(part, "term").groupBy("query_id", "chunk_id").agg(F.sum("w").alias("bm25"))


def _rank(*by):
    return F.row_number().over(Window.partitionBy("query_id").orderBy(*by))


def snippet(text, size: int = 500):
    """The first ``size`` characters, with dots where more follow."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def select_topk(scores: DataFrame, top_k: int = 8) -> DataFrame:
    rank = _rank(F.round("score", 9).desc(), "chunk_id")
    return scores.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def select_diverse(scores: DataFrame, chunks: DataFrame, top_k: int = 8) -> DataFrame:
    """At most max(1, top_k // 2) chunks of a document, then the best top_k."""
    cap = max(1, top_k // 2)
    own = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.round("score", 9).desc(), "chunk_id"))
    kept = scores.join(chunks.select("chunk_id", "doc_id"), "chunk_id").withColumn("own", own).filter(F.col("own") <= cap)
    return select_topk(kept.drop("own"), top_k)


def structural_neighbors(seeds: DataFrame, chunks: DataFrame, half_size: int = 2) -> DataFrame:
    """``<seed columns>, member_id, m_doc, m_pos``: chunks within ``half_size`` places in the same document and group. An equi-join on exploded places, not a range join."""
    place = chunks.select(F.col("chunk_id").alias("seed_id"), "doc_id", "position", "structural_group")
    reach = seeds.join(place, seeds["chunk_id"] == F.col("seed_id")).withColumn("m_pos", F.explode(F.sequence(F.col("position") - half_size, F.col("position") + half_size)))
    member = chunks.select(F.col("chunk_id").alias("member_id"), F.col("doc_id").alias("m_doc"), F.col("position").alias("p"), F.col("structural_group").alias("m_group"))
    hit = reach.join(member, (F.col("doc_id") == F.col("m_doc")) & (F.col("m_pos") == F.col("p")) & ((F.col("structural_group") == F.col("m_group")) & (F.col("m_group") >= 0) | (F.col("seed_id") == F.col("member_id"))))
    return hit.select(*[seeds[c] for c in seeds.columns], "member_id", "m_doc", "m_pos")


def select_windows(scores: DataFrame, chunks: DataFrame, top_k: int = 8, half_size: int = 2) -> DataFrame:
    """``query_id, rank, score, members``: the best max(3 top_k, 20) chunks widened to windows, equal windows once, scored by mean plus coherence."""
    seeds = select_topk(scores, max(3 * top_k, 20)).select("query_id", "chunk_id", "rank")
    return ranked_windows(seeds, scores, chunks, top_k, half_size)


def scored_windows(seeds: DataFrame, scores: DataFrame, chunks: DataFrame, half_size: int = 2) -> DataFrame:
    """``query_id, chunk_id, rank, members, score``: the window of each of ``seeds(query_id, chunk_id, rank)``; ``scores`` hold at least those of the windows' chunks."""
    wide = structural_neighbors(seeds, chunks, half_size)
    own = wide.join(scores.select("query_id", F.col("chunk_id").alias("member_id"), "score"), ["query_id", "member_id"], "left")
    return own.groupBy("query_id", "chunk_id", "rank").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("m_doc").cast("string").alias("d"), F.col("m_pos").alias("p"), "member_id"))), lambda x: x["member_id"]).alias("members"),
        (F.avg(F.coalesce("score", F.lit(0.0))) + 0.1 * F.when(F.countDistinct("m_doc") > 1, 0.5).otherwise(1.0)).alias("score"),
    )


def ranked_windows(seeds: DataFrame, scores: DataFrame, chunks: DataFrame, top_k: int = 8, half_size: int = 2) -> DataFrame:
    """``query_id, rank, score, members`` of the best windows, equal ones once."""
    windows = scored_windows(seeds, scores, chunks, half_size)
    once = windows.withColumn("key", F.array_sort("members")).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("rank"))).filter("n = 1")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("rank")))
    return once.select("query_id", order.alias("place"), F.col("score"), "members").filter(F.col("place") <= top_k).withColumnRenamed("place", "rank")


def path_steps(walks: DataFrame, topics: DataFrame) -> DataFrame:
    """``query_id, step, topic_id, level, parent_id`` along each path."""
    t = topics.select("topic_id", "level", F.get("parent_ids", F.lit(0)).alias("parent_id"))
    return walks.select("query_id", F.posexplode("path").alias("step", "topic_id")).join(t, "topic_id", "left").select("query_id", "step", "topic_id", "level", "parent_id")


def chunks_by_step(walks: DataFrame, topic_chunk: DataFrame) -> DataFrame:
    """``query_id, step, topic_id, chunk_id, weight``: the chunks of each visited topic with the weight of their link (1 where it has none)."""
    steps = walks.select("query_id", F.posexplode("path").alias("step", "topic_id"))
    return steps.join(topic_chunk, "topic_id").select("query_id", "step", "topic_id", "chunk_id", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def chunks_along_path(walks: DataFrame, topic_chunk: DataFrame) -> DataFrame:
    """``query_id, chunk_id, step``: chunks of the visited topics, each at its first step."""
    steps = walks.select("query_id", F.posexplode("path").alias("step", "topic_id")).groupBy("query_id", "topic_id").agg(F.min("step").alias("step"))
    return steps.join(topic_chunk, "topic_id").groupBy("query_id", "chunk_id").agg(F.min("step").alias("step"))
