"""The client: build an index over a corpus, query it in batches, explain, save and load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions.text import intent_of
from .functions.vectors import cosine
from .operators import chunking, graph, markov, navigation, retrieval, topics
from .operators.model import ClusterModel, GivenModel, TopicModel
from .schema import INTENTS, one_of
from .sources.staging import stage
from .sources.store import load_index, save_index
from .sources.vectors import EmbeddingProvider, HashingProvider

#: Queries of a batch up to which their vectors are broadcast.
BATCH = 50_000
#: Nearest stored chunks of a query that a provider is asked for when it reranks.
CANDIDATES = 512


class TopicGraph:
    """An index over one corpus. ``query`` takes one text; ``query_df`` a table of them, which is the unit of work.

    ``topic_model`` replaces clustering, ``provider`` makes the vectors (and may keep the chunks), ``policy`` and ``draw`` replace the
    scoring of moves and the random numbers of walks.
    """

    def __init__(self, spark: SparkSession, settings: Settings | None = None, provider: EmbeddingProvider | None = None, topic_model: TopicModel | None = None,
                 policy: navigation.Policy = navigation.scores, draw: navigation.Draw = navigation.uniform_draw):
        self.spark, self.settings, self.provider = spark, settings or Settings(), provider or HashingProvider()
        self.model, self.policy, self.draw = topic_model, policy, draw
        self.tables: dict[str, DataFrame] = {}
        self._explanation: dict | None = None

    def attach(self, provider: EmbeddingProvider) -> None:
        """Another provider, as after loading."""
        self.provider = provider

    # -- building --------------------------------------------------------------------------------
    def build_index(self, corpus, chunker=None, topic_table: DataFrame | None = None, n_coarse: int | None = None, n_fine: int | None = None) -> TopicGraph:
        """``corpus``: a table (doc_id, text) or a list of texts, numbered in order. ``chunker`` maps it to chunks; ``topic_table`` is a ready model."""
        s = self.settings
        if n_coarse is not None or n_fine is not None:
            s = s.with_(n_coarse=n_coarse or s.n_coarse, n_fine=n_fine or s.n_fine)
        if not isinstance(corpus, DataFrame):
            corpus = self.spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
        parts = (chunker or chunking.paragraph_sentence_chunks)(corpus)
        if "structural_group" not in parts.columns:
            parts = parts.withColumn("structural_group", F.lit(None).cast("long"))
        parts = parts.withColumn("chunk_id", F.concat_ws(":", F.col("doc_id"), F.col("position")))
        chunks = stage(self.provider.embed(parts).withColumn("v", F.col("v").cast("array<double>")), "chunks")
        if chunks.isEmpty():
            raise ValueError("no topic hierarchy: the corpus has no text")
        if self.provider.stores:
            self.provider.upsert_chunks(chunks)
        if topic_table is not None:
            self.model = GivenModel(topic_table)
        self.model = self.model or ClusterModel(s)
        t = self.model.fit(chunks)
        dist = stage(self.model.transform(chunks.select("chunk_id", "v")), "distribution")
        links = stage(topics.chunk_edges(topics.top_topics(dist, s.topic_chunk_top_m, s.topic_chunk_min_prob), t, s.topic_chunk_ancestor_decay), "links")
        near = topics.knn(t, s.neighbor_top_k, s.neighbor_min_cosine).select("src", "dst", F.lit("topic-topic").alias("kind"), "weight")
        edges = (
            graph.subtopic_edges(t)
            .unionByName(links.select(F.col("topic_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("topic-chunk").alias("kind"), "weight"))
            .unionByName(graph.structural_edges(chunks))
            .unionByName(near)
        )
        seq = markov.topic_sequences(dist, chunks.select("chunk_id", "doc_id", "position", "structural_group"))
        one, two = markov.fit(seq, 0.3)
        self.tables = {"chunks": chunks, "topics": t, "edges": stage(edges, "edges"), "trans1": stage(one, "trans1"), "trans2": stage(two, "trans2")}
        return self

    def keywords(self, topic_id: str, top_k: int = 10) -> list[str]:
        """The best terms of a topic."""
        self._need()
        row = self.tables["topics"].filter(F.col("topic_id") == topic_id).select(F.slice("keywords", 1, max(1, top_k)).alias("k")).first()
        return list(row["k"] or []) if row is not None else []

    # -- querying --------------------------------------------------------------------------------
    def _need(self) -> None:
        if not self.tables:
            raise RuntimeError("no index: call build_index or load first")

    def _prepared(self, queries: DataFrame) -> DataFrame:
        """``query_id, text, intent, vector, start, prior, weighed``. A query without a vector, or with one that meets no topic, starts at the first topic with equal shares of all."""
        t = self.tables["topics"]
        q = queries.withColumn("intent", F.coalesce("intent", intent_of(F.col("text"))))
        q = stage(self.provider.embed(q).select("query_id", "text", "intent", F.col("v").cast("array<double>").alias("vector")), "queries")
        lone = navigation.uniform_prior(q.select("query_id"), t)
        spread = lone.groupBy("query_id").agg(F.first("start").alias("first"), F.collect_list(F.struct("topic_id", "p")).alias("even"))
        if not self.provider.embeds:
            return q.join(spread, "query_id", "left").select("query_id", "text", "intent", "vector", F.col("first").alias("start"), F.col("even").alias("prior"))
        leaves = graph.leaves(t)
        leaf = topics.long_form(topics.leaf_distribution(q.filter("vector is not null").select("query_id", "vector"), leaves))
        terms = t.select("topic_id", F.explode("keywords").alias("term")).join(leaves.select("topic_id"), "topic_id", "left_semi")
        leaf = stage(navigation.query_prior(leaf, navigation.keyword_prior(q, terms)), "prior")
        rolled = topics.rollup(leaf, t).join(q.filter("intent <> 'neutral'").select("query_id"), "query_id", "left_semi")
        prior = rolled.unionByName(leaf.join(q.filter("intent = 'neutral'").select("query_id"), "query_id", "left_semi"))
        packed = prior.groupBy("query_id").agg(F.collect_list(F.struct("topic_id", "p")).alias("own"))
        ready = q.join(navigation.start_nodes(leaf, q.select("query_id", "intent"), t).select("query_id", F.col("start").alias("best")), "query_id", "left").join(packed, "query_id", "left").join(spread, "query_id", "left")
        return ready.select("query_id", "text", "intent", "vector", F.coalesce("best", "first").alias("start"), F.coalesce("own", "even").alias("prior"))

    def query_df(self, queries: DataFrame, steps: int | None = None) -> tuple[DataFrame, DataFrame]:
        """``(windows-ready scores, walks)`` of ``queries(query_id, text, intent)``; a null intent is read off the text."""
        self._need()
        s, t = self.settings, self.tables["topics"]
        q = stage(self._prepared(queries), "ready")
        self._ready = q
        few = q.count() <= BATCH
        moves = navigation.relations(t, self.tables["edges"])
        allowed = navigation.filtered_moves(t, moves, s.clarify_similarity_threshold)
        chain = markov.blend(self.tables["trans1"], self.tables["trans2"], s.smoothing_lambda, s.additive_alpha) if s.transition_policy_mix_eta < 1 else None
        walks = stage(navigation.walks(q, t, allowed, s, steps or s.max_steps, chain, self.policy, self.draw), "walks")
        links = self.tables["edges"].filter("kind = 'topic-chunk'").select(F.col("src").alias("topic_id"), F.col("dst").alias("chunk_id"), "weight")
        scores = retrieval.project(retrieval.visit_counts(walks), links)
        weights = (s.rerank_weight_topic, s.rerank_weight_cosine, s.rerank_weight_bm25)
        near = lexical = None
        if not self.provider.embeds:
            return scores, walks
        if s.rerank_weight_cosine > 0 and self.provider.stores:
            hits = self.provider.query_chunks(q.select("query_id", "text"), CANDIDATES)
            top = hits.groupBy("query_id").agg(F.max("score").alias("top"))
            near = hits.join(top, "query_id").select("query_id", F.col("id").alias("chunk_id"), F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("cosine"))
        elif s.rerank_weight_cosine > 0:
            vector = q.select("query_id", "vector")
            pairs = scores.join(self.tables["chunks"].select("chunk_id", "v"), "chunk_id").join(F.broadcast(vector) if few else vector, "query_id")
            near = pairs.select("query_id", "chunk_id", cosine(F.col("v"), F.col("vector")).alias("cosine"))
        if s.rerank_weight_bm25 > 0:
            lexical = retrieval.bm25(self.tables["chunks"].select("chunk_id", "text"), q.select("query_id", "text"))
        return retrieval.rerank(scores, near, lexical, weights, mapped=not self.provider.stores), walks

    def query(self, text: str, steps: int | None = None, top_k: int = 8, diversity: bool = True, path_trace: bool = False, intent=None, use_windows: bool = True) -> list[dict]:
        """Ranked windows ``{"rank", "score", "chunks": [{chunk_id, doc_id, position, text}]}`` for one text."""
        self._need()
        name = one_of(intent, INTENTS, "intent") if intent is not None else None
        one = self.spark.createDataFrame([(0, text, name)], "query_id long, text string, intent string")
        scores, walks = self.query_df(one, steps)
        scores = stage(scores, "scores")
        chunks = self.tables["chunks"]
        if use_windows:
            found = retrieval.select_windows(scores, chunks, top_k)
        else:
            picked = retrieval.select_diverse(scores, chunks, top_k) if diversity else retrieval.select_topk(scores, top_k)
            found = picked.select("query_id", "rank", "score", F.array("chunk_id").alias("members"))
        rows = found.select("rank", "score", F.posexplode("members").alias("n", "chunk_id")).join(chunks.select("chunk_id", "doc_id", "position", "text"), "chunk_id").orderBy("rank", "n").collect()
        out: dict[int, dict] = {}
        for r in rows:
            out.setdefault(r["rank"], {"rank": r["rank"], "score": r["score"], "chunks": []})["chunks"].append({c: r[c] for c in ("chunk_id", "doc_id", "position", "text")})
        self._explanation = self._explain(walks, path_trace)
        return list(out.values())

    def _explain(self, walks: DataFrame, path_trace: bool) -> dict:
        """Strategy, intent, prior, paths and path; traced also the steps, each with its chunks, and the chunks along the path, each at its first step."""
        head = walks.first()
        given = self._ready.first()
        info = {
            "strategy": "intent_conditioned", "intent": head["intent"], "prior": {d["topic_id"]: d["p"] for d in sorted(given["prior"] or (), key=lambda d: d["topic_id"])},
            "paths": [{"nodes": list(r["path"]), "steps": len(r["path"])} for r in walks.collect()], "path": list(head["path"]),
        }
        if path_trace:
            t = self.tables["topics"]
            links = self.tables["edges"].filter("kind = 'topic-chunk'").select(F.col("src").alias("topic_id"), F.col("dst").alias("chunk_id"), "weight")
            chunks = self.tables["chunks"].select("chunk_id", "doc_id", "position", retrieval.snippet(F.col("text")).alias("snippet"), F.col("v").alias("embedding"))
            shown: dict[int, list] = {}
            for r in retrieval.chunks_by_step(walks, links).join(chunks, "chunk_id").orderBy("step", F.col("weight").desc(), "chunk_id").collect():
                shown.setdefault(r["step"], []).append({c: r[c] for c in ("chunk_id", "doc_id", "position", "snippet", "weight", "embedding")})
            steps = retrieval.path_steps(walks, t).join(t.select("topic_id", "label", "keywords"), "topic_id").drop("query_id").orderBy("step").collect()
            info["path_steps"] = [{**r.asDict(), "chunks": shown.get(r["step"], [])} for r in steps]
            along: dict[str, dict] = {}
            for step in sorted(shown):
                for c in shown[step]:
                    along.setdefault(c["chunk_id"], {**c, "step": step})
            info["chunks_along_path"] = list(along.values())
        return info

    def explain(self, include_embeddings: bool = True) -> dict | None:
        """What the last query did; without embeddings if so asked."""
        if self._explanation is None or include_embeddings:
            return self._explanation
        strip = lambda x: {k: strip(v) for k, v in x.items() if k != "embedding"} if isinstance(x, dict) else [strip(v) for v in x] if isinstance(x, list) else x
        return strip(self._explanation)

    # -- storage ---------------------------------------------------------------------------------
    def save(self, path: str) -> None:
        self._need()
        save_index(path, self.tables, self.settings)

    @classmethod
    def load(cls, spark: SparkSession, path: str, provider: EmbeddingProvider | None = None) -> TopicGraph:
        tables, settings = load_index(spark, path)
        self = cls(spark, settings, provider)
        self.tables = tables
        return self
