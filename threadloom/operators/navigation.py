"""Intent, prior, relations, policy and walks over the topic graph, for batches of queries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.vectors import unit
from . import graph

#: Moves (and Markov transitions) up to which they are sent to every task; beyond it, ``walk_joined`` joins queries with their moves step by step.
MOVES_LIMIT = 2_000_000


def keyword_prior(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """``query_id, topic_id, p``: hits of lower-cased query terms (repeats count) on ``keywords(topic_id, term)``, normalised over topics."""
    terms = queries.select("query_id", F.explode(F.split(F.trim(F.lower("text")), r"(?U)\s+")).alias("term")).filter("term <> ''")
    hits = terms.join(keywords.groupBy("topic_id", "term").agg(F.count(F.lit(1)).alias("c")), "term").groupBy("query_id", "topic_id").agg(F.sum("c").alias("c"))
    return hits.select("query_id", "topic_id", (F.col("c") / F.sum("c").over(Window.partitionBy("query_id"))).alias("p"))


def query_prior(*priors: DataFrame) -> DataFrame:
    """Positive parts of several priors added and renormalised."""
    every = priors[0].filter("p > 0")
    for p in priors[1:]:
        every = every.unionByName(p.filter("p > 0"))
    total = every.groupBy("query_id", "topic_id").agg(F.sum("p").alias("p"))
    return total.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("query_id")))


def uniform_prior(queries: DataFrame, topics: DataFrame) -> DataFrame:
    """``query_id, topic_id, p, start``: equal shares of all topics; the start is the first by (level, id). For models without embeddings."""
    n = topics.count()
    first = topics.orderBy("level", "topic_id").head()
    names = [r["topic_id"] for r in topics.select("topic_id").orderBy("topic_id").collect()]
    each = F.explode(F.array(*[F.lit(t) for t in names])) if names else F.explode(F.array().cast("array<string>"))
    return queries.select("query_id", each.alias("topic_id")).select("query_id", "topic_id", F.lit(1.0 / n if n else 0.0).alias("p"), F.lit(first["topic_id"] if first else None).alias("start"))


def start_nodes(prior: DataFrame, queries: DataFrame, topics: DataFrame) -> DataFrame:
    """``query_id, intent, start``: the best leaf; for deepen its first parent with children, else its first parent. Neutral starts at the best leaf as well."""
    best = prior.groupBy("query_id").agg(F.min(F.struct((-F.round("p", 9)).alias("n"), "topic_id"))["topic_id"].alias("leaf"))
    up = graph.parents(topics).groupBy("topic_id").agg(F.min(F.struct("nth", "parent_id"))["parent_id"].alias("parent"))
    rows = queries.join(best, "query_id").join(up, F.col("leaf") == F.col("topic_id"), "left")
    return rows.select("query_id", "intent", F.when((F.col("intent") == "deepen") & F.col("parent").isNotNull(), F.col("parent")).otherwise(F.col("leaf")).alias("start"))


def relations(topics: DataFrame, edges: DataFrame) -> DataFrame:
    """``i, k, relation, weight`` of every candidate move: parents, children, siblings and topic neighbours, each pair under its first relation."""
    near = edges.filter(F.col("kind").isin("topic-topic", "topic-related")).select(F.col("src").alias("i"), F.col("dst").alias("k"), F.lit(3).alias("rank"), F.lit("semantic_neighbor").alias("relation"), "weight")
    up = graph.parents(topics)
    rows = (
        up.select(F.col("topic_id").alias("i"), F.col("parent_id").alias("k"), F.lit(0).alias("rank"), F.lit("parent").alias("relation"), F.lit(None).cast("double").alias("weight"))
        .union(up.select("parent_id", "topic_id", F.lit(1), F.lit("child"), F.lit(None).cast("double")))
        .union(graph.siblings(topics).select("topic_id", "sibling_id", F.lit(2), F.lit("sibling"), F.lit(None).cast("double")))
        .union(near)
    )
    return rows.groupBy("i", "k").agg(F.min(F.struct("rank", "relation"))["relation"].alias("relation"), F.max("weight").alias("weight"))


def r_intent(moves: DataFrame, clarify: float = 0.7) -> DataFrame:
    """``intent, i, k, relation, weight, r`` for the six intents: 1 where the relation is what the intent seeks, 0.5 for apply on distant pairs, else 0."""
    rel, wanted = F.col("relation"), {"deepen": "child", "broaden": "parent", "compare": "sibling", "apply": "semantic_neighbor"}
    r = None
    for intent, relation in wanted.items():
        hit = (F.col("intent") == intent) & (rel == relation)
        r = F.when(hit, 1.0) if r is None else r.when(hit, 1.0)
    r = r.when((F.col("intent") == "clarify") & (rel == "semantic_neighbor") & (F.coalesce("weight", F.lit(-9.0)) >= clarify), 1.0)
    r = r.when((F.col("intent") == "apply") & (rel == "distant_related"), 0.5).otherwise(0.0)
    six = F.explode(F.array(*[F.lit(x) for x in ("deepen", "broaden", "compare", "apply", "clarify", "neutral")]))
    return moves.select(six.alias("intent"), "i", "k", "relation", "weight").withColumn("r", r)


def filtered_moves(topics: DataFrame, moves: DataFrame, clarify: float = 0.7) -> DataFrame:
    """``intent, i, k, tier, r``: candidates of the lowest tier that any candidate of (intent, i) reaches.

    Deepen at a leaf may jump to a parent's sibling with children, which need not be a candidate.
    """
    parent_of = graph.parents(topics).select("topic_id", "parent_id")
    fertile = parent_of.select(F.col("parent_id").alias("f")).distinct()
    level = topics.select(F.col("topic_id").alias("t"), F.col("level"))
    m = r_intent(moves, clarify).join(fertile, F.col("k") == F.col("f"), "left").join(level.select(F.col("t").alias("ti"), F.col("level").alias("li")), F.col("i") == F.col("ti"), "left")
    m = m.join(level.select(F.col("t").alias("tk"), F.col("level").alias("lk")), F.col("k") == F.col("tk"), "left")
    rel, has = F.col("relation"), F.col("f").isNotNull()
    tier = (
        F.when(F.col("intent") == "neutral", 0)
        .when(F.col("intent") == "deepen", F.when(rel == "child", 0).when((rel == "sibling") & has, 1).when((rel == "parent") & has, 3).when(rel == "parent", 4).otherwise(9))
        .when(F.col("intent") == "broaden", F.when(rel == "parent", 0).when(rel == "sibling", 1).when(F.col("lk") <= F.col("li"), 2).otherwise(9))
        .when(F.col("intent") == "compare", F.when(rel == "sibling", 0).when(rel.isin("child", "parent"), 1).otherwise(9))
        .otherwise(F.when((rel == "semantic_neighbor") & ((F.col("intent") == "apply") | (F.col("weight") >= clarify)), 0).when(rel == "sibling", 1).otherwise(9))
    )
    rows = m.select("intent", "i", "k", tier.alias("tier"), "r")
    uncle = (
        parent_of.join(graph.siblings(topics).select(F.col("topic_id").alias("parent_id"), F.col("sibling_id").alias("k")), "parent_id").join(fertile, F.col("k") == F.col("f"))
        .select(F.lit("deepen").alias("intent"), F.col("topic_id").alias("i"), "k", F.lit(2).alias("tier"), F.lit(0.0).alias("r")).distinct()
    )
    rows = rows.union(uncle).groupBy("intent", "i", "k").agg(F.min("tier").alias("tier"), F.max("r").alias("r"))
    low = F.min("tier").over(Window.partitionBy("intent", "i"))
    return rows.withColumn("low", low).filter("tier = low").drop("low")


@dataclass
class MoveTable:
    """Moves grouped by (intent, topic), and unit centroids, for walks in tasks."""

    topics: list[str]
    unit: np.ndarray
    moves: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]
    markov: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def move_table(topics: DataFrame, allowed: DataFrame, markov: DataFrame | None = None) -> MoveTable:
    """Collected for the tasks. ValueError beyond ``MOVES_LIMIT``: ``walks`` then takes the joined way."""
    found = allowed.select("intent", "i", "k", "r").limit(MOVES_LIMIT + 1).collect()
    links = markov.select("i", "j", "k", "p").limit(MOVES_LIMIT + 1).collect() if markov is not None else []
    if max(len(found), len(links)) > MOVES_LIMIT:
        raise ValueError(f"more than {MOVES_LIMIT} moves: use walk_joined")
    rows = topics.select("topic_id", "centroid").orderBy("topic_id").collect()
    names = [r["topic_id"] for r in rows]
    dim = max((len(r["centroid"] or ()) for r in rows), default=0)
    m = unit(np.array([r["centroid"] if r["centroid"] is not None else [0.0] * dim for r in rows], np.float64).reshape(len(rows), dim))
    at = {t: k for k, t in enumerate(names)}
    moves: dict = {}
    for r in found:
        if r["i"] in at and r["k"] in at:
            moves.setdefault((r["intent"], at[r["i"]]), []).append((at[r["k"]], r["r"]))
    pack = lambda pairs: tuple(np.array(x) for x in zip(*sorted(pairs)))
    chain: dict = {}
    for r in links:
        if all(r[c] in at for c in "ijk"):
            chain.setdefault((at[r["i"]], at[r["j"]]), []).append((at[r["k"]], r["p"]))
    return MoveTable(names, m, {k: pack(v) for k, v in moves.items()}, {k: pack(v) for k, v in chain.items()})


def scores(table: MoveTable, s: Settings, intent: str, path: list[int], toward: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of the last topic of ``path`` and their policy scores."""
    i = path[-1]
    if (intent, i) not in table.moves:
        return np.zeros(0, int), np.zeros(0)
    k, r = table.moves[intent, i]
    seen = np.array([path.count(x) for x in k])
    value = s.navigation_alpha * toward[k] + s.navigation_beta * (table.unit[k] @ table.unit[i]) + s.navigation_gamma * r + s.navigation_prior_weight * prior[k]
    value += np.where(seen == 0, s.navigation_novelty_bonus, 0) - s.navigation_delta * seen**2
    if len(path) > 1:
        value = value - np.where(k == path[-2], s.navigation_backtrack_penalty, 0)
    return k, value


def uniform_draw(seed: int, query, step: int, topic: str) -> float:
    """A number in (0, 1) from the first 48 bits of a hash: the same under any partitioning, and in SQL."""
    return (int(hashlib.md5(f"{seed}|{query}|{step}|{topic}".encode()).hexdigest()[:12], 16) + 0.5) / 2.0**48


Policy = Callable[["MoveTable", Settings, str, list, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Draw = Callable[[int, object, int, str], float]


def walk_one(table: MoveTable, s: Settings, query, intent: str, start: int, toward: np.ndarray, prior: np.ndarray, steps: int, policy: Policy = scores, draw: Draw = uniform_draw) -> list[int]:
    """One path. Greedy takes the best of (rounded score, id); else a draw by the Gumbel trick from ``draw(seed, query, step, topic)``.

    With an exploration factor, a step whose draw under the name "" falls below it takes any candidate alike."""
    path = [start] if steps > 0 else []
    while 0 < len(path) < steps:
        k, value = policy(table, s, intent, path, toward, prior)
        if not len(k):
            break
        logit = value / max(s.navigation_temperature, 1e-9)
        if s.transition_policy_mix_eta < 1 and len(path) >= 3:
            e = np.exp(logit - logit.max())
            mixed = dict(zip(k.tolist(), s.transition_policy_mix_eta * e / e.sum()))
            for t, p in zip(*table.markov.get((path[-2], path[-1]), ((), ()))):
                mixed[int(t)] = mixed.get(int(t), 0.0) + (1 - s.transition_policy_mix_eta) * float(p)
            k = np.array(sorted(mixed))
            value = np.array([mixed[t] for t in k]) / sum(mixed.values())
            logit = np.log(np.maximum(value, 1e-300))
        if s.navigation_greedy:
            best = int(k[np.argmax(np.round(value, 9))])
        else:
            noise = [-np.log(-np.log(draw(s.seed, query, len(path), table.topics[t]))) for t in k]
            if s.exploration_factor and draw(s.seed, query, len(path), "") < s.exploration_factor:
                logit = np.zeros(len(k))
            best = int(k[np.argmax(np.round(logit + noise, 9))])
        path.append(best)
    return path


def walk(queries: DataFrame, table: MoveTable, settings: Settings, steps: int, policy: Policy = scores, draw: Draw = uniform_draw) -> DataFrame:
    """``query_id, intent, path``. ``queries(query_id, intent, start, vector, prior)`` with ``prior array<struct<topic_id, p>>``; vector and prior may be null.

    A step depends on the whole path so far, so walks run on Arrow batches, one query after another, with the graph's moves
    at hand, sent once to each executor. ``policy`` may replace the scoring of candidates, ``draw`` the random numbers.
    """
    shared = queries.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table = shared.value
        at = {t: k for k, t in enumerate(table.topics)}
        for batch in batches:
            paths = []
            for q, intent, start, vector, prior in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if start not in at:
                    paths.append([])
                    continue
                v = np.array(vector or np.zeros(table.unit.shape[1]), np.float64)
                n = np.sqrt(v @ v)
                p = np.zeros(len(table.topics))
                for d in prior or ():
                    if d["topic_id"] in at:
                        p[at[d["topic_id"]]] = d["p"]
                found = walk_one(table, settings, q, intent, at[start], table.unit @ v / (n if n else 1), p, steps, policy, draw)
                paths.append([table.topics[t] for t in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.list_(pa.string()))], names=["query_id", "intent", "path"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "intent", "start", "vector", "prior").mapInArrow(run, f"query_id {kind}, intent string, path array<string>")


def walk_joined(queries: DataFrame, topics: DataFrame, allowed: DataFrame, settings: Settings, steps: int, markov: DataFrame | None = None) -> DataFrame:
    """``query_id, intent, path`` as ``walk`` gives them, for a graph of any size: each step joins the queries with the moves of their topic.

    A step is staged, so lineage stays short. Candidates of a query are pre-aggregated to the best one; a hot topic's
    moves repeat for each query that is there, and adaptive execution splits them.
    """
    from ..functions.vectors import cosine
    from ..sources.staging import stage

    s = settings
    centre = topics.select(F.col("topic_id").alias("k"), F.col("centroid").alias("ck"))
    here = topics.select(F.col("topic_id").alias("i"), F.col("centroid").alias("ci"))
    prior = queries.select("query_id", F.explode("prior").alias("d")).select("query_id", F.col("d.topic_id").alias("k"), F.col("d.p").alias("prior"))
    near = allowed.select("intent", "i", "k", "r").join(centre, "k").join(here, "i").select("intent", "i", "k", "r", "ck", F.coalesce(cosine(F.col("ci"), F.col("ck")), F.lit(0.0)).alias("close"))
    asked = queries.join(topics.select(F.col("topic_id").alias("start")), "start", "left_semi").select("query_id", "intent", "vector", F.array("start").alias("path"))
    done = queries.join(topics.select(F.col("topic_id").alias("start")), "start", "left_anti").select("query_id", "intent", F.array().cast("array<string>").alias("path"))
    if steps <= 0:
        return queries.select("query_id", "intent", F.array().cast("array<string>").alias("path"))
    live = stage(asked, "walks")
    for step in range(1, steps):
        now = live.withColumn("i", F.element_at("path", -1))
        seen = F.size(F.filter("path", lambda x: x == F.col("k")))
        value = (
            s.navigation_alpha * F.coalesce(cosine(F.col("ck"), F.col("vector")), F.lit(0.0)) + s.navigation_beta * F.col("close") + s.navigation_gamma * F.col("r")
            + s.navigation_prior_weight * F.coalesce("prior", F.lit(0.0)) + F.when(seen == 0, s.navigation_novelty_bonus).otherwise(0.0) - s.navigation_delta * seen * seen
        )
        if step > 1:
            value = value - F.when(F.element_at("path", -2) == F.col("k"), s.navigation_backtrack_penalty).otherwise(0.0)
        found = now.join(near, ["intent", "i"]).join(prior, ["query_id", "k"], "left").withColumn("value", value)
        found = found.select("query_id", "k", "value", (F.col("value") / max(s.navigation_temperature, 1e-9)).alias("logit"))
        if s.transition_policy_mix_eta < 1 and step >= 3 and markov is not None:
            each = Window.partitionBy("query_id")
            soft = found.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(each)))
            soft = soft.select("query_id", "k", (s.transition_policy_mix_eta * F.col("e") / F.sum("e").over(each)).alias("a"))
            pairs = now.join(soft.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.element_at("path", -2).alias("h"), F.col("i").alias("j"))
            chain = pairs.join(markov.select(F.col("i").alias("h"), "j", "k", ((1 - s.transition_policy_mix_eta) * F.col("p")).alias("b")), ["h", "j"]).join(centre.select("k"), "k", "left_semi").select("query_id", "k", "b")
            mixed = soft.join(chain, ["query_id", "k"], "full_outer").select("query_id", "k", (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("m"))
            mixed = mixed.withColumn("value", F.col("m") / F.sum("m").over(each))
            found = mixed.select("query_id", "k", "value", F.ln(F.greatest("value", F.lit(1e-300))).alias("logit"))
        if s.navigation_greedy:
            goal = F.round("value", 9)
        else:
            u = lambda topic: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(s.seed)), F.col("query_id").cast("string"), F.lit(str(step)), topic)), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48
            logit = F.when(u(F.lit("")) < s.exploration_factor, 0.0).otherwise(F.col("logit")) if s.exploration_factor else F.col("logit")
            goal = F.round(logit - F.ln(-F.ln(u(F.col("k")))), 9)
        best = found.groupBy("query_id").agg(F.min(F.struct((-goal).alias("goal"), "k"))["k"].alias("k"))
        moved = live.join(best, "query_id", "left")
        staged = stage(moved.withColumn("path", F.when(F.col("k").isNull(), F.col("path")).otherwise(F.concat("path", F.array("k")))), "walks")
        done = done.union(staged.filter("k is null").select("query_id", "intent", "path"))
        live = staged.filter("k is not null").select("query_id", "intent", "vector", "path")
        if live.isEmpty():
            break
    return done.union(live.select("query_id", "intent", "path"))


def walks(queries: DataFrame, topics: DataFrame, allowed: DataFrame, settings: Settings, steps: int, markov: DataFrame | None = None, policy: Policy = scores, draw: Draw = uniform_draw) -> DataFrame:
    """``walk`` where the moves fit a task, else ``walk_joined``: the same paths either way. A policy or draw of one's own needs the former."""
    try:
        table = move_table(topics, allowed, markov)
    except ValueError:
        if policy is not scores or draw is not uniform_draw:
            raise
        return walk_joined(queries, topics, allowed, settings, steps, markov)
    return walk(queries, table, settings, steps, policy, draw)


def first_scores(queries: DataFrame, table: MoveTable, settings: Settings) -> DataFrame:
    """``query_id, k, score, p`` of the first step of each query: policy scores and their max-shifted softmax."""
    at = {t: k for k, t in enumerate(table.topics)}

    def run(batches):
        for batch in batches:
            rows = []
            for q, intent, start, vector, prior in zip(*(batch.column(c).to_pylist() for c in range(5))):
                v = np.array(vector, np.float64)
                p = np.zeros(len(table.topics))
                for d in prior or ():
                    p[at[d["topic_id"]]] = d["p"]
                k, value = scores(table, settings, intent, [at[start]], table.unit @ v / np.sqrt(v @ v), p)
                if len(k):
                    e = np.exp((value - value.max()) / settings.navigation_temperature)
                    rows += [(q, table.topics[t], float(x), float(y)) for t, x, y in zip(k, value, e / e.sum())]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.float64()))], names=["query_id", "k", "score", "p"])

    return queries.select("query_id", "intent", "start", "vector", "prior").mapInArrow(run, "query_id long, k string, score double, p double")


def blend_distributions(policy: DataFrame, markov: DataFrame, eta: float) -> DataFrame:
    """``grp, k, p``: eta * policy + (1 - eta) * markov over both supports, renormalised."""
    both = policy.withColumnRenamed("p", "p0").join(markov.withColumnRenamed("p", "p1"), ["grp", "k"], "full_outer")
    raw = F.coalesce("p0", F.lit(0.0)) * eta + F.coalesce("p1", F.lit(0.0)) * (1 - eta)
    return both.withColumn("raw", raw).withColumn("p", F.col("raw") / F.sum("raw").over(Window.partitionBy("grp"))).filter("p > 0").select("grp", "k", "p")
