"""Small exact fixtures: chunkers, graph, transitions, intents, walks, selection, client, store, streams."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from threadloom.client import TopicGraph
from threadloom.config import Settings
from threadloom.functions.text import intent_of
from threadloom.functions.vectors import cosine as vector_cosine
from threadloom.functions.vectors import cosines
from threadloom.operators import chunking, graph, markov, navigation, projection, retrieval, topics
from threadloom.plans.registry import QUERIES, r6
from threadloom.schema import one_of
from threadloom.sources import vectors
from threadloom.sources.store import load_index


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_settings_bounds():
    assert Settings().max_steps == 32 and Settings.debug_preset().max_steps == 5
    assert Settings.of(order=2, max_steps=3).max_steps == 3
    for bad in ({"smoothing_lambda": 1.5}, {"max_steps": 0}, {"navigation_temperature": 0}, {"neighbor_min_cosine": -2}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_fixed_windows(spark):
    docs = spark.createDataFrame([(0, "one two three four five"), (1, ""), (2, None)], "doc_id long, text string")
    assert rows(chunking.fixed_windows(docs, 3, 1), "doc_id", "position", "text") == [(0, 0, "one two three"), (0, 1, "three four five")]
    for w, o in ((0, 0), (3, -1), (3, 3)):
        with pytest.raises(ValueError):
            chunking.fixed_windows(docs, w, o)


def test_sentence_packing(spark):
    docs = spark.createDataFrame([(0, "A b c. D e! F?\n\nG h i j k. L."), (1, None)], "doc_id long, text string")
    got = rows(chunking.paragraph_sentence_chunks(docs, 5), "position", "text", "structural_group")
    assert got == [(0, "A b c. D e!", 0), (1, "F?", 0), (2, "G h i j k.", 1), (3, "L.", 1)]


def test_sections_and_positions(spark):
    docs = spark.createDataFrame([(3, "# Top\na b\n\nplain c\nOVERVIEW\nd e f g h")], "doc_id long, text string")
    assert rows(chunking.sections(docs), "section", "text") == [(0, "# Top\na b"), (1, "plain c"), (2, "OVERVIEW\nd e f g h")]
    got = rows(chunking.structure_aware_chunks(docs, 3, 1), "position", "structural_group")
    assert [p for p, _ in got] == list(range(len(got))) and {g for _, g in got} == {30000, 30001, 30002}


@pytest.fixture
def small(spark):
    t = spark.createDataFrame([("t:0", 1, [], [1.0, 0.0]), ("t:0.0", 2, ["t:0"], [0.9, 0.1]), ("t:0.1", 2, ["t:0"], [0.6, 0.8]), ("t:1", 1, [], [0.0, 1.0])], "topic_id string, level int, parent_ids array<string>, centroid array<double>")
    return t


def test_graph_algebra(spark):
    e = spark.createDataFrame([("t:0", "t:1", "topic-topic", 1.5), ("t:0", "t:1", "topic-topic", 0.5), ("t:0", "c:0", "topic-chunk", 1.0), ("k:kw", "t:0", "keyword-topic", 1.0)], "src string, dst string, kind string, weight double")
    n = spark.createDataFrame([("t:0", "topic"), ("t:1", "topic"), ("c:0", "chunk"), ("k:kw", "keyword")], "id string, kind string")
    full = graph.add_edges(e, n)
    assert dict(rows(graph.counts(n, full), "what", "n")) == {"node:topic": 2, "node:chunk": 1, "node:keyword": 1, "nodes": 4, "edges": 3}
    norm = {(s, d): w for s, d, w in rows(graph.normalize_edges(full), "src", "dst", "weight")}
    assert math.isclose(norm["t:0", "t:1"], 2 / 3) and math.isclose(norm["t:0", "c:0"], 1 / 3)
    assert graph.prune_edges(full, 1.5).count() == 1
    with pytest.raises(KeyError):
        graph.add_edges(e, n.filter("id <> 'c:0'"))
    nodes, _ = graph.from_records(n.filter("id <> 't:1'"), full)
    assert ("t:1", "topic") in rows(nodes, "id", "kind")


def test_hierarchy(small):
    assert rows(graph.siblings(small), "topic_id", "sibling_id") == [("t:0.0", "t:0.1"), ("t:0.1", "t:0.0")]
    assert rows(graph.ancestors(small), "topic_id", "ancestor_id", "hops") == [("t:0.0", "t:0", 1), ("t:0.1", "t:0", 1)]
    assert [r.topic_id for r in graph.leaves(small).orderBy("topic_id").collect()] == ["t:0.0", "t:0.1", "t:1"]


def test_ancestors_in_a_dag(spark):
    t = spark.createDataFrame([("a", 1, []), ("b", 2, ["a"]), ("c", 2, ["a", "b"]), ("d", 3, ["c"])], "topic_id string, level int, parent_ids array<string>")
    assert rows(graph.ancestors(t), "topic_id", "ancestor_id", "hops") == [("b", "a", 1), ("c", "a", 1), ("c", "b", 1), ("d", "a", 2), ("d", "b", 2), ("d", "c", 1)]


def test_dag_parents_stay_acyclic(spark):
    t = spark.createDataFrame([("t:0", 1, [], [1.0, 0.0]), ("t:1", 1, [], [1.0, 0.01])], "topic_id string, level int, parent_ids array<string>, centroid array<double>")
    got = {r.topic_id: r.parent_ids for r in topics.add_dag_parents(t, 0.5).collect()}
    assert got == {"t:0": ["t:1"], "t:1": []}


def test_leaf_distribution(spark, small):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    got = {r.id: {d.topic_id: d.p for d in r.dist} for r in topics.leaf_distribution(v, graph.leaves(small)).collect()}
    assert math.isclose(sum(got[1].values()), 1, abs_tol=1e-9) and max(got[1], key=got[1].get) == "t:0.0"
    assert all(math.isclose(p, 1 / 3) for p in got[2].values())


def test_top_topics_fall_back_to_the_best(spark):
    d = spark.createDataFrame([(1, [("a", 0.1), ("b", 0.1), ("c", 0.05)]), (2, [("a", 0.5), ("b", 0.4), ("c", 0.1)])], "id long, dist array<struct<topic_id: string, p: double>>")
    assert rows(topics.top_topics(d), "id", "topic_id") == [(1, "a"), (2, "a"), (2, "b")]


def test_kmeans_tree(spark):
    pts = [(k, [float(k % 2) * 10 + (k % 4) * 0.1, float(k % 4 // 2) * 3]) for k in range(40)]
    tree = topics.kmeans_tree(spark.createDataFrame(pts, "id long, v array<double>"), 2, 2, 2)
    ids = {r.topic_id: r for r in tree.collect()}
    assert {"t:0", "t:1", "t:0.0", "t:0.1"} <= set(ids) and all(r.parent_ids == ([] if r.level == 1 else [r.topic_id.rsplit(".", 1)[0]]) for r in ids.values())
    with pytest.raises(ValueError):
        topics.kmeans_tree(spark.createDataFrame([(1, [1.0])], "id long, v array<double>"))


def test_kmeans_tree_gives_every_cluster_starts(spark):
    """A small cluster beside a huge one, and a sample far below the rows: no cluster goes without centres."""
    pts = [(k, [float(k % 3), 0.5]) for k in range(3000)] + [(9000 + k, [100.0 + k % 3, 50.0]) for k in range(300)]
    tree = topics.kmeans_tree(spark.createDataFrame(pts, "id long, v array<double>"), 2, 2, 3, sample=20)
    ids = {r.topic_id: r for r in tree.collect()}
    assert sorted(r.members for r in ids.values() if r.level == 1) == [300, 3000]
    for r in ids.values():
        below = [c.members for c in ids.values() if c.parent_ids == [r.topic_id]]
        assert r.level == 3 or sum(below) == r.members
    twins = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(10)] + [(99, None)], "id long, v array<double>")
    assert [(r.topic_id, r.members) for r in topics.kmeans_tree(twins, 3, 2, 2).filter("level = 1").collect()] == [("t:0", 10)]


def test_kmeans_tree_starts_among_all_rows(spark):
    """Far more rows than a sample of 20,000 had: the one row farthest out still starts a cluster, whatever its hash."""
    near = spark.range(30_000).select("id", F.array(F.col("id") % 2 + 0.0, F.lit(0.0)).alias("v"))
    for far in (30_001, 30_002, 30_003):
        v = near.union(spark.createDataFrame([(far, [0.0, 50.0])], near.schema))
        assert sorted(r.members for r in topics.kmeans_tree(v, 2, 1, 1, rounds=1).collect()) == [1, 30_000]


def test_assign_ties_by_the_stated_digits(spark):
    """Two centres at distances that differ in the eighth digit only: a tie at six digits, the nearer one at nine."""
    c = spark.createDataFrame([("t:0.0", [1.00000002]), ("t:0.1", [-1.0])], "topic_id string, centroid array<double>")
    v = spark.createDataFrame([(1, [0.0])], "id long, v array<double>")
    assert [topics.assign(v, c, *d).first().topic_id for d in ((6,), ())] == ["t:0.0", "t:0.1"]


def test_keywords_fall_back_to_any_word(spark):
    m = spark.createDataFrame([("t:0", 1, "42 the 7"), ("t:0", 2, "42 9"), ("t:1", 3, None)], "topic_id string, doc_id long, text string")
    got = topics.keywords(m.filter("doc_id <> 1"))
    assert [r.term for r in got.orderBy("rank").collect()] == ["42", "9"]
    got = topics.keywords(m.unionByName(spark.createDataFrame([("t:0", 4, "words words")], m.schema)))
    assert [(r.topic_id, r.term) for r in got.collect()] == [("t:0", "words")]


def test_keywords_count_in_tasks_sized_by_bytes(spark, monkeypatch):
    """Texts go to tasks by their bytes, not by the session's number of partitions; frequencies of one need no lookup, joined or broadcast."""
    docs = spark.range(40).select(F.lit("t:0").alias("topic_id"), F.col("id").alias("doc_id"), F.concat(F.lit("same other "), F.repeat(F.lit("word "), F.col("id").cast("int")), F.lit("only"), F.chr(F.col("id") % 26 + 97)).alias("text"))
    monkeypatch.setattr(topics, "TEXT", 200, raising=False)
    got = topics.keywords(docs)
    assert "REPARTITION_BY_NUM" in (plan := got._jdf.queryExecution().executedPlan().toString()) and int(re.search(r"hashpartitioning\(doc_id[^)]*, (\d+)\), REPARTITION_BY_NUM", plan)[1]) > 10
    want = rows(got, "topic_id", "term", "score", "rank")
    monkeypatch.setattr(topics, "TERMS", 0)
    assert rows(topics.keywords(docs), "topic_id", "term", "score", "rank") == want


@pytest.mark.parametrize("name", ["chunk_structure_aware", "hash_embed"])
def test_texts_are_split_once(spark, name):
    """Tokens are made once for each text or section, however often they are used."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?U)\\s+") == 1


def test_sections_of_equal_ids_and_marks(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\nc"), (1, "d\x01\x02e\n1) f"), (2, None), (3, "")], "doc_id long, text string")
    assert rows(chunking.sections(docs), "doc_id", "section", "text") == [(1, 0, "a\nb"), (1, 0, "d\x01\x02e"), (1, 1, "1) f"), (1, 1, "c")]
    assert chunking.structure_aware_chunks(docs, 5, 1).count() == 4
    with pytest.raises(ValueError):
        chunking.structure_aware_chunks(docs, 0, 0)


def test_node_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([("a", "topic"), ("b", "topic")], "id string, kind string")
    new = spark.createDataFrame([("b", "chunk", 1), ("b", "keyword", 2), ("c", "chunk", 1)], "id string, kind string, at int")
    assert rows(graph.add_nodes(old, new, "at"), "id", "kind") == [("a", "topic"), ("b", "keyword"), ("c", "chunk")]


def test_blend(spark):
    seq = [(0, p, t) for p, t in enumerate("abcc")] + [(1, p, t) for p, t in enumerate("abd")]
    b = markov.blend(*markov.fit(spark.createDataFrame(seq, "doc_id int, pos int, topic_id string")), 0.5).filter("i = 'a' and j = 'b'")
    assert [(k, round(p, 9)) for k, p in rows(b, "k", "p")] == [("c", 0.5), ("d", 0.5)]
    with pytest.raises(ValueError):
        markov.blend(b, b, 1.5)


def test_structural_penalty(spark):
    s = spark.createDataFrame([(0, 0, "a", 1), (0, 1, "b", 1), (0, 2, "c", 2)], "doc_id int, pos int, topic_id string, grp int")
    one, two = markov.fit(s, 0.3)
    assert rows(one, "j", "k", "cnt") == [("a", "b", 1.0), ("b", "c", 0.3)] and rows(two, "cnt") == [(0.3,)]


def test_smoothing_entropy_rewards(spark):
    d = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 0.0)], "grp string, key string, c double")
    assert [round(p, 6) for (p,) in rows(markov.dirichlet_smoothing(d, 1.0, 2), "p")] == [0.25, 0.75]
    for call in (lambda: markov.additive_smoothing(d, -1), lambda: markov.temperature_rescale(d, 0), lambda: markov.dirichlet_smoothing(d, 1, 0)):
        with pytest.raises(ValueError):
            call()
    p = spark.createDataFrame([("g", "a", 0.25), ("g", "b", 0.75)], "grp string, key string, p double")
    assert math.isclose(markov.entropy(p).first().entropy, -(0.25 * math.log(0.25) + 0.75 * math.log(0.75)))
    sharp = dict(rows(markov.temperature_rescale(p, 0.5), "key", "p"))
    assert math.isclose(sharp["b"], 0.9)
    seq = spark.createDataFrame([(0, p, t) for p, t in enumerate("ijkk")], "doc_id int, pos int, topic_id string")
    f = markov.reward_factors(markov.reward_triples(seq, spark.createDataFrame([(0, 1.0)], "doc_id int, reward double")))
    assert ("i", "j", "k", 2.0) in rows(f, "i", "j", "k", "factor")


@pytest.mark.parametrize("text, intent", [("explain more about this", "deepen"), ("Tell  me more", "deepen"), ("give me an overview", "broaden"), ("how is this different", "compare"), ("a vs b", "compare"), ("transformer attention", "neutral"), ("", "neutral"), (None, "neutral")])
def test_intents(spark, text, intent):
    assert spark.createDataFrame([(text,)], "t string").select(intent_of(F.col("t")).alias("i")).first().i == intent
    assert one_of("Deepen", ("deepen",), "intent") == "deepen"
    with pytest.raises(ValueError):
        one_of("sideways", ("deepen",), "intent")


def test_keyword_prior(spark):
    q = spark.createDataFrame([(1, "Python ai"), (2, "none")], "query_id long, text string")
    k = spark.createDataFrame([("0", "python"), ("0", "ai"), ("1", "java")], "topic_id string, term string")
    assert rows(navigation.keyword_prior(q, k), "query_id", "topic_id", "p") == [(1, "0", 1.0)]


def test_walks(spark, small):
    edges = topics.knn(small).select("src", "dst", F.lit("topic-topic").alias("kind"), "weight")
    allowed = navigation.filtered_moves(small, navigation.relations(small, edges))
    table = navigation.move_table(small, allowed)
    q = spark.createDataFrame([(1, "deepen", "t:0", [1.0, 0.0], None), (2, "broaden", "t:0.1", None, None), (3, "compare", "t:0.0", [0.0, 1.0], [("t:1", 1.0)]), (4, "neutral", "gone", None, None)], "query_id long, intent string, start string, vector array<double>, prior array<struct<topic_id: string, p: double>>")
    greedy = Settings(navigation_greedy=True)
    paths = {r.query_id: r.path for r in navigation.walk(q, table, greedy, 3).collect()}
    assert paths[1][:2] == ["t:0", "t:0.0"] and paths[2][:2] == ["t:0.1", "t:0"] and paths[3][1] == "t:0.1" and paths[4] == []
    assert {r.query_id: r.path for r in navigation.walk(q.repartition(5), table, Settings(), 4).collect()} == {r.query_id: r.path for r in navigation.walk(q, table, Settings(), 4).collect()}
    assert all(len(r.path) <= 1 for r in navigation.walk(q, table, greedy, 1).collect())
    assert all(r.path == [] for r in navigation.walk(q, table, greedy, 0).collect())


def test_joined_walks_equal_walks_in_tasks(spark, small, monkeypatch):
    edges = topics.knn(small).select("src", "dst", F.lit("topic-topic").alias("kind"), "weight")
    allowed = navigation.filtered_moves(small, navigation.relations(small, edges))
    chain = spark.createDataFrame([("t:0", "t:0.0", "t:1", 0.9), ("t:0.0", "t:0.1", "t:1", 1.0), ("t:1", "t:0.1", "t:0", 0.4), ("t:0.1", "t:0", "t:1", 1.0)], "i string, j string, k string, p double")
    made = [(n, intent, start, v, prior) for n, (intent, start, v, prior) in enumerate(
        (i, t, v, p) for i in ("deepen", "broaden", "compare", "apply", "clarify", "neutral") for t in ("t:0", "t:0.1", "t:1", "gone") for v, p in (([1.0, 0.2], [("t:1", 0.5)]), (None, None)))]
    q = spark.createDataFrame(made, "query_id long, intent string, start string, vector array<double>, prior array<struct<topic_id: string, p: double>>")
    for s in (Settings(navigation_greedy=True), Settings(), Settings(transition_policy_mix_eta=0.5), Settings(exploration_factor=0.5, navigation_temperature=0.3)):
        want = rows(navigation.walk(q, navigation.move_table(small, allowed, chain), s, 5), "query_id", "path")
        assert rows(navigation.walk_joined(q, small, allowed, s, 5, chain), "query_id", "path") == want
    monkeypatch.setattr(navigation, "MOVES_LIMIT", 3)
    assert rows(navigation.walks(q, small, allowed, Settings(exploration_factor=0.5, navigation_temperature=0.3), 5, chain), "query_id", "path") == want
    with pytest.raises(ValueError):
        navigation.walks(q, small, allowed, Settings(), 5, draw=lambda *a: 0.5)


def test_a_policy_and_a_draw_of_ones_own(spark, small):
    edges = topics.knn(small).select("src", "dst", F.lit("topic-topic").alias("kind"), "weight")
    table = navigation.move_table(small, navigation.filtered_moves(small, navigation.relations(small, edges)))
    q = spark.createDataFrame([(1, "neutral", "t:0", [1.0, 0.0], None)], "query_id long, intent string, start string, vector array<double>, prior array<struct<topic_id: string, p: double>>")
    last = lambda table, s, intent, path, toward, prior: (k := table.moves[intent, path[-1]][0], k.astype(float))
    assert navigation.walk(q, table, Settings(navigation_greedy=True), 2, policy=last).first().path == ["t:0", "t:1"]
    assert len(navigation.walk(q, table, Settings(), 3, draw=lambda seed, query, step, topic: 0.5).first().path) == 3


def test_diversity_and_scores(spark):
    s = spark.createDataFrame([(0, f"c{k}", float(k)) for k in range(1, 7)], "query_id long, chunk_id string, score double")
    c = spark.createDataFrame([(f"c{k}", "doc1" if k <= 3 else "doc2") for k in range(1, 7)], "chunk_id string, doc_id string")
    got = retrieval.select_diverse(s, c, 4).collect()
    assert len(got) == 4 and len({r.doc_id for r in got}) == 2
    p = spark.createDataFrame([(0, ["a", "b", "a"], 5.0)], "query_id long, path array<string>, log_prob double")
    assert rows(retrieval.path_scores(p), "node", "score") == [("a", 2.0), ("b", 1.0)]


def _visited(spark):
    """Queries of equal and of different visits, and 60 chunks of 12 documents whose links tie often."""
    v = [(q, n, s) for q in range(9) for n, s in ((("a", 2.0), ("b", 1.0)), (("b", 3.0),), (("c", 1.0), ("a", 1.0), ("gone", 1.0)))[q % 3]]
    links = [(t, c, float(1 + c * k % 4)) for c in range(60) for k, t in enumerate("abc") if (c + k) % 3]
    return spark.createDataFrame(v, "query_id long, node string, score double"), spark.createDataFrame(links, "topic_id string, chunk_id long, weight double").repartition(5)


def _near(df):
    return sorted(tuple(round(x, 12) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in (r[c] for c in sorted(df.columns))) for r in df.collect())


def test_projection_equals_the_joined_way(spark):
    """Scores, mixes, first steps and selections made beside the chunks are those made of all pairs, whatever the batches."""
    visits, links = _visited(spark)
    vec = [(k, [math.sin(k + 1.0), math.cos(3.0 * k), 0.5]) for k in range(60)]
    chunks = spark.createDataFrame([(k, k // 5 % 7, k % 5, k // 3, v) for k, v in vec], "chunk_id long, doc_id long, position int, structural_group long, v array<double>")
    asked = spark.createDataFrame(vec[:9], "query_id long, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        want = retrieval.project(visits, links).cache()
        assert _near(projection.scores(visits, links)) == _near(want)
        cosine = asked.crossJoin(chunks.select("chunk_id", "v")).select("query_id", "chunk_id", vector_cosine(F.col("v"), F.col("vector")).alias("cosine"))
        assert _near(cosines(chunks.select("chunk_id", "v"), asked)) == _near(cosine)
        for mapped in (True, False):
            assert _near(projection.reranked(visits, links, chunks, asked, mapped=mapped)) == _near(retrieval.rerank(want, cosine, mapped=mapped))
        for k in (3, 8):
            assert _near(projection.topk(visits, links, k)) == _near(retrieval.select_topk(want, k))
            assert _near(projection.diverse(visits, links, chunks, k)) == _near(retrieval.select_diverse(want, chunks, k))
            assert _near(projection.windows(visits, links, chunks, k)) == _near(retrieval.select_windows(want, chunks, k))
        walks = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, [])], "query_id long, path array<string>")
        assert _near(projection.first_steps(walks, links)) == _near(retrieval.chunks_along_path(walks, links))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["explain_chunks_along_path", "rerank_hybrid", "rerank_backend", "chunk_projection", "cosine_pairs"])
def test_pairs_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0] and "MapInArrow" in plan


def test_cosine_pairs_leave_in_small_batches(spark, monkeypatch):
    """A batch of 60,000 rows against five queries: what leaves the task at a time is about 131,072 pairs, not all of them."""
    import numpy as np
    import pyarrow as pa

    made = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, kind: made.append(run) or spark.createDataFrame([], kind))
    QUERIES["cosine_pairs"](spark, "/root/testdata/sf0.001")
    v = np.random.default_rng(0).normal(size=(60_000, 64))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(60_000)), pa.ListArray.from_arrays(pa.array(np.arange(60_001) * 64, pa.int32()), pa.array(v.ravel()))], names=["chunk_id", "v"])
    assert max(b.nbytes for b in made[0]([batch])) <= 24 << 17


@pytest.mark.parametrize("name", ["window_score", "select_windows", "flagship", "select_diverse", "select_topk"])
def test_few_are_chosen_without_all_pairs(spark, monkeypatch, name):
    """No score of a query and chunk becomes a row but of what may be chosen."""
    from threadloom.plans.given import Given

    monkeypatch.setattr(Given, "scores", None)
    monkeypatch.setattr(retrieval, "project", None)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_six_digits_of_a_rounded_number(spark):
    """0.5047875 lies below its half as a double: SQL rounds it down."""
    assert spark.createDataFrame([(0.504787500,), (-0.504787500,), (0.0000005,), (-0.0000001,), (None,)], "x double").select(r6("x").alias("x")).collect() == [(0.504787,), (-0.504787,), (0.000001,) if 0.0000005 * 1e6 >= 0.5 else (0.0,), (0.0,), (None,)]


def test_nearest_rows_hold_few_pairs(spark):
    """Many queries against a batch of many rows, with ties at the edge; a task's numpy memory stays far below one number for each pair of the batch."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from threadloom.functions import vectors as fv

    class Rows:
        columns = ["id", "v"]

        def mapInArrow(self, run, kind):  # noqa: N802
            self.run = run
            raise StopIteration

    m = np.random.default_rng(0).integers(-2, 3, (3000, 4)).astype(float)
    q = spark.createDataFrame([(k, m[k].tolist()) for k in range(1500)], "query_id long, q array<double>")
    rows = Rows()
    with pytest.raises(StopIteration):
        fv.top_rows(rows, q, 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000, 0, -1)), pa.array(m.tolist())], names=["id", "v"])
    tracemalloc.start()
    got = {}
    for b in rows.run([batch]):
        for r in b.to_pylist():
            got.setdefault(r["query_id"], []).append((-r["cosine"], r["id"]))
    assert tracemalloc.get_traced_memory()[1] < 3000 * 1500 * 8 * 2
    tracemalloc.stop()
    u = fv.unit(m)
    for k in range(0, 1500, 100):
        score = np.round(u @ u[k], 9)
        assert sorted(got[k])[:3] == sorted(zip((-score).tolist(), range(3000, 0, -1)))[:3]


def test_vector_table(spark, tmp_path):
    table = vectors.VectorTable(spark, str(tmp_path / "v"))
    table.upsert(spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "y")], "chunk_id long, v array<double>, tag string"))
    table.upsert(spark.createDataFrame([(2, [1.0, 0.1], "y"), (3, [0.0, 2.0], "y")], "chunk_id long, v array<double>, tag string"))
    q = spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, q array<double>")
    assert [r.id for r in table.query(q, 2).orderBy("rank").collect()] == [3, 2]
    assert [r.id for r in table.query(q, 5, "tag = 'x'").collect()] == [1]


def test_vector_table_checks_and_repeats(spark, tmp_path):
    table = vectors.VectorTable(spark, f"file://{tmp_path}/v")
    with pytest.raises(RuntimeError):
        table.query(spark.createDataFrame([(9, [0.0])], "query_id long, q array<double>"), 1)
    kind = "chunk_id long, v array<double>, at int"
    table.upsert(spark.createDataFrame([(1, [1.0, 0.0], 5), (1, [0.0, 1.0], 7)], kind), order="at")
    table.upsert(spark.createDataFrame([(2, [1.0, 1.0], 1), (2, [1.0, 1.0], 1)], kind))
    table.upsert(spark.createDataFrame([], kind))
    assert rows(table.read(), "chunk_id", "v") == [(1, [0.0, 1.0]), (2, [1.0, 1.0])]
    for bad in ([(None, [1.0, 0.0], 1)], [(3, None, 1)], [(3, [1.0], 1)], [(3, [1.0, 2.0], 1), (4, [1.0], 1)]):
        with pytest.raises(ValueError):
            table.upsert(spark.createDataFrame(bad, kind))
    assert len(table._generations()) == 2
    with pytest.raises(ValueError):
        vectors.VectorTable(spark, "")


CORPUS = ["Cats purr softly. Cats sleep all day.\n\nDogs bark loudly. Dogs run in parks.", "Rockets fly to orbit. Fuel burns fast.\n\nPlanets turn around stars. Moons turn around planets.", "Bread needs flour. Ovens bake bread.\n\nSoup needs salt. Pots boil soup."]


def test_client_end_to_end(spark, tmp_path):
    client = TopicGraph(spark, Settings(navigation_greedy=True, max_steps=4))
    with pytest.raises(RuntimeError):
        client.query("x")
    with pytest.raises(ValueError):
        client.build_index([""])
    client.build_index(CORPUS, n_coarse=3, n_fine=2)
    found = client.query("tell me more about cats", top_k=3, path_trace=True)
    assert found and found[0]["score"] >= found[-1]["score"] and found[0]["chunks"][0]["text"]
    info = client.explain(include_embeddings=False)
    assert info["intent"] == "deepen" and len(info["path"]) <= 4 and "embedding" not in info["chunks_along_path"][0]
    assert math.isclose(sum(info["prior"].values()), 1) and info["paths"] == [{"nodes": info["path"], "steps": len(info["path"])}]
    first = info["path_steps"][0]
    assert first["chunks"] and {"weight", "snippet", "chunk_id"} <= set(first["chunks"][0]) and "embedding" in client.explain()["path_steps"][0]["chunks"][0]
    assert client.keywords(client.model.leaves().first().topic_id, 2) and client.model.parents("t:0.0") in ([], ["t:0"]) and client.model.coarse_centroid(0)
    client.save(str(tmp_path / "ix"))
    again = TopicGraph.load(spark, str(tmp_path / "ix"))
    assert again.query("tell me more about cats", top_k=3) == found and again.settings == client.settings
    with pytest.raises(FileNotFoundError):
        load_index(spark, str(tmp_path / "nowhere"))


def test_client_without_a_model_starts_evenly(spark):
    client = TopicGraph(spark, Settings(navigation_greedy=True, max_steps=3)).build_index(CORPUS, n_coarse=3, n_fine=2)
    client.attach(vectors.NoProvider())
    found = client.query("soup")
    info = client.explain()
    assert found and len(set(info["prior"].values())) == 1 and info["path"][0] == "t:0"


def test_client_with_stored_chunks_and_a_given_model(spark, tmp_path):
    from threadloom.operators.model import GivenModel, TopicModel

    table = vectors.VectorTable(spark, str(tmp_path / "v"))
    t = spark.createDataFrame([("t:0", 1, [], [1.0] * 16), ("t:0.0", 2, ["t:0"], [1.0] * 16), ("t:0.1", 2, ["t:0"], [-1.0] * 16)], "topic_id string, level int, parent_ids array<string>, centroid array<double>")
    client = TopicGraph(spark, Settings(navigation_greedy=True, max_steps=3), vectors.StoredProvider(vectors.HashingProvider(), table), GivenModel(t)).build_index(CORPUS)
    assert table.read().count() == client.tables["chunks"].count() == 6
    assert client.query("bread and ovens", top_k=2) and isinstance(client.model, TopicModel)
    scores, _ = client.query_df(spark.createDataFrame([(0, "Bread needs flour. Ovens bake bread.", "apply")], "query_id long, text string, intent string"))
    best = scores.orderBy(F.col("score").desc()).first()
    assert best.chunk_id == "2:0"
    with pytest.raises(NotImplementedError):
        vectors.HashingProvider().query_chunks(None, 1)


def test_staged_tables_go(spark):
    from threadloom.sources import staging

    df = staging.stage(spark.range(3), "gone")
    assert df.count() == 3
    fs, at = staging.file_system(spark, staging.shared_dir(spark) + "/gone-*")
    assert len(fs.globStatus(at)) == 1
    staging.release(spark)
    assert not fs.globStatus(at)


def test_streamed_counts(spark, tmp_path):
    from threadloom.streaming.counts import count_transitions, transitions

    made = [(1, f"2024-01-01 00:0{k}:00", t) for k, t in enumerate("abcd")] + [(1, "2024-01-02 00:00:00", "z")]
    df = spark.createDataFrame(made, "user_id long, at string, topic_id string").select("user_id", F.to_timestamp("at").alias("ts"), "topic_id")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    count_transitions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(transitions(spark, str(tmp_path / "out")), "i", "j", "k", "cnt") == [("a", "b", "c", 1.0), ("b", "c", "d", 1.0)]
