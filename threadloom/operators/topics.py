"""The topic model: assignment of chunks to leaves, clustering, keywords, and priors on the hierarchy.

Centroids, one for each topic, are a stated query set: they are collected in blocks and met by all chunks in matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import matrix, unit
from . import graph


def centroids(rows: DataFrame, key: str = "topic_id", vector: str = "v", dim: int = 64) -> DataFrame:
    """Mean vector of each key, one pre-aggregated sum for each dimension."""
    return rows.groupBy(key).agg(F.array(*[F.avg(F.get(vector, i)) for i in range(dim)]).alias("centroid"), F.count(F.lit(1)).alias("members"))


def leaf_items(leaves: DataFrame) -> list[tuple[str, list[float]]]:
    """Leaf ids in lexicographic order, with centroids."""
    return [(r["topic_id"], r["centroid"]) for r in leaves.select("topic_id", "centroid").orderBy("topic_id").collect()]


def leaf_distribution(rows: DataFrame, leaves: DataFrame, temperature: float = 0.1) -> DataFrame:
    """``<id>, dist array<struct<topic_id, p>>``: softmax of cosines to the leaves; uniform for a zero vector. No shuffle."""
    items = leaf_items(leaves)
    names, u = [i for i, _ in items], unit(np.array([v for _, v in items], np.float64))
    t, id_name = max(temperature, 1e-6), rows.columns[0]
    kind = pa.struct([("topic_id", pa.string()), ("p", pa.float64())])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            z = unit(matrix(batch.column(1))) @ u.T / t if n else np.zeros((0, len(names)))
            e = np.exp(z - z.max(1, keepdims=True)) if n else z
            p = e / e.sum(1, keepdims=True)
            flat = pa.StructArray.from_arrays([pa.array(names * n, pa.string()), pa.array(p.ravel())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(names), pa.int32()), flat)], names=[id_name, "dist"])

    return rows.mapInArrow(run, f"{id_name} {rows.schema[id_name].dataType.simpleString()}, dist array<struct<topic_id: string, p: double>>")


def long_form(dist: DataFrame) -> DataFrame:
    return dist.select(dist.columns[0], F.explode("dist").alias("d")).select(dist.columns[0], "d.topic_id", "d.p")


def ranked(dist):
    """The distribution by falling probability, ties by id."""
    return F.transform(F.array_sort(F.transform(dist, lambda d: F.struct((-d["p"]).alias("n"), d["topic_id"].alias("t")))), lambda d: F.struct(d["t"].alias("topic_id"), (-d["n"]).alias("p")))


def top_topics(dist: DataFrame, top_m: int = 2, min_prob: float = 0.15) -> DataFrame:
    """``<id>, topic_id, p``: the first m by probability that reach ``min_prob``, else the best alone. Ranked within the row's array."""
    key = dist.columns[0]
    kept = F.filter(F.slice(ranked(F.col("dist")), 1, top_m), lambda d: d["p"] >= min_prob)
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.slice(ranked(F.col("dist")), 1, 1))
    return dist.select(key, F.explode(kept).alias("d")).select(key, "d.topic_id", "d.p")


def chunk_edges(links: DataFrame, topics: DataFrame, decay: float = 0.7) -> DataFrame:
    """``topic_id, <id>, weight``: leaf links plus their decayed share for every ancestor, climbing by first parents and crediting all parents of a hop."""
    key = links.columns[0]
    base = links.select("topic_id", key, F.col("p").alias("weight"))
    if decay <= 0:
        return base
    climb = first_parent_chain(topics)
    up = base.join(climb, "topic_id").select(F.col("ancestor_id").alias("topic_id"), key, (F.col("weight") * F.pow(F.lit(decay), F.col("hops"))).alias("weight")).filter("weight >= 1e-9")
    return base.union(up).groupBy("topic_id", key).agg(F.sum("weight").alias("weight"))


def first_parent_chain(topics: DataFrame, max_depth: int = 64) -> DataFrame:
    """``topic_id, ancestor_id, hops``: all parents at each hop of the chain of first parents."""
    up = graph.parents(topics)
    first = up.filter("nth = 0").select(F.col("topic_id").alias("child"), F.col("parent_id").alias("above"))
    at = topics.select("topic_id", F.col("topic_id").alias("at"))
    known = graph.depth(topics)
    found = topics.select("topic_id", F.col("topic_id").alias("ancestor_id"), F.lit(0).alias("hops")).filter(F.lit(False))
    for hops in range(1, (max_depth if known is None else known) + 1):
        level = at.join(up.select(F.col("topic_id").alias("at"), F.col("parent_id").alias("ancestor_id")), "at").select("topic_id", "ancestor_id", F.lit(hops).alias("hops"))
        if known is None:
            level = level.cache()
            if level.isEmpty():
                break
        found = found.union(level)
        at = at.join(first, F.col("at") == F.col("child")).select("topic_id", F.col("above").alias("at"))
    return found


def rollup(prior: DataFrame, topics: DataFrame) -> DataFrame:
    """``query_id, topic_id, p``: each topic's sum over its descendant leaves, renormalised over all topics of the query."""
    down = graph.descendants(topics)
    total = prior.join(down, F.col("descendant_id") == prior["topic_id"]).groupBy("query_id", down["topic_id"]).agg(F.sum("p").alias("p"))
    return total.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("query_id")))


def knn(topics: DataFrame, top_k: int = 20, min_cosine: float = 0.0, skip_lineage: bool = True) -> DataFrame:
    """``src, dst, weight``: nearest other topics by centroid cosine (ties: smaller id); lineage pairs are left out before ranking if asked.

    Exact. Every topic meets the topics, which are few by construction, in one matrix product a batch, and only its own nearest leave it.
    """
    spark = topics.sparkSession
    rows = topics.select("topic_id", "centroid").filter("centroid is not null").orderBy("topic_id").collect()
    names = [r["topic_id"] for r in rows]
    at = {t: k for k, t in enumerate(names)}
    kin: list[list[int]] = [[] for _ in names]
    for r in graph.ancestors(topics).select("topic_id", "ancestor_id").collect() if skip_lineage else ():
        if r[0] in at and r[1] in at:
            kin[at[r[0]]].append(at[r[1]])
            kin[at[r[1]]].append(at[r[0]])
    shared = spark.sparkContext.broadcast((names, unit(np.array([r["centroid"] for r in rows], np.float64).reshape(len(rows), -1)), kin))

    def run(batches):
        names, u, kin = shared.value
        number = {t: k for k, t in enumerate(names)}
        label = np.array(names, object)
        for batch in batches:
            src, dst, weight = [], [], []
            for t in batch.column(0).to_pylist():
                k = number[t]
                c = np.round(u @ u[k], 9)
                c[[k, *kin[k]]] = -9
                best = np.flatnonzero(c >= max(min_cosine, -2))
                if len(best) > top_k:
                    best = best[c[best] >= np.partition(c[best], len(best) - top_k)[len(best) - top_k]]
                best = best[np.lexsort((best, -c[best]))][:top_k]  # names are in order, so numbers break ties
                src += [t] * len(best)
                dst += label[best].tolist()
                weight += c[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string()), pa.array(weight, pa.float64())], names=["src", "dst", "weight"])

    return topics.filter("centroid is not null").select("topic_id").mapInArrow(run, "src string, dst string, weight double")


def dag_candidates(topics: DataFrame, tau: float) -> DataFrame:
    """``child, parent, cosine`` pairs near enough for a further parent, lineage excluded."""
    return knn(topics, max(1, topics.count()), tau).select(F.col("src").alias("child"), F.col("dst").alias("parent"), F.col("weight").alias("cosine"))


def add_dag_parents(topics: DataFrame, tau: float | None) -> DataFrame:
    """Further parents in the order of ids, as long as the graph stays acyclic. A greedy pass over the topic rows, which are few by construction."""
    if tau is None or tau > 1:
        return topics
    rows = {r["topic_id"]: r.asDict() for r in topics.orderBy("topic_id").collect()}
    u = {i: unit(np.array([r["centroid"]], np.float64))[0] for i, r in rows.items() if r["centroid"] is not None}

    def above(i: str) -> set[str]:
        seen, todo = set(), list(rows[i]["parent_ids"])
        while todo:
            if (p := todo.pop()) not in seen and p in rows:
                seen.add(p)
                todo += rows[p]["parent_ids"]
        return seen

    for t in sorted(u):
        known = above(t)
        for p in sorted(u):
            if p != t and p not in known and float(u[t] @ u[p]) >= tau and t not in above(p):
                rows[t]["parent_ids"] = [*rows[t]["parent_ids"], p]
    return topics.sparkSession.createDataFrame(list(rows.values()), topics.schema)


def lloyd_step(points: DataFrame, centers: DataFrame, dim: int = 64) -> DataFrame:
    """``topic_id, centroid, members``: one round of k-means; nearest by squared distance, ties to the smaller id."""
    return centroids(assign(points, centers).select("topic_id", "v"), dim=dim)


def assign(points: DataFrame, centers: DataFrame, digits: int = 9) -> DataFrame:
    """``<id>, v, topic_id, distance`` of the nearest centre; distances equal in ``digits`` are ties, which go to the smaller id. Centres are few by construction (k of them)."""
    items = leaf_items(centers)
    names, c = np.array([i for i, _ in items], object), np.array([v for _, v in items], np.float64)
    key = points.columns[0]

    def run(batches):
        for batch in batches:
            m = matrix(batch.column(1))
            d = ((m[:, None, :] - c[None]) ** 2).sum(2) if len(m) else np.zeros((0, len(c)))
            at = np.round(d, digits).argmin(1) if len(m) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[at], pa.string()), pa.array(d[np.arange(len(m)), at])], names=[key, "v", "topic_id", "distance"])

    return points.mapInArrow(run, f"{key} {points.schema[key].dataType.simpleString()}, v array<double>, topic_id string, distance double")


#: Rows of each cluster among which its starts are chosen where a sample is asked for, at least.
STARTS = 64


def kmeans_tree(points: DataFrame, n_coarse: int = 5, n_fine: int = 3, max_depth: int = 3, min_cluster_size: int = 2, rounds: int = 8, sample: int | None = None) -> DataFrame:
    """``topic_id, level, parent_ids, centroid, members`` by splitting clusters level by level.

    A cluster of n rows splits into min(k, n) parts, k being ``n_coarse`` at the root and ``n_fine`` below, unless it is at
    ``max_depth``, smaller than ``min_cluster_size``, or that gives fewer than 2. Starts are chosen by farthest-first on all rows, one
    pass for each start; with ``sample`` on the rows of smallest hash, about that many over a level and at least ``STARTS`` of every
    cluster (all where it has fewer). Rounds run over all rows of all clusters of a level at once: a row only meets the centres below
    its own cluster. Children that are left empty vanish. Settings below 1 count as 1. Null and zero-length vectors are left out.
    """
    from ..sources.staging import stage

    n_coarse, n_fine, max_depth, min_cluster_size = (max(1, int(x)) for x in (n_coarse, n_fine, max_depth, min_cluster_size))
    key = points.columns[0]
    points = points.filter(F.size("v") > 0)
    spark = points.sparkSession
    first = points.first()
    out, dim = [], len(first[1]) if first is not None else 0
    state = points.select(key, "v", F.lit("t:").alias("at"))
    for depth in range(1, max_depth + 1 if first is not None else 1):
        k = n_coarse if depth == 1 else n_fine
        sizes = {r["at"]: r["count"] for r in state.groupBy("at").count().collect()}
        split = {a: min(k, n) for a, n in sizes.items() if n >= min_cluster_size and min(k, n) >= 2}
        if not split:
            break
        # a share of hashes that gives each cluster what it needs, with room for chance; the smallest of these are taken
        total = sum(sizes[a] for a in split)
        most = {a: n if sample is None else max(min(n, max(STARTS, split[a])), n * sample // total) for a, n in sizes.items() if a in split}
        cut = spark.createDataFrame([(a, min(1.0, most[a] / sizes[a] + 4 * (most[a] ** 0.5 + 4) / sizes[a]), most[a]) for a in sorted(split)], "at string, share double, most long")
        part = state.join(F.broadcast(cut), "at")
        among = part
        if sample is not None:
            spread = F.pmod(F.xxhash64(key, F.lit("start")), F.lit(1 << 30))
            near = part.withColumn("h", spread).filter(F.col("h") <= F.col("share") * (1 << 30))
            among = near.withColumn("nth", F.row_number().over(Window.partitionBy("at").orderBy("h", key))).filter("nth <= most")
        centers = _starts(among.select(key, "v", "at"), split, dim)
        part = part.select(key, "v", "at")
        for _ in range(max(1, rounds)):
            moved = _split_assign(part, centers, key)
            mean = {r["topic_id"]: r["centroid"] for r in centroids(moved, dim=dim).collect()}
            centers = {a: [(t, mean[t]) for t, _ in items if t in mean] for a, items in centers.items()}
        state = stage(_split_assign(part, centers, key).select(key, "v", F.col("topic_id").alias("at")), "clusters")
        level = centroids(state.withColumnRenamed("at", "topic_id"), dim=dim)
        parent = F.array() if depth == 1 else F.array(F.regexp_replace("topic_id", r"\.[0-9]+$", ""))
        out += level.select("topic_id", F.lit(depth).alias("level"), parent.cast("array<string>").alias("parent_ids"), "centroid", "members").collect()
    if not out:
        raise ValueError("no topic hierarchy: the corpus is empty or no cluster could be split")
    return spark.createDataFrame(sorted(out, key=lambda r: r["topic_id"]), "topic_id string, level int, parent_ids array<string>, centroid array<double>, members long")


def _starts(rows: DataFrame, split: dict[str, int], dim: int) -> dict[str, list[tuple[str, list[float]]]]:
    """Centres of each cluster of ``rows(<id>, v, at)``: the row nearest to the mean, then again and again the row farthest from all so far, ties to the smaller id.

    A pass sends one row for each task and cluster. A cluster whose rows all equal its centres takes no more.
    """
    key = rows.columns[0]
    chosen = {r["topic_id"]: [r["centroid"]] for r in centroids(rows.withColumnRenamed("at", "topic_id"), dim=dim).collect()}
    found: dict[str, list] = {a: [] for a in sorted(chosen)}
    for nth in range(max(split.values())):
        open_ = {a: np.array(c, np.float64) for a, c in chosen.items() if len(found[a]) == nth < split[a]}
        if not open_:
            break
        shared = rows.sparkSession.sparkContext.broadcast(open_)

        def run(batches, nth=nth, shared=shared):
            best: dict = {}
            for batch in batches:
                m, ids, at = matrix(batch.column(1)), batch.column(0).to_pylist(), np.array(batch.column(2).to_pylist(), object)
                for a in set(at.tolist()) & set(shared.value):
                    pick = np.flatnonzero(at == a)
                    d = np.full(len(pick), np.inf)
                    for c in shared.value[a]:
                        d = np.minimum(d, np.round(((m[pick] - c) ** 2).sum(1), 9))
                    d = d if nth == 0 else -d
                    k = min(pick[d == d.min()], key=lambda i: ids[i])
                    best[a] = min(best.get(a, (np.inf,)), (float(d.min()), ids[k], m[k].tolist()))
            names = sorted(best)
            cols = list(zip(*(best[a] for a in names))) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cols[0], pa.float64()), pa.array(cols[1], kind), pa.array(cols[2], pa.list_(pa.float64()))], names=["at", "d", key, "v"])

        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(rows.schema[key].dataType)
        best: dict = {}
        for a, *row in rows.mapInArrow(run, f"at string, d double, {key} {rows.schema[key].dataType.simpleString()}, v array<double>").collect():
            best[a] = min(best.get(a, (np.inf,)), tuple(row))
        for a, (d, _, v) in best.items():
            if nth == 0:
                chosen[a] = []  # the mean was no centre
            elif d == 0:
                continue
            found[a].append((f"{a}.{nth}" if a != "t:" else f"t:{nth}", v))
            chosen[a].append(v)
    return found


def _split_assign(rows: DataFrame, centers: dict, key: str) -> DataFrame:
    """``<id>, v, topic_id``: the nearest of the centres below the row's cluster, one matrix product for each cluster of a batch; a cluster without centres stays whole."""
    shared = rows.sparkSession.sparkContext.broadcast({a: (np.array([t for t, _ in items], object), np.array([v for _, v in items], np.float64)) for a, items in centers.items()})

    def run(batches):
        table = shared.value
        for batch in batches:
            m = matrix(batch.column(1))
            at = np.array(batch.column(2).to_pylist(), object)
            new = at.copy()
            for a in set(at.tolist()):
                if a in table:
                    names, c = table[a]
                    pick = np.flatnonzero(at == a)
                    d = (m[pick] ** 2).sum(1)[:, None] - 2 * m[pick] @ c.T + (c * c).sum(1)[None]
                    new[pick] = names[np.round(d, 9).argmin(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.string())], names=[key, "v", "topic_id"])

    return rows.select(key, "v", "at").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, v array<double>, topic_id string")


def keyword_members(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """``topic_id, <id>``: the rows that tell a topic's keywords. Of a topic with a parent these are all rows (not the parent's
    alone) that lie nearest to it among its siblings, ties to the first in order; of a root its nearest min(50, max(1, rows / topics)).
    """
    key = rows.columns[0]
    found = topics.select("topic_id", "parent_ids", "centroid").orderBy("topic_id").collect()
    of: dict[str, list] = {}
    roots = []
    for r in found:
        if r["parent_ids"]:
            of.setdefault(r["parent_ids"][0], []).append((r["topic_id"], r["centroid"]))
        else:
            roots.append((r["topic_id"], r["centroid"]))
    shared = rows.sparkSession.sparkContext.broadcast([(np.array([t for t, _ in x], object), np.array([c for _, c in x], np.float64)) for x in of.values()])
    kind = rows.schema[key].dataType.simpleString()

    def nearest(batches):
        for batch in batches:
            m = matrix(batch.column(1))
            for names, c in shared.value if len(m) else ():
                d = (m * m).sum(1)[:, None] - 2 * m @ c.T + (c * c).sum(1)[None]
                yield pa.RecordBatch.from_arrays([pa.array(names[np.round(d, 9).argmin(1)], pa.string()), batch.column(0)], names=["topic_id", key])

    below = rows.select(key, "v").mapInArrow(nearest, f"topic_id string, {key} {kind}")
    if not roots:
        return below
    k = min(50, max(1, rows.count() // max(1, len(found))))
    centre = rows.sparkSession.sparkContext.broadcast((np.array([t for t, _ in roots], object), np.array([c for _, c in roots], np.float64)))

    def best(batches):
        names, c = centre.value
        for batch in batches:
            m = matrix(batch.column(1))
            if not len(m):
                continue
            d = np.round((m * m).sum(1)[:, None] - 2 * m @ c.T + (c * c).sum(1)[None], 9)
            for j, t in enumerate(names):
                edge = np.partition(d[:, j], min(k, len(m)) - 1)[min(k, len(m)) - 1]
                pick = np.flatnonzero(d[:, j] <= edge)
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(pick), pa.string()), batch.column(0).take(pa.array(pick)), pa.array(d[pick, j])], names=["topic_id", key, "d"])

    near = rows.select(key, "v").mapInArrow(best, f"topic_id string, {key} {kind}, d double")
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy("d", key))
    return below.union(near.withColumn("r", rank).filter(F.col("r") <= k).select("topic_id", key))


STOP = "a about after all also am an and any are as at be because been but by can could did do does for from had has have he her his how i if in into is it its just me more my no not of on or our out she so some such than that the their them then there these they this to up us was we were what when which who will with would you your"


#: Terms of several documents up to which document frequencies are broadcast, and bytes of text that a task counts.
TERMS, TEXT = 500_000, 16 << 20


def keywords(members: DataFrame, top_k: int = 10, pattern: str = "[a-zA-Z]{2,}", stop: str = STOP) -> DataFrame:
    """``topic_id, term, score, rank`` from ``members(topic_id, doc_id, text)``: the best summed TF-IDF.

    idf = ln((1 + n) / (1 + df)) + 1 over distinct documents, rows of unit length; terms of score 0 don't occur. Where the
    pattern finds no term at all, words of any kind count, stop words too. Texts move once for each use, by document, into tasks
    sized by their bytes: counts, weights and norms of a document are made in place. Terms of one document need no lookup.
    """
    n, size = members.agg(F.countDistinct("doc_id"), F.sum(F.octet_length("text"))).first()
    n += members.filter("doc_id is null").limit(1).count()
    docs = members.select("doc_id", "text").repartition(max(1, -(-(size or 0) // TEXT)), "doc_id").dropDuplicates(["doc_id"])

    def counted(pattern: str, stop: list[str]) -> DataFrame:
        words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("term")).filter(~F.col("term").isin(stop) if stop else F.lit(True))
        return words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))

    def shared(tf: DataFrame) -> tuple[DataFrame, int, int]:
        df = stage(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
        return df.filter("df > 1"), *df.agg(F.count(F.lit(1)), F.count_if(F.col("df") > 1)).first()

    from ..sources.staging import stage

    tf = counted(pattern, stop.split())
    df, terms, common = shared(tf)
    if not terms:
        tf = counted(r"(?U)\w+", [])
        df, _, common = shared(tf)
    known = tf.join(F.broadcast(df) if common <= TERMS else df, "term", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    raw = known.withColumn("w", F.col("tf") * (F.ln((1.0 + n) / (1.0 + F.col("df"))) + 1))
    weight = raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id"))))
    score = weight.join(members.select("topic_id", "doc_id").distinct(), "doc_id").groupBy("topic_id", "term").agg(F.round(F.sum("w"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.col("score").desc(), "term"))
    return score.withColumn("rank", rank).filter(F.col("rank") <= top_k)
