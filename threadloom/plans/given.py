"""The driver's tables as inputs of the operators: a given clustering, a topic tree, sequences and weighted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.vectors import cosines
from ..operators import graph, navigation, topics
from ..sources.staging import stage

GREEDY = Settings(navigation_greedy=True, max_steps=5)
STEPS = 5


class Given:
    """Lazily built tables over one folder of test data."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make, local: bool) -> DataFrame:
        """Made once for a plan that uses it several times: as local rows if the topics bound it, else in the shared folder."""
        if name not in self._made:
            df = make()
            self._made[name] = self.spark.createDataFrame(df.collect(), df.schema) if local else stage(df, name)
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def vectors(self) -> DataFrame:
        """``vec_id, v, label, topic_id, parent_id``: the label gives the leaf."""
        e = self.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
        parent = F.concat(F.lit("t:"), F.col("label") % 3)
        return e.withColumn("parent_id", parent).withColumn("topic_id", F.concat(parent, F.lit("."), F.floor(F.col("label") / 3).cast("string")))

    def chunks(self) -> DataFrame:
        return self.vectors().select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 10).alias("doc_id"), (F.col("vec_id") % 10).cast("int").alias("position"), F.floor(F.col("vec_id") / 5).alias("structural_group"), "v")

    def topics(self) -> DataFrame:
        v = self.vectors()
        rows = v.select("topic_id", "v").union(v.select("parent_id", "v"))
        c = topics.centroids(rows)
        deep = F.contains("topic_id", F.lit("."))
        return c.select("topic_id", F.when(deep, 2).otherwise(1).alias("level"), F.when(deep, F.array(F.regexp_replace("topic_id", r"\.[0-9]+$", ""))).otherwise(F.array().cast("array<string>")).alias("parent_ids"), "centroid", "members")

    def settled(self) -> DataFrame:
        """Topics as local rows: they are few, and every operator below joins them several times."""
        return self._once("topics", lambda: self.topics().orderBy("topic_id"), True)

    def dist(self, t: DataFrame) -> DataFrame:
        return topics.leaf_distribution(self.vectors().select("vec_id", "v"), t.filter("level = 2"))

    def links(self, t: DataFrame) -> DataFrame:
        return topics.top_topics(self.dist(t))

    def topic_chunk(self, t: DataFrame) -> DataFrame:
        return topics.chunk_edges(self.links(t), t).withColumnRenamed("vec_id", "chunk_id")

    def queries(self) -> DataFrame:
        """Every vector whose id is divisible by 100, with the six intents in turn."""
        names = F.array(*[F.lit(x) for x in ("deepen", "broaden", "compare", "apply", "clarify", "neutral")])
        q = self.vectors().filter("vec_id % 100 = 0")
        return q.select(F.col("vec_id").alias("query_id"), F.get(names, (F.floor(F.col("vec_id") / 100) % 6).cast("int")).alias("intent"), F.col("v").alias("vector"))

    def prior(self, t: DataFrame) -> DataFrame:
        """``query_id, topic_id, p``: the leaf distribution of each query."""
        make = lambda: topics.long_form(topics.leaf_distribution(self.queries().select("query_id", "vector"), t.filter("level = 2")))
        return self._once("prior", make, False)

    def policy_prior(self, t: DataFrame) -> DataFrame:
        """What the policy weighs: rolled up to ancestors, but for neutral queries the leaf prior itself."""
        leaf = self.prior(t)
        intents = self.queries().select("query_id", "intent")
        up = topics.rollup(leaf, t).join(intents.filter("intent <> 'neutral'"), "query_id", "left_semi")
        return up.unionByName(leaf.join(intents.filter("intent = 'neutral'"), "query_id", "left_semi"))

    def knn(self, t: DataFrame) -> DataFrame:
        return topics.knn(t).select("src", "dst", F.lit("topic-topic").alias("kind"), "weight")

    def moves(self, t: DataFrame) -> DataFrame:
        return self._once("moves", lambda: navigation.relations(t, self.knn(t)), True)

    def allowed(self, t: DataFrame) -> DataFrame:
        return self._once("allowed", lambda: navigation.filtered_moves(t, self.moves(t)), True)

    def start(self, t: DataFrame) -> DataFrame:
        return navigation.start_nodes(self.prior(t), self.queries().select("query_id", "intent"), t)

    def ready(self, t: DataFrame) -> DataFrame:
        """Queries with start, vector and prior, as walks take them."""
        p = self.policy_prior(t).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("topic_id", "p"))).alias("prior"))
        return self.queries().join(self.start(t).select("query_id", "start"), "query_id").join(p, "query_id", "left")

    def walks(self, t: DataFrame, settings: Settings = GREEDY, markov: DataFrame | None = None) -> DataFrame:
        return navigation.walk(self.ready(t), navigation.move_table(t, self.allowed(t), markov), settings, STEPS)

    def visits(self, t: DataFrame) -> DataFrame:
        from ..operators.retrieval import visit_counts

        return visit_counts(self.walks(t))

    def scores(self, t: DataFrame) -> DataFrame:
        from ..operators.projection import scores

        return scores(self.visits(t), self.topic_chunk(t))

    def query_cosines(self) -> DataFrame:
        """``query_id, chunk_id, cosine``: the stated query set against all chunks."""
        return cosines(self.vectors().select(F.col("vec_id").alias("chunk_id"), "v"), self.queries().select("query_id", "vector"))

    def sequences(self) -> DataFrame:
        """Events of a user in time; the day is the group."""
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(F.col("user_id").alias("doc_id"), F.row_number().over(order).alias("pos"), F.col("event_type").alias("topic_id"), F.unix_date(F.to_date("ts")).alias("grp"))

    def topic_sequence(self, t: DataFrame) -> DataFrame:
        from ..operators.markov import topic_sequences

        return topic_sequences(self.dist(t).withColumnRenamed("vec_id", "chunk_id"), self.chunks().select("chunk_id", "doc_id", "position", "structural_group"))

    def weighted(self) -> DataFrame:
        """Customers to parts by quantity, unaccumulated."""
        o = self.table("orders").select("o_orderkey", "o_custkey")
        li = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c:"), "o_custkey").alias("src"), F.concat(F.lit("p:"), "l_partkey").alias("dst"), F.lit("chunk-chunk").alias("kind"), F.col("l_quantity").alias("weight"))

    def geography(self) -> DataFrame:
        """Regions and nations as a two-level hierarchy."""
        r = self.table("region").select(F.concat(F.lit("r:"), "r_regionkey").alias("topic_id"), F.lit(1).alias("level"), F.array().cast("array<string>").alias("parent_ids"))
        n = self.table("nation").select(F.concat(F.lit("n:"), "n_nationkey"), F.lit(2), F.array(F.concat(F.lit("r:"), "n_regionkey")))
        return r.union(n)

    def type_counts(self) -> DataFrame:
        """``grp, key, c``: events of a user by type."""
        return self.table("events").groupBy(F.col("user_id").alias("grp"), F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("c"))

    def type_shares(self) -> DataFrame:
        c = self.type_counts()
        return c.select("grp", "key", (F.col("c") / F.sum("c").over(Window.partitionBy("grp"))).alias("p"))


__all__ = ["GREEDY", "STEPS", "Given", "graph"]
