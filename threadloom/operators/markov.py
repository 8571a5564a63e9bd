"""Second-order topic transitions, smoothing, entropy and rewards.

Sequences are rows ``doc_id, pos, topic_id`` with an optional ``grp``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _steps(seq: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("pos")
    grp = "grp" if "grp" in seq.columns else F.lit(None)
    s = seq.select("doc_id", "pos", F.col("topic_id").alias("a"), (F.col(grp) if isinstance(grp, str) else grp).alias("ga"))
    return s.select("a", F.lead("a").over(order).alias("b"), F.lead("a", 2).over(order).alias("c"), "ga", F.lead("ga").over(order).alias("gb"), F.lead("ga", 2).over(order).alias("gc"))


def fit(seq: DataFrame, structural_penalty: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """``(trans1(j, k, cnt), trans2(i, j, k, cnt))``; a last hop into another group counts ``structural_penalty``."""
    s = _steps(seq)
    cross = lambda x, y: F.when(F.col(x) != F.col(y), F.lit(float(structural_penalty))).otherwise(1.0)
    one = s.filter("b is not null").groupBy(F.col("a").alias("j"), F.col("b").alias("k")).agg(F.sum(cross("ga", "gb")).alias("cnt"))
    two = s.filter("c is not null").groupBy(F.col("a").alias("i"), F.col("b").alias("j"), F.col("c").alias("k")).agg(F.sum(cross("gb", "gc")).alias("cnt"))
    return one, two


def probabilities(trans: DataFrame, alpha: float = 0.0) -> DataFrame:
    """Counts over totals of their context, additively smoothed over the observed keys if ``alpha`` > 0."""
    context = [c for c in trans.columns if c not in ("k", "cnt")]
    w = Window.partitionBy(*context)
    c = F.col("cnt") + alpha
    return trans.withColumn("p", c / F.sum(c).over(w)).filter("p is not null").drop("cnt")


def blend(trans1: DataFrame, trans2: DataFrame, lam: float = 0.7, alpha: float = 0.0) -> DataFrame:
    """``i, j, k, p`` for every observed pair (i, j): lam * P2 + (1 - lam) * P1 over both supports, renormalised; with one side empty the other alone."""
    if not 0 <= lam <= 1:
        raise ValueError("lambda must lie in [0, 1]")
    p2, p1 = probabilities(trans2, alpha), probabilities(trans1, alpha)
    pairs = trans1.select(F.col("j").alias("i"), F.col("k").alias("j")).distinct()
    first = pairs.join(p1.withColumnRenamed("p", "p1"), "j")
    both = first.join(p2.withColumnRenamed("p", "p2"), ["i", "j", "k"], "full_outer")
    w = Window.partitionBy("i", "j")
    has1, has2 = F.max(F.col("p1").isNotNull()).over(w), F.max(F.col("p2").isNotNull()).over(w)
    a, b = F.coalesce("p1", F.lit(0.0)), F.coalesce("p2", F.lit(0.0))
    raw = F.when(has1 & has2, b * lam + a * (1 - lam)).when(has2, b).otherwise(a)
    return both.withColumn("raw", raw).withColumn("p", F.col("raw") / F.sum("raw").over(w)).filter("p > 0").select("i", "j", "k", "p")


def sample_inverse(dist: DataFrame, draws: DataFrame, keys: list[str], exploration: float = 0.0) -> DataFrame:
    """For each row of ``draws(<keys>, u)`` the first k, in order of ids, whose cumulative probability reaches u.

    With ``exploration`` that share of the mass is spread evenly over the context's keys, as a uniform draw that often would.
    """
    if not 0 <= exploration <= 1:
        raise ValueError("exploration must lie in [0, 1]")
    if exploration:
        dist = dist.withColumn("p", F.col("p") * (1 - exploration) + exploration / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    cum = F.sum("p").over(Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    top = F.max("k").over(Window.partitionBy(*keys))
    table = dist.withColumn("cum", F.round(cum, 9)).withColumn("top", top)
    hit = table.join(draws, keys).groupBy(*draws.columns).agg(F.coalesce(F.min(F.when(F.col("cum") >= F.col("u"), F.col("k"))), F.max("top")).alias("k"))
    return hit


def additive_smoothing(dist: DataFrame, alpha: float) -> DataFrame:
    """``grp, key, p`` from ``grp, key, c``; nothing where a total does not exceed 0."""
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    total = F.sum(F.col("c") + alpha).over(Window.partitionBy("grp"))
    return dist.withColumn("t", total).filter("t > 0").select("grp", "key", ((F.col("c") + alpha) / F.col("t")).alias("p"))


def dirichlet_smoothing(dist: DataFrame, prior_mass: float, vocab_size: int) -> DataFrame:
    if prior_mass < 0 or vocab_size <= 0:
        raise ValueError("prior_mass must not be negative and vocab_size must be above 0")
    return additive_smoothing(dist, prior_mass / vocab_size)


def entropy(dist: DataFrame) -> DataFrame:
    """``grp, entropy`` in nats over positive probabilities."""
    return dist.groupBy("grp").agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0))).alias("entropy"))


def temperature_rescale(dist: DataFrame, temperature: float) -> DataFrame:
    """``grp, key, p``: softmax of ln max(p, 1e-12) over the temperature."""
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    w = Window.partitionBy("grp")
    z = dist.withColumn("z", F.ln(F.greatest("p", F.lit(1e-12))) / temperature)
    e = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
    return e.select("grp", "key", (F.col("e") / F.sum("e").over(w)).alias("p"))


def reward_triples(seq: DataFrame, rewards: DataFrame) -> DataFrame:
    """``i, j, k, sum_reward, n`` over consecutive triples; ``rewards(doc_id, reward)``."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    t = seq.select("doc_id", F.col("topic_id").alias("i"), F.lead("topic_id").over(order).alias("j"), F.lead("topic_id", 2).over(order).alias("k")).filter("k is not null")
    return t.join(rewards, "doc_id").groupBy("i", "j", "k").agg(F.sum("reward").alias("sum_reward"), F.count(F.lit(1)).alias("n"))


def reward_factors(triples: DataFrame) -> DataFrame:
    return triples.select("i", "j", "k", F.greatest(F.lit(0.0), 1 + F.col("sum_reward") / F.col("n")).alias("factor"))


def topic_sequences(dist: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, pos, topic_id, grp``: best topic of each chunk (ties: smaller id) in documents of two or more. Needs ``<id>, doc_id, position, structural_group``."""
    key = dist.columns[0]
    best = dist.select(key, F.array_min(F.transform("dist", lambda d: F.struct((-d["p"]).alias("n"), d["topic_id"].alias("t"))))["t"].alias("topic_id"))
    rows = best.join(chunks, key).select("doc_id", F.col("position").alias("pos"), "topic_id", F.coalesce(F.col("structural_group"), F.lit(-1)).alias("grp"))
    many = rows.groupBy("doc_id").count().filter("count >= 2").select("doc_id")
    return rows.join(many, "doc_id")
