"""Topic transitions counted as events arrive, and vector upserts from a stream.

The reference corpus is a batch; these are for corpora that grow. Counts add up in tables of deltas, so each
micro-batch writes what it saw once (by its batch id) and a replay overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def session_sequences(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``user_id, opened, closed, topics``: the topics of each session in the order of time, once its watermark has passed."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "topic_id"))), lambda x: x["topic_id"])
    return w.agg(ordered.alias("topics")).select("user_id", F.col("s.start").alias("opened"), F.col("s.end").alias("closed"), "topics")


def triples(sessions: DataFrame) -> DataFrame:
    """``i, j, k, cnt`` of consecutive topics within sessions."""
    t = F.col("topics")
    each = F.when(F.size(t) >= 3, F.transform(F.sequence(F.lit(0), F.size(t) - 3), lambda n: F.struct(F.get(t, n).alias("i"), F.get(t, n + 1).alias("j"), F.get(t, n + 2).alias("k"))))
    return sessions.select(F.explode(each).alias("x")).groupBy("x.i", "x.j", "x.k").agg(F.count(F.lit(1)).cast("double").alias("cnt"))


def count_transitions(events: DataFrame, deltas: str, checkpoint: str, gap: str = "30 minutes", late: str = "1 hour") -> StreamingQuery:
    """Starts a query that writes the triples of closed sessions under ``deltas``, one folder a batch."""

    def write(batch: DataFrame, number: int) -> None:
        triples(batch).write.mode("overwrite").parquet(f"{deltas}/batch={number}")

    return session_sequences(events, gap, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def transitions(spark: SparkSession, deltas: str) -> DataFrame:
    """The counts so far."""
    return spark.read.parquet(deltas).groupBy("i", "j", "k").agg(F.sum("cnt").alias("cnt"))


def upsert_stream(chunks: DataFrame, table, checkpoint: str) -> StreamingQuery:
    """Feeds a ``VectorTable`` from a stream of ``chunk_id, v, ...`` rows."""
    return chunks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: table.upsert(batch)).trigger(availableNow=True).start()
