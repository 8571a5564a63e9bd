"""Staging in the cluster's shared folder, bounded broadcasts and labelled samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import shared_dir, stage

#: Rows of a two-column table up to which a join side may be broadcast (about 3 MB).
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` hinted for broadcast when its counted ``rows`` are within ``limit``; else untouched, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


#: Bits of a sieve: its words, at most a 64th as many rows whatever the data, are broadcast.
SIEVE_BITS = 1 << 24


def _spot(*key):
    return F.pmod(F.xxhash64(*key, F.lit("sieve")), F.lit(SIEVE_BITS))


def sieve_words(keys: DataFrame, *key: str) -> DataFrame:
    """``_sieve_word, _sieve_bits``: a bit table of the hashed ``key`` columns of ``keys``."""
    spots = keys.select(_spot(*key).alias("_sieve_spot"))
    return spots.groupBy(F.expr("_sieve_spot div 64").alias("_sieve_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_sieve_spot % 64 as int)))").alias("_sieve_bits"))


def sieved(df: DataFrame, key: list, keys: DataFrame, names: list[str], inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be that of a row of ``keys`` (columns ``names``), or (not ``inside``) surely is not.

    All in the JVM and without moving a row; no row that has such a key is lost, so an exact join on what is left gives the
    same as one on all. The bit table is bounded, so with very many keys it only lets more rows through.
    """
    words = F.broadcast(sieve_words(keys, *names))
    columns = df.columns
    marked = df.withColumn("_sieve_spot", _spot(*key)).withColumn("_sieve_word", F.expr("_sieve_spot div 64")).join(words, "_sieve_word", "left")
    hit = F.coalesce(F.expr("shiftright(_sieve_bits, cast(_sieve_spot % 64 as int)) & 1L") == 1, F.lit(False))
    return marked.filter(hit if inside else ~hit).select(*[F.col(f"`{c}`") for c in columns])


#: Classes of a labelled sample: the most frequent ones.
MAX_CLASSES = 256


def stratified(df: DataFrame, by: str, content: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each value of ``by`` (of its ``MAX_CLASSES`` most frequent ones), one for each distinct ``content``.

    Rows are ordered by a hash of their content, and the first of each class are taken: repeats share a hash and
    collapse on the map side, so neither copies nor a hot key exceed the bound or push out a class. Distinct contents are
    counted roughly, for a hash threshold that keeps the rest from moving. Nulls in either column are left out.
    """
    space = 1 << 30
    pick = F.pmod(F.xxhash64(F.col(content), F.lit("sample")), F.lit(space))
    rows = df.filter(F.col(by).isNotNull() & F.col(content).isNotNull()).withColumn("_pick", pick)
    sizes = rows.groupBy(by).agg(F.approx_count_distinct("_pick", 0.03).alias("n"), F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), by).limit(MAX_CLASSES)
    cut = sizes.select(F.col(by).alias("_class"), (F.lit(float(space)) * per_class * 1.25 / F.col("n")).alias("_cut"))
    near = rows.join(F.broadcast(cut), (F.col(by) == F.col("_class")) & (F.col("_pick") < F.col("_cut"))).drop("_class", "_cut").dropDuplicates([by, "_pick"])
    first = Window.partitionBy(by).orderBy("_pick")
    return near.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= per_class).drop("_pick", "_rank")


__all__ = ["BROADCAST_ROWS", "crc_mod", "shared_dir", "sieve_words", "sieved", "small", "stage", "stratified"]
