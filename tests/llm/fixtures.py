"""Documents with every case that must not break an operator."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n int, id long, band long, seg long, comp string, doc int, copy int, number int, added string, term string"


def words(rng: random.Random, n: int, base: str = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau") -> str:
    pool = base.split()
    return " ".join(rng.choice(pool) + rng.choice(["", "", "s", "ing", "ed", str(rng.randrange(90))]) for _ in range(n))


def rows(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    passage = words(rng, 60)
    text = [words(rng, rng.randrange(5, 120)) for _ in range(40)]
    text += [None, "", "   \n\t ", "a", "one two three", "é" * 70, "ß straße 日本語 テキスト " * 20, text[0], text[0], text[1].upper()]
    near = text[2].split()
    text += [" ".join([*near[:-1], "changed"]), f"{words(rng, 20)} {passage} {words(rng, 20)}", f"{passage}.\nMore. {words(rng, 9)}", f"Zeta {passage}"]
    text += [words(rng, 12_000), "the " * 400, "ab" * 300, "x" * 200]
    out = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), None if t is None else len(t)) for k, t in enumerate(text)]
    out += [out[3], out[3], (None, text[4], "en", None, 3), (None, None, None, None, None)]
    return [r + (1, 2, 3, 4, 5, "x", 6, 7, 8, "y", "z") for r in out]


def table(spark, made: list[tuple] | None = None):
    return spark.createDataFrame(rows() if made is None else made, SCHEMA)


def save(spark, path: str, made: list[tuple] | None = None, labels: list[tuple] = (), benchmark: list[tuple] = ()) -> str:
    table(spark, made).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path
