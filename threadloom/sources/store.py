"""Saving and loading an index: one Parquet folder a table, and the settings as a line of JSON. Any store that Spark reaches will do."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings


def save_index(path: str, tables: dict[str, DataFrame], settings: Settings) -> None:
    """``edges`` are partitioned by kind, so a reader of one kind sees no other file. The settings come last: without them there is no index."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        (writer.partitionBy("kind") if name == "edges" else writer).parquet(f"{path}/{name}")
    info = {"settings": settings.to_dict(), "tables": {name: table.schema.jsonValue() for name, table in tables.items()}}
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_index(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], Settings]:
    """Tables with the schemas that they were saved with; FileNotFoundError where the index or a table of it is missing."""
    from pyspark.sql.types import StructType

    try:
        info = json.loads(spark.read.text(f"{path}/config").first()["value"])
        tables = {name: spark.read.schema(StructType.fromJson(schema)).parquet(f"{path}/{name}") for name, schema in info["tables"].items()}
    except AnalysisException as e:
        raise FileNotFoundError(f"no whole index in {path}: {e.getCondition()}") from None
    return tables, Settings.of(**info["settings"])


def tensor_encode(table: DataFrame) -> DataFrame:
    """``key "i|j", k, value`` of a sparse (i, j, k) table."""
    return table.select(F.concat_ws("|", "i", "j").alias("key"), "k", "value")


def tensor_decode(table: DataFrame) -> DataFrame:
    """Keys are split once, at the first bar."""
    parts = F.split("key", r"\|", 2)
    return table.select(parts[0].alias("i"), parts[1].alias("j"), "k", "value")
