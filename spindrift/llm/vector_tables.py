"""The vectors of the tables: current vectors of a change feed, and recorded queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.neighbours import unit_vectors
from spindrift.operators.changefeed import current_keys
from spindrift.runtime import cut, table


def current_vectors(spark: SparkSession, directory: str, width: int = 64) -> DataFrame:
    """collection, id, unit of every current record with a sound vector; written once to the shared folder.

    The current records are found from narrow columns; only their delivery ids meet the vectors."""
    ops = table(spark, directory, "delta_ops")
    keys = current_keys(ops).select("delivery_id")
    wide = ops.where(F.size("vector") == width).select("delivery_id", "collection", F.col("vector_id").alias("id"), "vector")
    return cut(unit_vectors(wide.join(keys, "delivery_id", "left_semi").drop("delivery_id"), width=width))


def recorded_vectors(spark: SparkSession, directory: str, width: int = 64) -> DataFrame:
    """collection, id, unit of every recorded query with a sound vector."""
    rows = table(spark, directory, "recorded_queries").select("collection", F.col("query_id").alias("id"), F.col("query").alias("vector"))
    return unit_vectors(rows, width=width)
