"""Combining ranked lists: normalised scores, rank fusion, federated merges.

A list is a DataFrame (source, id, distance); smaller distances are better. Ties are broken by id. Lists hold at most the k rows of a
search, so that the windows over one source are small."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(lists: DataFrame, by: Column | None = None, source: str = "source", id: str = "id") -> DataFrame:
    """``rank`` from 1 within each source."""
    return lists.withColumn("rank", F.row_number().over(W.partitionBy(source).orderBy(by if by is not None else F.col("distance"), id)))


def _weight(weights: Mapping[str, float] | None, source: str) -> Column:
    if not weights:
        return F.lit(1.0)
    return reduce(lambda c, kv: F.when(F.col(source) == kv[0], float(kv[1])).otherwise(c), weights.items(), F.lit(1.0))


def rrf(lists: DataFrame, k: int = 60, weights: Mapping[str, float] | None = None, source: str = "source", id: str = "id") -> DataFrame:
    """Reciprocal rank fusion: id, score = sum of weight / (k + rank), n_sources; best first by (score, id)."""
    share = _weight(weights, source) / (F.lit(k) + F.col("rank"))
    return ranked(lists, source=source, id=id).groupBy(id).agg(F.sum(share).alias("score"), F.count("*").alias("n_sources"))


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, k: int = 60, weight_vector: float = 0.5, weight_text: float = 0.5, id: str = "id") -> DataFrame:
    """Rank fusion of a vector list (id, distance) and a text list (id, score): id, score, vector_rank, text_rank."""
    a = vector_hits.select(id, F.row_number().over(W.orderBy("distance", id)).alias("vector_rank"))
    b = text_hits.select(id, F.row_number().over(W.orderBy(F.desc("score"), id)).alias("text_rank"))
    part = lambda rank, w: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    return a.join(b, id, "full_outer").withColumn("score", part("vector_rank", weight_vector) + part("text_rank", weight_text)).select(id, "score", "vector_rank", "text_rank")


def normalised(lists: DataFrame, how: str = "minmax", source: str = "source") -> DataFrame:
    """Distances made comparable between sources: ``minmax`` (0 to 1, 0 where all are equal), ``zscore`` (population), ``percent_rank``, ``none``."""
    w = W.partitionBy(source)
    d = F.col("distance")
    if how == "minmax":
        low, high = F.min("distance").over(w), F.max("distance").over(w)
        d = F.when(high > low, (d - low) / (high - low)).otherwise(0.0)
    elif how == "zscore":
        mean, spread = F.avg("distance").over(w), F.stddev_pop("distance").over(w)
        d = F.when(spread > 0, (d - mean) / spread).otherwise(0.0)
    elif how == "percent_rank":
        d = F.percent_rank().over(w.orderBy("distance"))
    elif how != "none":
        raise ValueError(f"unknown normalisation {how!r}")
    return lists.withColumn("distance", d)


def federated(lists: DataFrame, how: str = "minmax", weights: Mapping[str, float] | None = None, k: int = 10, source: str = "source", id: str = "id") -> DataFrame:
    """Serial federation: normalised distances times weight, ascending; equal ids of different sources stay apart."""
    rows = normalised(lists, how, source).withColumn("distance", F.col("distance") * _weight(weights, source))
    return rows.select(source, id, "distance").orderBy("distance", source, id).limit(k)


def merged(lists: DataFrame, how: str = "min", weights: Mapping[str, float] | None = None, source: str = "source", id: str = "id") -> DataFrame:
    """One row per id: the ``min``, ``max``, ``avg`` or ``weighted`` mean of its distances."""
    w = _weight(weights, source)
    value = {"min": F.min("distance"), "max": F.max("distance"), "avg": F.avg("distance"), "weighted": F.sum(F.col("distance") * w) / F.sum(w)}[how]
    return lists.groupBy(id).agg(value.alias("distance"), F.count("*").alias("n_sources"))


def nearest_of(lists: DataFrame, k: int, source: str = "source", id: str = "id") -> DataFrame:
    """Scatter-gather: the ``k`` nearest of all lists, each id once, with the source of its smallest distance."""
    best = lists.groupBy(id).agg(F.min(F.struct("distance", source)).alias("b"))
    return best.select(id, F.col(f"b.{source}").alias(source), F.col("b.distance").alias("distance")).orderBy("distance", id).limit(k)


def consensus(lists: DataFrame, k: int, source: str = "source", id: str = "id") -> DataFrame:
    """First the ids that most sources have, then by mean distance."""
    rows = lists.groupBy(id).agg(F.countDistinct(source).alias("n_sources"), F.avg("distance").alias("distance"))
    return rows.orderBy(F.desc("n_sources"), "distance", id).limit(k)


def by_priority(lists: DataFrame, priority: Mapping[str, int], k: int, source: str = "source", id: str = "id") -> DataFrame:
    """Each id from its source of highest priority (smallest number); then by priority and distance."""
    order = reduce(lambda c, kv: F.when(F.col(source) == kv[0], kv[1]).otherwise(c), priority.items(), F.lit(1 << 30))
    rows = lists.withColumn("priority", order).groupBy(id).agg(F.min(F.struct("priority", "distance", source)).alias("b"))
    return rows.select(id, F.col(f"b.{source}").alias(source), F.col("b.priority").alias("priority"), F.col("b.distance").alias("distance")).orderBy("priority", "distance", id).limit(k)


def round_robin(lists: DataFrame, k: int, source: str = "source", id: str = "id") -> DataFrame:
    """The lists interleaved by rank, each id once at its best place."""
    rows = ranked(lists, source=source, id=id).groupBy(id).agg(F.min(F.struct("rank", source)).alias("b"))
    return rows.select(id, F.col(f"b.{source}").alias(source), F.col("b.rank").alias("rank")).orderBy("rank", source, id).limit(k)


def intersection(lists: DataFrame, n_sources: int, source: str = "source", id: str = "id") -> DataFrame:
    """Ids that every source has, with their mean distance."""
    return lists.groupBy(id).agg(F.countDistinct(source).alias("n_sources"), F.avg("distance").alias("distance")).where(F.col("n_sources") == n_sources)
