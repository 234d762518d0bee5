"""Exact top-k search over a collection, and what is built on it.

A collection is a DataFrame with an id column and a vector column. Every search orders by (distance, id), so that ties are
decided; null vectors are never found. One query is a literal: the plan is a scan and ``TakeOrderedAndProject``. Many queries
are a stated set that meets the collection in blocks, without a join."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.distance import block_distances, distance
from spindrift.functions.distance import metric as known

#: Queries that one scan of the collection answers.
QUERY_BLOCK = 4_096


def scored(rows: DataFrame, query: Sequence[float], metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    """``rows`` with their ``distance`` to the query, without those that have none."""
    return rows.withColumn("distance", distance(metric, F.col(vector), query)).where("distance is not null")


def top_k(rows: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", vector: str = "embedding", id: str = "vec_id", where: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The ``k`` nearest rows that satisfy ``where`` (applied before the search): id, distance and ``keep``. k of 0 gives none."""
    kept = rows if where is None else rows.where(F.coalesce(where, F.lit(False)))
    return scored(kept, query, metric, vector).select(id, "distance", *keep).orderBy("distance", id).limit(max(k, 0))


def post_filtered(rows: DataFrame, query: Sequence[float], k: int, where: Column, factor: int = 3, metric: str = "cosine", vector: str = "embedding", id: str = "vec_id", keep: Sequence[str] = ()) -> DataFrame:
    """The nearest ``k * factor`` rows, of these the ones that satisfy ``where``, of these ``k``."""
    first = top_k(rows, query, k * factor, metric, vector, id, keep=[c for c in rows.columns if c not in (id, vector, "distance")])
    return first.where(F.coalesce(where, F.lit(False))).orderBy("distance", id).limit(k).select(id, "distance", *keep)


def radius(rows: DataFrame, query: Sequence[float], most: float, limit: int | None = None, metric: str = "cosine", vector: str = "embedding", id: str = "vec_id", where: Column | None = None) -> DataFrame:
    """All rows within a distance, nearest first; a negative or NaN radius and a limit of 0 give none."""
    kept = rows if where is None else rows.where(F.coalesce(where, F.lit(False)))
    if most != most or most < 0:
        kept = kept.limit(0)
    found = scored(kept, query, metric, vector).where(F.col("distance") <= F.lit(float(most))).select(id, "distance")
    return found if limit is None else found.orderBy("distance", id).limit(limit)


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int | None, metric: str = "cosine", vector: str = "embedding", id: str = "vec_id", query_id: str = "query_id", most: float | None = None, exclude_self: bool = False) -> DataFrame:
    """The ``k`` nearest rows for every query: query_id, id, distance, rank.

    ``queries`` (query_id, and a vector column of the same name) is a stated set: it is read in blocks of :data:`QUERY_BLOCK`, each
    of which meets all rows in one scan, where matrix products give each batch's nearest rows; only these are shuffled and
    ranked. With k of None all rows are given, without ranks. ``most`` leaves out what is farther. Rows and queries whose vectors are null or differ in width from the
    first query's are left out."""
    kind = known(metric)
    blocks: list[tuple[list, np.ndarray]] = []
    ids, vectors, width = [], [], None
    for q in queries.select(query_id, vector).where(F.col(vector).isNotNull()).orderBy(query_id).toLocalIterator():
        width = len(q[1]) if width is None else width
        if len(q[1]) == width:
            ids.append(q[0])
            vectors.append(q[1])
        if len(ids) == QUERY_BLOCK:
            blocks.append((ids, np.array(vectors, np.float64)))
            ids, vectors = [], []
    if ids or not blocks:
        blocks.append((ids, np.array(vectors, np.float64).reshape(len(ids), width or 0)))
    types = dict(rows.dtypes)
    schema = f"`{query_id}` {dict(queries.dtypes)[query_id]}, `{id}` {types[id]}, distance double"
    base = rows.where(F.size(vector) == (width or 0)).select(id, vector)
    out = None
    for block in blocks:
        shipped = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            asked, points = shipped.value
            for batch in batches:
                if not len(asked) or not len(batch):
                    continue
                own = batch.column(id)
                values = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
                far = block_distances(kind, values, points)
                if exclude_self:
                    far[np.array(asked, object)[:, None] == np.array(own.to_pylist(), object)[None]] = np.nan
                far = np.where(np.isnan(far), np.inf, far)
                if most is not None:
                    far[far > most] = np.inf
                near = np.isfinite(far)
                if k is not None:
                    # one more than k by distance, then all that tie with the last, so that the ids can decide
                    kth = np.partition(far, min(k, far.shape[1]) - 1, axis=1)[:, min(k, far.shape[1]) - 1]
                    near &= far <= kth[:, None]
                q, r = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(asked).take(pa.array(q)), own.take(pa.array(r)), pa.array(far[q, r])], [query_id, id, "distance"])

        part = base.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if k is None:
        return out
    best = W.partitionBy(query_id).orderBy("distance", id)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def two_stage(rows: DataFrame, query: Sequence[float], k: int, coarse: int, oversample: int = 4, metric: str = "cosine", vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """Matryoshka search: the nearest by the first ``coarse`` dimensions (k times oversample, at least twice k), reranked by all."""
    kind = metric
    first = rows.withColumn("coarse", distance(kind, F.slice(vector, 1, coarse), list(query)[:coarse])).orderBy("coarse", id).limit(k * max(oversample, 2))
    return top_k(first, query, k, metric, vector, id)


def decay(age: Column, kind: str, scale: float, *, half_life: bool = True, start: float = 0.0, steps: Sequence[tuple[float, float]] = ()) -> Column:
    """Weight of an age in seconds: ``exp`` (halves every ``scale``, or exp(-age/scale)), ``linear`` (0 at ``scale``), ``gauss``
    (exp(-(age/scale)^2)) or ``step`` (the factor of the first step that the age does not exceed, else 0). Ages below ``start`` weigh 1."""
    old = F.greatest(age.cast("double") - F.lit(float(start)), F.lit(0.0))
    if kind in ("exp", "exponential"):
        return F.pow(F.lit(0.5), old / F.lit(float(scale))) if half_life else F.exp(-old / F.lit(float(scale)))
    if kind == "linear":
        return F.greatest(F.lit(0.0), F.lit(1.0) - old / F.lit(float(scale)))
    if kind in ("gauss", "gaussian"):
        return F.exp(-F.pow(old / F.lit(float(scale)), 2.0))
    if kind == "step":
        out = F.lit(0.0)
        for most, factor in sorted(steps, reverse=True):
            out = F.when(old <= F.lit(float(most)), F.lit(float(factor))).otherwise(out)
        return out
    raise ValueError(f"unknown decay {kind!r}")


def decayed_top_k(rows: DataFrame, query: Sequence[float], k: int, weight: Column, metric: str = "cosine", vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """The ``k`` rows with the least distance divided by ``weight``; a weight of 0 puts a row last."""
    far = F.when(weight > 0, F.col("distance") / weight).otherwise(F.lit(float(np.finfo(np.float32).max)))
    found = scored(rows, query, metric, vector).withColumn("decayed", far)
    return found.select(id, F.col("decayed").alias("distance")).orderBy("distance", id).limit(k)


def with_scores(found: DataFrame, how: str = "minmax") -> DataFrame:
    """``score`` of a result: ``minmax`` (1 for the nearest, 0 for the farthest, all 1 if equal) or ``inverse`` (1/(1+d))."""
    if how == "inverse":
        return found.withColumn("score", 1 / (1 + F.col("distance")))
    whole = W.partitionBy()  # a result has at most k rows
    low, high = F.min("distance").over(whole), F.max("distance").over(whole)
    return found.withColumn("score", F.when(high > low, 1 - (F.col("distance") - low) / (high - low)).otherwise(1.0))


def mean_vector(rows: DataFrame, vector: str = "embedding") -> list[float]:
    """Element-wise mean, by one aggregation with a row per dimension and task."""
    parts = rows.select(F.posexplode(F.col(vector).cast("array<double>"))).groupBy("pos").agg(F.avg("col").alias("mean"))
    return [r.mean for r in sorted(parts.collect())]  # one row per dimension


def recommend(rows: DataFrame, liked: Sequence, disliked: Sequence, k: int, metric: str = "cosine", vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """Nearest to the mean of the liked minus the disliked (normalised if there are any), without the seeds themselves."""
    if not liked or len(liked) > 100 or len(disliked) > 100:
        raise ValueError("from 1 to 100 liked and up to 100 disliked ids")
    point = np.array(mean_vector(rows.where(F.col(id).isin(list(liked))), vector))
    if disliked:
        point = point - np.array([r[0] for r in rows.where(F.col(id).isin(list(disliked))).select(F.col(vector).cast("array<double>")).collect()]).sum(0)
        norm = np.linalg.norm(point)
        point = point / norm if norm > 0 else point
    return top_k(rows.where(~F.col(id).isin([*liked, *disliked])), point.tolist(), k, metric, vector, id)
