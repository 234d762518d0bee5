"""Sparse vectors (map<int, double>), multi-vectors (array<array<double>>) and similarity over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sparse_dot(v: Column, query: Mapping[int, float]) -> Column:
    """Inner product of a map column and a literal sparse vector; 0 where they share no dimension."""
    total = F.lit(0.0)
    for dim, x in sorted(query.items()):
        total = total + F.coalesce(F.try_element_at(v, F.lit(int(dim))).cast("double"), F.lit(0.0)) * float(x)
    return total


def sparse_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def sparse_scores(rows: DataFrame, query: Mapping[int, float], metric: str = "dot", vector: str = "sparse", id: str = "id") -> DataFrame:
    """id, score of every row by ``dot``, ``cosine`` or ``l2`` distance, unordered. Rows that share no dimension are no hits of the first two;
    null vectors never are."""
    product, norm = sparse_dot(F.col(vector), query), sum(x * x for x in query.values()) ** 0.5
    if metric == "dot":
        score = product
    elif metric == "cosine":
        score = product / F.nullif(sparse_norm(F.col(vector)) * norm, F.lit(0.0))
    else:
        score = F.sqrt(F.greatest(F.pow(sparse_norm(F.col(vector)), 2.0) + norm * norm - 2 * product, F.lit(0.0)))
    rows = rows.where(F.col(vector).isNotNull())
    if metric != "l2":
        rows = rows.where(F.arrays_overlap(F.map_keys(vector), F.array(*[F.lit(int(d)) for d in query])) if query else F.lit(False))
    return rows.select(id, score.alias("score")).where("score is not null")


def sparse_search(rows: DataFrame, query: Mapping[int, float], k: int, metric: str = "dot", vector: str = "sparse", id: str = "id", least: float | None = None) -> DataFrame:
    """The ``k`` rows with the greatest ``dot`` or ``cosine``, or the least ``l2`` distance: id, score (see :func:`sparse_scores`).
    ``least`` is the smallest score that counts."""
    found = sparse_scores(rows, query, metric, vector, id)
    found = found if least is None else found.where(F.col("score") >= least)
    return found.orderBy(F.col("score") if metric == "l2" else F.desc("score"), id).limit(k)


def _product(literal: Column):
    return lambda t: F.aggregate(F.zip_with(t, literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def max_sim(rows: DataFrame, query: Sequence[Sequence[float]], k: int, tokens: str = "tokens", id: str = "id") -> DataFrame:
    """Late interaction: for each query token its greatest inner product with a token of the row, summed up: id, score, best first.

    Rows without tokens are not found."""
    score = F.lit(0.0)
    for q in query:
        literal = F.array(*[F.lit(float(x)) for x in q])
        each = F.transform(tokens, _product(literal))
        score = score + F.array_max(each)
    return rows.where(F.size(tokens) > 0).select(id, score.alias("score")).orderBy(F.desc("score"), id).limit(k)


def fused(dense: DataFrame, sparse: DataFrame, alpha: float, k: int, id: str = "id") -> DataFrame:
    """alpha times the dense distance (id, distance) plus (1 - alpha) times (1 - sparse score / greatest score): id, distance."""
    top = sparse.agg(F.max("score").alias("top"))
    scaled = sparse.join(F.broadcast(top.limit(1)), F.lit(True)).select(id, (F.col("score") / F.nullif("top", F.lit(0.0))).alias("share"))
    rows = dense.join(scaled, id, "left").select(id, (alpha * F.col("distance") + (1 - alpha) * (1 - F.coalesce("share", F.lit(0.0)))).alias("distance"))
    return rows.orderBy("distance", id).limit(k)
