"""Quantisers, inverted-file search, k-means, principal components and recommendations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.distance import block_distances
from spindrift.functions.distance import metric as known
from spindrift.operators.aggregates import dimensions
from spindrift.operators.search import QUERY_BLOCK
from spindrift.runtime import cut, small


def bounds(rows: DataFrame, vector: str = "embedding") -> list[tuple[float, float, float]]:
    """(low, high, mean) of each dimension; one row per dimension comes to the driver."""
    return [(r.low, r.high, r.mean) for r in dimensions(rows, (), vector).orderBy("pos").collect()]


def _rows(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def scalar_codes(v: Column, limits: Sequence[tuple[float, float, float]]) -> Column:
    """Each dimension as an integer from 0 to 255 between its bounds (truncated, clamped; 0 where the bounds meet). Vectors have the width of the bounds."""
    low, high = (np.array([x[i] for x in limits]) for i in (0, 1))

    @F.arrow_udf("array<smallint>")
    def codes(x: pa.Array) -> pa.Array:
        scaled = np.floor((_rows(x) - low) / np.where(high > low, high - low, 1) * 255)
        flat = np.clip(scaled, 0, 255).astype(np.int16).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(low)), pa.array(flat))

    return codes(v)


def scalar_distance(codes: Column, limits: Sequence[tuple[float, float, float]], query: Sequence[float]) -> Column:
    """Euclidean distance of a query to decoded codes."""
    low, high = (np.array([x[i] for x in limits]) for i in (0, 1))
    point = np.array(query)

    @F.arrow_udf("double")
    def far(x: pa.Array) -> pa.Array:
        return pa.array(np.sqrt(((low + _rows(x) / 255 * (high - low) - point) ** 2).sum(1)))

    return far(codes)


def binary_codes(v: Column, limits: Sequence[tuple[float, float, float]]) -> Column:
    """Words of up to 63 bits, a bit per dimension: whether it exceeds its mean."""
    means = np.array([x[2] for x in limits])
    n_words = -(-len(means) // 63)

    @F.arrow_udf("array<bigint>")
    def codes(x: pa.Array) -> pa.Array:
        bits = _rows(x) > means
        words = [(bits[:, 63 * w : 63 * w + 63] * (np.int64(1) << np.arange(min(63, len(means) - 63 * w)))).sum(1) for w in range(n_words)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n_words), pa.array(np.stack(words, 1).ravel()))

    return codes(v)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two codes differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def kmeans(rows: DataFrame, k: int, vector: str = "embedding", id: str = "vec_id", seed: int = 42, iterations: int = 20) -> tuple[DataFrame, list[list[float]]]:
    """(id, cluster) and the centroids, by distributed Lloyd iterations from k-means||."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.where(F.col(vector).isNotNull()).select(id, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations, tol=1e-4, featuresCol="features", predictionCol="cluster").fit(data)
    return model.transform(data).select(id, "cluster"), [list(map(float, c)) for c in model.clusterCenters()]


def assigned(rows: DataFrame, centres: Sequence[Sequence[float]], vector: str = "embedding") -> DataFrame:
    """``rows`` with ``cluster``, the nearest of a bounded list of centroids, by matrix products over Arrow batches."""
    points = np.array(centres, np.float64)

    @F.pandas_udf("int")
    def nearest(v):
        import pandas as pd

        x = np.stack(v.to_numpy()).astype(np.float64)
        return pd.Series(((points**2).sum(1) - 2 * x @ points.T).argmin(1).astype(np.int32))

    return rows.where(F.col(vector).isNotNull()).withColumn("cluster", nearest(vector))


def _query_blocks(queries: DataFrame, query_id: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """A stated set of queries in blocks of QUERY_BLOCK: ids and vectors."""
    ids, vectors = [], []
    for q in queries.select(query_id, vector).where(F.col(vector).isNotNull()).orderBy(query_id).toLocalIterator():
        ids.append(q[0])
        vectors.append(q[1])
        if len(ids) == QUERY_BLOCK:
            yield ids, np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield ids, np.array(vectors, np.float64)


def _nearest_of_batches(rows: DataFrame, queries: DataFrame, k: int, far, columns: Sequence[str], id: str, query_id: str, vector: str) -> DataFrame:
    """query_id, id, distance, rank of the ``k`` nearest of each query by ``far`` (batch, queries' vectors) -> (query, row), infinite where a row isn't searched."""
    schema = f"`{query_id}` {dict(queries.dtypes)[query_id]}, `{id}` {dict(rows.dtypes)[id]}, distance double"
    out = rows.sparkSession.createDataFrame([], schema)
    for block in _query_blocks(queries, query_id, vector):
        shipped = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            asked, points = shipped.value
            for batch in batches:
                if not len(batch):
                    continue
                apart = far(batch, points)
                kth = np.partition(apart, min(k, len(batch)) - 1, axis=1)[:, min(k, len(batch)) - 1]
                q, r = np.nonzero((apart <= kth[:, None]) & np.isfinite(apart))
                yield pa.RecordBatch.from_arrays([pa.array(asked).take(pa.array(q)), batch.column(id).take(pa.array(r)), pa.array(apart[q, r])], [query_id, id, "distance"])

        out = out.unionByName(rows.where(F.col(vector).isNotNull()).select(id, *columns).mapInArrow(run, schema))
    best = W.partitionBy(query_id).orderBy("distance", id)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ivf_search(lists: DataFrame, centres: Sequence[Sequence[float]], queries: DataFrame, k: int, n_probe: int = 8, metric: str = "l2", vector: str = "embedding", id: str = "vec_id", query_id: str = "query_id") -> DataFrame:
    """The ``k`` nearest of each query (query_id, vector) within its ``n_probe`` nearest lists of a table that holds ``cluster``: query_id, id, distance, rank."""
    points, kind = np.array(centres, np.float64), known(metric)

    def far(batch: pa.RecordBatch, asked: np.ndarray) -> np.ndarray:
        values, own = _rows(batch.column(vector)), batch.column("cluster").to_numpy()
        probed = np.zeros((len(asked), len(points)), bool)
        order = np.argsort((points**2).sum(1) - 2 * asked @ points.T, axis=1, kind="stable")[:, :n_probe]
        np.put_along_axis(probed, order, True, axis=1)
        out = np.full((len(asked), len(values)), np.inf)
        for c in np.unique(own):
            q, r = np.nonzero(probed[:, c])[0], np.nonzero(own == c)[0]
            out[np.ix_(q, r)] = block_distances(kind, values[r], asked[q])
        return np.where(np.isnan(out), np.inf, out)

    return _nearest_of_batches(lists, queries, k, far, ["cluster", vector], id, query_id, vector)


def product_codebooks(rows: DataFrame, parts: int, size: int = 256, vector: str = "embedding", sample: int = 20_000, seed: int = 3) -> np.ndarray:
    """Centroids (parts, size, width / parts) of the sub-vectors, fitted on a bounded sample of ``sample`` rows."""
    n = rows.count()
    taken = rows if n <= sample else rows.sample(min(1.0, 1.1 * sample / n), seed=seed).limit(sample)
    x = np.array([r[0] for r in taken.select(F.col(vector).cast("array<double>")).collect()])
    books = []
    rng = np.random.default_rng(seed)
    for piece in np.split(x, parts, axis=1):
        c = piece[rng.choice(len(piece), size, replace=len(piece) < size)].copy()
        for _ in range(20):
            own = ((c**2).sum(1) - 2 * piece @ c.T).argmin(1)
            for j in range(size):
                if (own == j).any():
                    c[j] = piece[own == j].mean(0)
        books.append(c)
    return np.stack(books)


def product_search(rows: DataFrame, books: np.ndarray, queries: DataFrame, k: int, oversample: int = 10, vector: str = "embedding", id: str = "vec_id", query_id: str = "query_id") -> DataFrame:
    """The ``k`` nearest of each query (query_id, vector): of the ``k * oversample`` nearest by the product-quantised rows (tables of partial
    distances) those that are nearest by Euclidean distance: query_id, id, distance, rank."""
    parts, _, width = books.shape

    def far(batch: pa.RecordBatch, asked: np.ndarray) -> np.ndarray:
        x = _rows(batch.column(vector)).reshape(len(batch), parts, width)
        total = np.zeros((len(asked), len(batch)))
        for p in range(parts):
            size = (books[p] ** 2).sum(1)
            own = asked[:, p * width : (p + 1) * width]
            table = size - 2 * own @ books[p].T + (own**2).sum(1)[:, None]
            total += table[:, (size - 2 * x[:, p] @ books[p].T).argmin(1)]
        return total

    @F.arrow_udf("double")
    def exact(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.sqrt(((_rows(a) - _rows(b)) ** 2).sum(1)))

    first = cut(_nearest_of_batches(rows, queries, k * oversample, far, [vector], id, query_id, vector).select(query_id, id))
    both = rows.select(id, vector).join(small(first), id).join(small(queries.select(query_id, F.col(vector).alias("asked"))), query_id)
    best = W.partitionBy(query_id).orderBy("distance", id)
    return both.select(query_id, id, exact(vector, "asked").alias("distance")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def principal_components(rows: DataFrame, k: int, vector: str = "embedding", id: str = "vec_id") -> tuple[DataFrame, list[float]]:
    """(id, components: array of k) and the explained shares."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.where(F.col(vector).isNotNull()).select(id, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="reduced").fit(data)
    return model.transform(data).select(id, vector_to_array("reduced").alias("components")), [float(x) for x in model.explainedVariance]


def random_projection(v: Column, width: int, k: int, seed: int = 5) -> Column:
    """A vector of ``width`` projected to ``k`` dimensions by a Gaussian matrix from a seed."""
    m = np.random.default_rng(seed).normal(size=(k, width)) / np.sqrt(k)

    @F.arrow_udf("array<double>")
    def project(x: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array((_rows(x) @ m.T).ravel()))

    return project(v)


#: Weights of interactions.
INTERACTIONS = {"view": 0.1, "click": 1.0, "search": 0.5, "signup": 3.0, "purchase": 5.0}


def recommendations(interactions: DataFrame, user: str, item: str, weight: str, k: int, seed: int = 11, rank: int = 8) -> DataFrame:
    """user, item, score: the ``k`` best items per user by implicit-feedback alternating least squares."""
    from pyspark.ml.recommendation import ALS

    data = interactions.select(F.col(user).cast("int").alias("u"), F.col(item).cast("int").alias("i"), F.col(weight).cast("float").alias("w")).groupBy("u", "i").agg(F.sum("w").alias("w"))
    model = ALS(userCol="u", itemCol="i", ratingCol="w", implicitPrefs=True, rank=rank, maxIter=5, seed=seed, coldStartStrategy="drop").fit(data)
    return model.recommendForAllUsers(k).select(F.col("u").alias(user), F.explode("recommendations").alias("r")).select(user, F.col("r.i").alias(item), F.col("r.rating").alias("score"))
