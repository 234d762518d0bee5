"""Near-duplicate texts, embedders, search pipelines, semantic caches, sequences of vectors, isolation forests, noise."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.distance import distance
from spindrift.operators import graph
from spindrift.operators.search import batch_top_k
from spindrift.runtime import cut

# ---- near-duplicate chunks ---------------------------------------------------------------------------------------------

SHINGLE, HASHES, BAND = 3, 64, 4
#: Texts of a block of a band; two blocks meet in a task.
BLOCK = 512
_SEEDS = np.random.default_rng(29).integers(1, 2**61 - 1, (2, HASHES), dtype=np.int64).astype(np.uint64)


def char_shingles(text: str) -> set[str]:
    return {text[i : i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1))} if text else set()


def _bands(parts: set[str]) -> list[int]:
    values = np.array([xxhash.xxh32_intdigest(s) for s in parts], np.uint64)
    if not len(values):
        return []
    with np.errstate(over="ignore"):
        signature = ((values[:, None] * _SEEDS[0] + _SEEDS[1]) >> np.uint64(32)).min(0)
    return [xxhash.xxh64_intdigest(signature[i : i + BAND].tobytes(), seed=i) - 2**63 for i in range(0, HASHES, BAND)]


def linked_texts(texts: list[str], least: float, shingles: Callable[[str], set[str]] = char_shingles) -> list[tuple[int, int]]:
    """Places (text, representative) that connect the texts as all pairs with a Jaccard similarity of ``least`` and more do."""
    sets = [shingles(t) for t in texts]
    n = len(sets)
    if n <= 8:
        near = np.zeros((n, n), bool)
        for i in range(n):
            for j in range(i):
                small_one, large = sorted((len(sets[i]), len(sets[j])))
                if small_one >= least * large:
                    shared = len(sets[i] & sets[j])
                    near[i, j] = near[j, i] = shared / (small_one + large - shared) >= least
    else:
        place: dict[str, int] = {}
        at = [np.array([place.setdefault(x, len(place)) for x in s], np.int64) for s in sets]
        size = np.array([len(s) for s in sets], np.float64)
        shared = np.zeros((n, n), np.float64)
        step = 4096
        row, column = np.repeat(np.arange(n), size.astype(np.int64)), np.concatenate(at)
        for low in range(0, len(place), step):
            held = np.zeros((n, step), np.float32)
            own = (column >= low) & (column < low + step)
            held[row[own], column[own] - low] = 1
            shared += held @ held.T
        near = shared / (size[:, None] + size[None] - shared) >= least
    out, seen = [], np.zeros(n, bool)
    for i in range(n):
        if seen[i]:
            continue
        seen[i] = True
        found = [i]
        while found:
            fresh = np.nonzero(near[found.pop()] & ~seen)[0]
            seen[fresh] = True
            found += fresh.tolist()
            out += [(int(j), i) for j in fresh]
    return out


def near_duplicates(chunks: DataFrame, least: float = 0.8, id: str = "id", text: str = "content", shingles: Callable[[str], set[str]] = char_shingles) -> DataFrame:
    """id, canonical of every chunk: the smallest id of those linked to it by a Jaccard similarity of ``shingles`` (of characters, unless others are
    given) of ``least`` and more.

    Equal texts are one node. All pairs of a band are verified on the whole texts: a band of more than BLOCK texts is split into blocks, of which
    each two meet in a task, and the texts' shingles are compared by matrix products. Null texts stand alone."""
    rows = chunks.select(F.col(id).alias("id"), F.col(text).alias("text"))
    nodes = cut(rows.where("text is not null").groupBy("text").agg(F.min("id").alias("node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_bands(shingles(t)) for t in batch.column("text").to_pylist()]
            place = pa.array([i for i, b in enumerate(found) for _ in b], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node").take(place), pa.array([x for b in found for x in b], pa.int64())], ["node", "band"])

    kind = dict(rows.dtypes)["id"]
    banded = cut(nodes.mapInArrow(run, f"node {kind}, band bigint"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = banded.join(shared, "band").withColumn("own", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int"))
    other = F.explode(F.expr("CASE WHEN blocks = 1 THEN array(0) ELSE filter(sequence(0, blocks - 1), x -> x <> own) END"))
    met = placed.withColumn("other", other).select("node", F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("group"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(group: pa.Table) -> pa.RecordBatch:
            found = linked_texts(group.column("text").to_pylist(), least, shingles)
            own = group.column("node").combine_chunks()
            return pa.RecordBatch.from_arrays([own.take(pa.array([p[i] for p in found], pa.int64())) for i in (0, 1)], ["src", "dst"])

        left: pa.Table | None = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            key = whole.column("group").to_numpy()
            starts = np.r_[0, np.nonzero(key[1:] != key[:-1])[0] + 1] if len(key) else np.array([0])
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a > 1:
                    yield links(whole.slice(a, b - a))
            left = whole.slice(int(starts[-1]))  # the last group may go on in the next batch
        if left is not None and len(left) > 1:
            yield links(left)

    ordered = met.join(nodes, "node").select("group", "node", "text").repartition("group").sortWithinPartitions("group")
    linked = cut(ordered.mapInArrow(verify, f"src {kind}, dst {kind}").distinct())
    groups = graph.components(linked.withColumn("weight", F.lit(1.0)))
    named = nodes.join(groups, "node", "left").select("text", F.coalesce("component", "node").alias("canonical"))
    return rows.join(named, "text", "left").select(F.col("id").alias(id), F.coalesce("canonical", "id").alias("canonical"))


# ---- embedders, pipelines, caches -----------------------------------------------------------------------------------------


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """A deterministic embedding without a model: words hashed to signed dimensions, normalised; zero for null and empty texts."""

    @F.arrow_udf("array<float>")
    def embed(t: pa.Array) -> pa.Array:
        out = np.zeros((len(t), width), np.float32)
        for i, s in enumerate(t.to_pylist()):
            for word in (s or "").lower().split():
                h = xxhash.xxh64_intdigest(word)
                out[i, h % width] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out /= np.where(norm > 0, norm, 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * width), pa.array(out.ravel()))

    return embed(text)


Stage = Callable[[DataFrame], DataFrame]


def pipeline(*stages: Stage) -> Stage:
    """Stages (search, filter, rerank, threshold, limit, ...) one after another as one plan."""

    def run(rows: DataFrame) -> DataFrame:
        for stage in stages:
            rows = stage(rows)
        return rows

    return run


def search_stage(query: Sequence[float], k: int, metric: str = "cosine", vector: str = "embedding", id: str = "id") -> Stage:
    return lambda rows: rows.withColumn("distance", distance(metric, F.col(vector), list(query))).where("distance is not null").orderBy("distance", id).limit(k)


def filter_stage(where: Column) -> Stage:
    return lambda rows: rows.where(F.coalesce(where, F.lit(False)))


def threshold_stage(most: float) -> Stage:
    return lambda rows: rows.where(F.col("distance") <= most)


def rerank_stage(score: Column) -> Stage:
    return lambda rows: rows.withColumn("score", score)


def limit_stage(k: int, *order) -> Stage:
    return lambda rows: rows.orderBy(*order).limit(k)


def cached_answers(cache: DataFrame, queries: DataFrame, least: float, vector: str = "embedding", id: str = "vec_id", query_id: str = "query_id") -> DataFrame:
    """query_id, id, similarity of the nearest cached query of each query whose cosine is at least ``least``."""
    near = batch_top_k(cache, queries, 1, "cosine", vector, id, query_id, most=1 - least)
    return near.select(query_id, id, (1 - F.col("distance")).alias("similarity"))


# ---- sequences of vectors ---------------------------------------------------------------------------------------------------


def warped(one: np.ndarray, other: np.ndarray) -> float:
    """Dynamic time warping of two sequences by Euclidean steps."""
    cost = np.linalg.norm(one[:, None] - other[None], axis=2)
    best = np.full((len(one) + 1, len(other) + 1), np.inf)
    best[0, 0] = 0
    for i in range(1, len(one) + 1):
        for j in range(1, len(other) + 1):
            best[i, j] = cost[i - 1, j - 1] + min(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1])
    return float(best[-1, -1])


def frechet(one: np.ndarray, other: np.ndarray) -> float:
    """Discrete Fréchet distance."""
    cost = np.linalg.norm(one[:, None] - other[None], axis=2)
    best = np.full((len(one) + 1, len(other) + 1), np.inf)
    best[0, 0] = 0
    for i in range(1, len(one) + 1):
        for j in range(1, len(other) + 1):
            best[i, j] = max(cost[i - 1, j - 1], min(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1]))
    return float(best[-1, -1])


def sequence_distances(rows: DataFrame, query: Sequence[Sequence[float]], key: str, order: str, vector: str, how: str = "dtw") -> DataFrame:
    """key, distance of every sequence (the vectors of a key in order) to a query sequence."""
    target, measure = np.array(query, float), warped if how == "dtw" else frechet
    sequences = rows.where(F.col(vector).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, vector))).alias("s"))

    @F.pandas_udf("double")
    def far(s):
        import pandas as pd

        return pd.Series([measure(np.array([x[vector] for x in seq], float), target) for seq in s], dtype="float64")

    return sequences.select(key, far(F.col("s")).alias("distance"))


def trend(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """key, n, shift: how far the last vector of each sequence lies from its first."""
    ends = rows.groupBy(key).agg(F.count("*").alias("n"), F.min_by(vector, order).alias("a"), F.max_by(vector, order).alias("b"))
    return ends.select(key, "n", distance("l2", F.col("a"), F.col("b")).alias("shift"))


# ---- anomalies and noise -------------------------------------------------------------------------------------------------------


def isolation_scores(rows: DataFrame, trees: int = 50, sample: int = 256, seed: int = 23, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """id, score (near 1 for outliers): an isolation forest of random trees, each grown on ``sample`` rows of a bounded sample and applied to all."""
    n = rows.count()
    wanted = trees * sample
    taken = rows if n <= wanted else rows.sample(min(1.0, 1.2 * wanted / n), seed=seed).limit(wanted)
    x = np.array([r[0] for r in taken.orderBy(id).select(F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull()).collect()])
    if not len(x):
        return rows.select(id, F.lit(None).cast("double").alias("score"))
    rng = np.random.default_rng(seed)
    harmonic = lambda m: 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m if m > 2 else float(m == 2)

    def grow(part: np.ndarray, depth: int):
        spread = part.max(0) - part.min(0) if len(part) else np.zeros(1)
        if depth == 0 or len(part) <= 1 or not (spread > 0).any():
            return len(part)
        dim = int(rng.choice(np.flatnonzero(spread > 0)))
        at = rng.uniform(part[:, dim].min(), part[:, dim].max())
        return dim, at, grow(part[part[:, dim] < at], depth - 1), grow(part[part[:, dim] >= at], depth - 1)

    size = min(sample, len(x))
    forest = [grow(x[rng.choice(len(x), size, replace=False)], int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)]

    def depths(node, points: np.ndarray, at: np.ndarray, depth: int, out: np.ndarray) -> None:
        if isinstance(node, int):
            out[at] += depth + harmonic(node)
            return
        dim, cut_at, low, high = node
        left = points[at, dim] < cut_at
        if left.any():
            depths(low, points, at[left], depth + 1, out)
        if (~left).any():
            depths(high, points, at[~left], depth + 1, out)

    @F.arrow_udf("double")
    def score(v: pa.Array) -> pa.Array:
        points = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
        total = np.zeros(len(v))
        for tree in forest:
            depths(tree, points, np.arange(len(v)), 0, total)
        return pa.array(2 ** (-(total / trees) / max(harmonic(size), 1e-9)))

    return rows.where(F.col(vector).isNotNull()).select(id, score(vector).alias("score"))


def noisy(value: Column, epsilon: float, sensitivity: float, seed: int) -> Column:
    """A value with Laplace noise of scale sensitivity / epsilon, from a seed."""
    u = F.rand(seed) - 0.5
    return value - (sensitivity / epsilon) * F.signum(u) * F.log(1 - 2 * F.abs(u))
