"""Grouped analytics, aggregates over vectors, outliers and drift."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.distance import block_distances, distance
from spindrift.runtime import beside, cut, small

AGGREGATES = {
    "count": lambda c: F.count(c) if c != "*" else F.count(F.lit(1)),
    "count_distinct": F.countDistinct,
    "approx_count_distinct": F.approx_count_distinct,
    "sum": lambda c: F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)),
    "avg": lambda c: F.avg(F.col(c).cast("double")),
    "min": F.min,
    "max": F.max,
}


def analytics(rows: DataFrame, keys: Sequence[str], aggregates: Mapping[str, tuple[str, str]], where: Column | None = None, having: Column | None = None, order: Sequence = (), limit: int | None = None) -> DataFrame:
    """Group, aggregate (name: (function, column)), filter, order, limit. Without keys there is one group, on an empty table too.

    The sum of no number is 0.0, its mean null."""
    kept = rows if where is None else rows.where(F.coalesce(where, F.lit(False)))
    grouped = kept.groupBy(*keys).agg(*[AGGREGATES[f.lower()](c).alias(name) for name, (f, c) in aggregates.items()])
    grouped = grouped if having is None else grouped.where(having)
    grouped = grouped.orderBy(*order) if order else grouped
    return grouped if limit is None else grouped.limit(limit)


def dimensions(rows: DataFrame, keys: Sequence[str] = (), vector: str = "embedding") -> DataFrame:
    """Statistics by position: keys, pos, n, mean, low, high, spread (population), combined on the map side."""
    return rows.select(*keys, F.posexplode(F.col(vector).cast("array<double>"))).groupBy(*keys, "pos").agg(
        F.count("*").alias("n"), F.avg("col").alias("mean"), F.min("col").alias("low"), F.max("col").alias("high"), F.stddev_pop("col").alias("spread")
    )


def centroids(rows: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """keys, centroid (array<double>): the mean vector of each group."""
    parts = dimensions(rows, keys, vector).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("p"))  # one row per dimension
    return parts.select(*keys, F.transform("p", lambda x: x["mean"]).alias("centroid"))


def to_centroid(rows: DataFrame, keys: Sequence[str], id: str, vector: str = "embedding", metric: str = "l2") -> DataFrame:
    """keys, id, distance of every row to the centroid of its group."""
    means = small(centroids(rows, keys, vector))
    return rows.select(*keys, id, vector).join(means, list(keys)).select(*keys, id, distance(metric, F.col(vector), F.col("centroid")).alias("distance"))


def spread(rows: DataFrame, keys: Sequence[str], id: str, vector: str = "embedding") -> DataFrame:
    """keys, n, spread: the mean squared distance to the centroid."""
    far = to_centroid(rows, keys, id, vector)
    return far.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("distance") * F.col("distance")).alias("spread"))


#: Candidates of all groups whose sums one scan computes.
CANDIDATES = 1_024


def medoids(rows: DataFrame, keys: Sequence[str], id: str, vector: str = "embedding") -> DataFrame:
    """keys, medoid, distance: the member of each group with the least sum of Euclidean distances to the others, ties by the smaller id.

    Exact without all pairs: for a member p with a known sum S(p), the triangle inequality gives S(i) >= abs(n d(i, p) - S(p)) for every i. Each
    round takes the CANDIDATES most promising members of all groups, from the nearest to the centroid on, computes their sums in one scan
    with partial sums where the rows lie, tightens the bounds in another, and drops who can't win any more; it ends when nobody is left. Rows
    without vector don't take part."""
    width = rows.select(F.max(F.size(vector))).first()[0]
    sound_rows = rows.where((F.size(vector) == (width or 0)) & F.forall(vector, lambda x: x.isNotNull()))
    group = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    held = cut(sound_rows.select(*keys, group.alias("_g"), F.col(id).alias("_id"), F.col(vector).cast("array<double>").alias("_v")))
    sizes = held.groupBy("_g").agg(F.count("*").alias("_n"))
    first = to_centroid(held, ["_g"], "_id", "_v").select("_g", "_id", F.col("distance").alias("_order"))
    left = cut(held.join(small(sizes), "_g").join(first, ["_g", "_id"]).withColumn("_bound", F.lit(0.0)))
    known = None
    while True:
        picked = left.orderBy("_bound", "_order", "_id").limit(CANDIDATES).select("_g", "_id", "_v").collect()
        if not picked:
            break
        points: dict[int, tuple[list, np.ndarray]] = {}
        for g in {r._g for r in picked}:
            own = [r for r in picked if r._g == g]
            points[g] = ([r._id for r in own], np.array([r._v for r in own]))
        shipped = rows.sparkSession.sparkContext.broadcast(points)

        def sums(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for g, _, far in _far(batch, shipped.value):
                    total[g] = total.get(g, 0.0) + far.sum(0)
            flat = [(g, i, s) for g, t in total.items() for i, s in enumerate(t.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.int32()), pa.array([f[2] for f in flat], pa.float64())], ["_g", "_i", "_s"])

        found = held.select("_g", "_v").mapInArrow(sums, "_g bigint, _i int, _s double").groupBy("_g", "_i").agg(F.sum("_s").alias("s")).collect()  # one row per candidate
        totals = {g: np.zeros(len(p[0])) for g, p in points.items()}
        for r in found:
            totals[r._g][r._i] = r.s
        new = [(g, points[g][0][i], float(s)) for g, t in totals.items() for i, s in enumerate(t)]
        new = rows.sparkSession.createDataFrame(new, f"_g bigint, _id {dict(held.dtypes)['_id']}, _s double")
        known = cut(new if known is None else known.unionByName(new))
        best = known.groupBy("_g").agg(F.min("_s").alias("_best"))
        whole = rows.sparkSession.sparkContext.broadcast((points, totals))

        def tighten(batches: Iterator[pa.RecordBatch], whole=whole) -> Iterator[pa.RecordBatch]:
            at, known_sums = whole.value
            for batch in batches:
                bound = batch.column("_bound").to_numpy().copy()
                n = batch.column("_n").to_numpy()
                for g, place, far in _far(batch, at):
                    bound[place] = np.maximum(bound[place], np.abs(n[place][:, None] * far - known_sums[g]).max(1))
                columns = [batch.column(c) if c != "_bound" else pa.array(bound) for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema)
        open_ones = left.join(known.select("_g", "_id"), ["_g", "_id"], "left_anti").select(*left.columns).mapInArrow(tighten, schema)
        left = cut(open_ones.join(small(best), "_g", "left").where(F.col("_best").isNull() | (F.col("_bound") <= F.col("_best") * (1 + 1e-9))).select(*left.columns))
    if known is None:
        return held.limit(0).select(*keys, F.col("_id").alias("medoid"), F.lit(0.0).alias("distance"))
    least = known.groupBy("_g").agg(F.min(F.struct(F.round("_s", 9).alias("_s"), "_id")).alias("b")).select("_g", F.col("b._id").alias("_id"), F.col("b._s").alias("distance"))
    return held.join(least, ["_g", "_id"]).select(*keys, F.col("_id").alias("medoid"), "distance")


def _far(batch: pa.RecordBatch, points: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, places of its rows in the batch, their distances to the group's points) for the groups that have points."""
    groups = batch.column("_g").to_numpy()
    x = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, 1))
    for g in np.unique(groups):
        if int(g) in points:
            place = np.flatnonzero(groups == g)
            yield int(g), place, np.sqrt(np.maximum(block_distances("l2sq", points[int(g)][1], x[place]), 0))


def distribution(distances: DataFrame, bins: int, keys: Sequence[str] = (), column: str = "distance") -> DataFrame:
    """keys, bin, n, mean, deviation (population): equal widths between the least and the greatest value of each group."""
    stats = distances.groupBy(*keys).agg(F.min(column).alias("_low"), F.max(column).alias("_high"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("deviation"))
    rows = distances.join(small(stats), list(keys)) if keys else beside(distances, stats)
    wide = F.col("_high") > F.col("_low")
    place = F.when(wide, F.least(F.floor((F.col(column) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * bins), F.lit(bins - 1))).otherwise(0)
    return rows.groupBy(*keys, place.cast("int").alias("bin"), "mean", "deviation").agg(F.count("*").alias("n"))


def histogram(distances: DataFrame, bins: int, column: str = "distance") -> DataFrame:
    """bin, n over equal widths between the least and the greatest value; the greatest falls in the last bin."""
    ends = distances.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    x = beside(distances, ends)
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col(column) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    return x.select(place.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def zscore_outliers(distances: DataFrame, threshold: float, keys: Sequence[str] = (), column: str = "distance") -> DataFrame:
    """Rows more than ``threshold`` population deviations from the mean of their group; groups of two rows and fewer have none.

    The statistics are aggregated and joined, not windowed, so that a large group isn't gathered."""
    stats = distances.groupBy(*keys).agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"), F.count("*").alias("c"))
    rows = distances.join(small(stats), list(keys)) if keys else beside(distances, stats)
    return rows.withColumn("z", (F.col(column) - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).where((F.col("c") > 2) & (F.abs("z") > threshold)).drop("m", "s", "c")


def iqr_outliers(rows: DataFrame, column: str, factor: float = 1.5, keys: Sequence[str] = ()) -> DataFrame:
    """Rows outside the quartiles by more than ``factor`` times their distance (exact quartiles, interpolated)."""
    q = rows.groupBy(*keys).agg(F.expr(f"percentile({column}, array(0.25, 0.75))").alias("q"))
    x = rows.join(small(q), list(keys)) if keys else beside(rows, q)
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return x.where((F.col(column) < low - factor * (high - low)) | (F.col(column) > high + factor * (high - low))).drop("q")


def running_sums(rows: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """``rows`` with each of ``columns`` replaced by its sum up to the row in the order of a column of distinct values.

    No task sees all rows: they are range-partitioned and summed up within each partition, and the sums of the earlier partitions (one row per
    partition) are added."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    held = spread.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    earlier = held.select("_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    summed = spread.select("_part", order, *[F.sum(c).over(inside).alias(c) for c in columns])
    return summed.join(small(earlier), "_part").select(order, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in columns])


def ks_statistic(one: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """One row: statistic, the greatest difference of the two empirical distributions. Equal values are aggregated first."""
    counts = one.select(F.col(column).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(other.select(F.col(column).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    steps = counts.where("x is not null").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = steps.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    run = beside(running_sums(steps, "x", ["a", "b"]), total)
    return run.agg(F.max(F.abs(F.col("a") / F.col("na") - F.col("b") / F.col("nb"))).alias("statistic"))


def drift(one: DataFrame, other: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: centroid_shift (cosine distance of the means), mean_shift and variance_ratio by dimension, n_one, n_other."""
    a = dimensions(one, (), vector).select("pos", F.col("mean").alias("ma"), F.col("spread").alias("sa"), F.col("n").alias("na"))
    b = dimensions(other, (), vector).select("pos", F.col("mean").alias("mb"), F.col("spread").alias("sb"), F.col("n").alias("nb"))
    size = F.sqrt(F.sum(F.col("ma") * F.col("ma"))) * F.sqrt(F.sum(F.col("mb") * F.col("mb")))
    return a.join(b, "pos").agg(
        (1 - F.sum(F.col("ma") * F.col("mb")) / F.nullif(size, F.lit(0.0))).alias("centroid_shift"),
        F.avg(F.abs(F.col("ma") - F.col("mb"))).alias("mean_shift"),
        (F.sum(F.col("sb") * F.col("sb")) / F.nullif(F.sum(F.col("sa") * F.col("sa")), F.lit(0.0))).alias("variance_ratio"),
        F.max("na").alias("n_one"),
        F.max("nb").alias("n_other"),
    )


def retrieval_metrics(found: DataFrame, relevant: DataFrame, k: int, query: str = "query_id", id: str = "id") -> DataFrame:
    """query, precision, recall, reciprocal_rank, ndcg (binary), average_precision of ranked results (query, id, rank) against relevant pairs (query, id)."""
    wanted = relevant.select(query, id).distinct()
    total = wanted.groupBy(query).agg(F.count("*").alias("n_relevant"))
    hits = found.where(F.col("rank") <= k).join(wanted.withColumn("hit", F.lit(1)), [query, id], "left")
    ln2 = lambda c: F.log(c) / F.log(F.lit(2.0))
    # the precision at each hit: hits up to it (at most k rows per query) divided by its rank
    seen = F.sum(F.coalesce("hit", F.lit(0))).over(W.partitionBy(query).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    hits = hits.withColumn("gain", F.when(F.col("hit") == 1, seen / F.col("rank")).otherwise(0.0))
    per = hits.groupBy(query).agg(
        F.sum("gain").alias("gain"),
        F.sum(F.coalesce("hit", F.lit(0))).alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit") == 1, 1 / ln2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / ln2(i + 1.0))
    rows = total.join(per, query, "left").fillna(0, ["hits", "dcg", "gain"])
    return rows.select(
        query, (F.col("hits") / k).alias("precision"), (F.col("hits") / F.col("n_relevant")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("dcg") / ideal).alias("ndcg"),
        (F.col("gain") / F.least("n_relevant", F.lit(k))).alias("average_precision"),
    )


def field_statistics(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, n, n_null, n_distinct (exact) of several columns, in one pass with map-side combination by value."""
    pieces = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    values = rows.select(pieces).select("x.field", "x.value").groupBy("field", "value").agg(F.count("*").alias("n"))
    return values.groupBy("field").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.count("value").alias("n_distinct"))
