"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import answers, clusters, leaks, mixture, neighbours, quantiles, sentences
from spindrift.llm.tokens import vocabulary
from spindrift.llm.vector_tables import current_vectors, recorded_vectors
from spindrift.plans.feed_queries import DELIVERIES
from spindrift.runtime import cut, small, table


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    found = neighbours.similar_vectors(current_vectors(spark, directory), recorded_vectors(spark, directory), k=10, at_least=0.96)
    return neighbours.pairs_at_least(found)


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    found = clusters.clusters(current_vectors(spark, directory))
    return found.select("collection", found.id.alias("vector_id"), "first_id")


def p2_described(spark: SparkSession, directory: str) -> DataFrame:
    return clusters.described(clusters.clusters(current_vectors(spark, directory)))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return answers.defects(table(spark, directory, "cache_entries"), table(spark, directory, "documents").select("text", "lang"))


P5_KEYS = ["measure", "collection"]
P5_SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
#: The stated bound of the rank error of p5's percentiles, as a share of the values of a group.
P5_RANK_BOUND = 0.01


def _latencies(spark: SparkSession, directory: str) -> DataFrame:
    """measure, collection, day, value of both tables; replays that were written twice count once."""
    asked = table(spark, directory, "recorded_queries").select(F.lit("latency_ms").alias("measure"), "collection", F.to_date("recorded_at").alias("day"), F.col("latency_ms").alias("value"))
    replays = table(spark, directory, "replay_results").groupBy("replay_id", "collection", "new_latency_ms").agg(F.min("replayed_at").alias("at"))
    return asked.unionByName(replays.select(F.lit("new_latency_ms").alias("measure"), "collection", F.to_date("at").alias("day"), F.col("new_latency_ms").alias("value")))


def p5_percentiles(spark: SparkSession, directory: str) -> DataFrame:
    """Latency percentiles by collection of both tables, from the sketches of their tasks."""
    whole = quantiles.merged(quantiles.sketches(_latencies(spark, directory), P5_KEYS, "value"), P5_KEYS)
    return quantiles.percentiles(whole, P5_KEYS, P5_SHARES)


def p5_daily(spark: SparkSession, directory: str) -> DataFrame:
    """The partial results: a sketch by collection and day, to be combined by :func:`quantiles.merged`."""
    keys = [*P5_KEYS, "day"]
    return quantiles.merged(quantiles.sketches(_latencies(spark, directory), keys, "value"), keys)


def p5_by_month(spark: SparkSession, directory: str) -> DataFrame:
    """Sketches of single days and collections, combined to months."""
    keys = ["measure", "month"]
    days = p5_daily(spark, directory)
    months = quantiles.merged(days.select("measure", F.trunc("day", "month").alias("month"), "n", "sketch"), keys)
    return quantiles.percentiles(months, keys, {"p50": 0.5, "p99": 0.99})


def p5_within_bound(spark: SparkSession, directory: str) -> DataFrame:
    """measure, collection, n, within: whether the exact ranks of all five percentiles lie within :data:`P5_RANK_BOUND` of those asked for."""
    rows = _latencies(spark, directory)
    found = small(cut(p5_percentiles(spark, directory).withColumnRenamed("n", "held")))
    value = F.col("value")
    sound = rows.where((value >= 0) & ~F.isnan("value") & (value < float("inf")))
    both = sound.join(found, (sound.measure == found.measure) & sound.collection.eqNullSafe(found.collection)).select(sound.measure, sound.collection, "value", "held", *P5_SHARES)
    width = 2.0**-quantiles.MANTISSA
    counts = both.groupBy(*P5_KEYS).agg(
        F.count("*").alias("n"),
        F.max("held").alias("held"),
        *[F.sum((value < F.col(p) * (1 - width)).cast("int")).alias(f"below_{p}") for p in P5_SHARES],
        *[F.sum((value <= F.col(p) * (1 + width)).cast("int")).alias(f"upto_{p}") for p in P5_SHARES],
    )
    good = F.col("n") == F.col("held")
    for p, share in P5_SHARES.items():
        rank, room = F.ceil(F.lit(share) * F.col("n") - 1e-9), F.ceil(P5_RANK_BOUND * F.col("n"))
        good = good & (F.col(f"below_{p}") - room < rank) & (rank <= F.col(f"upto_{p}") + room)
    return counts.select(*P5_KEYS, "n", good.alias("within"))


def _mixture(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    counts = cut(mixture.token_counts(table(spark, directory, "documents"), vocabulary()))
    plan = cut(mixture.plan(counts, table(spark, directory, "mix_targets")))
    return mixture.mixed(counts, plan), plan


def p8_mixture(spark: SparkSession, directory: str) -> DataFrame:
    """The mixture itself: each use of a document is a row with its text."""
    used, _ = _mixture(spark, directory)
    uses = used.select(F.col("id").alias("doc_id"), "source", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return uses.join(table(spark, directory, "documents").select("doc_id", "text"), "doc_id")


def p8_shares(spark: SparkSession, directory: str) -> DataFrame:
    used, plan = _mixture(spark, directory)
    return mixture.shares(used, plan)


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return leaks.leaks(table(spark, directory, "documents"), table(spark, directory, "eval_items")).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, directory: str) -> DataFrame:
    """Also pairs whose shared runs of five words and more cover half of the item, in whatever order."""
    return leaks.leaks(table(spark, directory, "documents"), table(spark, directory, "eval_items"), seed=5, seed_letters=10, coverage=0.5)


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return sentences.sentence_units(table(spark, directory, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_described": p2_described,
    "p3_found": p3_found,
    "p5_percentiles": p5_percentiles,
    "p5_daily": p5_daily,
    "p5_by_month": p5_by_month,
    "p5_within_bound": p5_within_bound,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
}
ORACLE = {
    "p5_within_bound": """
WITH r AS (SELECT 'latency_ms' AS measure, collection, latency_ms AS value FROM recorded_queries
           UNION ALL SELECT 'new_latency_ms', collection, new_latency_ms FROM (SELECT DISTINCT replay_id, collection, new_latency_ms FROM replay_results))
SELECT measure, collection, count(*) AS n, true AS within FROM r WHERE isfinite(value) AND value >= 0 GROUP BY measure, collection""",
    "p1_found": f"""
WITH {DELIVERIES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY collection, vector_id ORDER BY at_ms DESC, sequence DESC, delivery_id) AS rn
           FROM del WHERE op IN ('upsert', 'delete') AND vector_id IS NOT NULL AND collection IS NOT NULL AND at_ms IS NOT NULL),
drops AS (SELECT collection, max(at_ms) AS dropped FROM del WHERE op = 'dropcollection' GROUP BY collection),
kept AS (SELECT r.delivery_id FROM ranked r LEFT JOIN drops d ON r.collection = d.collection
         WHERE rn = 1 AND op = 'upsert' AND (dropped IS NULL OR at_ms > dropped)),
sound AS (SELECT collection, 'vector' AS kind, vector_id AS id, vector::DOUBLE[] AS v FROM delta_ops JOIN kept USING (delivery_id)
          UNION ALL SELECT collection, 'query', query_id, query::DOUBLE[] FROM recorded_queries),
asked AS (SELECT * FROM sound WHERE len(v) = 64 AND len(list_filter(v, lambda x: isfinite(x))) = 64 AND list_max(list_transform(v, lambda x: abs(x))) > 0),
near AS (SELECT a.collection, a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS s FROM asked a JOIN asked b ON a.collection = b.collection
         WHERE b.kind = 'vector' AND NOT (a.kind = 'vector' AND a.id = b.id)
         QUALIFY row_number() OVER (PARTITION BY a.collection, a.kind, a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) <= 10)
SELECT DISTINCT collection, least(id, other) AS low_id, greatest(id, other) AS high_id FROM near WHERE s >= 0.96""",
}
