"""Queries of serving, analytics over groups and windows, joins, time, lineage, streams with late rows and declared pipelines, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.filters import Json, compile_filter
from spindrift.functions.times import parse_time
from spindrift.operators import aggregates, fusion, search, serving, text, versions
from spindrift.plans.vector_queries import _DIST, _E, _Q, vector_of, vectors
from spindrift.plans.verb_queries import scratch
from spindrift.runtime import table
from spindrift.streaming import changes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def r6(name: str = "distance"):
    return F.round(name, 6).alias(name)


# ---- search -------------------------------------------------------------------------------------------------------------

_MAIN = f"{_Q}, {_E}"


@query("delta_search", f"WITH {_MAIN}, m AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM e WHERE vec_id % 11 <> 1) SELECT vec_id, round(list_cosine_distance(m.v, q.v), 6) AS distance FROM m, q ORDER BY list_cosine_distance(m.v, q.v), vec_id LIMIT 10")
def delta_search(spark, directory):
    """A search over a main part and a later delta that replaces some rows and deletes others."""
    rows = vectors(spark, directory).select("vec_id", "embedding")
    changed = rows.where("vec_id % 7 = 0 or vec_id % 11 = 1").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"), (F.col("vec_id") % 11 == 1).alias("gone"))
    return search.top_k(serving.with_delta(rows, changed, deleted=F.col("gone")), vector_of(spark, directory), 10).select("vec_id", r6())


@query("tiered_search", f"WITH {_MAIN} SELECT vec_id, CASE WHEN label < 3 THEN 'hot' ELSE 'cold' END AS tier, round({_DIST['cosine']}, 6) AS distance FROM e, q WHERE label < 8 ORDER BY {_DIST['cosine']}, vec_id LIMIT 10")
def tiered_search(spark, directory):
    """A hot and a cold store that share some rows."""
    rows = vectors(spark, directory)
    return serving.tiered(rows.where("label < 3"), rows.where("label between 2 and 7"), vector_of(spark, directory), 10).select("vec_id", "tier", r6())


_RING = "p AS (SELECT s AS shard, i, ('0x' || substring(md5(s || '#' || i), 1, 15))::BIGINT AS place FROM (SELECT unnest(['a', 'b', 'c']) AS s), (SELECT unnest(range(64)) AS i))"


@query("shard_routing", f"WITH {_RING}, h AS (SELECT vec_id, ('0x' || substring(md5(vec_id::VARCHAR), 1, 15))::BIGINT AS own FROM embeddings) SELECT vec_id, coalesce((SELECT arg_min(shard, place) FROM p WHERE place >= own), (SELECT arg_min(shard, place) FROM p)) AS shard FROM h")
def shard_routing(spark, directory):
    return serving.routed(vectors(spark, directory).select("vec_id"), "vec_id", ["a", "b", "c"])


@query("sharded_search", f"WITH {_MAIN} SELECT vec_id, round({_DIST['l2']}, 6) AS distance FROM e, q ORDER BY {_DIST['l2']}, vec_id LIMIT 10")
def sharded_search(spark, directory):
    """Rows routed to shards, the nearest of each shard, merged."""
    rows = serving.routed(search.scored(vectors(spark, directory), vector_of(spark, directory), "l2").select("vec_id", "distance"), "vec_id", ["a", "b", "c"])
    best = fusion.ranked(rows.select(F.col("shard").alias("source"), F.col("vec_id").alias("id"), "distance")).where("rank <= 10")
    return fusion.nearest_of(best, 10).select(F.col("id").alias("vec_id"), r6())


@query("hybrid_exact_search", f"WITH {_MAIN} SELECT vec_id, 'exact' AS strategy, 1.0::DOUBLE AS recall FROM e, q ORDER BY {_DIST['l2']}, vec_id LIMIT 10")
def hybrid_exact_search(spark, directory):
    """The adaptive strategy over a collection small enough for an exact search."""
    rows = vectors(spark, directory)
    return serving.hybrid_search(rows, None, None, vector_of(spark, directory), 10).select("vec_id", "strategy", "recall")


@query("hybrid_verified_search", "SELECT 10::BIGINT AS n, true AS good")
def hybrid_verified_search(spark, directory):
    """An approximate search verified against the exact one: its number of rows, and whether its recall is at least 0.9."""
    from spindrift.operators import quantize

    rows = vectors(spark, directory)
    _, centres = quantize.kmeans(rows, 16)
    found = serving.hybrid_search(rows, quantize.assigned(rows, centres), centres, vector_of(spark, directory), 10, "verified", n_probe=14)
    return found.agg(F.count("*").alias("n"), (F.min("recall") >= 0.9).alias("good"))


@query("search_trace", "SELECT count(*) AS scanned, count(*) FILTER (label < 4) AS passed, count(*) FILTER (label < 4) AS measured, least(count(*) FILTER (label < 4), 10) AS returned FROM embeddings")
def search_trace(spark, directory):
    return serving.traced(vectors(spark, directory), vector_of(spark, directory), 10, F.col("label") < 4)


@query("radius_filtered", f"WITH {_MAIN} SELECT vec_id, round({_DIST['cosine']}, 6) AS distance FROM e, q WHERE label IN (1, 2) AND {_DIST['cosine']} <= 0.9 ORDER BY {_DIST['cosine']}, vec_id LIMIT 25")
def radius_filtered(spark, directory):
    return search.radius(vectors(spark, directory), vector_of(spark, directory), 0.9, 25, where=F.col("label").isin(1, 2)).select("vec_id", r6())


@query("topk_cosine_unit", f"WITH {_MAIN}, n AS (SELECT vec_id, list_transform(e.v, lambda x: x / sqrt(list_inner_product(e.v, e.v))) AS v FROM e) SELECT vec_id, round(1 - list_inner_product(n.v, (SELECT v FROM n WHERE vec_id = 0)), 6) AS distance FROM n ORDER BY 1 - list_inner_product(n.v, (SELECT v FROM n WHERE vec_id = 0)), vec_id LIMIT 10")
def topk_cosine_unit(spark, directory):
    """Cosine distance of vectors that were normalised before."""
    from spindrift.functions.distance import normalized

    rows = vectors(spark, directory).select("vec_id", normalized(F.col("embedding")).alias("embedding"))
    q = [float(x) for x in rows.where("vec_id = 0").first().embedding]
    return search.top_k(rows, q, 10, "cosine_unit").select("vec_id", r6())


@query("distance_widths", "SELECT vec_id, vec_id % 3 = 0 AS measured FROM embeddings")
def distance_widths(spark, directory):
    """Vectors as wide as the query, wider and narrower: only the first have a distance, by every metric."""
    from spindrift.functions.distance import distance

    q = vector_of(spark, directory)[:12]
    width = F.when(F.col("vec_id") % 3 == 0, 12).when(F.col("vec_id") % 3 == 1, 20).otherwise(5)
    rows = vectors(spark, directory).select("vec_id", F.slice("embedding", F.lit(1), width).alias("v"))
    seen = [distance(m, F.col("v"), q).isNotNull() for m in ("cosine", "l2", "dot", "l1", "linf", "hamming")]
    both = seen[0]
    for one in seen[1:]:
        both = F.when(both == one, both)  # null where two metrics disagree
    return rows.select("vec_id", both.alias("measured"))


@query("half_precision", "SELECT vec_id, true AS f16, true AS bf16 FROM embeddings")
def half_precision(spark, directory):
    """16-bit vectors lie within a relative 2^-11 (f16) and 2^-8 (bf16) of the originals."""
    rows = vectors(spark, directory).select("vec_id", "embedding", serving.half(F.col("embedding")).alias("h"), serving.half(F.col("embedding"), "bf16").alias("b"))
    near = lambda c, share: F.forall(F.zip_with("embedding", c, lambda x, y: F.abs(x - y) <= F.abs(x) * share + 1e-7), lambda t: t)
    return rows.select("vec_id", near("h", 2.0**-11).alias("f16"), near("b", 2.0**-8).alias("bf16"))


@query("decay_score", f"WITH {_Q}, {_E}, a AS (SELECT e.vec_id, e.v, epoch(TIMESTAMP '2024-02-01') - epoch(x.ts) AS age FROM e JOIN events x ON x.event_id = e.vec_id) SELECT vec_id, round((1 - list_cosine_distance(a.v, q.v)) * exp(-pow(greatest(age, 0) / 1209600.0, 2)), 6) AS score FROM a, q ORDER BY (1 - list_cosine_distance(a.v, q.v)) * exp(-pow(greatest(age, 0) / 1209600.0, 2)) DESC, vec_id LIMIT 10")
def decay_score(spark, directory):
    """Similarity times decay, greatest first."""
    from spindrift.plans.vector_queries import _aged

    rows = search.scored(_aged(spark, directory), vector_of(spark, directory))
    score = (1 - F.col("distance")) * search.decay(F.col("age"), "gauss", 14 * 86_400.0)
    return rows.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", r6("score"))


@query("multi_query_rrf", f"WITH {_E}, a AS (SELECT vec_id AS source, v FROM e WHERE vec_id IN (0, 1, 2)), l AS (SELECT a.source, e.vec_id AS id, row_number() OVER (PARTITION BY a.source ORDER BY list_cosine_distance(e.v, a.v), e.vec_id) AS rank FROM e, a QUALIFY rank <= 20) SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) AS n_sources FROM l GROUP BY id")
def multi_query_rrf(spark, directory):
    """Three wordings of one question, their results fused by rank."""
    rows = vectors(spark, directory)
    asked = rows.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    lists = search.batch_top_k(rows, asked, 20).select(F.col("query_id").alias("source"), F.col("vec_id").alias("id"), "distance")
    return fusion.rrf(lists).select("id", r6("score"), "n_sources")


@query("rerank_ensemble", f"WITH {_MAIN}, t AS (SELECT vec_id AS id, e.v, q.v AS w FROM e, q ORDER BY {_DIST['cosine']}, vec_id LIMIT 30), r AS (SELECT id, row_number() OVER (ORDER BY list_cosine_distance(v, w), id) AS a, row_number() OVER (ORDER BY list_max(list_transform(range(1, 65), lambda i: abs(v[i] - w[i]))), id) AS b FROM t) SELECT id, round(0.7 / (60 + a) + 0.3 / (60 + b), 6) AS score FROM r")
def rerank_ensemble(spark, directory):
    """The nearest rows, ordered by two rerankers of different weight."""
    from spindrift.functions.distance import distance

    q, rows = vector_of(spark, directory), vectors(spark, directory)
    top = search.top_k(rows, q, 30, keep=["embedding"])
    lists = top.select(F.lit("cosine").alias("source"), F.col("vec_id").alias("id"), "distance").unionByName(top.select(F.lit("linf").alias("source"), F.col("vec_id").alias("id"), distance("linf", F.col("embedding"), q).alias("distance")))
    return fusion.rrf(lists, weights={"cosine": 0.7, "linf": 0.3}).select("id", r6("score"))


@query("rerank_bandit", f"WITH {_MAIN} SELECT vec_id AS id, true AS inside FROM e, q ORDER BY {_DIST['cosine']}, vec_id LIMIT 20")
def rerank_bandit(spark, directory):
    """The nearest rows in the order of draws from their Beta distributions; the draws lie between 0 and 1 and a second run repeats them."""
    hits = search.top_k(vectors(spark, directory), vector_of(spark, directory), 20).select(F.col("vec_id").alias("id"))
    one = serving.thompson(hits.withColumn("alpha", F.col("id") % 5 + 1).withColumn("beta", F.lit(2)))
    two = serving.thompson(hits.withColumn("alpha", F.col("id") % 5 + 1).withColumn("beta", F.lit(2))).select("id", F.col("score").alias("again"))
    return one.join(two, "id").select("id", ((F.col("score") > 0) & (F.col("score") < 1) & (F.col("score") == F.col("again"))).alias("inside"))


@query("maxsim_two_stage", f"WITH {_E}, t AS (SELECT vec_id AS id, j, v[j * 16 + 1 : j * 16 + 16] AS t FROM e, range(0, 4) r(j)), c AS (SELECT id, list(m ORDER BY i) AS c FROM (SELECT id, i, avg(t[i]) AS m FROM t, range(1, 17) x(i) GROUP BY id, i) GROUP BY id), f AS (SELECT c.id FROM c, (SELECT c FROM c WHERE id = 0) q ORDER BY round(list_inner_product(c.c, q.c), 9) DESC, c.id LIMIT 40), m AS (SELECT b.id, a.j, max(list_inner_product(a.t, b.t)) AS m FROM t a, t b WHERE a.id = 0 AND b.id IN (SELECT id FROM f) GROUP BY b.id, a.j) SELECT id, round(sum(m), 6) AS score FROM m GROUP BY id ORDER BY sum(m) DESC, id LIMIT 10")
def maxsim_two_stage(spark, directory):
    q = vector_of(spark, directory)
    return serving.two_stage_max_sim(_tokens(spark, directory), [q[16 * j : 16 * j + 16] for j in range(4)], 10).select("id", r6("score"))


def _tokens(spark: SparkSession, directory: str) -> DataFrame:
    return vectors(spark, directory).select(F.col("vec_id").alias("id"), F.array(*[F.slice("embedding", 16 * j + 1, 16) for j in range(4)]).alias("tokens"))


@query("maxsim_explained", f"WITH {_E}, t AS (SELECT vec_id AS id, j, v[j * 16 + 1 : j * 16 + 16] AS t FROM e, range(0, 4) r(j)) SELECT b.id, a.j::INT AS query_token, arg_max(b.j, list_inner_product(a.t, b.t))::INT AS token, round(max(list_inner_product(a.t, b.t)), 6) AS similarity FROM t a, t b WHERE a.id = 0 GROUP BY b.id, a.j")
def maxsim_explained(spark, directory):
    q = vector_of(spark, directory)
    return serving.matched_tokens(_tokens(spark, directory), [q[16 * j : 16 * j + 16] for j in range(4)]).select("id", "query_token", "token", r6("similarity"))


@query("multimodal_search", f"WITH {_MAIN} SELECT vec_id AS id, round((2 * (1 - list_cosine_distance(e.v[1:32], q.v[1:32])) + CASE WHEN vec_id % 4 <> 0 THEN 1 - list_cosine_distance(e.v[33:64], q.v[33:64]) ELSE 0 END) / (CASE WHEN vec_id % 4 <> 0 THEN 3 ELSE 2 END), 6) AS score FROM e, q ORDER BY (2 * (1 - list_cosine_distance(e.v[1:32], q.v[1:32])) + CASE WHEN vec_id % 4 <> 0 THEN 1 - list_cosine_distance(e.v[33:64], q.v[33:64]) ELSE 0 END) / (CASE WHEN vec_id % 4 <> 0 THEN 3 ELSE 2 END) DESC, vec_id LIMIT 10")
def multimodal_search(spark, directory):
    """Two modalities, of which a quarter of the rows lack one."""
    q = vector_of(spark, directory)
    rows = vectors(spark, directory).select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 32).alias("text"), F.when(F.col("vec_id") % 4 != 0, F.slice("embedding", 33, 32)).alias("image"))
    return serving.multimodal(rows, {"text": q[:32], "image": q[32:]}, 10, {"text": 2.0, "image": 1.0}).select("id", r6("score"))


@query("cross_modal_projection", f"WITH {_E} SELECT vec_id, i::INT AS pos, round(list_sum(list_transform(range(1, 65), lambda j: v[j] * ((((j - 1) * (i + 1)) % 5) - 2) / 10.0)), 5) AS x FROM e, range(0, 8) t(i)")
def cross_modal_projection(spark, directory):
    matrix = [[((j * (i + 1)) % 5 - 2) / 10 for j in range(64)] for i in range(8)]
    return vectors(spark, directory).select("vec_id", F.posexplode(serving.projected(F.col("embedding"), matrix)).alias("pos", "x")).select("vec_id", "pos", F.round("x", 5).alias("x"))


_NEAR = f"{_E}, l AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_distance(a.v, b.v) AS d FROM e a, e b WHERE a.vec_id <> b.vec_id AND list_cosine_distance(a.v, b.v) < 0.55)"


@query("dedup_scan", f"WITH RECURSIVE {_NEAR}, s(i, taken) AS (SELECT -1::BIGINT, MAP {{}}::MAP(BIGINT, BIGINT) UNION ALL SELECT i + 1, CASE WHEN map_contains(taken, i + 1) THEN taken ELSE map_concat(map_from_entries(coalesce((SELECT list({{'k': b, 'v': i + 1}} ORDER BY b) FROM l WHERE a = i + 1 AND b > i + 1), [])), taken) END FROM s WHERE i < (SELECT max(vec_id) FROM e)), f AS (SELECT unnest(map_entries(taken)) AS m FROM s WHERE i = (SELECT max(vec_id) FROM e)) SELECT m.key AS vec_id, m.value AS canonical, round(d, 6) AS distance FROM f JOIN l ON a = m.value AND b = m.key")
def dedup_scan(spark, directory):
    """Groups as a greedy scan in the order of the ids makes them; the distance is wide so that there are some."""
    return serving.dedup_scan(vectors(spark, directory), 0.55).select("vec_id", "canonical", r6())


@query("trigger_proximity", f"WITH {_E} SELECT a.vec_id AS watch_id, b.vec_id, round(list_cosine_distance(a.v, b.v), 6) AS distance FROM e a, e b WHERE a.vec_id % 50 = 0 AND b.label > 4 AND list_cosine_distance(a.v, b.v) < 0.6")
def trigger_proximity(spark, directory):
    """New rows that come near a watched vector."""
    rows = vectors(spark, directory)
    return serving.near_watched(rows.where("label > 4"), rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("watch_id"), "embedding"), 0.6).select("watch_id", "vec_id", r6())


@query("silhouette", f"WITH {_E}, p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg(pow(list_distance(a.v, b.v), 2)) AS m, count(*) AS n FROM e a, e b GROUP BY 1, 2, 3), s AS (SELECT vec_id, max(CASE WHEN la = lb THEN m * n / (n - 1) END) AS a, min(CASE WHEN la <> lb THEN m END) AS b FROM p GROUP BY vec_id) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s")
def silhouette(spark, directory):
    return serving.silhouette(vectors(spark, directory), "label").select(r6("silhouette"))


# ---- analytics -----------------------------------------------------------------------------------------------------------

_CENTRE = f"{_E}, m AS (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) t(i) GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label), f AS (SELECT e.label, vec_id, list_distance(v, c) AS d FROM e JOIN c ON e.label = c.label)"


@query("distance_distribution", f"WITH {_CENTRE}, s AS (SELECT label, min(d) AS lo, max(d) AS hi, avg(d) AS mean, stddev_pop(d) AS deviation FROM f GROUP BY label) SELECT f.label, least(floor((d - lo) / (hi - lo) * 5), 4)::INT AS bin, count(*) AS n, round(any_value(mean), 6) AS mean, round(any_value(deviation), 6) AS deviation FROM f JOIN s ON f.label = s.label GROUP BY 1, 2")
def distance_distribution(spark, directory):
    far = aggregates.to_centroid(vectors(spark, directory), ["label"], "vec_id")
    return aggregates.distribution(far, 5, ["label"]).select("label", "bin", "n", r6("mean"), r6("deviation"))


@query("retrieval_average_precision", f"WITH {_E}, f AS (SELECT a.vec_id AS query_id, (a.label = b.label)::INT AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_distance(a.v, b.v), 9), b.vec_id) AS rank FROM e a, e b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10), p AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) / rank AS p FROM f), n AS (SELECT a.vec_id AS query_id, count(*) AS n FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % 50 = 0 GROUP BY 1) SELECT p.query_id, round(sum(hit * p) / least(any_value(n), 10), 6) AS average_precision FROM p JOIN n ON p.query_id = n.query_id GROUP BY 1")
def retrieval_average_precision(spark, directory):
    from spindrift.plans.vector_queries import _asked
    from spindrift.runtime import small

    rows = vectors(spark, directory)
    found = search.batch_top_k(rows, _asked(rows), 10).select("query_id", F.col("vec_id").alias("id"), "rank")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = rows.select(F.col("vec_id").alias("id"), "label").join(small(asked), "label").select("query_id", "id")
    return aggregates.retrieval_metrics(found, relevant, 10).select("query_id", r6("average_precision"))


@query("agg_rollup", "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def agg_rollup(spark, directory):
    t = lambda n: table(spark, directory, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("agg_grouping_sets", "SELECT p_brand, p_size, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
def agg_grouping_sets(spark, directory):
    rows = table(spark, directory, "part")
    return rows.groupingSets([["p_brand"], ["p_size"], []], "p_brand", "p_size").agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("types"))


@query("agg_count_field", "SELECT source, count(*) AS n, count(title) AS titles, min(title) AS low, max(title) AS high FROM documents GROUP BY source")
def agg_count_field(spark, directory):
    return aggregates.analytics(table(spark, directory, "documents"), ["source"], {"n": ("count", "*"), "titles": ("count", "title"), "low": ("min", "title"), "high": ("max", "title")})


@query(
    "window_functions",
    """SELECT o_orderkey, row_number() OVER w AS n, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d, ntile(3) OVER w AS t,
lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after, first_value(o_orderkey) OVER w AS first, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def window_functions(spark, directory):
    w, p = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), W.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, directory, "orders").select(
        "o_orderkey", F.row_number().over(w).alias("n"), F.rank().over(p).alias("r"), F.dense_rank().over(p).alias("d"), F.ntile(3).over(w).alias("t"), F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice").over(w).alias("after"),
        F.first("o_orderkey").over(w).alias("first"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"),
    )


@query("query_percentiles", "SELECT collection, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, count(*) FILTER (latency_ms > 200) AS slow FROM recorded_queries WHERE isfinite(latency_ms) AND latency_ms >= 0 GROUP BY 1")
def query_percentiles(spark, directory):
    """Exact percentiles for a report; columns too large for that take the sketches."""
    x = F.col("latency_ms")
    rows = table(spark, directory, "recorded_queries").where((x >= 0) & (x < float("inf")) & ~F.isnan(x))
    return rows.groupBy("collection").agg(F.count("*").alias("n"), F.round(F.percentile(x, 0.5), 6).alias("p50"), F.round(F.percentile(x, 0.95), 6).alias("p95"), F.count_if(x > 200).alias("slow"))


@query("query_patterns", "SELECT collection, k, count(*) AS n FROM recorded_queries WHERE query IS NOT NULL GROUP BY collection, k, query::VARCHAR HAVING count(*) > 1")
def query_patterns(spark, directory):
    """Queries that were asked more than once, by a digest of their vectors."""
    rows = table(spark, directory, "recorded_queries").where("query is not null")
    same = rows.groupBy("collection", "k", F.md5(F.to_json(F.struct("query"))).alias("digest")).agg(F.count("*").alias("n"))
    return same.where("n > 1").select("collection", "k", "n")


@query("alert_rules", "SELECT collection AS metric, round(avg(latency_ms), 4) AS value, 'slow' AS rule FROM recorded_queries WHERE collection = 'product-search' AND isfinite(latency_ms) AND latency_ms >= 0 GROUP BY 1 HAVING avg(latency_ms) > 1")
def alert_rules(spark, directory):
    x = F.col("latency_ms")
    means = table(spark, directory, "recorded_queries").where((x >= 0) & (x < float("inf")) & ~F.isnan(x)).groupBy(F.col("collection").alias("metric")).agg(F.avg(x).alias("value"))
    rules = [{"name": "slow", "metric": "product-search", "op": ">", "threshold": 1.0}, {"name": "never", "metric": "product-search", "op": "<", "threshold": 0.0}]
    return serving.alerts(means, rules).select("metric", F.round("value", 4).alias("value"), "rule")


@query("time_series", "WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS high, arg_max(value, {'t': ts, 'i': event_id}) AS latest FROM l GROUP BY 1")
def time_series(spark, directory):
    """The last hundred points of each series: their mean, greatest and latest value."""
    rows = table(spark, directory, "events").withColumn("at", F.struct("ts", "event_id"))
    last = serving.last_points(rows, "event_type", "at", 100)
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("high"), F.max_by("value", "at").alias("latest"))


# ---- joins ------------------------------------------------------------------------------------------------------------------


@query("join_semi_anti", "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def join_semi_anti(spark, directory):
    c, o = table(spark, directory, "customer"), table(spark, directory, "orders")
    on = c.c_custkey == o.o_custkey
    part = lambda kind, how: c.join(o, on, how).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return part("with", "left_semi").unionByName(part("without", "left_anti"))


@query("join_range", "SELECT p_partkey, b AS band FROM part, (SELECT unnest(range(0, 40)) AS b) WHERE p_retailprice >= b * 60 AND p_retailprice < b * 60 + 60")
def join_range(spark, directory):
    """Parts with the price band that they lie in: an interval join without a cross join."""
    bands = spark.range(40).select(F.col("id").alias("band"), (F.col("id") * 60.0).alias("low"), (F.col("id") * 60.0 + 60).alias("high"))
    return serving.range_join(table(spark, directory, "part"), bands, "p_retailprice", "low", "high", 60.0).select("p_partkey", "band")


@query("join_as_of", "WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), v AS (SELECT * FROM events WHERE event_type = 'view') SELECT v.event_id, p.value AS last_value FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts >= p.ts")
def join_as_of(spark, directory):
    """Every view of a user with the value of the last purchase before it."""
    rows = table(spark, directory, "events")
    views = rows.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return serving.as_of_join(views, rows.where("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", ["value"]).select("event_id", "last_value")


# ---- filters, access, time ----------------------------------------------------------------------------------------------------


@query("filter_dotted_path", "SELECT delivery_id FROM (SELECT *, CASE WHEN json_valid(metadata) THEN metadata::JSON END AS m FROM delta_ops) WHERE m->>'$.tags[0]' = 'fjord' AND json_type(m, '$.tags') = 'ARRAY'")
def filter_dotted_path(spark, directory):
    return table(spark, directory, "delta_ops").where(compile_filter({"tags.0": "fjord"}, Json("metadata"))).select("delivery_id")


@query("access_rules", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_orderpriority = '1-URGENT') AND NOT (o_orderpriority = '5-LOW')")
def access_rules(spark, directory):
    """The orders that a user sees by the policies of theirs and of their roles."""
    policies = [
        {"effect": "allow", "principal": "role:sales", "field": "o_orderstatus", "value": "O", "priority": 1},
        {"effect": "allow", "principal": "kim", "field": "o_orderpriority", "value": "1-URGENT", "priority": 1},
        {"effect": "allow", "principal": "role:admin", "priority": 9},
        {"effect": "deny", "principal": "*", "field": "o_orderpriority", "value": "5-LOW", "priority": 5},
    ]
    return table(spark, directory, "orders").where(serving.permitted(policies, "kim", ["sales"])).select("o_orderkey")


@query("relative_times", "SELECT 'ago' AS name, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 3 DAY AND ts <= TIMESTAMP '2024-01-20 12:00:00' UNION ALL SELECT 'yesterday', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-19' AND ts < TIMESTAMP '2024-01-20' UNION ALL SELECT 'monday', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def relative_times(spark, directory):
    """Events since relative times, as of a fixed moment."""
    now = datetime(2024, 1, 20, 12)
    at = lambda t: F.lit(parse_time(t, now).isoformat(sep=" ")).cast("timestamp_ntz")
    rows, ts = table(spark, directory, "events"), F.col("ts")
    tests = {"ago": (ts >= at("3 days ago")) & (ts <= at("now")), "yesterday": (ts >= at("yesterday")) & (ts < at("today")), "monday": (ts >= at("last monday")) & (ts <= at("now"))}
    counts = rows.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in tests])))


@query("search_since", f"WITH {_Q}, {_E}, a AS (SELECT e.vec_id, e.v FROM e JOIN events x ON x.event_id = e.vec_id WHERE x.ts >= TIMESTAMP '2024-01-12') SELECT vec_id, round(list_cosine_distance(a.v, q.v), 6) AS distance FROM a, q ORDER BY list_cosine_distance(a.v, q.v), vec_id LIMIT 10")
def search_since(spark, directory):
    """A search over what was changed since a time."""
    from spindrift.plans.vector_queries import _aged

    since = parse_time("2024-01-12", datetime(2024, 2, 1))
    return search.top_k(_aged(spark, directory), vector_of(spark, directory), 10, where=F.col("ts") >= F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz")).select("vec_id", r6())


@query("schema_evolution", "SELECT c_custkey, c_name AS name, c_acctbal, 'none' AS tier, NULL::BIGINT AS score FROM customer")
def schema_evolution(spark, directory):
    return serving.evolved(table(spark, directory, "customer"), [{"add": "tier", "type": "string", "default": "none"}, {"rename": "c_name", "to": "name"}, {"remove": "c_nationkey"}, {"remove": "c_mktsegment"}, {"add": "score", "type": "bigint"}])


@query("storage_tiers", "SELECT CASE WHEN coalesce(hit_count, 0) >= 20 THEN 'hot' WHEN date_diff('day', created_at::DATE, DATE '2025-01-31') <= 14 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS n FROM cache_entries GROUP BY 1")
def storage_tiers(spark, directory):
    idle = F.datediff(F.lit("2025-01-31").cast("date"), F.col("created_at"))
    return serving.tier_counts(table(spark, directory, "cache_entries"), serving.storage_tier(F.col("hit_count"), idle, 20, 14))


@query("cache_eviction", "SELECT entry_id FROM cache_entries WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2025-01-15' ORDER BY coalesce(hit_count, 0) DESC, created_at DESC, entry_id LIMIT 200")
def cache_eviction(spark, directory):
    """What a cache of 200 entries keeps: the unexpired, most often and then most recently used."""
    order = [F.desc(F.coalesce("hit_count", F.lit(0))), F.desc("created_at"), F.col("entry_id")]
    return serving.evicted(table(spark, directory, "cache_entries"), F.lit("2025-01-15").cast("timestamp_ntz"), 200, by=order).select("entry_id")


@query("feedback_scores", "SELECT event_type, round(avg(CASE event_type WHEN 'click' THEN 0.5 WHEN 'error' THEN -0.3 WHEN 'view' THEN greatest(-1, least(1, (value * 100 / 1000 - 3) / 5)) WHEN 'purchase' THEN (value % 5 - 3) / 2 END), 6) AS score FROM events GROUP BY 1")
def feedback_scores(spark, directory):
    """Signals of users as scores: clicks, skips (errors), dwell times (views) and ratings (purchases)."""
    signal = F.when(F.col("event_type") == "error", "skip").when(F.col("event_type") == "view", "dwell").when(F.col("event_type") == "purchase", "rating").otherwise(F.col("event_type"))
    value = F.when(F.col("event_type") == "view", F.col("value") * 100).otherwise(F.col("value") % 5)
    return table(spark, directory, "events").groupBy("event_type").agg(F.round(F.avg(serving.relevance(signal, value)), 6).alias("score"))


# ---- graphs: customers, their nations and regions ---------------------------------------------------------------------------------


def _lineage(spark: SparkSession, directory: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    parts = [
        table(spark, directory, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.lit("ordered").alias("type")),
        table(spark, directory, "customer").select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"), F.lit("lives").alias("type")),
        table(spark, directory, "nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"), F.lit("part").alias("type")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("lineage_ancestors", "SELECT 'c:' || o_custkey AS node, 1 AS depth FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 'n:' || c_nationkey, 2 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 7 UNION ALL SELECT 'r:' || n_regionkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 7")
def lineage_ancestors(spark, directory):
    return serving.descendants(_lineage(spark, directory), ["o:7"], 5, backwards=True)


@query("lineage_impact", "SELECT 'n:' || n_nationkey AS node, 1 AS depth FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'c:' || c_custkey, 2 FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def lineage_impact(spark, directory):
    """What depends on a region within two steps."""
    return serving.descendants(_lineage(spark, directory), ["r:1"], 2)


@query("typed_traversal", "SELECT 'o:' || o_orderkey AS node, 1 AS depth FROM orders WHERE o_custkey = 4")
def typed_traversal(spark, directory):
    return serving.descendants(_lineage(spark, directory), ["c:4"], 3, kind="ordered")


@query("graph_best_path")
def graph_best_path(spark, directory):
    """The path of greatest product of similarities between two vectors, over the nearest neighbours."""
    from spindrift.plans.vector_queries import _edges

    path, product = serving.best_path(_edges(spark, directory), 0, 1)
    return spark.createDataFrame([(i, n, round(product, 5)) for i, n in enumerate(path)], "place int, node bigint, product double")


# ---- feeds and streams ---------------------------------------------------------------------------------------------------------------


@query("log_replay", "SELECT delivery_id FROM delta_ops WHERE delivery_id > (SELECT min(delivery_id) + 100 FROM delta_ops) AND lower(regexp_replace(op_type, '[^A-Za-z]', '', 'g')) = 'delete' ORDER BY delivery_id LIMIT 50")
def log_replay(spark, directory):
    """Fifty deletions after the position of a resume token."""
    rows = table(spark, directory, "delta_ops").select("delivery_id", "op_type")
    token = serving.resume_token(rows.agg(F.min("delivery_id")).first()[0] + 100, "delta_ops")
    where = F.lower(F.regexp_replace("op_type", "[^A-Za-z]", "")) == "delete"
    return serving.replayed(rows, "delivery_id", serving.position_of(token, "delta_ops"), where=where, limit=50).select("delivery_id")


@query("delta_sync", "SELECT collection, vector_id, delivery_id FROM delta_ops WHERE delivery_id > (SELECT quantile_disc(delivery_id, 0.5) FROM delta_ops) AND vector_id IS NOT NULL AND collection IS NOT NULL QUALIFY row_number() OVER (PARTITION BY collection, vector_id ORDER BY delivery_id DESC) = 1")
def delta_sync(spark, directory):
    """What a replica that has the first half of the log needs: the last change of each key after it."""
    rows = table(spark, directory, "delta_ops").select("collection", "vector_id", "delivery_id").where("vector_id is not null and collection is not null")
    half = table(spark, directory, "delta_ops").agg(F.expr("percentile_disc(0.5) within group (order by delivery_id)").alias("h")).first().h
    later = serving.replayed(rows, "delivery_id", half)
    return later.groupBy("collection", "vector_id").agg(F.max("delivery_id").alias("delivery_id"))


_SPLIT = "2024-01-20"


@query(
    "stream_late_rows",
    f"""WITH w AS (SELECT *, date_trunc('day', ts) AS day, (ts < TIMESTAMP '{_SPLIT}' AND event_id % 4 = 0) OR ts >= TIMESTAMP '{_SPLIT}' AS second FROM events),
m AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM w WHERE NOT second) SELECT day, count(*) AS n FROM w, m WHERE NOT second OR day + INTERVAL 1 DAY > mark GROUP BY day""",
)
def stream_late_rows(spark, directory):
    """Daily counts of two batches with a delay of two days: rows of the second batch whose day had closed by the watermark are late and dropped, those
    of days still open count."""
    path, rows = scratch(spark), table(spark, directory, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    second = ((F.col("ts") < F.lit(_SPLIT).cast("timestamp")) & (F.col("event_id") % 4 == 0)) | (F.col("ts") >= F.lit(_SPLIT).cast("timestamp"))
    out, seen = f"{path}/out", f"{path}/in"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for part in (~second, second):
        rows.where(part).coalesce(1).write.mode("append").parquet(seen)
        stream = changes.windowed(spark.readStream.schema(rows.schema).parquet(seen), "ts", "2 days", "1 day", [], [F.count("*").alias("n")])
        stream.writeStream.outputMode("update").option("checkpointLocation", path + "/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    found = spark.read.parquet(out)
    last = found.groupBy(F.col("window.start").cast("timestamp_ntz").alias("day")).agg(F.max_by("n", "batch").alias("n"))
    return last


# ---- pipelines, text ---------------------------------------------------------------------------------------------------------------------


@query("pipeline_optimised", f"WITH {_MAIN} SELECT vec_id AS id, round({_DIST['cosine']}, 6) AS distance FROM e, q WHERE label IN (2, 3, 4) ORDER BY {_DIST['cosine']}, vec_id LIMIT 10")
def pipeline_optimised(spark, directory):
    """A filter declared behind a search runs before it after optimisation, so that the search is full."""
    rows = vectors(spark, directory).withColumnRenamed("vec_id", "id")
    stages = serving.optimised(serving.template("filtered", vector_of(spark, directory), 10, "label in (2, 3, 4)"))
    return serving.declared(rows, stages).select("id", r6())


@query("pipeline_declared", "SELECT o_orderkey AS key, o_totalprice * 2 AS double_price FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def pipeline_declared(spark, directory):
    stages = [{"stage": "filter", "where": "o_orderstatus = 'F'"}, {"stage": "compute", "column": "double_price", "value": "o_totalprice * 2"}, {"stage": "limit", "k": 25, "by": ["o_totalprice desc", "o_orderkey"]}, {"stage": "rename", "columns": {"o_orderkey": "key"}}, {"stage": "select", "columns": ["key", "double_price"]}]
    return serving.declared(table(spark, directory, "orders"), stages)


@query("bm25_index", "SELECT 20::BIGINT AS n, true AS same")
def bm25_index(spark, directory):
    """The best twenty documents by a persisted index, after one document was changed twice, one was removed and all were added in two parts, and whether
    their scores are those of a scan over the same state."""
    path, terms = scratch(spark), ["recall", "snapshot", "writer"]
    docs = table(spark, directory, "documents").select("doc_id", "text")
    text.bm25_index(docs.where("doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit(" old words"))), path)
    text.bm25_index(docs, path, append=True)
    first = docs.agg(F.min("doc_id")).first()[0]
    text.bm25_remove(spark, path, docs.where(F.col("doc_id") == first).select(F.col("doc_id").alias("id")))
    best = lambda rows: rows.orderBy(F.desc(F.round("score", 9)), "id").limit(20)
    a = best(text.bm25_lookup(spark, path, terms))
    b = best(text.bm25(docs.where(F.col("doc_id") != first), terms).select(F.col("doc_id").cast("string").alias("id"), F.col("score").alias("other")).withColumnRenamed("other", "score")).select("id", F.col("score").alias("other"))
    return a.join(b, "id", "full_outer").agg(F.count("*").alias("n"), F.every(F.coalesce(F.abs(F.col("score") - F.col("other")) < 1e-6, F.lit(False))).alias("same"))
