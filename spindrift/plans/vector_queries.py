"""Queries of vector search, vector aggregates, fusion, quantisation and graphs, and their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.distance import distance, normalized
from spindrift.operators import aggregates, extras, fusion, graph, quantize, search, sparse
from spindrift.plans import ql
from spindrift.runtime import cut, small, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def vectors(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "embeddings")


def vector_of(spark: SparkSession, directory: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in vectors(spark, directory).where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def r6(name: str = "distance"):
    return F.round(name, 6).alias(name)


_Q = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_TERMS = "list_transform(range(1, 65), lambda i: {})"
_DIST = {
    "cosine": "list_cosine_distance(e.v, q.v)",
    "l2": "list_distance(e.v, q.v)",
    "dot": "-list_inner_product(e.v, q.v)",
    "l1": "list_sum(" + _TERMS.format("abs(e.v[i] - q.v[i])") + ")",
    "linf": "list_max(" + _TERMS.format("abs(e.v[i] - q.v[i])") + ")",
    "hamming": "list_sum(" + _TERMS.format("CASE WHEN (e.v[i] <> 0) <> (q.v[i] <> 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END") + ")",
}


def _top(metric: str):
    def f(spark: SparkSession, directory: str) -> DataFrame:
        return search.top_k(vectors(spark, directory), vector_of(spark, directory), 10, metric).select("vec_id", r6())

    return f


for _m in ("cosine", "l2", "dot", "l1", "linf", "hamming"):
    QUERIES[f"topk_{_m}"] = _top(_m)
    ORACLE[f"topk_{_m}"] = f"WITH {_Q}, {_E} SELECT vec_id, round({_DIST[_m]}, 6) AS distance FROM e, q ORDER BY {_DIST[_m]}, vec_id LIMIT 10"


@query("all_distances", f"WITH {_Q}, {_E} SELECT vec_id, round({_DIST['cosine']}, 6) AS cosine, round({_DIST['l2']}, 6) AS l2, round({_DIST['dot']}, 6) AS dot, round({_DIST['l1']}, 6) AS l1, round({_DIST['linf']}, 6) AS linf FROM e, q")
def all_distances(spark, directory):
    q = vector_of(spark, directory)
    return vectors(spark, directory).select("vec_id", *[F.round(distance(m, F.col("embedding"), q), 6).alias(m) for m in ("cosine", "l2", "dot", "l1", "linf")])


@query("normalize", f"WITH {_E} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 6) AS total FROM e")
def normalize(spark, directory):
    n = normalized(F.col("embedding"))
    return vectors(spark, directory).select("vec_id", F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("radius_l2", f"WITH {_Q}, {_E} SELECT vec_id, round({_DIST['l2']}, 6) AS distance FROM e, q WHERE {_DIST['l2']} <= 1.3")
def radius_l2(spark, directory):
    return search.radius(vectors(spark, directory), vector_of(spark, directory), 1.3, metric="l2").select("vec_id", r6())


@query("filtered_topk", f"WITH {_Q}, {_E} SELECT vec_id, label, round({_DIST['cosine']}, 6) AS distance FROM e, q WHERE label IN (1, 2, 3) ORDER BY {_DIST['cosine']}, vec_id LIMIT 10")
def filtered_topk(spark, directory):
    return search.top_k(vectors(spark, directory), vector_of(spark, directory), 10, where=F.col("label").isin(1, 2, 3), keep=["label"]).select("vec_id", "label", r6())


@query("post_filter_topk", f"WITH {_Q}, {_E}, t AS (SELECT vec_id, label, {_DIST['cosine']} AS d FROM e, q ORDER BY d, vec_id LIMIT 30) SELECT vec_id, round(d, 6) AS distance FROM t WHERE label <= 4 ORDER BY d, vec_id LIMIT 10")
def post_filter_topk(spark, directory):
    return search.post_filtered(vectors(spark, directory), vector_of(spark, directory), 10, F.col("label") <= 4).select("vec_id", r6())


def _asked(rows: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


_BATCH = f"""WITH {_E}, p AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, list_cosine_distance(a.v, b.v) AS d FROM e a, e b WHERE a.vec_id % 50 = 0)"""


@query("batch_knn", _BATCH + " SELECT query_id, vec_id, round(d, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) <= 5")
def batch_knn(spark, directory):
    rows = vectors(spark, directory)
    return search.batch_top_k(rows, _asked(rows), 5).select("query_id", "vec_id", r6())


@query("knn_filtered_batch", _BATCH + " SELECT query_id, vec_id, round(d, 6) AS distance FROM p WHERE label < 5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) <= 5")
def knn_filtered_batch(spark, directory):
    rows = vectors(spark, directory)
    return search.batch_top_k(rows.where("label < 5"), _asked(rows), 5).select("query_id", "vec_id", r6())


@query("threshold_join", _BATCH + " SELECT query_id, vec_id, round(d, 6) AS distance FROM p WHERE d <= 0.6 AND query_id <> vec_id")
def threshold_join(spark, directory):
    rows = vectors(spark, directory)
    return search.batch_top_k(rows, _asked(rows), None, most=0.6, exclude_self=True).select("query_id", "vec_id", r6())


@query("score_minmax", f"WITH {_Q}, {_E}, t AS (SELECT vec_id, {_DIST['l2']} AS d FROM e, q ORDER BY d, vec_id LIMIT 20) SELECT vec_id, round(1 - (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()), 6) AS score FROM t")
def score_minmax(spark, directory):
    return search.with_scores(search.top_k(vectors(spark, directory), vector_of(spark, directory), 20, "l2")).select("vec_id", r6("score"))


@query("score_inverse", f"WITH {_Q}, {_E}, t AS (SELECT vec_id, {_DIST['l2']} AS d FROM e, q ORDER BY d, vec_id LIMIT 20) SELECT vec_id, round(1 / (1 + d), 6) AS score FROM t")
def score_inverse(spark, directory):
    return search.with_scores(search.top_k(vectors(spark, directory), vector_of(spark, directory), 20, "l2"), "inverse").select("vec_id", r6("score"))


@query(
    "recommend_pos_neg",
    f"""WITH {_E}, pos AS (SELECT i, avg(v[i]) AS m FROM e, range(1, 65) t(i) WHERE vec_id IN (1, 2, 3) GROUP BY i), neg AS (SELECT i, sum(v[i]) AS s FROM e, range(1, 65) t(i) WHERE vec_id = 4 GROUP BY i),
q AS (SELECT list(m - s ORDER BY i) AS v FROM pos JOIN neg USING (i)) SELECT vec_id, round(list_cosine_distance(e.v, q.v), 6) AS distance FROM e, q WHERE vec_id NOT IN (1, 2, 3, 4) ORDER BY list_cosine_distance(e.v, q.v), vec_id LIMIT 10""",
)
def recommend_pos_neg(spark, directory):
    return search.recommend(vectors(spark, directory), [1, 2, 3], [4], 10).select("vec_id", r6())


@query("matryoshka_two_stage", f"WITH {_Q}, {_E}, c AS (SELECT e.* FROM e, q ORDER BY list_cosine_distance(e.v[1:16], q.v[1:16]), vec_id LIMIT 40) SELECT vec_id, round(list_cosine_distance(c.v, q.v), 6) AS distance FROM c, q ORDER BY list_cosine_distance(c.v, q.v), vec_id LIMIT 10")
def matryoshka_two_stage(spark, directory):
    return search.two_stage(vectors(spark, directory), vector_of(spark, directory), 10, 16).select("vec_id", r6())


@query("search_page", f"WITH {_Q}, {_E} SELECT vec_id, round({_DIST['cosine']}, 6) AS distance FROM e, q ORDER BY {_DIST['cosine']}, vec_id LIMIT 10 OFFSET 20")
def search_page(spark, directory):
    return search.scored(vectors(spark, directory), vector_of(spark, directory)).orderBy("distance", "vec_id").offset(20).limit(10).select("vec_id", r6())


# ---- decay and time: a vector's time is that of the event with its number ------------------------------------------

NOW = "2024-02-01 00:00:00"
_AGED = f"{_Q}, {_E}, a AS (SELECT e.vec_id, e.v, v.ts, epoch(TIMESTAMP '{NOW}') - epoch(v.ts) AS age FROM e JOIN events v ON v.event_id = e.vec_id)"


def _aged(spark: SparkSession, directory: str) -> DataFrame:
    events = table(spark, directory, "events").select(F.col("event_id").alias("vec_id"), "ts")
    age = F.lit(NOW).cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")
    return vectors(spark, directory).join(events, "vec_id").withColumn("age", age)


_DAY = 86_400.0
_STEPS = [(3 * _DAY, 1.0), (14 * _DAY, 0.5), (30 * _DAY, 0.25)]
_FADES = {
    "exp": "pow(0.5, greatest(age, 0) / 604800.0)",
    "linear": "greatest(0.0, 1.0 - greatest(age, 0) / 2592000.0)",
    "gauss": "exp(-pow(greatest(age, 0) / 1209600.0, 2))",
    "step": "CASE WHEN greatest(age, 0) <= 259200 THEN 1.0 WHEN greatest(age, 0) <= 1209600 THEN 0.5 WHEN greatest(age, 0) <= 2592000 THEN 0.25 ELSE 0.0 END",
}
_SCALES = {"exp": 7 * _DAY, "linear": 30 * _DAY, "gauss": 14 * _DAY, "step": 0.0}


def _decayed(kind: str):
    def f(spark: SparkSession, directory: str) -> DataFrame:
        weight = search.decay(F.col("age"), kind, _SCALES[kind], steps=_STEPS)
        return search.decayed_top_k(_aged(spark, directory), vector_of(spark, directory), 10, weight).select("vec_id", F.round("distance", 5).alias("distance"))

    return f


for _k, _w in _FADES.items():
    QUERIES[f"decay_{_k}"] = _decayed(_k)
    ORACLE[f"decay_{_k}"] = (
        f"WITH {_AGED}, t AS (SELECT vec_id, CASE WHEN {_w} > 0 THEN list_cosine_distance(a.v, q.v) / ({_w}) ELSE 3.4028234663852886e38 END AS d FROM a, q) SELECT vec_id, round(d, 5) AS distance FROM t ORDER BY d, vec_id LIMIT 10"
    )


@query("as_of", f"WITH {_AGED} SELECT vec_id, round(list_cosine_distance(a.v, q.v), 6) AS distance FROM a, q WHERE ts <= TIMESTAMP '2024-01-10' ORDER BY list_cosine_distance(a.v, q.v), vec_id LIMIT 10")
def as_of(spark, directory):
    return search.top_k(_aged(spark, directory), vector_of(spark, directory), 10, where=F.coalesce(F.col("ts") <= F.lit("2024-01-10").cast("timestamp_ntz"), F.lit(True))).select("vec_id", r6())


@query("range_search", f"WITH {_AGED} SELECT vec_id, round(list_cosine_distance(a.v, q.v), 6) AS distance FROM a, q WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15' ORDER BY list_cosine_distance(a.v, q.v), vec_id LIMIT 10")
def range_search(spark, directory):
    between = F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-15").cast("timestamp_ntz"))
    return search.top_k(_aged(spark, directory), vector_of(spark, directory), 10, where=between).select("vec_id", r6())


# ---- the query language ----------------------------------------------------------------------------------------------


@query("ql_select_similar", f"WITH {_Q}, {_E} SELECT vec_id, label, round({_DIST['l2']}, 6) AS distance FROM e, q WHERE label IN (2, 5) ORDER BY {_DIST['l2']}, vec_id LIMIT 8")
def ql_select_similar(spark, directory):
    text = "SELECT vec_id, label, distance FROM vectors WHERE label IN (2, 5) AND embedding SIMILAR TO $q USING l2 LIMIT 8"
    return ql.run(spark, text, {"vectors": vectors(spark, directory)}, {"q": vector_of(spark, directory)}, id="vec_id").select("vec_id", "label", r6())


@query("ql_order_offset", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT o_orderpriority LIKE '%URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def ql_order_offset(spark, directory):
    text = "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT o_orderpriority LIKE '%URGENT' ORDER BY o_totalprice DESC LIMIT 20 OFFSET 5"
    return ql.run(spark, text, {"orders": table(spark, directory, "orders")}, id="o_orderkey")


@query("ql_time_decay", f"WITH {_AGED}, t AS (SELECT vec_id, list_cosine_distance(a.v, q.v) / pow(0.5, greatest(age, 0) / 604800.0) AS d FROM a, q) SELECT vec_id, round(d, 5) AS distance FROM t ORDER BY d, vec_id LIMIT 10")
def ql_time_decay(spark, directory):
    text = "SEARCH NEAR $q FROM vectors WITH TIME_DECAY(exp, field = ts, half_life = 7d)"
    found = ql.run(spark, text, {"vectors": _aged(spark, directory)}, {"q": vector_of(spark, directory)}, id="vec_id", now=F.lit(NOW))
    return found.select("vec_id", F.round("distance", 5).alias("distance"))


@query("ql_threshold", f"WITH {_Q}, {_E} SELECT vec_id, round({_DIST['cosine']}, 6) AS distance FROM e, q WHERE 1 - {_DIST['cosine']} > 0.2 ORDER BY {_DIST['cosine']}, vec_id LIMIT 50")
def ql_threshold(spark, directory):
    text = "SELECT vec_id, distance FROM vectors WHERE cosine_similarity(embedding, $q) > 0.2 LIMIT 50"
    return ql.run(spark, text, {"vectors": vectors(spark, directory)}, {"q": vector_of(spark, directory)}, id="vec_id").select("vec_id", r6())


@query("mmr_diversify")
def mmr_diversify(spark, directory):
    text = "SELECT vec_id, place FROM vectors WHERE embedding SIMILAR TO $q RERANK BY MMR(0.5) FETCH 50 LIMIT 10"
    return ql.run(spark, text, {"vectors": vectors(spark, directory)}, {"q": vector_of(spark, directory)}, id="vec_id")


@query("ql_explain")
def ql_explain(spark, directory):
    return ql.run(spark, "EXPLAIN SELECT vec_id, distance FROM vectors WHERE embedding SIMILAR TO $q LIMIT 5", {"vectors": vectors(spark, directory)}, {"q": vector_of(spark, directory)}, id="vec_id")


# ---- federation: three collections by label ----------------------------------------------------------------------------

_LISTS = f"""{_Q}, {_E}, l AS (SELECT 'c' || (label % 3) AS source, vec_id AS id, {_DIST['l2']} AS d FROM e, q
QUALIFY row_number() OVER (PARTITION BY label % 3 ORDER BY {_DIST['l2']}, vec_id) <= 20)"""


def _lists(spark: SparkSession, directory: str) -> DataFrame:
    """The 20 nearest of each of three collections, as one table of lists."""
    q = vector_of(spark, directory)
    source = F.concat(F.lit("c"), (F.col("label") % 3).cast("string"))
    rows = search.scored(vectors(spark, directory), q, "l2").select(source.alias("source"), F.col("vec_id").alias("id"), "distance")
    return fusion.ranked(rows).where("rank <= 20").drop("rank")


_OVER = f"""{_Q}, {_E}, l AS (SELECT 'cosine' AS source, vec_id AS id, {_DIST['cosine']} AS d FROM e, q QUALIFY row_number() OVER (ORDER BY {_DIST['cosine']}, vec_id) <= 20
UNION ALL SELECT 'l1', vec_id, {_DIST['l1']} FROM e, q QUALIFY row_number() OVER (ORDER BY {_DIST['l1']}, vec_id) <= 20
UNION ALL SELECT 'linf', vec_id, {_DIST['linf']} FROM e, q QUALIFY row_number() OVER (ORDER BY {_DIST['linf']}, vec_id) <= 20)"""


def _overlapping(spark: SparkSession, directory: str) -> DataFrame:
    """The same collection ranked by three metrics: lists that share ids."""
    q, rows = vector_of(spark, directory), vectors(spark, directory)
    parts = [search.top_k(rows, q, 20, m).select(F.lit(m).alias("source"), F.col("vec_id").alias("id"), "distance") for m in ("cosine", "l1", "linf")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("fed_minmax", f"WITH {_LISTS}, n AS (SELECT source, id, (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) AS d FROM l WINDOW w AS (PARTITION BY source)) SELECT source, id, round(d, 6) AS distance FROM n ORDER BY n.d, source, id LIMIT 15")
def fed_minmax(spark, directory):
    return fusion.federated(_lists(spark, directory), "minmax", k=15).select("source", "id", r6())


@query("fed_zscore", f"WITH {_LISTS}, n AS (SELECT source, id, (d - avg(d) OVER w) / stddev_pop(d) OVER w AS d FROM l WINDOW w AS (PARTITION BY source)) SELECT source, id, round(d, 6) AS distance FROM n ORDER BY n.d, source, id LIMIT 15")
def fed_zscore(spark, directory):
    return fusion.federated(_lists(spark, directory), "zscore", k=15).select("source", "id", r6())


@query("fed_percent_rank", f"WITH {_LISTS}, n AS (SELECT source, id, percent_rank() OVER (PARTITION BY source ORDER BY d) AS d FROM l) SELECT source, id, round(d, 6) AS distance FROM n ORDER BY n.d, source, id LIMIT 15")
def fed_percent_rank(spark, directory):
    return fusion.federated(_lists(spark, directory), "percent_rank", k=15).select("source", "id", r6())


@query("fed_rrf", f"WITH {_OVER}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d, id) AS rank FROM l) SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) AS n_sources FROM r GROUP BY id")
def fed_rrf(spark, directory):
    return fusion.rrf(_overlapping(spark, directory)).select("id", r6("score"), "n_sources")


@query("fed_consensus", f"WITH {_OVER} SELECT id, count(DISTINCT source) AS n_sources, round(avg(d), 6) AS distance FROM l GROUP BY id ORDER BY n_sources DESC, avg(d), id LIMIT 10")
def fed_consensus(spark, directory):
    return fusion.consensus(_overlapping(spark, directory), 10).select("id", "n_sources", r6())


@query("fed_priority", f"WITH {_OVER}, p AS (SELECT *, CASE source WHEN 'linf' THEN 0 WHEN 'cosine' THEN 1 ELSE 2 END AS priority FROM l) SELECT id, source, priority, round(d, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority, d) = 1 ORDER BY priority, d, id LIMIT 25")
def fed_priority(spark, directory):
    return fusion.by_priority(_overlapping(spark, directory), {"linf": 0, "cosine": 1, "l1": 2}, 25).select("id", "source", "priority", r6())


@query("fed_round_robin", f"WITH {_OVER}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d, id) AS rank FROM l) SELECT id, source, rank FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, source) = 1 ORDER BY rank, source, id LIMIT 25")
def fed_round_robin(spark, directory):
    return fusion.round_robin(_overlapping(spark, directory), 25)


@query("fed_intersection", f"WITH {_OVER} SELECT id, count(DISTINCT source) AS n_sources, round(avg(d), 6) AS distance FROM l GROUP BY id HAVING count(DISTINCT source) = 3")
def fed_intersection(spark, directory):
    return fusion.intersection(_overlapping(spark, directory), 3).select("id", "n_sources", r6())


for _how, _agg in {"min": "min(d)", "max": "max(d)", "avg": "avg(d)", "weighted": "sum(d * w) / sum(w)"}.items():
    QUERIES[f"cross_{_how}"] = lambda spark, directory, how=_how: fusion.merged(_overlapping(spark, directory), how, {"cosine": 3.0, "l1": 1.0, "linf": 2.0}).select("id", r6(), "n_sources")
    ORACLE[f"cross_{_how}"] = f"WITH {_OVER}, w AS (SELECT *, CASE source WHEN 'cosine' THEN 3.0::DOUBLE WHEN 'linf' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM l) SELECT id, round({_agg}, 6) AS distance, count(*) AS n_sources FROM w GROUP BY id"


@query("scatter_gather", f"WITH {_OVER} SELECT id, arg_min(source, {{'d': d, 's': source}}) AS source, round(min(d), 6) AS distance FROM l GROUP BY id ORDER BY min(d), id LIMIT 10")
def scatter_gather(spark, directory):
    return fusion.nearest_of(_overlapping(spark, directory), 10).select("id", "source", r6())


# ---- sparse and multi-vectors: positive dimensions as a sparse vector, quarters as tokens -------------------------------

_SPARSE = "s AS (SELECT vec_id AS id, i AS dim, v[i + 1] AS x FROM e, range(0, 64) t(i) WHERE v[i + 1] > 0.1)"


def _sparse(spark: SparkSession, directory: str) -> DataFrame:
    pairs = F.filter(F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.struct(i.alias("k"), x.alias("v"))), lambda p: p["v"] > 0.1)
    return vectors(spark, directory).select(F.col("vec_id").alias("id"), F.map_from_entries(pairs).alias("sparse"))


def _sparse_query(spark: SparkSession, directory: str) -> dict[int, float]:
    return {i: x for i, x in enumerate(vector_of(spark, directory)) if x > 0.1}


_SDOT = f"WITH {_E}, {_SPARSE}, d AS (SELECT b.id, sum(a.x * b.x) AS p FROM s a JOIN s b ON a.dim = b.dim WHERE a.id = 0 GROUP BY b.id), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM s GROUP BY id)"


@query("sparse_dot", _SDOT + " SELECT id, round(p, 6) AS score FROM d ORDER BY p DESC, id LIMIT 10")
def sparse_dot(spark, directory):
    return sparse.sparse_search(_sparse(spark, directory), _sparse_query(spark, directory), 10).select("id", r6("score"))


@query("sparse_cosine", _SDOT + " SELECT d.id, round(p / (n.n * m.n), 6) AS score FROM d JOIN n ON d.id = n.id, (SELECT n FROM n WHERE id = 0) m ORDER BY p / (n.n * m.n) DESC, d.id LIMIT 10")
def sparse_cosine(spark, directory):
    return sparse.sparse_search(_sparse(spark, directory), _sparse_query(spark, directory), 10, "cosine").select("id", r6("score"))


@query("sparse_min_score", _SDOT + " SELECT id, round(p, 6) AS score FROM d WHERE p >= 0.2 ORDER BY p DESC, id LIMIT 100")
def sparse_min_score(spark, directory):
    return sparse.sparse_search(_sparse(spark, directory), _sparse_query(spark, directory), 100, least=0.2).select("id", r6("score"))


@query("maxsim", f"WITH {_E}, t AS (SELECT vec_id AS id, j, v[j * 16 + 1 : j * 16 + 16] AS t FROM e, range(0, 4) r(j)), m AS (SELECT b.id, a.j, max(list_inner_product(a.t, b.t)) AS m FROM t a, t b WHERE a.id = 0 GROUP BY b.id, a.j) SELECT id, round(sum(m), 6) AS score FROM m GROUP BY id ORDER BY sum(m) DESC, id LIMIT 10")
def maxsim(spark, directory):
    rows = vectors(spark, directory).select(F.col("vec_id").alias("id"), F.array(*[F.slice("embedding", 16 * j + 1, 16) for j in range(4)]).alias("tokens"))
    q = vector_of(spark, directory)
    return sparse.max_sim(rows, [q[16 * j : 16 * j + 16] for j in range(4)], 10).select("id", r6("score"))


@query("sparse_dense_fusion", _SDOT.replace("WITH ", f"WITH {_Q}, ", 1) + f", f AS (SELECT e.vec_id AS id, 0.6 * {_DIST['cosine']} + 0.4 * (1 - coalesce(d.p / (SELECT max(p) FROM d), 0)) AS f FROM e CROSS JOIN q LEFT JOIN d ON d.id = e.vec_id) SELECT id, round(f, 6) AS distance FROM f ORDER BY f, id LIMIT 10")
def sparse_dense_fusion(spark, directory):
    q = vector_of(spark, directory)
    dense = search.scored(vectors(spark, directory), q).select(F.col("vec_id").alias("id"), "distance")
    hits = sparse.sparse_scores(_sparse(spark, directory), _sparse_query(spark, directory))
    return sparse.fused(dense, hits, 0.6, 10).select("id", r6())


# ---- aggregates over vectors ------------------------------------------------------------------------------------------

_MEANS = f"{_E}, m AS (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) t(i) GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label), f AS (SELECT e.label, vec_id, list_distance(v, c) AS d FROM e JOIN c ON e.label = c.label)"


@query("centroid_by_label", f"WITH {_MEANS} SELECT label, i - 1 AS pos, round(m, 6) AS mean FROM m")
def centroid_by_label(spark, directory):
    return aggregates.dimensions(vectors(spark, directory), ["label"]).select("label", F.col("pos").cast("bigint").alias("pos"), r6("mean"))


@query("medoid_by_label", f"WITH {_E}, s AS (SELECT a.label, a.vec_id, sum(list_distance(a.v, b.v)) AS s FROM e a JOIN e b ON a.label = b.label GROUP BY 1, 2) SELECT label, arg_min(vec_id, {{'s': round(s, 9), 'i': vec_id}}) AS medoid, round(min(s), 5) AS distance FROM s GROUP BY label")
def medoid_by_label(spark, directory):
    return aggregates.medoids(vectors(spark, directory), ["label"], "vec_id").select("label", "medoid", F.round("distance", 5).alias("distance"))


@query("spread_by_label", f"WITH {_MEANS} SELECT label, count(*) AS n, round(avg(d * d), 6) AS spread FROM f GROUP BY label")
def spread_by_label(spark, directory):
    return aggregates.spread(vectors(spark, directory), ["label"], "vec_id").select("label", "n", r6("spread"))


@query("distance_histogram", f"WITH {_MEANS}, b AS (SELECT min(d) AS lo, max(d) AS hi FROM f) SELECT least(floor((d - lo) / (hi - lo) * 10), 9)::INT AS bin, count(*) AS n FROM f, b GROUP BY 1")
def distance_histogram(spark, directory):
    return aggregates.histogram(aggregates.to_centroid(vectors(spark, directory), ["label"], "vec_id"), 10)


@query("outliers_zscore", f"WITH {_MEANS}, z AS (SELECT label, vec_id, (d - avg(d) OVER w) / stddev_pop(d) OVER w AS z FROM f WINDOW w AS (PARTITION BY label)) SELECT label, vec_id, round(z, 5) AS z FROM z WHERE abs(z) > 2")
def outliers_zscore(spark, directory):
    far = aggregates.to_centroid(vectors(spark, directory), ["label"], "vec_id")
    return aggregates.zscore_outliers(far, 2.0, ["label"]).select("label", "vec_id", F.round("z", 5).alias("z"))


@query("outliers_iqr", "WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1) SELECT o_orderkey, o.o_orderpriority, o_totalprice FROM orders o JOIN q ON o.o_orderpriority = q.o_orderpriority WHERE o_totalprice > b + 0.4 * (b - a) OR o_totalprice < a - 0.4 * (b - a)")
def outliers_iqr(spark, directory):
    return aggregates.iqr_outliers(table(spark, directory, "orders"), "o_totalprice", 0.4, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", "o_totalprice")


_KNN = f"{_E}, n AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 9), b.vec_id) AS r FROM e a, e b WHERE a.vec_id <> b.vec_id QUALIFY r <= 5)"


def _knn(rows: DataFrame, k: int = 5) -> DataFrame:
    asked = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    return search.batch_top_k(rows, asked, k, "l2", exclude_self=True)


@query("knn_outliers", f"WITH {_KNN} SELECT a AS vec_id, round(avg(d), 5) AS score FROM n GROUP BY a ORDER BY avg(d) DESC, a LIMIT 20")
def knn_outliers(spark, directory):
    per = _knn(vectors(spark, directory)).groupBy("query_id").agg(F.avg("distance").alias("score"))
    return per.orderBy(F.desc("score"), "query_id").limit(20).select(F.col("query_id").alias("vec_id"), F.round("score", 5).alias("score"))


@query(
    "lof",
    f"""WITH {_KNN}, k AS (SELECT a AS id, max(d) AS kd FROM n GROUP BY a), l AS (SELECT n.a AS id, 1 / avg(greatest(n.d, k.kd)) AS lrd FROM n JOIN k ON n.b = k.id GROUP BY n.a)
SELECT n.a AS vec_id, round(avg(lb.lrd) / any_value(la.lrd), 5) AS lof FROM n JOIN l la ON n.a = la.id JOIN l lb ON n.b = lb.id GROUP BY n.a""",
)
def lof(spark, directory):
    n = cut(_knn(vectors(spark, directory)).select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), "distance"))
    kd = n.groupBy(F.col("a").alias("b")).agg(F.max("distance").alias("kd"))
    lrd = cut(n.join(kd, "b").groupBy("a").agg((1 / F.avg(F.greatest("distance", "kd"))).alias("lrd")))
    near = lrd.select(F.col("a").alias("b"), F.col("lrd").alias("other"))
    return n.join(near, "b").join(lrd, "a").groupBy("a").agg((F.avg("other") / F.max("lrd")).alias("lof")).select(F.col("a").alias("vec_id"), F.round("lof", 5).alias("lof"))


@query(
    "drift_report",
    f"""WITH {_E}, a AS (SELECT i, avg(v[i]) AS m, stddev_pop(v[i]) AS s FROM e, range(1, 65) t(i) WHERE label < 5 GROUP BY i), b AS (SELECT i, avg(v[i]) AS m, stddev_pop(v[i]) AS s FROM e, range(1, 65) t(i) WHERE label >= 5 GROUP BY i)
SELECT round(1 - sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 6) AS centroid_shift, round(avg(abs(a.m - b.m)), 6) AS mean_shift, round(sum(b.s * b.s) / sum(a.s * a.s), 6) AS variance_ratio,
(SELECT count(*) FROM e WHERE label < 5) AS n_one, (SELECT count(*) FROM e WHERE label >= 5) AS n_other FROM a JOIN b ON a.i = b.i""",
)
def drift_report(spark, directory):
    rows = vectors(spark, directory)
    return aggregates.drift(rows.where("label < 5"), rows.where("label >= 5")).select(r6("centroid_shift"), r6("mean_shift"), r6("variance_ratio"), "n_one", "n_other")


@query(
    "ks_drift",
    """WITH x AS (SELECT round(o_totalprice, 0) AS x, (o_orderdate < TIMESTAMP '1995-06-01')::INT AS a FROM orders), s AS (SELECT x, sum(a) AS a, sum(1 - a) AS b FROM x GROUP BY x),
r AS (SELECT sum(a) OVER (ORDER BY x) / (SELECT sum(a) FROM s) AS fa, sum(b) OVER (ORDER BY x) / (SELECT sum(b) FROM s) AS fb FROM s) SELECT round(max(abs(fa - fb)), 6) AS statistic FROM r""",
)
def ks_drift(spark, directory):
    rows = table(spark, directory, "orders").withColumn("x", F.round("o_totalprice", 0))
    split = F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")
    return aggregates.ks_statistic(rows.where(split), rows.where(~split), "x").select(r6("statistic"))


@query(
    "retrieval_eval",
    f"""WITH {_E}, f AS (SELECT a.vec_id AS query_id, a.label AS la, b.vec_id AS id, b.label AS lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_distance(a.v, b.v), 9), b.vec_id) AS rank FROM e a, e b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10),
n AS (SELECT a.vec_id AS query_id, count(*) AS n FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % 50 = 0 GROUP BY 1),
h AS (SELECT query_id, sum((la = lb)::INT) AS hits, min(CASE WHEN la = lb THEN rank END) AS first, sum(CASE WHEN la = lb THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM f GROUP BY 1)
SELECT n.query_id, round(hits / 10, 6) AS precision, round(hits / n, 6) AS recall, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM n JOIN h ON n.query_id = h.query_id""",
)
def retrieval_eval(spark, directory):
    rows = vectors(spark, directory)
    found = search.batch_top_k(rows, _asked(rows), 10).select("query_id", F.col("vec_id").alias("id"), "rank")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = rows.select(F.col("vec_id").alias("id"), "label").join(small(asked), "label").select("query_id", "id")
    return aggregates.retrieval_metrics(found, relevant, 10).select("query_id", *[r6(c) for c in ("precision", "recall", "reciprocal_rank", "ndcg")])


# ---- quantisers and clusters -------------------------------------------------------------------------------------------


@query("sq_quantize", f"WITH {_E}, b AS (SELECT i, min(v[i]) AS lo, max(v[i]) AS hi FROM e, range(1, 65) t(i) GROUP BY i) SELECT vec_id, sum(least(greatest(floor((v[b.i] - lo) / (hi - lo) * 255), 0), 255))::BIGINT AS code_sum FROM e, b GROUP BY vec_id")
def sq_quantize(spark, directory):
    rows = vectors(spark, directory)
    codes = quantize.scalar_codes(F.col("embedding"), quantize.bounds(rows))
    return rows.select("vec_id", F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("code_sum"))


@query("bq_hamming", f"WITH {_E}, m AS (SELECT i, avg(v[i]) AS m FROM e, range(1, 65) t(i) GROUP BY i), c AS (SELECT vec_id, m.i, v[m.i] > m AS bit FROM e, m) SELECT b.vec_id, sum((a.bit <> b.bit)::INT)::BIGINT AS hamming FROM c a JOIN c b ON a.i = b.i WHERE a.vec_id = 0 GROUP BY b.vec_id")
def bq_hamming(spark, directory):
    rows = vectors(spark, directory)
    limits = quantize.bounds(rows)
    coded = rows.select("vec_id", quantize.binary_codes(F.col("embedding"), limits).alias("code"))
    own = coded.where("vec_id = 0").first()[1]
    return coded.select("vec_id", quantize.hamming(F.col("code"), F.array(*[F.lit(x).cast("bigint") for x in own])).cast("bigint").alias("hamming"))


@query("sq_search")
def sq_search(spark, directory):
    rows = vectors(spark, directory)
    limits = quantize.bounds(rows)
    far = quantize.scalar_distance(quantize.scalar_codes(F.col("embedding"), limits), limits, vector_of(spark, directory))
    return rows.select("vec_id", far.alias("distance")).orderBy("distance", "vec_id").limit(10)


@query("pq_search")
def pq_search(spark, directory):
    rows = vectors(spark, directory)
    return quantize.product_search(rows, quantize.product_codebooks(rows, 16), _asked(rows), 10)


@query("kmeans")
def kmeans(spark, directory):
    return quantize.kmeans(vectors(spark, directory), 8)[0]


@query("ivf_search")
def ivf_search(spark, directory):
    rows = vectors(spark, directory)
    _, centres = quantize.kmeans(rows, 256)
    return quantize.ivf_search(quantize.assigned(rows, centres), centres, _asked(rows), 10, 128)


@query("pca")
def pca(spark, directory):
    return quantize.principal_components(vectors(spark, directory), 4)[0]


@query("random_projection")
def random_projection(spark, directory):
    return vectors(spark, directory).select("vec_id", quantize.random_projection(F.col("embedding"), 64, 8).alias("projected"))


@query("als")
def als(spark, directory):
    events = table(spark, directory, "events")
    weight = F.lit(0.0)
    for kind, w in quantize.INTERACTIONS.items():
        weight = F.when(F.col("event_type") == kind, w).otherwise(weight)
    rows = events.select("user_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("item"), weight.alias("weight")).where("item is not null")
    return quantize.recommendations(rows, "user_id", "item", "weight", 3)


# ---- the similarity graph: each vector's five nearest with a cosine of 0.3 and more --------------------------------------

_EDGES = f"{_E}, n AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_cosine_distance(a.v, b.v) AS w FROM e a, e b WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_distance(a.v, b.v), 9), b.vec_id) <= 5), g AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, max(w) AS weight FROM n WHERE w >= 0.3 GROUP BY 1, 2), u AS (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g)"


def _edges(spark: SparkSession, directory: str) -> DataFrame:
    rows = vectors(spark, directory)
    near = search.batch_top_k(rows, rows.select(F.col("vec_id").alias("query_id"), "embedding"), 5, exclude_self=True)
    return cut(graph.similarity_edges(near, 0.3))


@query("graph_edges", f"WITH {_EDGES} SELECT src, dst, round(weight, 5) AS weight FROM g")
def graph_edges(spark, directory):
    return _edges(spark, directory).select("src", "dst", F.round("weight", 5).alias("weight"))


@query("graph_degree", f"WITH {_EDGES} SELECT src AS node, count(*) AS degree, round(sum(weight), 5) AS strength FROM u GROUP BY src")
def graph_degree(spark, directory):
    return graph.degrees(_edges(spark, directory)).select("node", "degree", F.round("strength", 5).alias("strength"))


@query("graph_neighborhood", f"WITH RECURSIVE {_EDGES}, s(node, hop) AS (SELECT 0::BIGINT, 0 UNION SELECT u.dst, hop + 1 FROM s JOIN u ON s.node = u.src WHERE hop < 3) SELECT node, min(hop)::INT AS hop FROM s GROUP BY node")
def graph_neighborhood(spark, directory):
    return graph.neighbourhood(_edges(spark, directory), [0], 3)


def _ranks(rounds: int) -> str:
    steps = ["o AS (SELECT src, count(*) AS o FROM u GROUP BY src), n0 AS (SELECT count(*) AS n FROM o), r0 AS (SELECT src AS node, 1.0 / n AS r FROM o, n0)"]
    steps += [f"r{i + 1} AS (SELECT u.dst AS node, 0.15 / any_value(n) + 0.85 * sum(r / o.o) AS r FROM u JOIN r{i} ON u.src = r{i}.node JOIN o ON u.src = o.src, n0 GROUP BY u.dst)" for i in range(rounds)]
    return ", ".join(steps) + f" SELECT node, round(r, 6) AS rank FROM r{rounds}"


@query("graph_pagerank", f"WITH {_EDGES}, " + _ranks(5))
def graph_pagerank(spark, directory):
    return graph.page_rank(_edges(spark, directory), rounds=5).select("node", r6("rank"))


@query("graph_components", f"WITH RECURSIVE {_EDGES}, s(node, root) AS (SELECT src, src FROM u UNION SELECT u.dst, s.root FROM s JOIN u ON s.node = u.src WHERE s.root < u.dst) SELECT node, min(root) AS component FROM s GROUP BY node")
def graph_components(spark, directory):
    return graph.components(_edges(spark, directory))


@query("graph_communities")
def graph_communities(spark, directory):
    return graph.communities(_edges(spark, directory), 5)


@query("graph_shortest_path")
def graph_shortest_path(spark, directory):
    edges = _edges(spark, directory)
    end = edges.agg(F.max("dst")).first()[0]
    path = graph.shortest_path(edges, 0, end)
    return spark.createDataFrame([(i, n) for i, n in enumerate(path)], "step int, node bigint")


@query("graph_fused_search", f"""WITH {_Q}, {_EDGES}, h AS (SELECT vec_id AS node, {_DIST['cosine']} AS d FROM e, q ORDER BY d, vec_id LIMIT 15), l0 AS (SELECT node, 0.7 * d AS base, 0.7 * d AS score, 0 AS hop FROM h),
l1 AS (SELECT u.dst AS node, min(base) AS base, min(base + 0.3 / (weight * 0.5)) AS score, 1 AS hop FROM u JOIN l0 ON u.src = l0.node GROUP BY u.dst), l2 AS (SELECT u.dst AS node, min(base) AS base, min(base + 0.3 / (weight * 0.25)) AS score, 2 AS hop FROM u JOIN l1 ON u.src = l1.node GROUP BY u.dst),
x AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) SELECT node, round(min(score), 5) AS score, arg_min(hop, score) AS hop FROM x GROUP BY node ORDER BY min(score), node LIMIT 10""")
def graph_fused_search(spark, directory):
    hits = search.top_k(vectors(spark, directory), vector_of(spark, directory), 15).select(F.col("vec_id").alias("node"), "distance")
    return graph.fused_search(cut(hits), _edges(spark, directory), 2, 10).select("node", F.round("score", 5).alias("score"), "hop")


# ---- further operators ---------------------------------------------------------------------------------------------------


@query("semantic_cache", _BATCH + " SELECT query_id, vec_id, round(1 - d, 6) AS similarity FROM p WHERE label >= 5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) = 1")
def semantic_cache(spark, directory):
    rows = vectors(spark, directory)
    return extras.cached_answers(rows.where("label >= 5"), _asked(rows), -1.0).select("query_id", "vec_id", r6("similarity"))


@query("pipeline_stages", f"WITH {_Q}, {_E}, t AS (SELECT vec_id, label, {_DIST['cosine']} AS d FROM e, q ORDER BY d, vec_id LIMIT 50) SELECT vec_id, round((1 - d) * 0.7 + 0.3 * (label = 1)::INT, 6) AS score FROM t WHERE label < 5 AND d <= 0.95 ORDER BY (1 - d) * 0.7 + 0.3 * (label = 1)::INT DESC, vec_id LIMIT 8")
def pipeline_stages(spark, directory):
    run = extras.pipeline(
        extras.search_stage(vector_of(spark, directory), 50, id="vec_id"),
        extras.filter_stage(F.col("label") < 5),
        extras.threshold_stage(0.95),
        extras.rerank_stage((1 - F.col("distance")) * 0.7 + 0.3 * (F.col("label") == 1).cast("int")),
        extras.limit_stage(8, F.desc("score"), "vec_id"),
    )
    return run(vectors(spark, directory)).select("vec_id", r6("score"))


@query("sequence_trend", f"WITH {_E} SELECT label, count(*) AS n, round(list_distance(arg_min(v, vec_id), arg_max(v, vec_id)), 6) AS shift FROM e GROUP BY label")
def sequence_trend(spark, directory):
    return extras.trend(vectors(spark, directory), "label", "vec_id", "embedding").select("label", "n", r6("shift"))


@query("sequence_dtw")
def sequence_dtw(spark, directory):
    q = [vector_of(spark, directory, i) for i in range(3)]
    return extras.sequence_distances(vectors(spark, directory), q, "label", "vec_id", "embedding")


@query("sequence_frechet")
def sequence_frechet(spark, directory):
    q = [vector_of(spark, directory, i) for i in range(3)]
    return extras.sequence_distances(vectors(spark, directory), q, "label", "vec_id", "embedding", "frechet")


@query("isolation_forest")
def isolation_forest(spark, directory):
    return extras.isolation_scores(vectors(spark, directory))


@query("private_distances")
def private_distances(spark, directory):
    found = search.top_k(vectors(spark, directory), vector_of(spark, directory), 10)
    return found.select("vec_id", extras.noisy(F.col("distance"), 1.0, 0.01, 7).alias("distance"))


@query("minhash_dedup")
def minhash_dedup(spark, directory):
    return extras.near_duplicates(table(spark, directory, "documents"), 0.8, "doc_id", "text")


@query("embed_text")
def embed_text(spark, directory):
    return table(spark, directory, "documents").select("doc_id", extras.hashed_embedding(F.col("text")).alias("embedding"))
