import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions.distance import distance, metric, normalized
from spindrift.operators import aggregates, fusion, graph, search, sparse
from spindrift.plans import ql
from spindrift.plans import vector_queries as V
from spindrift.runtime import table

ROWS = [(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [0.0, 0.0], "a"), (4, [1.0, 0.0], None), (5, None, "b"), (6, [3.0, 4.0], "a")]

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "vec_id bigint, embedding array<float>, tag string")


def brute(name, a, b):
    a, b = np.array(a, float), np.array(b, float)
    if name == "cosine":
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return 1.0 if n == 0 else 1 - a @ b / n
    return {"l2": lambda: np.linalg.norm(a - b), "dot": lambda: -(a @ b), "l1": lambda: np.abs(a - b).sum(), "linf": lambda: np.abs(a - b).max(), "hamming": lambda: float(((a != 0) != (b != 0)).sum())}[name]()


@pytest.mark.parametrize("name", ["cosine", "l2", "dot", "l1", "linf", "hamming"])
@pytest.mark.parametrize("width", [2, 40])
def test_distances_equal_brute_force(spark, name, width):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=width).round(3).tolist()) for i in range(6)] + [(7, [0.0] * width), (8, None), (9, [1.0])]
    q = rng.normal(size=width).tolist()
    frame = spark.createDataFrame(data, "id bigint, v array<double>")
    found = {r.id: (r.lit, r.col) for r in frame.where("id < 8").select("id", distance(name, F.col("v"), q).alias("lit"), distance(name, F.col("v"), F.array(*[F.lit(x) for x in q])).alias("col")).collect()}
    for i, v in data[:7]:
        assert found[i] == pytest.approx((brute(name, v, q),) * 2)
    assert [r[0] for r in frame.where("id >= 8").select(distance(name, F.col("v"), q)).collect()] == [None, None]


def test_metric_names():
    assert metric(" Euclidean ") == "l2" and metric("INNER_PRODUCT") == "dot"
    with pytest.raises(ValueError):
        metric("nearest")


def test_normalized_keeps_zero(rows):
    assert [r[0] for r in rows.orderBy("vec_id").select(normalized(F.col("embedding"))).collect()][2:] == [[0.0, 0.0], [1.0, 0.0], None, pytest.approx([0.6, 0.8])]


def test_top_k_ties_filter_and_limits(rows):
    ids = lambda df: [r.vec_id for r in df.collect()]
    assert ids(search.top_k(rows, [1.0, 0.0], 3)) == [1, 4, 6]
    assert ids(search.top_k(rows, [1.0, 0.0], 99)) == [1, 4, 6, 2, 3]
    assert ids(search.top_k(rows, [1.0, 0.0], 0)) == []
    assert ids(search.top_k(rows, [1.0, 0.0], 9, where=F.col("tag") == "a")) == [1, 6, 3]
    assert ids(search.radius(rows, [1.0, 0.0], float("nan"))) == [] and ids(search.radius(rows, [1.0, 0.0], -1)) == []
    assert sorted(ids(search.radius(rows, [1.0, 0.0], 1.0, metric="l2"))) == [1, 3, 4]
    assert ids(search.top_k(rows.limit(0), [1.0, 0.0], 3)) == []


def test_batch_equals_single(rows):
    asked = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in search.batch_top_k(rows, asked, 2, "l2").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for i, v, _ in ROWS:
        if v:
            assert [x[1] for x in sorted(got[i])] == [r.vec_id for r in search.top_k(rows, v, 2, "l2").collect()]
    assert search.batch_top_k(rows, asked.limit(0), 2).count() == 0


def test_decay(spark):
    ages = spark.createDataFrame([(0.0,), (10.0,), (40.0,), (-5.0,)], "age double")
    value = lambda kind, **k: [round(r[0], 4) for r in ages.select(search.decay(F.col("age"), kind, 10.0, **k)).collect()]
    assert value("exp") == [1.0, 0.5, 0.0625, 1.0]
    assert value("linear") == [1.0, 0.0, 0.0, 1.0]
    assert value("gauss") == [1.0, round(math.exp(-1), 4), round(math.exp(-16), 4), 1.0]
    assert value("step", steps=[(10, 0.5), (5, 1.0)]) == [1.0, 0.5, 0.0, 1.0]


def test_fusion(spark):
    lists = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.2), ("b", 2, 5.0), ("b", 3, 5.0)], "source string, id bigint, distance double")
    assert {r.id: round(r.score, 6) for r in fusion.rrf(lists).collect()} == {1: round(1 / 61, 6), 2: round(1 / 62 + 1 / 61, 6), 3: round(1 / 62, 6)}
    assert [(r.id, r.source) for r in fusion.nearest_of(lists, 2).collect()] == [(1, "a"), (2, "a")]
    assert [r.id for r in fusion.consensus(lists, 1).collect()] == [2]
    assert {(r.source, r.id): r.distance for r in fusion.federated(lists, "minmax").collect()} == {("a", 1): 0.0, ("a", 2): 1.0, ("b", 2): 0.0, ("b", 3): 0.0}
    assert [r.id for r in fusion.intersection(lists, 2).collect()] == [2]


def test_sparse_and_late_interaction(spark):
    s = spark.createDataFrame([(1, {0: 1.0, 3: 2.0}), (2, {1: 1.0}), (3, None), (4, {})], "id bigint, sparse map<int,double>")
    assert [(r.id, r.score) for r in sparse.sparse_search(s, {3: 2.0, 9: 1.0}, 5).collect()] == [(1, 4.0)]
    m = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, []), (3, None), (4, [[0.5, 0.5]])], "id bigint, tokens array<array<double>>")
    assert [(r.id, r.score) for r in sparse.max_sim(m, [[1.0, 0.0], [0.0, 1.0]], 5).collect()] == [(1, 2.0), (4, 1.0)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0)], "src bigint, dst bigint, weight double")
    assert {(r.node, r.hop) for r in graph.neighbourhood(e, [1], 5).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert graph.shortest_path(e, 1, 3) == [1, 2, 3] and graph.shortest_path(e, 1, 5) == []
    assert {(r.node, r.component) for r in graph.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert sum(r["rank"] for r in graph.page_rank(e, rounds=3).collect()) == pytest.approx(1.0)
    assert graph.components(e.limit(0)).count() == 0


def test_outliers_and_drift(spark, rows):
    d = spark.createDataFrame([(i, 1.0) for i in range(20)] + [(99, 50.0)], "id bigint, distance double")
    assert [r.id for r in aggregates.zscore_outliers(d, 3.0).collect()] == [99]
    assert aggregates.zscore_outliers(d.limit(2), 0.0).count() == 0
    assert aggregates.ks_statistic(d, d, "distance").first()[0] == 0
    some = rows.where("embedding is not null")
    assert aggregates.drift(some, some).first().centroid_shift == pytest.approx(0)


def test_query_language(spark, rows):
    run = lambda text, **p: [r.vec_id for r in ql.run(spark, text, {"t": rows}, p, id="vec_id").collect()]
    q = [1.0, 0.0]
    assert run("SELECT vec_id FROM t WHERE tag = 'a' AND embedding SIMILAR TO $q LIMIT 2", q=q) == [1, 6]
    assert run("SELECT vec_id FROM t ORDER BY vec_id DESC LIMIT 2 OFFSET 1") == [5, 4]
    assert run("SELECT vec_id FROM t WHERE NOT tag = 'a' OR vec_id BETWEEN 1 AND 1") == [1, 2, 4, 5]
    assert run("SELECT vec_id FROM t WHERE tag IS NULL") == [4]
    assert run("SELECT vec_id FROM t WHERE cosine_similarity(embedding, $q) > 0.9", q=q) == [1, 4]
    assert run("SELECT vec_id FROM t WHERE embedding SIMILAR TO $q RERANK BY MMR(0.3) LIMIT 3", q=q)[0] == 1
    for bad in ("SELECT vec_id FROM t WHERE tag = 'a' OR embedding SIMILAR TO $q", "SELECT vec_id FROM t WHERE NOT embedding SIMILAR TO $q", "SELECT vec_id FROM t LIMIT 10001", "SELECT vec_id FROM t WHERE tag = $none", "SELECT FROM", "SELECT vec_id FROM t WITH TIME_DECAY(exp)", "SELECT vec_id FROM nowhere"):
        with pytest.raises(ql.QueryError):
            run(bad, q=q)


@pytest.mark.parametrize("name", ["pq_search", "ivf_search"])
def test_quantised_searches_find_the_true_neighbours(spark, name):
    rows = table(spark, SF, "embeddings")
    x = {r.vec_id: np.array(r.embedding, float) for r in rows.select("vec_id", "embedding").collect()}
    got: dict = {}
    for r in V.QUERIES[name](spark, SF).collect():
        assert r.distance == pytest.approx(np.linalg.norm(x[r.query_id] - x[r.vec_id]), abs=1e-6)
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sorted(got) == [i for i in sorted(x) if i % 50 == 0] and all(len(v) == 10 for v in got.values())
    true = {q: set(sorted(x, key=lambda i: (np.linalg.norm(x[q] - x[i]), i))[:10]) for q in got}
    recall = np.mean([len(got[q] & true[q]) / 10 for q in got])
    print(name, "recall@10", recall)
    assert recall >= 0.9


def test_shortest_path_of_many_hops(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(13)] + [(20, 21, 1.0)], "src bigint, dst bigint, weight double")
    assert graph.shortest_path(chain, 0, 13) == list(range(14)) and graph.shortest_path(chain, 0, 21) == []
    assert graph.shortest_path(chain, 0, 13, most=5) == []


def test_batch_search_without_a_limit(spark, rows):
    asked = rows.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    found = search.batch_top_k(rows, asked, None, most=0.5, exclude_self=True)
    assert {(r.query_id, r.vec_id) for r in found.collect()} == {(1, 4), (1, 6)}
    assert "rank" not in found.columns and search.batch_top_k(rows, asked, None).count() == 5


@pytest.mark.parametrize("name", ["cosine", "cosine_unit", "l2", "l2sq", "dot", "l1", "linf", "hamming"])
@pytest.mark.parametrize("width", [3, 40])
def test_vectors_of_another_width_have_no_distance(spark, name, width):
    rows = spark.createDataFrame([(n, [1.0] * n) for n in (0, width - 1, width, width + 1, 2 * width)] + [(-1, None)], "n int, v array<double>")
    found = {r.n: r.d for r in rows.select("n", distance(name, F.col("v"), [0.5] * width).alias("d")).collect()}
    assert [n for n, d in found.items() if d is not None] == [width]
