from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions.stems import stem
from spindrift.functions.times import parse_time
from spindrift.operators import aggregates, serving, text
from spindrift.plans import ql

ROWS = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("word,found", [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hoping", "hope"), ("hopping", "hop"), ("relational", "relat"), ("generously", "generous"), ("hopefulness", "hope"), ("replacement", "replac"), ("skies", "sky"), ("adoption", "adopt"), ("luxuriated", "luxuri"), ("gas", "gas"), ("day", "day"), ("größe", "größe"), ("v2", "v2")])
def test_stems(word, found):
    assert stem(word) == found


def test_words_and_text_search(spark):
    docs = spark.createDataFrame([(1, "The writers kept WRITING; the Größe is 42"), (2, None), (3, ""), (4, "nothing a b")], "doc_id bigint, text string")
    assert {r.doc_id: list(r.w) for r in docs.select("doc_id", text.words(F.col("text")).alias("w")).collect()} == {1: ["writer", "kept", "write", "größe", "42"], 2: [], 3: [], 4: ["noth"]}
    assert [r.doc_id for r in text.bm25(docs, ["writer"]).collect()] == [1]
    assert text.bm25(docs.limit(0), ["writer"]).count() == 0


def test_kinds_of_queries_and_learned_weights(spark):
    assert text.query_kind("How does the writer flush its batch to disk?")[0] == "semantic"
    assert text.query_kind('"exact phrase" ef_search=12')[0] == "keyword"
    assert text.query_kind("") == ("keyword", 0.3, 0.7)
    rows = [("How does it flush the batch to disk?", True, 0.9, 0.1)] * 10 + [("x", None, 0.0, 1.0)]
    found = {r.kind: r for r in text.learned_weights(spark.createDataFrame(rows, "query string, relevant boolean, vector_weight double, text_weight double")).collect()}
    assert found["semantic"].vector_weight == pytest.approx(0.8) and found["mixed"].vector_weight == 0.5


def test_index_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    text.bm25_index(docs, str(tmp_path / "i"))
    text.bm25_index(spark.createDataFrame([(1, "snapshot"), (2, None)], "doc_id bigint, text string"), str(tmp_path / "i"), append=True)
    assert [r.id for r in text.bm25_lookup(spark, str(tmp_path / "i"), ["snapshots"]).collect()] == ["1"]
    assert text.bm25_lookup(spark, str(tmp_path / "i"), []).count() == 0


def test_medoids_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "CANDIDATES", 7)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(60, 3)), 2)
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(60)] + [(90, None, 0), (91, [1.0], 1), (92, [0.0, 0.0, 0.0], None), (93, [0.0, 0.0, 0.0], None)]
    found = {r.label: (r.medoid, r.distance) for r in aggregates.medoids(spark.createDataFrame(rows, ROWS), ["label"], "vec_id").collect()}
    for g in range(3):
        own = np.arange(g, 60, 3)
        sums = np.linalg.norm(x[own].astype(np.float32)[:, None] - x[own].astype(np.float32)[None], axis=2).sum(1)
        assert found[g] == (own[sums.argmin()], pytest.approx(sums.min(), rel=1e-5))
    assert aggregates.medoids(spark.createDataFrame([], ROWS), ["label"], "vec_id").count() == 0


def test_greedy_groups_against_a_scan(spark):
    rng = np.random.default_rng(6)
    for n, m in ((30, 40), (12, 11)):
        links = {(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b} | ({(i, i + 1) for i in range(n - 1)} if n == 12 else set())
        near = {i: {b for a, b in links if a == i} | {a for a, b in links if b == i} for i in range(n)}
        canonical: dict[int, int] = {}
        for i in range(n):
            if i not in canonical and near[i]:
                canonical[i] = i
                canonical |= {j: i for j in near[i] if j not in canonical}
        found = serving.greedy_groups(spark.createDataFrame([(a, b) for a, b in links], "a bigint, b bigint"))
        assert {r.id: r.canonical for r in found.collect()} == canonical
    assert serving.greedy_groups(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_best_path(spark):
    edges = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.9), (2, 1, 0.8), (3, 4, 1.0)], "src bigint, dst bigint, weight double")
    path, product = serving.best_path(edges, 0, 1)
    assert path == [0, 2, 1] and product == pytest.approx(0.72)
    assert serving.best_path(edges, 0, 4) == ([], 0.0)


def test_tokens_of_position():
    token = serving.resume_token(17, "a")
    assert serving.position_of(token, "a") == 17
    for bad in (("zzz", "a"), (token, "b")):
        with pytest.raises(ValueError):
            serving.position_of(*bad)


@pytest.mark.parametrize("expression,found", [("now", datetime(2024, 3, 6, 15)), ("yesterday", datetime(2024, 3, 5)), ("3 days ago", datetime(2024, 3, 3, 15)), ("an hour ago", datetime(2024, 3, 6, 14)), ("in 2 weeks", datetime(2024, 3, 20, 15)), ("last monday", datetime(2024, 3, 4)), ("last wednesday", datetime(2024, 2, 28)), ("last month", datetime(2024, 2, 5, 15)), ("0", datetime(1970, 1, 1)), ("2024-01-02", datetime(2024, 1, 2))])
def test_relative_times(expression, found):
    assert parse_time(expression, datetime(2024, 3, 6, 15)) == found
    with pytest.raises(ValueError):
        parse_time("soon " + expression, datetime(2024, 3, 6, 15))


def test_access_and_pipelines(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, None, None)], ROWS)
    assert rows.where(serving.permitted([], "kim", [])).count() == 0
    rules = [{"effect": "allow", "principal": "*"}, {"effect": "deny", "principal": "role:guest", "field": "label", "value": 1}]
    assert [r.vec_id for r in rows.where(serving.permitted(rules, "kim", ["guest"])).orderBy("vec_id").collect()] == [2, 3]
    stages = [{"stage": "search", "query": [1.0, 0.0], "k": 1}, {"stage": "filter", "where": "label = 2"}]
    named = rows.withColumnRenamed("vec_id", "id")
    assert serving.declared(named, stages).count() == 0 and [r.id for r in serving.declared(named, serving.optimised(stages)).collect()] == [2]
    with pytest.raises(ValueError):
        serving.declared(named, [{"stage": "none"}])
    assert serving.routes([{"collection": "a"}, {"collection": "b", "when": 3, "weight": 2}], 2) == [("a", 1.0)]


def test_half_precision_and_silhouette(spark):
    rows = spark.createDataFrame([(1, [1.0, 70000.0], 1), (2, None, 1), (3, [], 2)], ROWS)
    assert [r.h for r in rows.orderBy("vec_id").select(serving.half(F.col("embedding")).alias("h")).collect()] == [[1.0, float("inf")], None, []]
    apart = spark.createDataFrame([(i, [float(i // 2), 0.0], i // 2) for i in range(4)], ROWS)
    assert serving.silhouette(apart, "label").first().silhouette == pytest.approx(1.0)


def test_query_language_retrieval(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], "snapshot writer"), ("b", [0.9, 0.1], "snapshot writer"), ("c", [0.0, 1.0], "alias table"), ("d", None, None)], "id string, v array<float>, text string")
    say = lambda q: [r.id for r in ql.run(spark, q, {"t": rows}, {"q": [1.0, 0.0]}, vector="v").collect()]
    assert say("SELECT id, score FROM t HYBRID_SEARCH($q, 'alias table', text_weight = 0.9, vector_weight = 0.1)")[0] == "c"
    assert say("SELECT id, score FROM t WHERE v SIMILAR TO $q USING RAG(top_k = 3, deduplicate = true)") == ["a", "c"]
    assert say("SELECT id, score FROM t WHERE v SIMILAR TO $q USING RAG(top_k = 1, question = 'alias', rerank = true)") == ["a"]
    assert say("SELECT id FROM t NEAREST_TO($q, metric = l1) LIMIT 2") == ["a", "b"]
    for bad in ("SELECT id FROM t USING RAG(top_k = 1)", "SELECT id FROM t AS OF VERSION 1", "SELECT id FROM t AS OF NOTHING 1"):
        with pytest.raises(ql.QueryError):
            say(bad)
