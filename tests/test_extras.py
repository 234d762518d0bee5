import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import extras as X


def test_near_duplicates(spark):
    base = "the compacted reranker merges each nested posting file under memory pressure while the mirror lags"
    rows = [(1, base), (2, base + "."), (3, base), (4, "something else altogether, with other words"), (5, None), (6, None), (7, "")]
    got = {r.id: r.canonical for r in X.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "id bigint, content string, node string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}


def test_near_duplicates_behind_other_texts_of_their_bands(spark):
    rng = np.random.default_rng(5)

    def letters(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))

    base = letters(400)
    texts = {i: base + letters(120) for i in [*range(100), *range(1001, 1400)]} | {1000: base, 2000: base[:-3] + letters(12)}
    near = lambda a, b: len(X.char_shingles(a) & X.char_shingles(b)) / len(X.char_shingles(a) | X.char_shingles(b)) >= 0.8
    assert {(a, b) for a in texts for b in texts if a < b and near(texts[a], texts[b])} == {(1000, 2000)}
    frame = spark.createDataFrame(list(texts.items()), "id bigint, content string")
    assert {r.id: r.canonical for r in X.near_duplicates(frame).collect()} == {i: 1000 if i == 2000 else i for i in texts}


def test_linked_texts_are_those_of_all_pairs(monkeypatch, spark):
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(60)]
    texts = {}
    for i in range(200):
        own = list(rng.choice(words, 30)) if i < 20 else texts[int(rng.integers(i))].split()
        own[int(rng.integers(30))] = str(rng.choice(words))
        texts[i] = " ".join(own)
    sets = {i: X.char_shingles(t) for i, t in texts.items()}
    first = {i: i for i in texts}
    for a in texts:
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and first[a] != first[b]:
                low, high = sorted((first[a], first[b]))
                first = {k: low if v == high else v for k, v in first.items()}
    monkeypatch.setattr(X, "BLOCK", 16)  # hot bands in many blocks
    got = {r.id: r.canonical for r in X.near_duplicates(spark.createDataFrame(list(texts.items()), "id bigint, content string")).collect()}
    assert got == first and len(set(first.values())) < 100


def test_embedding_is_deterministic_and_unit(spark):
    rows = spark.createDataFrame([("a b a",), ("a b a",), ("",), (None,)], "t string")
    v = [np.array(r[0]) for r in rows.select(X.hashed_embedding(F.col("t"), 16)).collect()]
    assert (v[0] == v[1]).all() and np.linalg.norm(v[0]) == pytest.approx(1, abs=1e-6) and not v[2].any() and not v[3].any()


def test_warping_and_frechet():
    a = np.array([[0.0], [1.0], [2.0]])
    assert X.warped(a, a) == 0 and X.warped(a, np.repeat(a, 2, 0)) == 0 and X.frechet(a, a + 3) == 3


def test_isolation_forest_finds_the_far_point(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)] + [(999, [30.0] * 4), (1000, None)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    scores = {r.vec_id: r.score for r in X.isolation_scores(frame, trees=20).collect()}
    assert max(scores, key=scores.get) == 999 and 1000 not in scores
    assert X.isolation_scores(frame.limit(0)).count() == 0
