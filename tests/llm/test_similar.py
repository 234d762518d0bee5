import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import clusters as C
from spindrift.llm import neighbours as N

SCHEMA = "collection string, id string, vector array<double>, clash string"


def planted(seed=1, width=64, sizes=(12, 9, 5), loners=30):
    """Unit vectors: blobs around random centres, and loners."""
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for b, size in enumerate(sizes):
        centre = rng.normal(size=width)
        centre /= np.linalg.norm(centre)
        for i in range(size):
            v = centre + 0.08 * rng.normal(size=width) / np.sqrt(width) * np.sqrt(width) * 0.6
            rows.append((f"b{b}-{i:02}", v))
            truth[f"b{b}-{i:02}"] = b
    rows += [(f"x{i:02}", rng.normal(size=width)) for i in range(loners)]
    return rows, truth


def frame(spark, rows, collection="c"):
    return spark.createDataFrame([(collection, i, np.asarray(v, float).tolist() if v is not None else None, "x") for i, v in rows], SCHEMA)


def test_unsound_vectors_are_left_out(spark):
    rows = [("ok", [1.0] * 64), ("big", [1e200] * 64), ("short", [1.0] * 63), ("zero", [0.0] * 64), ("nan", [float("nan")] + [1.0] * 63), ("inf", [float("inf")] + [1.0] * 63), ("none", None)]
    units = N.unit_vectors(frame(spark, rows)).collect()
    assert sorted(r.id for r in units) == ["big", "ok"]
    assert all(np.frombuffer(r.unit, np.float32) == pytest.approx(np.full(64, 0.125)) for r in units)
    assert N.unit_vectors(frame(spark, rows).limit(0)).count() == 0


def test_search_without_a_target_is_exact():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, score = N.search(x, x[:50], 10, target=10**9)
    true = np.sort(x[:50] @ x.T, axis=1)[:, ::-1][:, :10]
    assert score == pytest.approx(true, abs=1e-5)
    assert N.search(x[:3], x[:2], 5)[0][:, 3:].tolist() == [[-1, -1]] * 2


def test_traversal_yields_cells_in_the_order_of_their_sums():
    rng = np.random.default_rng(4)
    a, b, counts = rng.random(6), rng.random(6), rng.integers(0, 3, (6, 6))
    i, j = np.argsort(a), np.argsort(b)
    cells = N.closest_cells(a[i].tolist(), b[j].tolist(), i.tolist(), j.tolist(), counts.ravel().tolist(), 10**9)
    sums = [a[c // 6] + b[c % 6] for c in cells]
    assert sums == sorted(sums) and len(cells) == (counts > 0).sum()


def test_recall_on_a_scanned_part(monkeypatch):
    monkeypatch.setattr(N, "SCAN_ROWS", 500)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 64))
    x = (centres[rng.integers(0, 60, 6000)] + 0.5 * rng.normal(size=(6000, 64))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, _ = N.search(x, x[:200], 10, target=1500)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(f) & set(t)) / 10 for f, t in zip(found, true)]) >= 0.9


def test_best_columns_equals_sorting():
    s = np.random.default_rng(6).random((7, 1003))
    for k in (1, 5, 11):
        assert np.sort(np.take_along_axis(s, N.best_columns(s, k), 1), 1) == pytest.approx(np.sort(s, 1)[:, -k:])


# no index; several regions, headers in every task and joined; slices of cells
@pytest.mark.parametrize("scan,cell,region,header", [(10**6, 10**6, 10**6, 10**6), (8, 4, 6, 10**6), (8, 4, 6, 0), (8, 10**6, 3, 10**6)])
def test_neighbours_with_queries_copies_and_regions(spark, monkeypatch, scan, cell, region, header):
    for name, value in (("HEADER_BYTES", header), ("SCAN_ROWS", scan), ("CELL_ROWS", cell), ("REGION_ROWS", region), ("BLOCK_ROWS", region)):
        monkeypatch.setattr(N, name, value)
    data, _ = planted(sizes=(6, 4), loners=10)
    data += [("copy-b", data[0][1]), ("copy-a", data[0][1] * 3)]
    vectors = N.unit_vectors(frame(spark, data)).select("collection", "id", "unit")
    queries = N.unit_vectors(frame(spark, [("q", data[0][1]), (None, data[1][1])])).unionByName(N.unit_vectors(frame(spark, [("q2", data[0][1])], "other"))).select("collection", "id", "unit")
    found = N.similar_vectors(vectors, queries, k=3, exact=True)
    got = {}
    for r in found.collect():
        got.setdefault((r.kind, r.id), []).append((-round(r.similarity, 4), r.neighbour))
    x = {i: np.asarray(v, float) / np.linalg.norm(v) for i, v in data}
    for (kind, i), near in got.items():
        point = x["b0-00"] if kind == "query" else x[i]
        true = sorted((-round(float(point @ v), 4), j) for j, v in x.items() if kind == "query" or j != i)[:3]
        assert [s for s, _ in sorted(near)] == pytest.approx([s for s, _ in true], abs=2e-4)
    assert sorted(n for _, n in got["query", "q"]) == ["b0-00", "copy-a", "copy-b"]
    assert set(got) == {("vector", i) for i in x} | {("query", "q")}
    pairs = N.pairs_at_least(N.similar_vectors(vectors, queries, k=3, at_least=0.999, exact=True)).collect()
    assert len(pairs) == len(set(pairs)) == 6 and all(r.low_id < r.high_id for r in pairs)


def test_no_vectors(spark):
    empty = N.unit_vectors(frame(spark, [("a", [1.0] * 64)]).limit(0)).select("collection", "id", "unit")
    assert N.similar_vectors(empty, empty).count() == 0
    assert C.clusters(empty).count() == 0


def test_rounds_merge_what_is_near_and_nothing_else():
    x = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99], [-1, 0]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.triu_indices(5, 1)
    assert C.link(x, np.ones(5), a, b, 0.6, 3).tolist() == [0, 0, 2, 2, 4]


@pytest.mark.parametrize("local_nodes", [10**6, 8])
def test_clusters(spark, local_nodes):
    data, truth = planted()
    data.append(("copy", data[0][1]))
    units = N.unit_vectors(frame(spark, data)).select("collection", "id", "unit")
    got = {r.id: (r.first_id, r.size) for r in C.clusters(units, local_nodes=local_nodes).collect()}
    want = {i: (f"b{b}-00", {0: 13, 1: 9}[b]) for i, b in truth.items() if b < 2} | {"copy": ("b0-00", 13)}
    assert got == want


def test_more_clusters_than_fit_a_task(spark):
    data, truth = planted(sizes=(9, 8, 8, 9), loners=0)
    units = N.unit_vectors(frame(spark, data)).select("collection", "id", "unit")
    got = {r.id: (r.first_id, r.size) for r in C.clusters(units, local_nodes=2).collect()}
    assert got == {i: (f"b{b}-00", (9, 8, 8, 9)[b]) for i, b in truth.items()}


def test_description(spark):
    data, _ = planted(sizes=(9,), loners=3)
    units = N.unit_vectors(frame(spark, data)).select("collection", "id", "unit")
    row = C.described(C.clusters(units)).collect()
    x = np.array([v / np.linalg.norm(v) for i, v in data[:9]])
    order = np.argsort(-(x @ x.mean(0)))[:3]
    assert len(row) == 1 and row[0].size == 9 and row[0].typical == [f"b0-{i:02}" for i in order]
