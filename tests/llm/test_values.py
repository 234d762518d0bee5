import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import mixture as M
from spindrift.llm import quantiles as Q


def test_codes_keep_the_order_and_the_value():
    x = np.sort(np.abs(np.random.default_rng(1).lognormal(2, 3, 2000)))
    codes = Q.encode(x)
    assert (np.diff(codes) >= 0).all() and Q.decode(codes) == pytest.approx(x, rel=2**-11)
    assert Q.decode(Q.encode(np.array([0.0, 1e-300]))).tolist() == [0.0, 0.0] and Q.encode(np.array([1e300]))[0] == 2**Q.BITS - 1


def sketch_of(x, w=None):
    s = np.zeros((1, Q.SIZE), np.int64)
    Q.add(s, np.zeros(len(x), np.int64), Q.encode(x), np.ones(len(x)) if w is None else w)
    return s[0]


def rank_error(x, value, rank):
    x = np.sort(x)
    low, high = np.searchsorted(x, value * (1 - 2**-10)) + 1, np.searchsorted(x, value * (1 + 2**-10), "right")
    return max(0, low - rank, rank - high) / len(x)


@pytest.mark.parametrize("kind", ["lognormal", "uniform", "constant", "modes"])
def test_rank_errors_are_small(kind):
    rng = np.random.default_rng(2)
    x = {"lognormal": rng.lognormal(3, 1, 50_000), "uniform": rng.random(50_000) * 100, "constant": np.full(50_000, 7.0), "modes": np.r_[rng.normal(10, 1, 30_000), rng.normal(500, 9, 20_000)]}[kind]
    ranks = [int(np.ceil(q * len(x))) for q in (0.01, 0.25, 0.5, 0.9, 0.99, 0.999)]
    assert max(rank_error(x, v, r) for v, r in zip(Q.invert(sketch_of(x), ranks), ranks)) <= 0.005


def test_merging_and_taking_out_are_addition():
    rng = np.random.default_rng(3)
    a, b = rng.random(3000), rng.random(2000) * 9
    assert (sketch_of(a) + sketch_of(b) == sketch_of(np.r_[a, b])).all()
    assert (sketch_of(np.r_[a, b], np.r_[np.ones(3000), np.ones(2000)]) + sketch_of(b, -np.ones(2000)) == sketch_of(a)).all()


def test_percentiles_by_group(spark):
    rows = [("a", float(i)) for i in range(1, 101)] + [("a", v) for v in (None, float("nan"), float("inf"), -1.0)] + [(None, 5.0), ("only bad", None)]
    frame = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "k string, v double, day int, n string").repartition(3)
    parts = Q.sketches(frame, ["k"], "v")
    got = {r.k: (r.n, r.p50, r.p99) for r in Q.percentiles(Q.merged(parts, ["k"]), ["k"], {"p50": 0.5, "p99": 0.99}).collect()}
    assert got == {"a": (100, pytest.approx(50, rel=1e-3), pytest.approx(99, rel=1e-3)), None: (1, pytest.approx(5, rel=1e-3), pytest.approx(5, rel=1e-3))}
    days = Q.merged(Q.sketches(frame, ["k", "day"], "v"), ["k", "day"])  # partial results, combined later
    assert {r.k: r.p50 for r in Q.percentiles(Q.merged(days, ["k"]), ["k"], {"p50": 0.5}).collect()} == {k: v[1] for k, v in got.items()}
    assert Q.sketches(frame.limit(0), ["k"], "v").count() == 0


def test_small_sketches_are_lists_and_grow_into_tables():
    rng = np.random.default_rng(4)
    x = rng.lognormal(3, 2, 5000)
    codes, n = np.unique(Q.encode(x), return_counts=True)
    one, parts = Q._Sum(), []
    for at in range(0, len(codes), 700):
        part = Q._Sum()
        part.put(codes[at : at + 700], n[at : at + 700])
        parts.append(part.packed())
        one.put_packed(parts[-1])
    assert parts[0][:1] == b"\0" and one.packed()[:1] == b"\1" and one.n() == 5000
    assert (one.table[0] == sketch_of(x)).all()
    few = Q._Sum()
    few.put(np.array([5, 9]), np.array([2, 1]))
    few.put(np.array([9, 4]), np.array([-1, 1]))
    assert few.n() == 3 and few.at([1, 2, 3]) == Q.decode(np.array([4, 5, 5])).tolist()


def test_many_groups_are_held_in_bounded_memory(spark):
    rows = spark.range(300_000, numPartitions=2).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("v"))
    parts = Q.sketches(rows, ["k"], "v")
    assert parts.count() == 300_000 and parts.agg(F.sum("n")).first()[0] == 300_000


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, target_weight double, max_repeats int")


def test_mixture_reaches_its_shares(spark):
    counts = spark.createDataFrame([(i, "big", 50 + i % 7) for i in range(400)] + [(1000 + i, "small", 40) for i in range(20)] + [(2000, "unlisted", 9), (2001, None, 9)], "id bigint, source string, n_tokens bigint")
    plan = M.plan(counts, targets(spark, ("big", 0.6, 2), ("small", 0.3, 4), ("absent", 0.1, 3), (None, 0.5, 1)))
    used = M.mixed(counts, plan).cache()
    report = {r.source: r for r in M.shares(used, plan).collect()}
    assert set(report) == {"big", "small", "absent"} and report["absent"].n_tokens == 0
    assert report["small"].most_repeats <= 4 and report["big"].most_repeats <= 2
    assert report["big"].actual_share == pytest.approx(2 / 3, abs=0.02) and report["small"].actual_share == pytest.approx(1 / 3, abs=0.02)
    assert used.where(F.col("source").isNull() | (F.col("source") == "unlisted")).count() == 0
    again = M.mixed(counts.repartition(5), plan)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, used.collect()))


def test_a_cap_holds_whatever_the_total(spark):
    counts = spark.createDataFrame([(i, "s", 10) for i in range(5)], "id bigint, source string, n_tokens bigint")
    plan = M.plan(counts, targets(spark, ("s", 1.0, 3)), total=1e9)
    assert [r.copies for r in M.mixed(counts, plan).collect()] == [3] * 5


def test_nothing_to_mix(spark):
    counts = spark.createDataFrame([(1, "s", 0), (2, "t", None)], "id bigint, source string, n_tokens bigint")
    for c in (counts, counts.limit(0)):
        plan = M.plan(c, targets(spark, ("s", 0.5, 1), ("t", None, 2), ("u", 0.2, 0)))
        assert M.mixed(c, plan).count() == 0 and M.shares(M.mixed(c, plan), plan).count() == 3


def test_token_counts(spark):
    from spindrift.llm.tokens import vocabulary

    docs = spark.createDataFrame([(1, "s", "Hello world"), (2, None, None), (3, "s", "")], "doc_id bigint, source string, text string")
    got = {r.id: r.n_tokens for r in M.token_counts(docs, vocabulary()).collect()}
    assert got[1] >= 2 and got[2] == got[3] == 0
