"""Groups of mutually similar vectors, by average linkage of reciprocal nearest neighbours.

Method. Copies of a vector start as one cluster. Each node's most similar vectors (the inverted
multi-index of :mod:`spindrift.llm.neighbours`) make a sparse graph of the pairs at or above the linkage threshold. Each
round merges all pairs of clusters that are each other's best at once; the similarity of two clusters is the average cosine over
all pairs of their members, exact at every round, since it is the product of the two sums of unit vectors divided by the two
sizes. When no linked pair reaches the threshold, the clusters themselves are searched for their most similar clusters, and
the rounds go on; all ends when such a search links nothing either.

A collection's nodes meet in one task while they number at most :data:`LOCAL_NODES`; a larger collection runs the same rounds as
joins, cut to a table each, until it has shrunk to that, so that no unbounded group meets in one task. The rounds
themselves are the same.

Last, membership is made to fit the definition of a cluster: its members are the vectors whose cosine to the mean of its members'
unit vectors is at least ``member_cosine``. A vector's candidates are its own cluster and those of its neighbours in the graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.llm import neighbours
from spindrift.llm.neighbours import matrix, packed
from spindrift.runtime import cut, small

#: Nodes of a collection that one task may hold: 256 bytes each, and a few hundred for its links.
LOCAL_NODES = 500_000


# ---- rounds in one task -------------------------------------------------------------------------------------------


def merge_mutual(sums: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Merge along the links (a, b) until none reaches ``threshold``; ``sums`` and ``counts`` are changed in place.

    Each round takes, for every cluster, its best link (of equal ones that to the smaller number) and merges the pairs whose best
    links are each other. Result: the number of the cluster (its smallest member) of each node."""
    n = len(counts)
    root = np.arange(n)
    a, b = _links(a, b, n)
    similarity = _average(sums, counts, a, b)
    while True:
        keep = similarity >= threshold
        a, b, similarity = a[keep], b[keep], similarity[keep]
        if not len(a):
            break
        one, other, value = np.r_[a, b], np.r_[b, a], np.r_[similarity, similarity]
        order = np.lexsort((other, -value, one))
        one, other = one[order], other[order]
        first = np.flatnonzero(np.diff(one, prepend=-1))
        best = np.full(n, -1)
        best[one[first]] = other[first]
        node = one[first]
        kept = node[(best[best[node]] == node) & (node < best[node])]
        gone = best[kept]
        sums[kept] += sums[gone]
        counts[kept] += counts[gone]
        root[gone] = kept
        changed = np.zeros(n, bool)
        changed[kept] = True
        now = np.arange(n)
        now[gone] = kept
        a, b = now[a], now[b]
        a, b, similarity = _links(a, b, n, similarity)
        again = changed[a] | changed[b]
        similarity[again] = _average(sums, counts, a[again], b[again])
    while (root[root] != root).any():
        root = root[root]
    return root


def _links(a: np.ndarray, b: np.ndarray, n: int, value: np.ndarray | None = None):
    """Each link between different nodes once, the smaller number first."""
    keep = a != b
    low, high = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
    code, at = np.unique(low * n + high, return_index=True)
    return (code // n, code % n) if value is None else (code // n, code % n, value[keep][at])


def _average(sums: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for at in range(0, len(a), 65_536):
        part = slice(at, at + 65_536)
        out[part] = np.einsum("ij,ij->i", sums[a[part]], sums[b[part]]) / (counts[a[part]] * counts[b[part]])
    return out


def link(sums: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, k: int) -> np.ndarray:
    """Average linkage over the links (a, b), then over links between the clusters, until nothing merges."""
    sums, counts = sums.astype(np.float64), counts.astype(np.float64)
    root = merge_mutual(sums, counts, a, b, threshold)
    while True:
        tops = np.flatnonzero(root == np.arange(len(root)))
        means = sums[tops] / np.linalg.norm(sums[tops], axis=1, keepdims=True)
        found, score = neighbours.search(means.astype(np.float32), means.astype(np.float32), k + 1)
        one, place = np.nonzero((found >= 0) & (score >= threshold - 1e-6))
        x, y = tops[one], tops[found[one, place]]
        step = merge_mutual(sums, counts, x, y, threshold)
        if (step == np.arange(len(step))).all():
            return root
        root = step[root]


def refit(units: np.ndarray, root: np.ndarray, a: np.ndarray, b: np.ndarray, member_cosine: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Membership by the definition: (the cluster of each row or -1, its cosine to the mean), from a first ``root``.

    A row's candidates are its own cluster and those of the rows it is linked to; it joins the nearest at or above ``member_cosine``. Rounds go
    on until the membership stays, or is one that was there before."""
    n = len(units)
    seen: set[int] = set()
    ends, others = np.r_[a, b, np.arange(n)], np.r_[b, a, np.arange(n)]
    cosine = np.zeros(n)
    while True:
        used = np.flatnonzero(root >= 0)
        order = used[np.argsort(root[used], kind="stable")]
        names, first = np.unique(root[order], return_index=True)
        sums = np.add.reduceat(units[order].astype(np.float64), first) if len(order) else np.zeros((0, units.shape[1]))
        size = np.diff(np.r_[first, len(order)])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        means = sums / np.where(norm > 0, norm, 1)
        place = np.full(n, -1)
        place[names] = np.where(size >= (least + 1) // 2, np.arange(len(names)), -1)
        of = np.where(root[others] >= 0, place[root[others]], -1)
        pairs = np.unique(ends[of >= 0] * np.int64(len(names) + 1) + of[of >= 0])
        row, cluster = pairs // (len(names) + 1), pairs % (len(names) + 1)
        value = np.empty(len(row))
        for at in range(0, len(row), 65_536):
            part = slice(at, at + 65_536)
            value[part] = np.einsum("ij,ij->i", units[row[part]], means[cluster[part]])
        good = value >= member_cosine
        row, cluster, value = row[good], cluster[good], value[good]
        order = np.lexsort((cluster, -value, row))
        lead = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        now = np.full(n, -1)
        now[row[lead]] = names[cluster[lead]]
        cosine[row[lead]] = value[lead]
        state = hash(now.tobytes())
        steady = (now == root).all() or state in seen
        seen.add(state)
        root = now
        if steady:
            break
    return root, cosine


def copies_first(units: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, k: int) -> np.ndarray:
    """:func:`link` over rows of which the copies are one node each; the number of the cluster of each row."""
    first, number = neighbours.distinct_rows(units)
    order = np.argsort(first)  # nodes in the order of their first rows, as the ties ask for
    at = np.empty(len(first), np.int64)
    at[order] = np.arange(len(first))
    number, first = at[number], first[order]
    counts = np.bincount(number)
    root = link(units[first] * counts[:, None], counts, number[a], number[b], threshold, k)
    return first[root][number]


def _sorted(nodes: pa.Table, links: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows by id, sorted ids, and the links as places in these)"""
    ids = nodes.column("id").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    return order, ids, *(np.searchsorted(ids, links.column(c).to_numpy()) for c in ("a", "b"))


def _local(threshold: float, k: int, width: int, member_cosine: float, least: int):
    """Linkage and membership of one collection: its members with cluster and cosine."""

    def run(key: tuple, nodes: pa.Table, links: pa.Table) -> pa.Table:
        order, ids, a, b = _sorted(nodes, links)
        root, cosine = np.zeros(0, np.int64), np.zeros(0)
        if len(ids):
            units = matrix(nodes.column("unit"), width)[order]
            linked = np.zeros(len(ids), bool)
            linked[a] = linked[b] = True
            some = np.flatnonzero(linked)  # the others are alone: nothing is near enough
            short = np.cumsum(linked) - 1
            root = np.arange(len(ids))
            root[some] = some[copies_first(units[some], short[a], short[b], threshold, k)]
            root, cosine = refit(units, root, a, b, member_cosine, least)
        kept = np.flatnonzero(root >= 0)
        return pa.table({"collection": pa.repeat(key[0], len(kept)).cast(pa.string()), "id": pa.array(ids[kept], pa.int64()), "root": pa.array(ids[root[kept]], pa.int64()), "cosine": pa.array(cosine[kept])})

    return lambda key, nodes, links: run(tuple(x.as_py() for x in key), nodes, links)


def _roots(threshold: float, k: int, width: int):
    """Linkage of what is left of a large collection."""

    def run(key: tuple, nodes: pa.Table, links: pa.Table) -> pa.Table:
        order, ids, a, b = _sorted(nodes, links)
        root = np.zeros(0, np.int64)
        if len(ids):
            root = link(matrix(nodes.column("sum"), width)[order], nodes.column("n").to_numpy()[order], a, b, threshold, k)
        return pa.table({"collection": pa.repeat(key[0], len(ids)).cast(pa.string()), "id": pa.array(ids, pa.int64()), "root": pa.array(ids[root], pa.int64())})

    return lambda key, nodes, links: run(tuple(x.as_py() for x in key), nodes, links)


# ---- rounds as joins ----------------------------------------------------------------------------------------------


def _dot(width: int):
    @F.pandas_udf("double")
    def dot(x, y):
        import pandas as pd

        one, two = (np.frombuffer(b"".join(v), np.float32).reshape(-1, width).astype(np.float64) for v in (x, y))
        return pd.Series((one * two).sum(1))

    return dot


def _added(width: int):
    @F.pandas_udf("binary")
    def added(x, y):
        import pandas as pd

        one, two = (np.frombuffer(b"".join(v), np.float32).reshape(-1, width) for v in (x, y))
        return pd.Series([row.tobytes() for row in one + two])

    return added


def merge_round(nodes: DataFrame, links: DataFrame, threshold: float, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of :func:`merge_mutual` over all rows: (nodes, links, merges), each cut to a table.

    nodes: collection, id, sum, n; links: collection, a, b with a < b; merges: collection, gone, kept."""
    side = lambda c: nodes.select("collection", F.col("id").alias(c), F.col("sum").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    scored = (
        links.join(side("a"), ["collection", "a"])
        .join(side("b"), ["collection", "b"])
        .select("collection", "a", "b", (_dot(width)("sa", "sb") / (F.col("na") * F.col("nb"))).alias("similarity"))
    )
    scored = cut(scored.where(F.col("similarity") >= threshold))
    both = scored.unionByName(scored.select("collection", F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    best = both.groupBy("collection", "a").agg(F.max_by("b", F.struct("similarity", -F.col("b"))).alias("b"))
    pair = best.select("collection", F.least("a", "b").alias("kept"), F.greatest("a", "b").alias("gone"))
    merges = cut(pair.groupBy("collection", "kept", "gone").count().where("count = 2").drop("count"))
    gone = merges.select("collection", F.col("gone").alias("id"), F.col("kept").alias("into"))
    lost = nodes.join(gone, ["collection", "id"]).select("collection", F.col("into").alias("id"), F.col("sum").alias("more"), F.col("n").alias("m"))
    rest = nodes.join(gone, ["collection", "id"], "left_anti").join(lost, ["collection", "id"], "left")
    grown = rest.where("m is not null").select("collection", "id", _added(width)("sum", "more").alias("sum"), (F.col("n") + F.col("m")).alias("n"))
    nodes = cut(rest.where("m is null").select("collection", "id", "sum", "n").unionByName(grown))
    for c in ("a", "b"):
        moved = merges.select("collection", F.col("gone").alias(c), F.col("kept").alias("into"))
        scored = scored.join(moved, ["collection", c], "left").withColumn(c, F.coalesce("into", c)).drop("into")
    links = scored.where("a <> b").select("collection", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return nodes, cut(links), merges


def link_large(nodes: DataFrame, links: DataFrame, threshold: float, k: int, width: int, local_nodes: int) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Rounds over the collections with more than ``local_nodes`` nodes until none is left or nothing merges.

    (nodes, links, moves, ended): what remains of them, for each node that was merged (collection, id) the node it is in now (root), and the
    nodes of collections that are still large when nothing merges, each its own root: their linkage has ended."""
    moves = None
    while True:
        large = nodes.groupBy("collection").count().where(F.col("count") > local_nodes).select("collection")
        if not large.limit(1).count():
            return nodes, links, moves, None
        big = small(cut(large))
        here, there = (x.join(big, "collection", "left_semi") for x in (nodes, links))
        here, there, merges = merge_round(here, there, threshold, width)
        if not merges.limit(1).count():
            unit = here.select("collection", "id", _unit(width)("sum").alias("unit"))
            found = neighbours.similar_vectors(unit, k=k, at_least=threshold - 1e-6, width=width)
            there = cut(_undirected(found))
            here, there, merges = merge_round(here, there, threshold, width)
            if not merges.limit(1).count():
                nodes, links = (x.join(big, "collection", "left_anti") for x in (nodes, links))
                return nodes, links, moves, here.select("collection", "id", F.col("id").alias("root"))
        step = merges.select("collection", F.col("gone").alias("id"), F.col("kept").alias("root"))
        if moves is None:
            moves = step
        else:
            on = step.select("collection", F.col("id").alias("root"), F.col("root").alias("next"))
            moves = cut(moves.join(on, ["collection", "root"], "left").select("collection", "id", F.coalesce("next", "root").alias("root")).unionByName(step))
        nodes = cut(nodes.join(big, "collection", "left_anti").unionByName(here))
        links = cut(links.join(big, "collection", "left_anti").unionByName(there))


def _unit(width: int):
    @F.pandas_udf("binary")
    def unit(x):
        import pandas as pd

        rows = np.frombuffer(b"".join(x), np.float32).reshape(-1, width)
        return pd.Series([row.tobytes() for row in rows / np.linalg.norm(rows, axis=1, keepdims=True)])

    return unit


def _undirected(found: DataFrame) -> DataFrame:
    return found.select("collection", F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()


# ---- membership ---------------------------------------------------------------------------------------------------


def _partial_sums(width: int):
    """Sums of the unit vectors by cluster within each batch: the map side of the means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, int]] = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    packed(np.array([held[k][0] for k in keys], np.float64).reshape(-1, width)),
                    pa.array([held[k][1] for k in keys], pa.int64()),
                ],
                ["collection", "root", "sum", "n"],
            )

        for batch in batches:
            units = matrix(batch.column("unit"), width).astype(np.float64)
            keys = list(zip(batch.column("collection").to_pylist(), batch.column("root").to_pylist()))
            number: dict[tuple, int] = {}
            group = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)
            sums = np.zeros((len(number), width))
            np.add.at(sums, group, units)
            count = np.bincount(group, minlength=len(number))
            for key, i in number.items():
                old = held.get(key)
                held[key] = (sums[i] if old is None else old[0] + sums[i], int(count[i]) + (old[1] if old else 0))
            if len(held) > 50_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


def _add_partials(width: int):
    def run(key: tuple, parts: pa.Table) -> pa.Table:
        total = np.frombuffer(b"".join(parts.column("sum").to_pylist()), np.float64).reshape(-1, width).sum(0)
        norm = np.linalg.norm(total)
        mean = (total / norm if norm > 0 else total).astype(np.float32)
        return pa.table({"collection": [key[0].as_py()], "root": [key[1].as_py()], "mean": packed(mean[None]), "size": [pc.sum(parts.column("n")).as_py()]})

    return run


def cluster_means(members: DataFrame, width: int) -> DataFrame:
    """collection, root, mean (unit, float32), size of the clusters of ``members`` (collection, root, unit).

    The rows are summed where they lie; a cluster shuffles one row per task, whatever its size."""
    parts = members.mapInArrow(_partial_sums(width), "collection string, root bigint, sum binary, n bigint")
    return parts.groupBy("collection", "root").applyInArrow(_add_partials(width), "collection string, root bigint, mean binary, size bigint")


def clusters(
    vectors: DataFrame, threshold: float = 0.6, member_cosine: float = 0.72, least: int = 8, k: int = 10, width: int = 64, local_nodes: int = LOCAL_NODES
) -> DataFrame:
    """The clusters of ``vectors`` (collection, id string, unit): one row (collection, id, first_id, size, cosine) per member.

    ``first_id`` is the smallest id of the cluster in byte order, ``size`` its number of members, ``cosine`` the member's to the mean.
    A cluster has at least ``least`` members, each with a cosine of at least ``member_cosine`` to the mean of the members' unit
    vectors, and holds every vector of its collection near enough among the candidates described above. ``threshold`` is
    where linkage stops; the average cosine of a cluster's vector to its members is about ``member_cosine`` times the mean's
    length, so it lies below that. Membership is refitted until it stays, or repeats an earlier one. Vectors in no cluster and
    empty tables give no rows. Rows with a null collection or id are left out."""
    vectors = vectors.where(F.col("collection").isNotNull() & F.col("id").isNotNull())
    numbered = cut(vectors.select("collection", "unit", F.col("id").alias("name"), F.monotonically_increasing_id().alias("id")))
    found = neighbours.similar_vectors(numbered.select("collection", "id", "unit"), k=k, at_least=threshold, width=width, distinct=True)
    links = cut(_undirected(found))
    large = cut(numbered.groupBy("collection").count().where(F.col("count") > local_nodes).select("collection"))
    any_large = large.limit(1).count() > 0
    nodes = numbered.select("collection", "id", "unit")
    usual = (nodes, links)
    if any_large:
        usual = tuple(x.join(small(large), "collection", "left_anti") for x in usual)
    inside = (
        usual[0].groupBy("collection")
        .cogroup(usual[1].groupBy("collection"))
        .applyInArrow(_local(threshold, k, width, member_cosine, least), "collection string, id bigint, root bigint, cosine double")
    )
    if any_large:
        big = [x.join(small(large), "collection", "left_semi") for x in (nodes, links)]
        inside = inside.unionByName(_large_members(*big, threshold, member_cosine, least, k, width, local_nodes))
    named = cut(inside).join(numbered.select("collection", "id", "name"), ["collection", "id"])
    sizes = named.groupBy("collection", "root").agg(F.count("*").alias("size"), F.min("name").alias("first_id")).where(F.col("size") >= least)
    return named.join(small(cut(sizes)), ["collection", "root"]).select("collection", F.col("name").alias("id"), "first_id", "size", "cosine")


def _large_members(nodes: DataFrame, links: DataFrame, threshold: float, member_cosine: float, least: int, k: int, width: int, local_nodes: int) -> DataFrame:
    """What :func:`_local` does, for collections too large for one task: collection, id, root, cosine of the members."""
    keyed = nodes.withColumn("key", F.md5("unit"))
    groups = keyed.groupBy("collection", "key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("unit").alias("unit"))
    groups = cut(groups)
    copy = cut(keyed.select("collection", "key", "id").join(groups.select("collection", "key", "rep"), ["collection", "key"]).drop("key"))
    on = lambda c: copy.select("collection", F.col("id").alias(c), F.col("rep").alias(f"r{c}"))
    between = links.join(on("a"), ["collection", "a"]).join(on("b"), ["collection", "b"]).where("ra <> rb")
    between = cut(between.select("collection", F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    ends = between.select("collection", F.col("a").alias("id")).union(between.select("collection", "b")).distinct()
    tree = groups.select("collection", F.col("rep").alias("id"), _scaled(width)("unit", "n").alias("sum"), "n")
    rest, left, moves, ended = link_large(cut(tree.join(ends, ["collection", "id"], "left_semi")), between, threshold, k, width, local_nodes)
    root = rest.groupBy("collection").cogroup(left.groupBy("collection")).applyInArrow(_roots(threshold, k, width), "collection string, id bigint, root bigint")
    root = cut(root if ended is None else root.unionByName(ended))
    if moves is not None:
        last = root.select("collection", F.col("id").alias("root"), F.col("root").alias("last"))
        root = root.unionByName(moves.join(last, ["collection", "root"], "left").select("collection", "id", F.coalesce("last", "root").alias("root")))
    of_rep = root.select("collection", F.col("id").alias("rep"), "root")
    member = cut(copy.join(of_rep, ["collection", "rep"], "left").select("collection", "id", F.coalesce("root", "rep").alias("root")))
    near = links.unionByName(links.select("collection", F.col("b").alias("a"), F.col("a").alias("b")))
    seen: set = set()
    while True:
        means = cut(cluster_means(nodes.join(member, ["collection", "id"]), width).where(F.col("size") >= (least + 1) // 2))
        of = member.select("collection", F.col("id").alias("b"), "root")
        options = near.join(of, ["collection", "b"]).select("collection", F.col("a").alias("id"), "root")
        options = options.union(of.select("collection", F.col("b").alias("id"), "root")).distinct()
        fits = (
            options.join(nodes, ["collection", "id"])
            .join(small(means), ["collection", "root"])
            .select("collection", "id", "root", _dot(width)("unit", "mean").alias("cosine"))
            .where(F.col("cosine") >= member_cosine)
        )
        best = W.partitionBy("collection", "id").orderBy(F.desc("cosine"), "root")
        now = cut(fits.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place"))
        was = member.select("collection", "id", F.col("root").alias("was"))
        steady = not now.join(was, ["collection", "id"], "full").where("not (was <=> root)").limit(1).count()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("collection", "id", "root").cast("decimal(38,0)"))).first()
        member = now.select("collection", "id", "root")
        if steady or tuple(state) in seen:
            break
        seen.add(tuple(state))
    return now


def _scaled(width: int):
    @F.pandas_udf("binary")
    def scaled(x, n):
        import pandas as pd

        rows = np.frombuffer(b"".join(x), np.float32).reshape(-1, width) * n.to_numpy(np.float32)[:, None]
        return pd.Series([row.tobytes() for row in rows])

    return scaled


def described(members: DataFrame, typical: int = 3) -> DataFrame:
    """One row per cluster of the result of :func:`clusters`: collection, first_id, size, and the ids of its ``typical``
    members nearest to the mean, nearest first, ties by the smaller id."""
    order = W.partitionBy("collection", "first_id").orderBy(F.desc("cosine"), "id")
    top = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= typical)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])
    return top.groupBy("collection", "first_id").agg(F.max("size").alias("size"), listed.alias("typical"))
