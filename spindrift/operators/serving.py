"""Searches over collections in parts, rerankers, greedy duplicates, access rules, routing and alerts."""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.distance import distance
from spindrift.operators import search
from spindrift.runtime import cut, small

# ---- collections in parts ---------------------------------------------------------------------------------------------


def with_delta(main: DataFrame, delta: DataFrame, id: str = "vec_id", deleted: Column | None = None) -> DataFrame:
    """``main`` with the rows of ``delta`` in place of those with equal ids, and without those that ``deleted`` marks in the delta."""
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    return main.join(delta.select(id), id, "left_anti").unionByName(delta.where(~gone).select(*main.columns))


def tiered(hot: DataFrame, cold: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """id, distance, tier of the ``k`` nearest of two stores; an id that both have counts once, from the hot one."""
    parts = [search.top_k(rows, query, k, metric, vector, id).withColumn("tier", F.lit(name)) for name, rows in (("hot", hot), ("cold", cold))]
    best = parts[0].unionByName(parts[1]).groupBy(id).agg(F.max_by(F.struct("distance", "tier"), "tier").alias("b"))
    return best.select(id, F.col("b.distance").alias("distance"), F.col("b.tier").alias("tier")).orderBy("distance", id).limit(k)


def ring_position(text: Column) -> Column:
    """A place on the ring: the first 60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def routed(rows: DataFrame, id: str, shards: Sequence[str], nodes: int = 64) -> DataFrame:
    """``rows`` with ``shard``: the owner of the next of its ``nodes`` places per shard on a ring of hashes, so that a new shard takes over
    only its share. The places are an array in the plan."""
    spark = rows.sparkSession
    places = spark.createDataFrame([(s, i) for s in shards for i in range(nodes)], "shard string, i int")
    places = places.select(ring_position(F.concat_ws("#", "shard", "i")).alias("at"), "shard")
    ring = F.broadcast(places.agg(F.array_sort(F.collect_list(F.struct("at", "shard"))).alias("_ring")))  # shards times nodes
    own = ring_position(F.col(id).cast("string"))
    after = F.filter("_ring", lambda p: p["at"] >= own)
    return rows.join(ring, F.lit(True)).withColumn("shard", F.coalesce(F.get(after, F.lit(0)), F.get("_ring", F.lit(0)))["shard"]).drop("_ring")


def hybrid_search(rows: DataFrame, lists: DataFrame, centres, query: Sequence[float], k: int, strategy: str = "adaptive", least: int = 10_000, n_probe: int = 8, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """id, distance, strategy, recall of an approximate (``lists`` and ``centres`` of an inverted file), exact or mixed search.

    ``ann`` and ``exact`` are what they say; ``adaptive`` is exact up to ``least`` rows; ``verified`` gives the approximate result with its recall
    against the exact one; ``cascade`` probes twice the lists and reranks."""
    from spindrift.operators.quantize import ivf_search

    asked = rows.sparkSession.createDataFrame([(0, [float(x) for x in query])], f"query_id bigint, `{vector}` array<float>")
    ann = lambda probes: ivf_search(lists, centres, asked, k, probes, vector=vector, id=id).select(id, "distance")
    exact = lambda: search.top_k(rows, query, k, "l2", vector, id)
    used = ("exact" if rows.limit(least + 1).count() <= least else "ann") if strategy == "adaptive" else strategy
    if used == "exact":
        return exact().withColumn("strategy", F.lit("exact")).withColumn("recall", F.lit(1.0))
    found = cut(ann(2 * n_probe if used == "cascade" else n_probe))
    if used != "verified":
        return found.withColumn("strategy", F.lit(used)).withColumn("recall", F.lit(None).cast("double"))
    truth = exact()
    hits = truth.join(found.select(id), id, "left_semi").count()
    return found.withColumn("strategy", F.lit(used)).withColumn("recall", F.lit(hits / max(truth.count(), 1)))


def traced(rows: DataFrame, query: Sequence[float], k: int, where: Column | None = None, metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    """One row: how many rows a search scans, how many pass its filter, how many have a distance, and how many it returns."""
    passed = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    measured = passed & distance(metric, F.col(vector), query).isNotNull()
    counts = rows.agg(F.count("*").alias("scanned"), F.count_if(passed).alias("passed"), F.count_if(measured).alias("measured"))
    return counts.withColumn("returned", F.least("measured", F.lit(max(k, 0)).cast("bigint")))


# ---- duplicates ------------------------------------------------------------------------------------------------------------


def greedy_groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, canonical of the ends of undirected links, as a scan in the order of the ids would group them: an id that no earlier canonical one has
    taken is canonical, and takes those linked to it that are free.

    In rounds: an id is decided once all smaller ids linked to it are; a chain of n ids needs up to n rounds, groups of duplicates a few."""
    both = links.select(F.col(a).alias("id"), F.col(b).alias("other")).union(links.select(b, a)).where("id <> other").distinct()
    both = cut(both)
    smaller = cut(both.where("other < id"))
    decided = cut(both.select("id").distinct().join(smaller.select("id"), "id", "left_anti").select("id", F.col("id").alias("canonical")))
    total = both.select("id").distinct().count()
    while decided.count() < total:
        state = decided.select(F.col("id").alias("other"), "canonical")
        open_ones = smaller.join(decided.select("id"), "id", "left_anti")
        seen = open_ones.join(state, "other", "left")
        # taken by the smallest canonical neighbour; canonical once all smaller ones are decided and none of them is canonical
        per = seen.groupBy("id").agg(F.min(F.when(F.col("canonical") == F.col("other"), F.col("other"))).alias("taker"), F.count_if(F.col("canonical").isNull()).alias("open"), F.min(F.when(F.col("canonical").isNull(), F.col("other"))).alias("first_open"))
        ready = per.where("open = 0 or taker < first_open").select("id", F.coalesce("taker", "id").alias("canonical"))
        decided = cut(decided.unionByName(ready))
    return decided


def dedup_scan(rows: DataFrame, most: float = 0.02, metric: str = "cosine", vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """id, canonical, distance of the rows that :func:`greedy_groups` puts into the group of another row nearer than ``most``.

    Exact copies are one node; the distinct vectors are the query set, in blocks."""
    copies = rows.where(F.col(vector).isNotNull()).groupBy(F.col(vector).alias("_v")).agg(F.min(id).alias("_first"))
    nodes = cut(copies.select(F.col("_first").alias("_id"), F.col("_v").alias(vector)))
    near = search.batch_top_k(nodes, nodes.select(F.col("_id").alias("query_id"), vector), None, metric, vector, "_id", most=most, exclude_self=True)
    links = cut(near.where(F.col("distance") < most).select(F.col("query_id").alias("a"), F.col("_id").alias("b"), "distance"))
    groups = greedy_groups(links)
    far = links.select(F.col("a").alias("_id"), F.col("b").alias("canonical"), F.col("distance").alias("_far")).distinct()
    named = nodes.join(groups.withColumnRenamed("id", "_id"), "_id", "left").join(far, ["_id", "canonical"], "left")
    named = named.select(F.col(vector).alias("_v"), F.coalesce("canonical", "_id").alias("canonical"), F.coalesce("_far", F.lit(0.0)).alias("distance"))
    return rows.select(id, F.col(vector).alias("_v")).join(named, "_v").where(F.col(id) != F.col("canonical")).select(id, "canonical", "distance")


# ---- rerankers ---------------------------------------------------------------------------------------------------------------


def thompson(hits: DataFrame, alpha: str = "alpha", beta: str = "beta", seed: int = 7, id: str = "id") -> DataFrame:
    """``hits`` with ``score``: one draw per row from its Beta(alpha, beta), from a seed and the row's id, so that a repeated run gives the same order."""
    @F.pandas_udf("double")
    def draw(name, a, b):
        import pandas as pd

        return pd.Series([np.random.default_rng(xxhash.xxh64_intdigest(str(n), seed=seed)).beta(max(x, 1e-6), max(y, 1e-6)) for n, x, y in zip(name, a, b)], dtype="float64")

    return hits.withColumn("score", draw(F.col(id).cast("string"), F.col(alpha).cast("double"), F.col(beta).cast("double")))


#: What a signal says about a result, from -1 to 1; ratings from 1 to 5 and dwell times in milliseconds have a scale.
SIGNALS = {"thumbs_up": 1.0, "thumbs_down": -1.0, "click": 0.5, "skip": -0.3}


def relevance(signal: Column, value: Column) -> Column:
    """The score of a feedback signal: :data:`SIGNALS`, (rating - 3) / 2, or (seconds - 3) / 5 between -1 and 1; null for others."""
    out = F.lit(None).cast("double")
    for name, score in SIGNALS.items():
        out = F.when(signal == name, F.lit(score)).otherwise(out)
    seconds = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (value.cast("double") / 1000 - 3) / 5))
    return F.when(signal == "rating", (value.cast("double") - 3) / 2).when(signal == "dwell", seconds).otherwise(out)


# ---- access, routing, alerts ---------------------------------------------------------------------------------------------------


def permitted(policies: Sequence[Mapping], user: str, roles: Sequence[str], field=F.col) -> Column:
    """The condition that a user's rows meet: the rows of an ``allow`` policy for them, without those of a ``deny`` policy of the same or a higher
    priority. A policy: {effect, principal ("*", user or "role:..."), field, value, priority}; without field it is of all rows. Nobody who isn't
    allowed sees a row."""
    own = [p for p in policies if p["principal"] in ("*", user, *(f"role:{r}" for r in roles))]
    test = lambda p: F.coalesce(field(p["field"]) == p["value"], F.lit(False)) if p.get("field") else F.lit(True)
    allowed = F.lit(False)
    for p in sorted(own, key=lambda p: (p.get("priority", 0), p["effect"] == "deny")):
        allowed = F.when(test(p), F.lit(p["effect"] == "allow")).otherwise(allowed)
    return allowed


def routes(rules: Sequence[Mapping], dimensions: int) -> list[tuple[str, float]]:
    """(collection, weight) of the rules {collection, when: "always" or a number of dimensions, weight} that a query of ``dimensions`` meets."""
    return [(r["collection"], float(r.get("weight", 1.0))) for r in rules if r.get("when", "always") in ("always", dimensions)]


def alerts(metrics: DataFrame, rules: Sequence[Mapping], metric: str = "metric", value: str = "value") -> DataFrame:
    """``metrics`` with ``rule`` for each rule {name, metric, op, threshold} that a row breaks."""
    tests = {">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, "==": lambda x, y: x == y}
    broken = [F.when((F.col(metric) == r["metric"]) & tests[r["op"]](F.col(value), F.lit(float(r["threshold"]))), F.lit(r["name"])) for r in rules]
    return metrics.withColumn("rule", F.explode(F.array_compact(F.array(*broken)))) if rules else metrics.withColumn("rule", F.lit(None).cast("string")).limit(0)


def near_watched(rows: DataFrame, watched: DataFrame, most: float, metric: str = "cosine", vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """Proximity triggers: watch_id, id, distance of the new rows nearer than ``most`` to a watched vector (watch_id, and a vector)."""
    near = search.batch_top_k(rows, watched, None, metric, vector, id, "watch_id", most=most)
    return near.where(F.col("distance") < most).select("watch_id", id, "distance")


def last_points(rows: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """The last ``n`` points per series; the window keeps ``n`` rows per task and key before its shuffle."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))).where(F.col("_place") <= n).drop("_place")


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, columns: Sequence[str], prefix: str = "last_") -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` with an equal key and a time not after its own, by one shuffle and no pair of rows.

    Of rows of the right side with equal times the one with the greatest ``columns`` counts."""
    whole = right.select(key, at, F.struct(*columns).alias("_r"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"))
    asked = left.select(key, at, F.lit(None).cast(whole.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    order = W.partitionBy(key).orderBy(F.col(at), F.col("_l").isNotNull(), F.col("_r")).rowsBetween(W.unboundedPreceding, 0)
    rows = whole.unionByName(asked).withColumn("_m", F.last("_r", ignorenulls=True).over(order)).where("_l is not null")
    return rows.select("_l.*", *[F.col("_m")[c].alias(prefix + c) for c in columns])


def silhouette(rows: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """One row: silhouette, the mean over all rows of (b - a) / max(a, b) by mean squared distances to the own and the nearest other cluster.

    From the sums and squares of each cluster instead of pairs: the mean squared distance of x to a cluster is |x|^2 - 2 x.mean + mean |y|^2. A
    row alone in its cluster counts 0. Clusters are few (their means are joined to every row, broadcast only if counted small)."""
    from spindrift.operators.aggregates import centroids

    square = F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    held = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("_own"), F.col(vector).cast("array<double>").alias("_v"), square.alias("_s"))
    stats = cut(centroids(held, ["_own"], "_v").join(held.groupBy("_own").agg(F.count("*").alias("_n"), F.avg("_s").alias("_q")), "_own").withColumnRenamed("_own", "_other"))
    listed = stats.agg(F.collect_list(F.struct("_other", "centroid", "_n", "_q")).alias("_c"))  # a row per cluster
    far = lambda c: F.col("_s") - 2 * F.aggregate(F.zip_with("_v", c["centroid"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) + c["_q"]
    both = held.join(F.broadcast(listed), F.lit(True))
    own = F.get(F.filter("_c", lambda c: c["_other"] == F.col("_own")), F.lit(0))
    a = far(own) * own["_n"] / F.nullif(own["_n"] - 1, F.lit(0))
    b = F.array_min(F.transform(F.filter("_c", lambda c: c["_other"] != F.col("_own")), far))
    per = both.select(a.alias("a"), b.alias("b"))
    return per.agg(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))).alias("silhouette"))


def evolved(rows: DataFrame, changes: Sequence[Mapping]) -> DataFrame:
    """Schema changes in order: {"add": name, "type", "default"}, {"remove": name}, {"rename": name, "to"}. Unknown fields raise."""
    for c in changes:
        name = c.get("add") or c.get("remove") or c.get("rename")
        if ("add" in c) == (name in rows.columns):
            raise ValueError(f"field {name!r} {'exists' if 'add' in c else 'is unknown'}")
        if "add" in c:
            rows = rows.withColumn(name, F.lit(c.get("default")).cast(c["type"]))
        elif "remove" in c:
            rows = rows.drop(name)
        else:
            rows = rows.withColumnRenamed(name, c["to"])
    return rows


def storage_tier(uses: Column, idle_days: Column, hot: int = 10, warm_days: int = 30) -> Column:
    """``hot`` from ``hot`` uses on, ``warm`` if used within ``warm_days``, else ``cold``; unknown uses count as none."""
    return F.when(F.coalesce(uses, F.lit(0)) >= hot, "hot").when(F.coalesce(idle_days <= warm_days, F.lit(False)), "warm").otherwise("cold")


def evicted(cache: DataFrame, now: Column, capacity: int, expires: str = "expires_at", by: Sequence[Column] = ()) -> DataFrame:
    """What a bounded cache keeps: rows that have not expired, of these ``capacity`` in the order ``by`` (least frequently or recently used last)."""
    live = cache.where(F.col(expires).isNull() | (F.col(expires) > now))
    return live.orderBy(*by).limit(capacity)


def best_path(edges: DataFrame, start, end) -> tuple[list, float]:
    """(nodes, product) of the path whose product of edge weights (0 to 1) is greatest; ([], 0.0) if there is none. Rounds of joins relax the
    products until none grows; ties go to fewer edges, then the smaller node before."""
    from spindrift.operators.graph import both_ways

    links = cut(both_ways(edges).select("src", "dst", "weight"))
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    state = spark.createDataFrame([(start, 1.0, 0, None)], f"node {kind}, product double, hops int, parent {kind}")
    while True:
        step = links.join(state.select(F.col("node").alias("src"), "product", "hops"), "src").select(F.col("dst").alias("node"), (F.col("product") * F.col("weight")).alias("product"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("parent"))
        both = state.unionByName(step)
        new = cut(both.groupBy("node").agg(F.max_by(F.struct("product", "hops", "parent"), F.struct(F.round("product", 12), -F.col("hops"), -F.col("parent"))).alias("b")).select("node", "b.*"))
        grown = new.join(state.select("node", F.col("product").alias("was")), "node", "left").where("was is null or product > was + 1e-12").limit(1).count()
        state = new
        if not grown:
            break
    path, total = [end], state.where(F.col("node") == end).select("product").first()
    if total is None:
        return [], 0.0
    while path[-1] != start:
        path.append(state.where(F.col("node") == path[-1]).first().parent)
    return path[::-1], total[0]


def descendants(edges: DataFrame, seeds: Sequence, depth: int, backwards: bool = False, kind: str | None = None) -> DataFrame:
    """node, depth: what directed edges (src, dst, optional type) lead to from the seeds within ``depth`` steps, or what leads to them."""
    from spindrift.operators.graph import neighbourhood

    rows = edges if kind is None else edges.where(F.col("type") == kind)
    if backwards:
        rows = rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = neighbourhood(rows, seeds, depth, directed=True)
    return found.where("hop > 0").select("node", F.col("hop").alias("depth"))


def replayed(events: DataFrame, position: str, after=None, until=None, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Events after one position up to another, in order: what a reader that stopped at ``after`` has not seen."""
    rows = events if after is None else events.where(F.col(position) > after)
    rows = rows if until is None else rows.where(F.col(position) <= until)
    rows = rows if where is None else rows.where(F.coalesce(where, F.lit(False)))
    return rows.orderBy(position) if limit is None else rows.orderBy(position).limit(limit)


def resume_token(position, stream: str) -> str:
    """An opaque text that holds the position in a stream."""
    return base64.urlsafe_b64encode(json.dumps({"stream": stream, "position": position}).encode()).decode()


def position_of(token: str, stream: str):
    """The position of a token; one of another stream, or no token, raises ValueError."""
    try:
        held = json.loads(base64.urlsafe_b64decode(token.encode()))
    except Exception:
        raise ValueError("no resume token") from None
    if held.get("stream") != stream:
        raise ValueError(f"the token is of {held.get('stream')!r}, not {stream!r}")
    return held["position"]


def two_stage_max_sim(rows: DataFrame, query: Sequence[Sequence[float]], k: int, multiplier: int = 4, tokens: str = "tokens", id: str = "id") -> DataFrame:
    """The ``k * multiplier`` rows whose mean token has the greatest inner product with the query's mean token, reranked by their MaxSim."""
    from spindrift.operators.sparse import max_sim

    width = len(query[0])
    mean = [sum(q[i] for q in query) / len(query) for i in range(width)]
    total = lambda i: F.aggregate(tokens, F.lit(0.0), lambda a, t: a + F.get(t, F.lit(i)).cast("double"))
    score = F.lit(0.0)
    for i, x in enumerate(mean):
        score = score + total(i) * float(x)
    first = rows.where(F.size(tokens) > 0).withColumn("_c", score / F.size(tokens)).orderBy(F.desc("_c"), id).limit(k * multiplier)
    return max_sim(first.drop("_c"), query, k, tokens, id)


def matched_tokens(rows: DataFrame, query: Sequence[Sequence[float]], tokens: str = "tokens", id: str = "id") -> DataFrame:
    """id, query_token, token, similarity: for each query token the row's token with the greatest inner product (the first of equal ones)."""
    parts = []
    for n, q in enumerate(query):
        literal = F.array(*[F.lit(float(x)) for x in q])
        each = F.transform(tokens, lambda t, i: F.struct(F.aggregate(F.zip_with(t, literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x).alias("similarity"), (-i).alias("_at")))
        best = F.array_max(each)
        parts.append(F.struct(F.lit(n).alias("query_token"), (-best["_at"]).alias("token"), best["similarity"].alias("similarity")))
    return rows.where(F.size(tokens) > 0).select(id, F.inline(F.array(*parts)))


def multimodal(rows: DataFrame, queries: Mapping[str, Sequence[float]], k: int, weights: Mapping[str, float] | None = None, id: str = "id") -> DataFrame:
    """id, score of the ``k`` rows with the greatest weighted mean of 1 - cosine distance over the modalities asked for (a vector column each); a row
    counts by the modalities that it has, one without any isn't found."""
    weights = weights or {m: 1.0 for m in queries}
    total, size = F.lit(0.0), F.lit(0.0)
    for m, q in queries.items():
        s = 1 - distance("cosine", F.col(m), q)
        total, size = total + F.coalesce(s * weights[m], F.lit(0.0)), size + F.when(s.isNotNull(), F.lit(float(weights[m]))).otherwise(0.0)
    return rows.select(id, (total / F.nullif(size, F.lit(0.0))).alias("score")).where("score is not null").orderBy(F.desc("score"), id).limit(k)


def projected(v: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """A vector times a matrix (one row per dimension of the result): a linear map between spaces."""
    row = lambda weights: F.aggregate(F.zip_with(v.cast("array<double>"), F.array(*[F.lit(float(x)) for x in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.array(*[row(weights) for weights in matrix])


def half(v: Column, kind: str = "f16") -> Column:
    """A vector rounded to 16-bit floats (``f16``, or ``bf16`` by rounding to the nearest even) and read as float again."""
    @F.arrow_udf("array<float>")
    def run(x: pa.Array) -> pa.Array:
        flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        if kind == "f16":
            with np.errstate(over="ignore"):
                flat = flat.astype(np.float16).astype(np.float32)
        else:
            bits = flat.view(np.uint32)
            bits = (bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))) & np.uint32(0xFFFF0000)
            flat = np.where(np.isnan(flat), flat, bits.view(np.float32))
        lengths = x.value_lengths().fill_null(0).to_numpy()
        offsets = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float32()), mask=x.is_null())

    return run(v)


# ---- pipelines that are declared ------------------------------------------------------------------------------------------------


def optimised(stages: Sequence[Mapping]) -> list[Mapping]:
    """Filters before the search that they follow, when only filters and reranks lie between, so that the search counts rows that pass."""
    out: list[Mapping] = []
    for s in stages:
        at = len(out)
        if s["stage"] == "filter":
            while at and out[at - 1]["stage"] in ("filter", "rerank"):
                at -= 1
            at = at - 1 if at and out[at - 1]["stage"] == "search" else len(out)
        out.insert(at, s)
    return out


def declared(rows: DataFrame, stages: Sequence[Mapping], id: str = "id") -> DataFrame:
    """A pipeline of declared stages as one plan: search {query, k, metric, vector}, filter {where}, threshold {most}, rerank {score}, limit {k, by},
    select {columns}, rename {columns}, compute {column, value}. Conditions and values are SQL expressions."""
    from spindrift.operators import extras

    steps = {
        "search": lambda s: extras.search_stage(s["query"], s["k"], s.get("metric", "cosine"), s.get("vector", "embedding"), id),
        "filter": lambda s: extras.filter_stage(F.expr(s["where"])),
        "threshold": lambda s: extras.threshold_stage(float(s["most"])),
        "rerank": lambda s: extras.rerank_stage(F.expr(s["score"])),
        "limit": lambda s: extras.limit_stage(s["k"], *[F.expr(x) if not x.endswith(" desc") else F.expr(x[:-5]).desc() for x in s.get("by", [id])]),
        "select": lambda s: lambda d: d.select(*s["columns"]),
        "rename": lambda s: lambda d: d.withColumnsRenamed(dict(s["columns"])),
        "compute": lambda s: lambda d: d.withColumn(s["column"], F.expr(s["value"])),
    }
    unknown = [s["stage"] for s in stages if s.get("stage") not in steps]
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(map(str, unknown))}")
    return extras.pipeline(*[steps[s["stage"]](s) for s in stages])(rows)


def template(name: str, query: Sequence[float], k: int, where: str = "true", most: float = 2.0) -> list[Mapping]:
    """The stages of a common pipeline: simple, filtered, thresholded, wide (searches four times as many and cuts)."""
    find = {"stage": "search", "query": list(query), "k": k}
    return {
        "simple": [find],
        "filtered": [find, {"stage": "filter", "where": where}],
        "thresholded": [find, {"stage": "threshold", "most": most}],
        "wide": [{**find, "k": 4 * k}, {"stage": "filter", "where": where}, {"stage": "limit", "k": k, "by": ["distance", "id"]}],
    }[name]


def tier_counts(rows: DataFrame, tier: Column) -> DataFrame:
    return rows.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``points`` with the rows of ``ranges`` whose interval [low, high) holds their value: an equi-join on buckets of ``width``.

    A range is put into every bucket that it touches, so ``width`` should be about that of a range."""
    bucket = F.floor(F.col(value) / width)
    spread = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    both = points.withColumn("_b", bucket).join(small(spread), "_b")
    return both.where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_b")
