"""Graphs as tables: edges (src, dst, weight). Loops run as joins, and each round is cut to a table in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.runtime import cut


def similarity_edges(neighbours: DataFrame, least: float, query: str = "query_id", id: str = "vec_id") -> DataFrame:
    """Undirected edges (src < dst, weight) of the neighbour lists (query, id, distance) with a cosine of at least ``least``."""
    w = 1 - F.col("distance")
    pairs = neighbours.where((w >= least) & (F.col(query) != F.col(id)))
    return pairs.groupBy(F.least(query, id).alias("src"), F.greatest(query, id).alias("dst")).agg(F.max(w).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def neighbourhood(edges: DataFrame, seeds: Sequence, hops: int, directed: bool = False) -> DataFrame:
    """node, hop: every node within ``hops`` steps of a seed, with the fewest steps."""
    links = (edges if directed else both_ways(edges)).select("src", "dst")
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    seen = spark.createDataFrame([(s, 0) for s in dict.fromkeys(seeds)], f"node {kind}, hop int")
    frontier = seen
    for hop in range(1, hops + 1):
        step = links.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hop")))
        if not frontier.limit(1).count():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def shortest_path(edges: DataFrame, start, end, most: int | None = None) -> list:
    """Nodes of a path with the fewest edges (ties by the smaller node), or an empty list; with ``most``, of a path of at most so many edges."""
    links = both_ways(edges).select("src", "dst")
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    seen = spark.createDataFrame([(start, None, 0)], f"node {kind}, parent {kind}, hop int")
    frontier = seen
    for hop in count(1) if most is None else range(1, most + 1):
        if start == end or frontier.where(F.col("node") == end).limit(1).count():
            break
        step = links.join(frontier.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = cut(step.join(seen, "node", "left_anti").select("node", "parent", F.lit(hop).alias("hop")))
        if not frontier.limit(1).count():
            return []
        seen = cut(seen.unionByName(frontier))
    path = [end]
    while path[-1] != start:
        row = seen.where(F.col("node") == path[-1]).first()
        if row is None:
            return []
        path.append(row.parent)
    return path[::-1]


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def page_rank(edges: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """node, rank after a fixed number of rounds over the undirected, unweighted graph; ranks sum to 1 (every node has an edge)."""
    links = both_ways(edges).select("src", "dst")
    out = links.groupBy("src").agg(F.count("*").alias("out"))
    n = out.count()
    links = cut(links.join(out, "src"))
    ranks = out.select(F.col("src").alias("node"), F.lit(1.0 / n if n else 0.0).alias("rank"))
    for _ in range(rounds):
        given = links.join(ranks, links.src == ranks.node).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        ranks = cut(given.select(F.col("dst").alias("node"), (F.lit((1 - damping) / n) + damping * F.col("got")).alias("rank")))
    return ranks


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, label by synchronous label propagation: the label with the greatest weight among the neighbours and, once, the node itself;
    ties go to the smaller label. It ends when no label changes, or after ``rounds``."""
    links = cut(both_ways(edges))
    labels = links.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    own = 1e-9
    for _ in range(rounds):
        votes = links.join(labels.select(F.col("node").alias("dst"), "label"), "dst").select(F.col("src").alias("node"), "label", "weight")
        votes = votes.unionByName(labels.withColumn("weight", F.lit(own)))
        total = votes.groupBy("node", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        new = cut(total.groupBy("node").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            break
    return labels


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), by hooking to the smallest neighbour and pointer jumping, in logarithmically many rounds."""
    links = cut(both_ways(edges).select("src", "dst"))
    labels = links.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("component"))
    while True:
        near = links.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("low"))
        hooked = labels.join(near, "node").select("node", F.least("component", "low").alias("component"))
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = cut(hooked.join(up, "component").select("node", F.least("component", "top").alias("component")))
        moved = new.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        labels = new
        if not moved:
            return labels


def fused_search(hits: DataFrame, edges: DataFrame, hops: int, k: int, vector_weight: float = 0.7, graph_weight: float = 0.3, fade: float = 0.5) -> DataFrame:
    """Search hits (node, distance) spread along the edges: the score of a node is the least of vector_weight times the seed's distance plus
    graph_weight / (edge weight times fade^hop): node, score, hop, best first."""
    links = both_ways(edges)
    level = hits.select("node", (vector_weight * F.col("distance")).alias("base"), (vector_weight * F.col("distance")).alias("score"), F.lit(0).alias("hop"))
    found = level
    for hop in range(1, hops + 1):
        step = links.join(level.select(F.col("node").alias("src"), "base"), "src")
        level = step.groupBy(F.col("dst").alias("node")).agg(F.min("base").alias("base"), F.min(F.col("base") + graph_weight / (F.col("weight") * fade**hop)).alias("score")).withColumn("hop", F.lit(hop))
        found = found.unionByName(level.select("node", "base", "score", "hop"))
    best = found.groupBy("node").agg(F.min(F.struct("score", "hop")).alias("b"))
    return best.select("node", F.col("b.score").alias("score"), F.col("b.hop").alias("hop")).orderBy("score", "node").limit(k)
