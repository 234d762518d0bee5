"""Mixing the documents of several sources to target weights, by systematic sampling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.llm.tokens import encoder
from spindrift.runtime import cut, small


def token_counts(documents: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, source, n_tokens of every document; a null text has none. ``vocabulary``: path of a tiktoken rank file."""
    rows = documents.select(F.col(id).alias("id"), "source", F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(counts, pa.int64())], ["id", "source", "n_tokens"])

    return rows.mapInArrow(run, f"id {kind}, source string, n_tokens bigint")


def plan(counts: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """What each listed source is to give: source, target_weight, max_repeats, n_docs, held (tokens), share, budget, copies.

    ``counts``: id, source, n_tokens; ``targets``: source, target_weight, max_repeats. ``share`` is the weight among the sources that hold
    any token; a listed source without tokens gets share 0. The mixture has ``total`` tokens; unset, as many as the most at which
    every such source still reaches its share without using a document more often than its ``max_repeats``. ``copies`` is how
    often each document of the source is used on average, at most ``max_repeats``. Targets with a null source, a weight that is
    null or not above 0, or no repeats count as weight 0; of a source listed twice the weights add up and the smaller cap holds."""
    listed = (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.sum(F.when(F.col("max_repeats") > 0, F.greatest("target_weight", F.lit(0.0))).otherwise(0.0)).alias("target_weight"), F.min("max_repeats").alias("max_repeats"))
        .withColumn("target_weight", F.coalesce("target_weight", F.lit(0.0)))
    )
    held = counts.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("held"))
    rows = listed.join(held, "source", "left").fillna(0, ["n_docs", "held"])
    able = (F.col("held") > 0) & (F.col("target_weight") > 0)
    everything = W.partitionBy()  # one row per listed source
    rows = rows.withColumn("share", F.when(able, F.col("target_weight")).otherwise(0.0))
    rows = rows.withColumn("share", F.coalesce(F.col("share") / F.nullif(F.sum("share").over(everything), F.lit(0.0)), F.lit(0.0)))
    most = F.min(F.when(able, F.col("max_repeats") * F.col("held") / F.col("share"))).over(everything)
    rows = rows.withColumn("budget", F.col("share") * (F.lit(float(total)) if total is not None else F.coalesce(most, F.lit(0.0))))
    copies = F.when(able, F.least(F.col("budget") / F.col("held"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return rows.withColumn("copies", copies)


def mixed(counts: DataFrame, plan: DataFrame, seed: int = 20) -> DataFrame:
    """How often each document is used: id, source, n_tokens, copies (at least 1; documents that are not used give no row).

    Systematic sampling: the expected copies of the documents are summed up along each source, in the order of their
    sizes and ids; one random offset per source is added, and a document is used once for each whole number that the sum crosses at it. So
    each source gives its budget within about the size of one document, and no document is used more than ``ceil(copies)`` times.

    The running sums don't gather a source in one task: the rows are range-partitioned by source, size and id, ranked
    within (source, partition), and the rows of the earlier partitions of the source are added from a table of counts."""
    rows = counts.join(small(plan.select("source", F.col("copies").alias("rate")).where("rate > 0")), "source")
    spread = rows.repartitionByRange(_partitions(rows), "source", "n_tokens", "id")
    spread = cut(spread.withColumn("part", F.spark_partition_id()))
    held = spread.groupBy("source", "part").agg(F.count("*").alias("here"))
    earlier = held.withColumn("before", F.coalesce(F.sum("here").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("source", "part").orderBy("n_tokens", "id"))
    rank = F.col("before") + F.col("inside")
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    crossed = F.floor(rank * F.col("rate") + offset) - F.floor((rank - 1) * F.col("rate") + offset)
    return (
        spread.withColumn("inside", place)
        .join(small(cut(earlier.select("source", "part", "before"))), ["source", "part"])
        .select("id", "source", "n_tokens", crossed.cast("int").alias("copies"))
        .where("copies > 0")
    )


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shares(used: DataFrame, plan: DataFrame) -> DataFrame:
    """The report: source, target_weight, share (wanted), actual_share, n_docs, n_copies, n_tokens, most_repeats of every listed source."""
    got = used.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_repeats")
    )
    rows = plan.select("source", "target_weight", "share").join(got, "source", "left").fillna(0, ["docs", "n_copies", "n_tokens", "most_repeats"])
    actual = F.col("n_tokens") / F.nullif(F.sum("n_tokens").over(W.partitionBy()), F.lit(0))
    return rows.select("source", "target_weight", "share", F.coalesce(actual, F.lit(0.0)).alias("actual_share"), F.col("docs").alias("n_docs"), "n_copies", "n_tokens", "most_repeats")
