"""Change feeds of vector collections: one delivery of each message, and the state that the messages leave behind.

Columns used: those of ``delta_ops`` and ``delta_logs``. More columns do no harm; the results carry those documented
at each function only, except where they say otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.operators import graph
from spindrift.runtime import cut, small

#: Epoch values below the first are seconds, below the second milliseconds, below the third microseconds, else
#: nanoseconds. In milliseconds the first is 1973 and the second 5138.
SECONDS_BELOW, MILLIS_BELOW, MICROS_BELOW = 100_000_000_000, 100_000_000_000_000, 100_000_000_000_000_000


def epoch_millis(value: Column) -> Column:
    """Epoch milliseconds of a value in seconds, milliseconds, microseconds or nanoseconds, told by its magnitude."""
    size = F.abs(value)
    return (
        F.when(size < SECONDS_BELOW, value * 1000)
        .when(size < MILLIS_BELOW, value)
        .when(size < MICROS_BELOW, F.floor(value / F.lit(1000)))
        .otherwise(F.floor(value / F.lit(1_000_000)))
        .cast("bigint")
    )


def plain_name(value: Column) -> Column:
    """A name without case, blanks and punctuation."""
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""))


def plain_checksum(value: Column) -> Column:
    """A checksum in lower case, without a prefix that names its algorithm and without blanks; null if nothing is left."""
    digest = F.lower(F.regexp_replace(F.trim(value), r"^[A-Za-z0-9_-]+[:=]", ""))
    return F.when(F.length(F.trim(digest)) > 0, F.trim(digest))


def plain_op(value: Column) -> Column:
    """``upsert``, ``delete``, ``createcollection`` or ``dropcollection``."""
    return F.lower(F.regexp_replace(value, r"[^A-Za-z]+", ""))


def deliveries(ops: DataFrame, logs: DataFrame) -> DataFrame:
    """The deliveries of ``ops`` with what identifies their messages, in plain spelling, and without payload.

    Columns: delivery_id, source, sequence, op, collection, vector_id, at (epoch ms), checksum. A batch that ``logs``
    does not have gets a null source; repeated rows of a batch in ``logs`` count once (the smallest name)."""
    sources = logs.groupBy("batch_id").agg(F.min(plain_name(F.col("source_id"))).alias("source"))
    return ops.select(
        "delivery_id",
        "batch_id",
        "sequence",
        plain_op(F.col("op_type")).alias("op"),
        "collection",
        "vector_id",
        epoch_millis(F.col("timestamp_ms")).alias("at"),
        plain_checksum(F.col("checksum")).alias("checksum"),
    ).join(small(sources), "batch_id", "left")


IDENTITY = ["source", "sequence", "op", "collection", "vector_id", "at"]
DIGEST = ["source", "sequence", "checksum"]


def _same(one: DataFrame, other: DataFrame, names: list[str]) -> DataFrame:
    """Inner join on columns of equal names where nulls equal each other; the names come out once."""
    other = other.select(*[F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in other.columns])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
    return one.join(other, on).drop(*[f"_{c}" for c in names])


def _messages(ops: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exact, kept): one row per distinct (IDENTITY, checksum) with its ``first`` delivery, written once; and the column ``first`` of the
    deliveries that are the first of their message."""
    exact = cut(deliveries(ops, logs).groupBy(*IDENTITY, "checksum").agg(F.min_by("delivery_id", "delivery_id").alias("first")))
    summed = exact.where("checksum is not null")
    digests = summed.groupBy(*DIGEST).agg(F.min("first").alias("node"))
    bare = exact.where("checksum is null").select(*IDENTITY, F.col("first").alias("open"))
    # deliveries without checksum tie together the checksums that share their attributes
    tied = _same(_same(summed.drop("first"), bare, IDENTITY), digests, DIGEST)
    links = cut(tied.groupBy("open", "node").agg(F.count("*").alias("n")))
    nodes = digests.select(F.col("node").alias("first")).union(bare.select("open"))
    # most are one to one, and the later of the two is no message of its own; only what branches needs rounds
    alone = links.groupBy("node").agg(F.count("*").alias("n"), F.min("open").alias("open")).where("n = 1").drop("n")
    alone = cut(alone.join(links.groupBy("open").count().where("count = 1"), "open"))
    later = alone.select(F.greatest("open", "node").alias("first"))
    rest = links.join(alone, "open", "left_anti").select(F.col("open").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("weight"))
    if rest.limit(1).count():
        later = later.union(graph.components(rest).where("node <> component").select("node"))
    return exact, nodes.join(later, "first", "left_anti")


def first_deliveries(ops: DataFrame, logs: DataFrame) -> DataFrame:
    """One row per message: the delivery that arrived first. Columns as of :func:`deliveries`.

    Two deliveries are one message if source, sequence and checksum are equal; where a checksum is missing, source,
    sequence, op, collection, vector_id and time must be equal instead. That relation is closed: what is tied through a third
    delivery is one message, however long the chain. Nulls in a key equal each other.

    Method: a hash aggregation by identifier whose ``min_by`` over the arrival keeps the first delivery. ``delivery_id`` counts
    the arrivals and is unique, so that time of delivery and tie-break are one number, of fixed width: with a struct of two fields
    Spark would sort instead (SortAggregate). It combines on the map side, so that a message delivered a million times shuffles a row
    per task. What lacks a checksum is tied to what has one by joins and connected components over these few; no window gathers a key."""
    exact, kept = _messages(ops, logs)
    return exact.join(kept, "first", "left_semi").select(F.col("first").alias("delivery_id"), *IDENTITY, "checksum")


def repeated_deliveries(ops: DataFrame, logs: DataFrame) -> DataFrame:
    """``delivery_id`` of every delivery but the first of its message (see :func:`first_deliveries`)."""
    _, kept = _messages(ops, logs)
    return ops.select("delivery_id").join(kept.select(F.col("first").alias("delivery_id")), "delivery_id", "left_anti")


def current_keys(ops: DataFrame, logs: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """The state that the feed leaves: one row (collection, vector_id, sequence, delivery_id, at) per current record.

    Messages are applied once each, per (collection, vector_id) by true time, then sequence, then arrival: an upsert
    replaces the record, a delete removes it, and a DropCollection removes the records of its collection written up to
    its time. Rows with another op, or with a null collection, vector_id or time, change nothing. ``base`` holds the records
    from before the feed (collection, vector_id, sequence, at); their delivery_id is null. Without ``logs`` the messages
    are not deduplicated first, which leaves the same state, since a repeated message has its first one's place in the order.

    Method: the last change per key by ``row_number() = 1``, which Spark also applies before the shuffle (window group
    limit), so that a key with a third of all changes sends a row per task."""
    if logs is None:
        rows = ops.select(
            "delivery_id",
            "sequence",
            plain_op(F.col("op_type")).alias("op"),
            "collection",
            "vector_id",
            epoch_millis(F.col("timestamp_ms")).alias("at"),
        )
    else:
        rows = first_deliveries(ops, logs)
    names = ["collection", "vector_id", "op", "at", "sequence", "delivery_id"]
    changes = rows.where(F.col("op").isin("upsert", "delete") & F.col("vector_id").isNotNull()).select(*names)
    if base is not None:
        old = base.select("collection", "vector_id", F.lit("upsert").alias("op"), "at", "sequence", F.lit(None).cast("bigint").alias("delivery_id"))
        changes = changes.unionByName(old)
    changes = changes.where(F.col("collection").isNotNull() & F.col("at").isNotNull())
    order = [F.desc("at"), F.desc_nulls_last("sequence"), F.desc_nulls_last("delivery_id")]
    last = (
        changes.withColumn("rank", F.row_number().over(W.partitionBy("collection", "vector_id").orderBy(*order)))
        .where("rank = 1 and op = 'upsert'")
        .drop("rank", "op")
    )
    drops = (
        ops.where(plain_op(F.col("op_type")) == "dropcollection")
        .groupBy("collection")
        .agg(F.max(epoch_millis(F.col("timestamp_ms"))).alias("dropped"))
        .where(F.col("collection").isNotNull() & F.col("dropped").isNotNull())
    )
    return (
        last.join(small(drops), "collection", "left")
        .where(F.col("dropped").isNull() | (F.col("at") > F.col("dropped")))
        .select("collection", "vector_id", "sequence", "delivery_id", "at")
    )


def current_records(ops: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Every column of ``ops`` for the deliveries that wrote the current records (see :func:`current_keys`)."""
    return ops.join(current_keys(ops, logs).select("delivery_id"), "delivery_id", "left_semi")
