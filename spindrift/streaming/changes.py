"""Structured Streaming over change events: reading, filtering, deduplication, windows, applying to a table, dead letters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A Debezium envelope: op c, u, d or r, with the row before and after as JSON text.
ENVELOPE = "payload struct<op: string, before: string, after: string, ts_ms: bigint, source: struct<table: string>>"
#: What the letters of an envelope mean.
OPERATIONS = {"c": "insert", "r": "insert", "u": "update", "d": "delete"}


def file_stream(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a directory; ``files`` bounds a batch (back pressure)."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topics: str, most: int | None = None) -> DataFrame:
    """A stream over Kafka topics (needs the connector on the class path): key, value, timestamp."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    return (reader.option("maxOffsetsPerTrigger", most) if most else reader).load()


def from_debezium(rows: DataFrame, value: str = "value") -> DataFrame:
    """operation, collection, before, after, at (epoch ms) of the envelopes in a column; a text that is none gives a null operation."""
    e = F.from_json(F.col(value).cast("string"), ENVELOPE)
    letter = e["payload"]["op"]
    kind = F.lit(None).cast("string")
    for code, name in OPERATIONS.items():
        kind = F.when(letter == code, name).otherwise(kind)
    return rows.select(kind.alias("operation"), e["payload"]["source"]["table"].alias("collection"), e["payload"]["before"].alias("before"), e["payload"]["after"].alias("after"), e["payload"]["ts_ms"].alias("at"))


def selected(events: DataFrame, collections: Sequence[str] | None = None, operations: Sequence[str] | None = None, key: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Events of these collections and operations whose key holds ``key``, at or after ``since`` and before ``until``."""
    if collections is not None:
        events = events.where(F.col("collection").isin(list(collections)))
    if operations is not None:
        events = events.where(F.col("operation").isin(list(operations)))
    if key is not None:
        events = events.where(F.contains("key", F.lit(key)))
    if since is not None:
        events = events.where(F.col("at") >= since)
    return events if until is None else events.where(F.col("at") < until)


def deduplicated(events: DataFrame, id: str, at: str, lateness: str) -> DataFrame:
    """Each id once within the watermark; state older than that is dropped, so it stays bounded."""
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark([id])


def windowed(events: DataFrame, at: str, lateness: str, size: str, keys: Sequence[str], aggregates: Sequence[Column], slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows by event time."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, lateness).groupBy(window, *keys).agg(*aggregates)


def sessions(events: DataFrame, at: str, lateness: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Sessions by event time: events of a key less than ``gap`` apart."""
    return events.withWatermark(at, lateness).groupBy(F.session_window(at, gap), *keys).agg(*aggregates)


def apply_changes(table: DataFrame, batch: DataFrame, key: str, order: Sequence[str], delete: Column) -> DataFrame:
    """``table`` after a batch of changes with the same columns and ``order``: the last change per key wins, deletes drop the row."""
    last = batch.withColumn("_gone", F.coalesce(delete, F.lit(False))).withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("_place = 1")
    kept = table.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("not _gone").select(*table.columns))


def split(batch: DataFrame, good: Column, error: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that can be applied, dead letters with ``error``)."""
    fine = F.coalesce(good, F.lit(False))
    return batch.where(fine), batch.where(~fine).withColumn("error", error)


def upsert_sink(path: str, key: str, order: Sequence[str], delete: Column, good: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the current table under ``path`` as one directory per batch number.

    A repeated batch writes the same directory again, so that a restart applies each batch once. Rows that are not ``good`` go to
    ``path``/dead, by batch, before the batch counts as applied."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if good is not None:
            batch, dead = split(batch, good, F.lit("rejected"))
            dead.write.mode("overwrite").parquet(f"{path}/dead/batch={number}")
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/state/{number - 1}/_SUCCESS")
        before = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
        table = spark.read.parquet(f"{path}/state/{number - 1}") if before else spark.createDataFrame([], batch.schema)
        apply_changes(table, batch, key, order, delete).write.mode("overwrite").parquet(f"{path}/state/{number}")

    return write
