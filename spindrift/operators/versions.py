"""Versions and time travel over append-only tables: one row per change of a key, ordered by a version column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def history(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``version``, from 1 per key."""
    return rows.withColumn("version", F.row_number().over(W.partitionBy(key).orderBy(*order)))


def as_of(rows: DataFrame, key: str, order: Sequence[str], until: Column | None = None, deleted: Column | None = None) -> DataFrame:
    """The last version per key among the rows that satisfy ``until``; keys whose last version is ``deleted`` are gone."""
    seen = rows if until is None else rows.where(until)
    last = seen.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("_place = 1").drop("_place")
    return last if deleted is None else last.where(~F.coalesce(deleted, F.lit(False)))


def difference(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, change: ``added``, ``removed`` or ``modified`` between two states; keys that stay the same are left out."""
    b = before.select(key, F.struct(*columns).alias("_b"))
    a = after.select(key, F.struct(*columns).alias("_a"))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return b.join(a, key, "full_outer").select(key, kind.alias("change")).where("change is not null")


def retained(rows: DataFrame, key: str, order: Sequence[str], keep: int) -> DataFrame:
    """The last ``keep`` versions per key."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where(F.col("_place") <= keep).drop("_place")


def unexpired(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows without an expiry, or with one that lies after ``now``."""
    return rows.where(F.col(expires).isNull() | (F.col(expires) > now))


def lifecycle(rows: DataFrame, at: str, now: Column, archive_days: int, expire_days: int) -> DataFrame:
    """``rows`` with ``action``: keep, archive or expire by age."""
    age = F.datediff(now, F.col(at))
    return rows.withColumn("action", F.when(age >= expire_days, "expire").when(age >= archive_days, "archive").otherwise("keep"))


def last_writer(replicas: DataFrame, key: str, clock: str, node: str, deleted: Column) -> DataFrame:
    """Replicas merged by last writer (clock, then node); tombstones remove their key."""
    last = replicas.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(F.desc(clock), F.desc(node)))).where("_place = 1").drop("_place")
    return last.where(~F.coalesce(deleted, F.lit(False)))
