"""Collections on disk, and their import and export.

A database is a directory with numbered JSON manifests, of which the highest number holds, and one directory of Parquet files per change. A
collection is a list of such segments: the first holds rows, the later ones rows that replace those of equal ids, and tombstones. A change
writes a segment of its own size and then publishes the next manifest by a rename, so that readers see a whole state, a failed write leaves
the old one, and of two writers that publish the same number one fails. :meth:`Collection.compact` folds the segments into one; it runs by
itself beyond :data:`MOST_SEGMENTS`. Aliases, snapshots, branches and views are entries of the manifest."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.distance import metric, sound
from spindrift.functions.filters import Json, compile_filter
from spindrift.operators import search as exact
from spindrift.runtime import cut

SCHEMA = "id string, vector array<float>, metadata string, inserted_at timestamp, expires_at timestamp"
COLUMNS = ["id", "vector", "metadata", "inserted_at", "expires_at"]
#: Segments of a collection beyond which a change folds them into one, and manifests that are kept.
MOST_SEGMENTS, MANIFESTS = 16, 8


class Conflict(RuntimeError):
    """Another writer changed what this one changed."""


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad) lines of a file of ``{"id", "vector", "metadata"}`` objects; blank lines and those that begin with # are passed over.
    Bad lines hold ``line`` and ``error``. ``strict``: the first bad line raises."""
    lines = spark.read.text(path).withColumnRenamed("value", "line").where(~F.rlike("line", F.lit(r"^\s*(#|$)")))
    parsed = lines.withColumn("v", F.try_parse_json("line"))
    rows = parsed.select(
        "line",
        F.try_variant_get("v", "$.id", "string").alias("id"),
        F.try_variant_get("v", "$.vector", "array<float>").alias("vector"),
        F.try_variant_get("v", "$.metadata", "variant").cast("string").alias("metadata"),
        F.when(F.col("v").isNull(), "no JSON").when(F.try_variant_get("v", "$.id", "string").isNull(), "no id").when(F.try_variant_get("v", "$.vector", "array<float>").isNull(), "no vector").alias("error"),
    )
    good = rows.where("error is null").select("id", "vector", "metadata")
    bad = rows.where("error is not null").select("line", "error")
    if strict:
        first = bad.first()
        if first is not None:
            raise ValueError(f"{first.error}: {first.line[:80]}")
    return good, bad


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object per row."""
    rows.select(F.to_json(F.struct("id", "vector", F.try_parse_json("metadata").alias("metadata"))).alias("value")).write.text(path)


def csv_rows(rows: DataFrame) -> DataFrame:
    """id, vector (joined by ;), metadata: what is exported as CSV."""
    return rows.select("id", F.array_join(F.transform("vector", lambda x: x.cast("string")), ";").alias("vector"), F.coalesce("metadata", F.lit("")).alias("metadata"))


def write_csv(rows: DataFrame, path: str) -> None:
    csv_rows(rows).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def merged_json(base: Column, patch: Column) -> Column:
    """JSON objects merged deeply: values of ``patch`` replace those of ``base``, and objects are merged in turn. What is no object counts as
    empty in ``base`` and changes nothing in ``patch``."""

    def merge(one: Any, other: Any) -> Any:
        if not isinstance(one, dict) or not isinstance(other, dict):
            return other
        return {**one, **{k: merge(one[k], v) if k in one else v for k, v in other.items()}}

    def parsed(text: str | None) -> dict:
        try:
            value = json.loads(text) if text else {}
        except ValueError:
            return {}
        return value if isinstance(value, dict) else {}

    @F.arrow_udf("string")
    def run(b: pa.Array, p: pa.Array) -> pa.Array:
        return pa.array([json.dumps(merge(parsed(x), parsed(y)), separators=(",", ":"), ensure_ascii=False) for x, y in zip(b.to_pylist(), p.to_pylist())], pa.string())

    return run(base, patch)


class Database:
    """Named collections under a directory (any file system that Spark writes to)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hpath = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._hpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hpath(self.path))

    def _numbers(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._hpath(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self) -> dict[str, Any]:
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "collections": {}, "aliases": {}, "views": {}, "branches": {}}
        at = f"{self.path}/manifest-{numbers[-1]:012d}.json"
        return json.loads("\n".join(r.value for r in self.spark.read.text(at, wholetext=True).collect()))

    def _publish(self, manifest: dict[str, Any]) -> None:
        number = manifest["number"] = manifest["number"] + 1
        at, new = self._hpath(f"{self.path}/manifest-{number:012d}.json"), self._hpath(f"{self.path}/_new-{uuid.uuid4().hex}")
        out = self._fs.create(new, False)
        out.write(bytearray(json.dumps(manifest, indent=1).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(new, at):
            self._fs.delete(new, False)
            raise Conflict(f"manifest {number} was published by another writer")
        for old in self._numbers()[:-MANIFESTS]:
            self._fs.delete(self._hpath(f"{self.path}/manifest-{old:012d}.json"), False)

    def names(self) -> list[str]:
        return sorted(self.manifest()["collections"])

    def create(self, name: str, dimensions: int, distance: str = "cosine", ttl: int | None = None, exist_ok: bool = False) -> Collection:
        m = self.manifest()
        if name in m["collections"] or name in m["aliases"]:
            if exist_ok and name in m["collections"]:
                return self[name]
            raise ValueError(f"collection {name!r} exists")
        if dimensions < 1:
            raise ValueError("a collection has at least one dimension")
        m["collections"][name] = {"dimensions": dimensions, "metric": metric(distance), "ttl": ttl, "segments": [], "snapshots": {}, "schema": {}}
        self._publish(m)
        return self[name]

    def drop(self, name: str) -> None:
        """Removes a collection, unless aliases name it. Files go with :meth:`vacuum`."""
        m = self.manifest()
        named = sorted(a for a, c in m["aliases"].items() if c == name)
        if named:
            raise ValueError(f"aliases name collection {name!r}: {', '.join(named)}")
        del m["collections"][name]
        self._publish(m)

    def rename(self, name: str, new: str) -> None:
        m = self.manifest()
        if new in m["collections"] or new in m["aliases"]:
            raise ValueError(f"{new!r} exists")
        m["collections"][new] = m["collections"].pop(name)
        m["aliases"] = {a: new if c == name else c for a, c in m["aliases"].items()}
        self._publish(m)

    def vacuum(self) -> int:
        """Deletes the segments that no collection, snapshot or branch names; their number."""
        m = self.manifest()
        used = {s for c in m["collections"].values() for part in [c["segments"], *c["snapshots"].values()] for s in part}
        found = [f.getPath().getName() for f in self._fs.listStatus(self._hpath(self.path)) if f.isDirectory()]
        gone = [n for n in found if n.startswith("s-") and n not in used]
        for n in gone:
            self._fs.delete(self._hpath(f"{self.path}/{n}"), True)
        return len(gone)

    # aliases
    def alias(self, alias: str, name: str, replace: bool = False) -> None:
        m = self.manifest()
        if alias in m["collections"] or name not in m["collections"] or alias in m["aliases"] and not replace:
            raise ValueError("an alias must be new and name a collection")
        m["aliases"][alias] = name
        self._publish(m)

    def unalias(self, alias: str) -> bool:
        m = self.manifest()
        if m["aliases"].pop(alias, None) is None:
            return False
        self._publish(m)
        return True

    def aliases(self) -> dict[str, str]:
        return dict(sorted(self.manifest()["aliases"].items()))

    def __getitem__(self, name: str) -> Collection:
        m = self.manifest()
        name = m["aliases"].get(name, name)
        if name not in m["collections"]:
            raise KeyError(name)
        return Collection(self, name)

    # branches
    def branch(self, name: str, parent: str) -> Collection:
        """A collection that begins as another one is now, and shares its segments."""
        m = self.manifest()
        if name in m["collections"]:
            raise ValueError(f"{name!r} exists")
        m["collections"][name] = {**m["collections"][parent], "snapshots": {}}
        m["branches"][name] = {"parent": parent, "at": list(m["collections"][parent]["segments"])}
        self._publish(m)
        return self[name]

    def merge_branch(self, name: str) -> None:
        """Applies to the parent what the branch changed since it began: rows put and removed there. Rows that the parent changed as well
        raise :class:`Conflict`."""
        m = self.manifest()
        start = m["branches"][name]
        own, parent = self[name], self[start["parent"]]
        before = own._read(start["at"])
        mine, theirs = changed_rows(before, own._read(own.config()["segments"])), changed_rows(before, parent._read(parent.config()["segments"]))
        both = mine.join(theirs, "id", "left_semi").select("id").first()
        if both is not None:
            raise Conflict(f"row {both.id!r} was changed in the branch and in {start['parent']!r}")
        parent._append(mine)
        m = self.manifest()
        m["branches"][name]["at"] = list(m["collections"][name]["segments"])
        self._publish(m)

    def transaction(self) -> Transaction:
        return Transaction(self)

    # views
    def create_view(self, name: str, text: str, params: dict | None = None, materialized: bool = False, max_age: float = 300.0, max_changes: int = 100) -> None:
        """A stored query of the SELECT dialect over one collection. A materialized one keeps its rows, until they are older than
        ``max_age`` seconds or its collection has had ``max_changes`` changes."""
        m = self.manifest()
        if name in m["views"]:
            raise ValueError(f"view {name!r} exists")
        m["views"][name] = {"text": text, "params": params or {}, "materialized": materialized, "max_age": max_age, "max_changes": max_changes, "path": None, "at": 0.0, "changes": 0}
        self._publish(m)

    def drop_view(self, name: str) -> None:
        m = self.manifest()
        del m["views"][name]
        self._publish(m)

    def view(self, name: str) -> DataFrame:
        v = self.manifest()["views"][name]
        if not v["materialized"]:
            return self.query(v["text"], v["params"])
        if v["path"] is None or time.time() - v["at"] > v["max_age"] or self.manifest()["number"] - v["changes"] >= v["max_changes"]:
            self.refresh(name)
            v = self.manifest()["views"][name]
        return self.spark.read.parquet(f"{self.path}/{v['path']}")

    def refresh(self, name: str) -> None:
        v = self.manifest()["views"][name]
        path = f"view-{uuid.uuid4().hex}"
        self.query(v["text"], v["params"]).write.parquet(f"{self.path}/{path}")
        m = self.manifest()
        m["views"][name] = {**m["views"][name], "path": path, "at": time.time(), "changes": m["number"] + 1}
        self._publish(m)

    def query(self, text: str, params: dict | None = None) -> DataFrame:
        """A query or a statement of the SELECT dialect over the collections."""
        from spindrift.plans import ql

        return ql.execute(self, text, params)

    # whole databases
    def all_rows(self) -> DataFrame:
        """collection and the live rows of every collection."""
        parts = [self[n].rows().select(F.lit(n).alias("collection"), *COLUMNS) for n in self.names()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "collection string, " + SCHEMA)

    def _settings(self) -> dict[str, Any]:
        return {n: {k: c[k] for k in ("dimensions", "metric", "ttl", "schema")} for n, c in self.manifest()["collections"].items()}

    def export_json(self, path: str) -> None:
        """Every collection: its settings in one line and its rows as JSON lines."""
        rows = self.all_rows().select(F.to_json(F.struct("collection", "id", "vector", F.try_parse_json("metadata").alias("metadata"))).alias("value"))
        settings = self.spark.createDataFrame([(json.dumps({"settings": self._settings()}),)], "value string")
        settings.unionByName(rows).write.text(path)

    def import_json(self, path: str) -> None:
        lines = self.spark.read.text(path)
        head = F.get_json_object("value", "$.settings")
        for name, c in json.loads(lines.where(head.isNotNull()).select(head).first()[0]).items():
            self.create(name, c["dimensions"], c["metric"], c["ttl"])
            own = lines.where(F.get_json_object("value", "$.collection") == name).withColumn("v", F.try_parse_json("value"))
            self[name].insert(own.select(F.try_variant_get("v", "$.id", "string").alias("id"), F.try_variant_get("v", "$.vector", "array<float>").alias("vector"), F.try_variant_get("v", "$.metadata", "variant").cast("string").alias("metadata")))

    def save_file(self, path: str) -> None:
        """The live rows of every collection in one Parquet file, which appears whole by a rename (for what one task can write)."""
        folder = f"{self.path}/_file-{uuid.uuid4().hex}"
        settings = F.lit(json.dumps(self._settings()))
        self.all_rows().withColumn("settings", settings).coalesce(1).write.parquet(folder)
        part = next(f.getPath() for f in self._fs.listStatus(self._hpath(folder)) if f.getPath().getName().startswith("part-"))
        if not self._fs.rename(part, self._hpath(path)):
            raise OSError(f"{path} could not be written")
        self._fs.delete(self._hpath(folder), True)

    def load_file(self, path: str) -> None:
        rows = self.spark.read.parquet(path)
        first = rows.select("settings").first()
        for name, c in (json.loads(first.settings) if first else {}).items():
            self.create(name, c["dimensions"], c["metric"], c["ttl"])
            self[name]._append(rows.where(F.col("collection") == name).select(*COLUMNS).withColumn("gone", F.lit(False)))

    def export_bundle(self, name: str, path: str) -> dict[str, Any]:
        """One collection as a directory: its rows, and a manifest with their number and digest."""
        c = self[name]
        c.rows().select(*COLUMNS).write.parquet(f"{path}/data")
        manifest = {"format": 1, "name": name, **self._settings()[name], "rows": c.count(), "digest": c.digest()}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
        return manifest

    def import_bundle(self, path: str, name: str | None = None) -> Collection:
        """The collection of a bundle; one of another format, or whose rows don't have the manifest's digest, is refused."""
        m = json.loads(self.spark.read.text(f"{path}/manifest").first().value)
        if m["format"] != 1:
            raise ValueError(f"bundle format {m['format']} is unknown")
        c = self.create(name or m["name"], m["dimensions"], m["metric"], m["ttl"])
        c._append(self.spark.read.schema(SCHEMA).parquet(f"{path}/data").withColumn("gone", F.lit(False)))
        if c.digest() != m["digest"]:
            self.drop(c.name)
            raise ValueError("the rows don't have the digest of the manifest")
        return c


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows to put and the tombstones (``gone``) that lead from one state to another."""
    b = before.select("id", F.struct("vector", "metadata", "expires_at").alias("_b"))
    a = after.select("id", F.struct(*COLUMNS[1:]).alias("_a"), F.struct("vector", "metadata", "expires_at").alias("_c"))
    both = b.join(a, "id", "full_outer").where(~F.col("_b").eqNullSafe(F.col("_c")))
    return both.select("id", *[F.col("_a")[c].alias(c) for c in COLUMNS[1:]], F.col("_a").isNull().alias("gone"))


class Transaction(Database):
    """Changes that are published together, against the state at its begin.

    Reads see that state and the transaction's own changes. ``commit`` raises :class:`Conflict`, and publishes nothing, if another writer has
    changed a collection that the transaction changed. As a context it commits at the end, or rolls back on an error."""

    def __init__(self, database: Database):
        self.base, self.spark, self.path, self._hpath, self._fs = database, database.spark, database.path, database._hpath, database._fs
        self._begin = database.manifest()
        self._now = json.loads(json.dumps(self._begin))

    def manifest(self) -> dict[str, Any]:
        return json.loads(json.dumps(self._now))

    def _publish(self, manifest: dict[str, Any]) -> None:
        self._now = manifest

    def commit(self) -> None:
        last = self.base.manifest()
        for part in ("collections", "aliases", "views", "branches"):
            for name in {*self._begin[part], *self._now[part]}:
                was, now = self._begin[part].get(name), self._now[part].get(name)
                if was == now:
                    continue
                if last[part].get(name) != was:
                    raise Conflict(f"{name!r} was changed by another writer")
                if now is None:
                    del last[part][name]
                else:
                    last[part][name] = now
        self.base._publish(last)

    def rollback(self) -> None:
        self._now = json.loads(json.dumps(self._begin))

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()


class Collection:
    """Verbs over one collection; reads return DataFrames, writes append a segment and publish."""

    def __init__(self, database: Database, name: str):
        self.db, self.name = database, name
        #: Functions from rows to rows, before rows are written and after a search.
        self.before_insert: list[Callable[[DataFrame], DataFrame]] = []
        self.after_search: list[Callable[[DataFrame], DataFrame]] = []

    def config(self) -> dict[str, Any]:
        return self.db.manifest()["collections"][self.name]

    def _read(self, segments: Sequence[str]) -> DataFrame:
        """The rows that a list of segments leaves: the last of each id, without those removed."""
        if not segments:
            return self.db.spark.createDataFrame([], SCHEMA)
        one = lambda s: self.db.spark.read.schema(SCHEMA + ", gone boolean").parquet(f"{self.db.path}/{s}")
        base = one(segments[0]).where("not gone").select(*COLUMNS)
        if len(segments) == 1:
            return base
        later = reduce(DataFrame.unionByName, [one(s).withColumn("_segment", F.lit(i)) for i, s in enumerate(segments[1:])])
        last = later.withColumn("_place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("_segment")))).where("_place = 1")
        return base.join(last.select("id"), "id", "left_anti").select(*COLUMNS).unionByName(last.where("not gone").select(*COLUMNS))

    def rows(self, now: Column | None = None, snapshot: str | None = None, version: int | None = None) -> DataFrame:
        """Live rows: those that have not expired; now, of a snapshot, or of the first ``version`` changes since the last compaction."""
        c = self.config()
        segments = c["snapshots"][snapshot] if snapshot else c["segments"] if version is None else c["segments"][:version]
        return self._read(segments).where(F.col("expires_at").isNull() | (F.col("expires_at") > (now if now is not None else F.current_timestamp())))

    def _append(self, rows: DataFrame, replace: bool = False) -> None:
        """Publishes ``rows`` (with ``gone``) as the last segment, or as the only one."""
        segment = f"s-{uuid.uuid4().hex}"
        rows.select(*COLUMNS, "gone").write.parquet(f"{self.db.path}/{segment}")
        m = self.db.manifest()
        c = m["collections"][self.name]
        c["segments"] = [segment] if replace else [*c["segments"], segment]
        self.db._publish(m)
        if len(c["segments"]) > MOST_SEGMENTS:
            self.compact()

    def _put(self, rows: DataFrame) -> None:
        self._append(rows.select(*COLUMNS, F.lit(False).alias("gone")))

    def _remove(self, ids: DataFrame) -> int:
        """Tombstones for the live rows among ``ids``; their number."""
        live = cut(self.rows().select("id").join(ids.select("id").distinct(), "id", "left_semi"))
        n = live.count()
        if n:
            self._append(live.select("id", *[F.lit(None).cast(t).alias(c) for c, t in zip(COLUMNS[1:], ("array<float>", "string", "timestamp", "timestamp"))], F.lit(True).alias("gone")))
        return n

    def _checked(self, rows: DataFrame, ttl: int | None) -> DataFrame:
        c = self.config()
        for hook in self.before_insert:
            rows = hook(rows)
        ttl = ttl if ttl is not None else c["ttl"]
        have = set(rows.columns)
        rows = cut(rows.select(
            F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"),
            F.col("metadata").cast("string").alias("metadata") if "metadata" in have else F.lit(None).cast("string").alias("metadata"),
            F.current_timestamp().alias("inserted_at"),
            (F.current_timestamp() + F.make_interval(secs=F.lit(ttl)) if ttl else F.lit(None)).cast("timestamp").alias("expires_at"),
            *(["_at"] if "_at" in have else []),
        ))
        bad = rows.where(~(sound(F.col("vector"), c["dimensions"]) & F.coalesce(F.octet_length("id").between(1, 1024), F.lit(False)))).select("id").first()
        if bad is not None:
            raise ValueError(f"row {bad.id!r}: an id has from 1 to 1024 bytes and a vector {c['dimensions']} finite values")
        if c.get("schema"):
            wrong = violations(rows, c["schema"]).first()
            if wrong is not None:
                raise ValueError(f"row {wrong.id!r}: {wrong.error}")
        return rows

    def insert(self, rows: DataFrame, ttl: int | None = None) -> None:
        """Adds rows (id, vector, metadata); ids that exist or occur twice are an error, and then nothing is added."""
        new = self._checked(rows, ttl)
        twice = new.groupBy("id").count().where("count > 1").select("id").union(new.select("id").join(self.rows().select("id"), "id", "left_semi")).first()
        if twice is not None:
            raise ValueError(f"id {twice.id!r} exists")
        self._put(new)

    def insert_text(self, rows: DataFrame, embed: Callable[[Column], Column], text: str = "text", ttl: int | None = None) -> None:
        """Adds rows (id, text, metadata) whose vectors an embedder gives; the text is kept in the metadata."""
        have = F.col("metadata") if "metadata" in rows.columns else F.lit("{}")
        own = F.to_json(F.struct(F.col(text).alias("text")))
        self.insert(rows.select("id", embed(F.col(text)).alias("vector"), merged_json(have, own).alias("metadata")), ttl)

    def insert_unless_near(self, rows: DataFrame, most: float = 0.02, policy: str = "reject") -> DataFrame:
        """Adds the rows with no row of the collection nearer than ``most``; the others (id, existing, distance) are the result.

        ``reject`` leaves them out, ``merge`` merges their metadata into that of the nearest row, ``version`` adds them as
        ``<existing>-v<n>`` with the next free n. The rows are a stated query set that meets the collection in blocks."""
        c = self.config()
        new = self._checked(rows, None)
        asked = new.select(F.col("id").alias("query_id"), "vector")
        near = cut(exact.batch_top_k(self.rows(), asked, 1, c["metric"], "vector", "id", "query_id", most=most).where(F.col("distance") < most))
        near = near.select(F.col("query_id").alias("id"), F.col("id").alias("existing"), "distance")
        self._put(new.join(near.select("id"), "id", "left_anti"))
        if policy == "merge":
            patch = new.select("id", F.col("metadata").alias("patch")).join(near, "id").groupBy("existing").agg(F.max_by("patch", "id").alias("metadata"))
            self.merge_metadata(patch.select(F.col("existing").alias("id"), "metadata"))
        elif policy == "version":
            versions = self.rows().select(F.regexp_extract("id", r"^(.*)-v(\d+)$", 1).alias("existing"), F.regexp_extract("id", r"-v(\d+)$", 1).try_cast("int").alias("v"))
            last = versions.where("v is not null").groupBy("existing").agg(F.max("v").alias("last"))
            numbered = near.join(last, "existing", "left").withColumn("n", F.row_number().over(W.partitionBy("existing").orderBy("id")))
            names = numbered.select("id", F.concat("existing", F.lit("-v"), (F.coalesce("last", F.lit(1)) + F.col("n")).cast("string")).alias("name"))
            self._put(new.join(names, "id").drop("id").withColumnRenamed("name", "id"))
        return near

    def upsert(self, rows: DataFrame, ttl: int | None = None) -> tuple[int, int]:
        """Adds rows or replaces those of equal ids; of rows with equal ids the last counts. (inserted, updated)"""
        new = self._checked(rows.withColumn("_at", F.monotonically_increasing_id()), ttl)
        new = new.withColumn("_place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("_at")))).where("_place = 1").drop("_at", "_place")
        there = new.select("id").join(self.rows().select("id"), "id", "left_semi").count()
        total = new.count()
        self._put(new)
        return total - there, there

    def _known(self, rows: DataFrame) -> None:
        lost = rows.select("id").join(self.rows().select("id"), "id", "left_anti").first()
        if lost is not None:
            raise KeyError(lost.id)

    def update(self, rows: DataFrame) -> None:
        """Replaces vector and metadata of rows that exist; an unknown id is an error, and then nothing changes."""
        new = self._checked(rows, None)
        self._known(new)
        self._put(new)

    def update_metadata(self, patches: DataFrame) -> None:
        """Replaces the metadata of the ids of ``patches`` (id, metadata)."""
        p = patches.groupBy("id").agg(F.max("metadata").alias("_new"))
        self._put(self.rows().join(p, "id").withColumn("metadata", F.col("_new")))

    def merge_metadata(self, patches: DataFrame) -> None:
        """Merges JSON objects into the metadata of the ids of ``patches`` (id, metadata); see :func:`merged_json`."""
        p = patches.groupBy("id").agg(F.max("metadata").alias("_new"))
        self._put(self.rows().join(p, "id").withColumn("metadata", merged_json(F.col("metadata"), F.col("_new"))))

    def delete(self, ids: Sequence[str] | DataFrame) -> int:
        """Removes rows by id; the number of those that were there."""
        if not isinstance(ids, DataFrame):
            ids = self.db.spark.createDataFrame([(i,) for i in ids], "id string")
        return self._remove(ids)

    def delete_where(self, spec: dict) -> int:
        return self._remove(self.rows().where(compile_filter(spec, Json("metadata"))).select("id"))

    def expire(self, now: Column | None = None) -> int:
        """Removes the rows whose time has come; their number."""
        now = now if now is not None else F.current_timestamp()
        old = cut(self._read(self.config()["segments"]).where(F.col("expires_at") <= now).select("id"))
        n = old.count()
        if n:
            self._append(old.select("id", *[F.lit(None).cast(t).alias(c) for c, t in zip(COLUMNS[1:], ("array<float>", "string", "timestamp", "timestamp"))], F.lit(True).alias("gone")))
        return n

    def clear(self) -> int:
        """Removes all rows; their number."""
        n = self.count()
        m = self.db.manifest()
        m["collections"][self.name]["segments"] = []
        self.db._publish(m)
        return n

    def compact(self) -> int:
        """Folds the segments into one; the number of rows and tombstones that this drops."""
        segments = self.config()["segments"]
        before = sum(self.db.spark.read.parquet(f"{self.db.path}/{s}").count() for s in segments)
        self._append(self._read(segments).withColumn("gone", F.lit(False)), replace=True)
        return before - self._read(self.config()["segments"]).count()

    def get(self, id: str) -> DataFrame:
        return self.rows().where(F.col("id") == id)

    def get_many(self, ids: Sequence[str]) -> DataFrame:
        """position and the rows of these ids, in their order; ids that are not there are left out."""
        wanted = self.db.spark.createDataFrame(list(enumerate(ids)), "position int, id string")
        return self.rows().join(F.broadcast(wanted), "id").select("position", *COLUMNS).orderBy("position")

    def ids(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        """A page of the ids in their order."""
        page = self.rows().select("id").orderBy("id").offset(offset)
        return page if limit is None else page.limit(limit)

    def count(self, spec: dict | None = None) -> int:
        rows = self.rows()
        return (rows if spec is None else rows.where(compile_filter(spec, Json("metadata")))).count()

    def find(self, spec: dict, offset: int = 0, limit: int = 10) -> tuple[DataFrame, int, bool]:
        """Rows by metadata only: (the page in the order of the ids, how many there are in all, whether more follow)."""
        found = self.rows().where(compile_filter(spec, Json("metadata"))).select("id", "metadata")
        total = found.count()
        return found.orderBy("id").offset(offset).limit(limit), total, offset + limit < total

    def search(self, query: Sequence[float], k: int, spec: dict | None = None, distance: str | None = None, snapshot: str | None = None, version: int | None = None) -> DataFrame:
        c = self.config()
        if len(query) != c["dimensions"]:
            raise ValueError(f"a query has {c['dimensions']} values")
        where = None if spec is None else compile_filter(spec, Json("metadata"))
        found = exact.top_k(self.rows(snapshot=snapshot, version=version), query, k, distance or c["metric"], "vector", "id", where, keep=["metadata"])
        for hook in self.after_search:
            found = hook(found)
        return found

    def resize(self, dimensions: int) -> None:
        """Cuts the vectors, or fills them up with zeros."""
        fill = F.array_repeat(F.lit(0.0).cast("float"), max(dimensions, 0))
        self._append(self.rows().withColumn("vector", F.slice(F.concat("vector", fill), 1, dimensions)).withColumn("gone", F.lit(False)), replace=True)
        m = self.db.manifest()
        m["collections"][self.name]["dimensions"] = dimensions
        self.db._publish(m)

    def set_schema(self, schema: dict[str, dict]) -> None:
        """What the metadata of rows must hold from now on: field -> {"type", "required"} (see :func:`violations`)."""
        m = self.db.manifest()
        m["collections"][self.name]["schema"] = schema
        self.db._publish(m)

    def snapshot(self, name: str) -> None:
        m = self.db.manifest()
        c = m["collections"][self.name]
        c["snapshots"][name] = list(c["segments"])
        self.db._publish(m)

    def snapshots(self) -> list[str]:
        return sorted(self.config()["snapshots"])

    def restore(self, name: str) -> None:
        m = self.db.manifest()
        c = m["collections"][self.name]
        c["segments"] = list(c["snapshots"][name])
        self.db._publish(m)

    def digest(self) -> str:
        """SHA-256 over the sorted digests of the rows (in 256 groups), as a bundle's manifest carries it."""
        rows = self.rows().select(F.sha2(F.to_json(F.struct("id", "vector", "metadata")), 256).alias("d"))
        parts = rows.groupBy(F.substring("d", 1, 2).alias("g")).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("d", 3, 12), 16, 10).cast("decimal(38,0)")).alias("s"))
        return hashlib.sha256(json.dumps([[r.g, r.n, str(r.s)] for r in parts.orderBy("g").collect()]).encode()).hexdigest()


#: Names of the types of metadata fields, and how they begin as JSON text.
FIELD_TYPES = {"string": r'^"', "number": r"^-?\d", "integer": r"^-?\d+$", "boolean": "^(true|false)$", "array": r"^\[", "object": r"^\{", "null": "^null$"}


def violations(rows: DataFrame, schema: dict[str, dict], id: str = "id", metadata: str = "metadata") -> DataFrame:
    """id, field, error of the fields that break a schema {field: {"type": ..., "required": bool}}.

    A missing field breaks it only if it is required; metadata that is no JSON object has no fields."""
    parsed = F.try_parse_json(metadata)
    checks = []
    for field, rule in schema.items():
        value = F.try_variant_get(parsed, f"$.{field}", "variant").cast("string")
        text = F.to_json(F.try_variant_get(parsed, f"$.{field}", "variant"))
        wrong = F.when(text.isNull(), F.lit("is missing") if rule.get("required") else F.lit(None).cast("string"))
        wrong = wrong.when(~F.rlike(text, F.lit(FIELD_TYPES[rule.get("type", "null")])) if "type" in rule else F.lit(False), F.lit(f"is no {rule.get('type')}"))
        if "values" in rule:
            wrong = wrong.when(~value.isin([str(v) for v in rule["values"]]), F.lit("is none of the values"))
        checks.append(F.struct(F.lit(field).alias("field"), wrong.alias("error")))
    return rows.select(id, F.explode(F.array(*checks)).alias("c")).where("c.error is not null").select(id, "c.field", F.concat("c.field", F.lit(" "), "c.error").alias("error"))
