"""Queries of the verbs of collections: each builds a database in the shared folder, changes it and returns what it holds, and their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.extras import hashed_embedding
from spindrift.plans.vector_queries import vector_of, vectors
from spindrift.runtime import shared_dir, table
from spindrift.sources.collections import Collection, Conflict, Database, violations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def scratch(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "spindrift", spark.sparkContext.applicationId, uuid.uuid4().hex)


def rows_of(spark: SparkSession, directory: str) -> DataFrame:
    return vectors(spark, directory).select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata"))


def collection(spark: SparkSession, directory: str) -> Collection:
    """All embeddings as a collection of a new database; the label is metadata."""
    c = Database(spark, scratch(spark)).create("vectors", 64)
    c.insert(rows_of(spark, directory))
    return c


def shown(rows: DataFrame) -> DataFrame:
    """id, total (of the vector), metadata."""
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", F.round(total, 4).alias("total"), "metadata")


def number(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} bigint" for k in values))


_V = "v AS (SELECT vec_id, vec_id::VARCHAR AS id, label, list_sum(embedding::DOUBLE[]) AS t, '{\"label\":' || label || '}' AS metadata FROM embeddings)"
_SHOW = "SELECT id, round(t, 4) AS total, metadata FROM"


@query("collection_insert", f"WITH {_V} {_SHOW} v")
def collection_insert(spark, directory):
    return shown(collection(spark, directory).rows())


@query("collection_point_get", f"WITH {_V} {_SHOW} v WHERE id = '7'")
def collection_point_get(spark, directory):
    return shown(collection(spark, directory).get("7"))


@query("collection_multi_get", "SELECT i::INT AS position, u AS id FROM (SELECT unnest(['30', '4', 'none', '12', '4']) AS u, unnest(range(5)) AS i) WHERE u <> 'none'")
def collection_multi_get(spark, directory):
    return collection(spark, directory).get_many(["30", "4", "none", "12", "4"]).select("position", "id")


@query("collection_ids_page", f"WITH {_V} SELECT id FROM v ORDER BY id LIMIT 20 OFFSET 40")
def collection_ids_page(spark, directory):
    return collection(spark, directory).ids(40, 20)


@query("collection_find", f"WITH {_V}, f AS (SELECT id FROM v WHERE label IN (1, 3)) SELECT id, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 15 AS more FROM f ORDER BY id LIMIT 10 OFFSET 5")
def collection_find(spark, directory):
    """A query by metadata alone: a page, how many rows there are in all, and whether more follow."""
    page, total, more = collection(spark, directory).find({"label": {"$in": [1, 3]}}, 5, 10)
    return page.select("id", F.lit(total).cast("bigint").alias("total"), F.lit(more).alias("more"))


@query("collection_count", "SELECT count(*) AS n, count(*) FILTER (label = 2) AS filtered FROM embeddings")
def collection_count(spark, directory):
    c = collection(spark, directory)
    return number(spark, n=c.count(), filtered=c.count({"label": 2}))


@query("collection_update", f"WITH {_V} SELECT id, round(CASE WHEN vec_id % 10 = 0 THEN 2 * t ELSE t END, 4) AS total, CASE WHEN vec_id % 10 = 0 THEN '{{\"new\":true}}' ELSE metadata END AS metadata FROM v")
def collection_update(spark, directory):
    c = collection(spark, directory)
    some = rows_of(spark, directory).where(F.col("id").cast("int") % 10 == 0)
    c.update(some.select("id", F.transform("vector", lambda x: x * 2).alias("vector"), F.lit('{"new":true}').alias("metadata")))
    return shown(c.rows())


@query("collection_update_metadata", f"WITH {_V} SELECT id, round(t, 4) AS total, CASE WHEN label = 4 THEN '{{\"kind\":\"four\"}}' ELSE metadata END AS metadata FROM v")
def collection_update_metadata(spark, directory):
    c = collection(spark, directory)
    c.update_metadata(c.rows().where(F.get_json_object("metadata", "$.label") == "4").select("id", F.lit('{"kind":"four"}').alias("metadata")))
    return shown(c.rows())


@query("collection_merge_metadata", f"WITH {_V} SELECT id, round(t, 4) AS total, CASE WHEN label = 4 THEN '{{\"label\":4,\"a\":{{\"b\":1,\"c\":3}},\"d\":null}}' WHEN label = 5 THEN '{{\"label\":5,\"a\":{{\"b\":1}}}}' ELSE metadata END AS metadata FROM v")
def collection_merge_metadata(spark, directory):
    """Two patches one after another, the second into what the first one put there."""
    c = collection(spark, directory)
    label = F.get_json_object("metadata", "$.label")
    c.merge_metadata(c.rows().where(label.isin("4", "5")).select("id", F.lit('{"a":{"b":1}}').alias("metadata")))
    c.merge_metadata(c.rows().where(label == "4").select("id", F.lit('{"a":{"c":3},"d":null}').alias("metadata")))
    return shown(c.rows())


@query("collection_upsert", f"WITH {_V} {_SHOW} v WHERE vec_id % 3 <> 0 UNION ALL SELECT id, round(3 * t, 4), '{{\"turn\":2}}' FROM v WHERE vec_id % 3 = 0 UNION ALL SELECT 'new-' || id, round(t, 4), '{{\"turn\":0}}' FROM v WHERE vec_id < 5")
def collection_upsert(spark, directory):
    """Rows that exist, rows that don't, and ids that occur twice, of which the last counts."""
    c = collection(spark, directory)
    old = rows_of(spark, directory).where(F.col("id").cast("int") % 3 == 0)
    part = lambda rows, n, times, prefix="": rows.select(F.concat(F.lit(prefix), "id").alias("id"), F.transform("vector", lambda x: x * times).alias("vector"), F.lit(f'{{"turn":{n}}}').alias("metadata"))
    fresh = rows_of(spark, directory).where(F.col("id").cast("int") < 5)
    c.upsert(part(old, 1, 2.0).unionByName(part(old, 2, 3.0)).unionByName(part(fresh, 0, 1.0, "new-")))
    return shown(c.rows())


@query("collection_delete", f"WITH {_V} {_SHOW} v WHERE id NOT IN ('1', '2', '3') AND label <> 6")
def collection_delete(spark, directory):
    c = collection(spark, directory)
    c.delete(["1", "2", "3", "none"])
    c.delete_where({"label": 6})
    return shown(c.rows())


@query("collection_clear", "SELECT count(*) AS removed, 0::BIGINT AS left FROM embeddings")
def collection_clear(spark, directory):
    c = collection(spark, directory)
    return number(spark, removed=c.clear(), left=c.count())


@query("collection_compact", "SELECT 2 * count(*) FILTER (label = 1) AS dropped, 1::BIGINT AS segments, count(*) FILTER (label <> 1) AS left FROM embeddings")
def collection_compact(spark, directory):
    c = collection(spark, directory)
    c.delete_where({"label": 1})
    dropped = c.compact()
    return number(spark, dropped=dropped, segments=len(c.config()["segments"]), left=c.count())


@query("collection_expire", "SELECT count(*) FILTER (vec_id % 2 = 0) AS expired, count(*) FILTER (vec_id % 2 = 1) AS left FROM embeddings")
def collection_expire(spark, directory):
    """Half of the rows live for an hour, the others for ever; the sweep looks two hours ahead."""
    c = Database(spark, scratch(spark)).create("vectors", 64)
    rows, even = rows_of(spark, directory), F.col("id").cast("int") % 2 == 0
    c.insert(rows.where(even), ttl=3600)
    c.insert(rows.where(~even))
    return number(spark, expired=c.expire(F.current_timestamp() + F.expr("interval 2 hours")), left=c.count())


@query("collection_resize", "SELECT vec_id::VARCHAR AS id, round(list_sum((embedding::DOUBLE[])[1:16]), 4) AS total, '{\"label\":' || label || '}' AS metadata FROM embeddings")
def collection_resize(spark, directory):
    c = collection(spark, directory)
    c.resize(16)
    return shown(c.rows())


@query("collection_catalogue", "SELECT * FROM (VALUES ('alias', 'latest', 'renamed'), ('collection', 'other', NULL), ('collection', 'renamed', NULL)) t(kind, name, target)")
def collection_catalogue(spark, directory):
    """Create, rename, drop, and aliases that are made, moved, deleted and listed; a collection with an alias can't be dropped."""
    db = Database(spark, scratch(spark))
    for name in ("one", "other", "third"):
        db.create(name, 4)
    db.alias("latest", "other")
    db.alias("latest", "one", replace=True)
    db.alias("old", "third")
    db.unalias("old")
    db.drop("third")
    db.rename("one", "renamed")
    try:
        db.drop("renamed")
    except ValueError:
        pass
    rows = [("collection", n, None) for n in db.names()] + [("alias", a, c) for a, c in db.aliases().items()]
    return spark.createDataFrame(rows, "kind string, name string, target string")


@query("collection_snapshot", "SELECT count(*) AS now, (SELECT count(*) FROM embeddings) AS before, (SELECT count(*) FROM embeddings) AS restored FROM embeddings WHERE label <> 2")
def collection_snapshot(spark, directory):
    c = collection(spark, directory)
    c.snapshot("before")
    c.delete_where({"label": 2})
    now, before = c.count(), c.rows(snapshot="before").count()
    c.restore("before")
    return number(spark, now=now, before=before, restored=c.count())


@query("collection_branch", f"WITH {_V} {_SHOW} v WHERE label <> 3 AND id <> '0' UNION ALL SELECT 'added', round(t, 4), metadata FROM v WHERE vec_id = 5")
def collection_branch(spark, directory):
    """A branch deletes and adds rows, its parent deletes another one, and the branch is merged."""
    c = collection(spark, directory)
    b = c.db.branch("trial", "vectors")
    b.delete_where({"label": 3})
    b.insert(rows_of(spark, directory).where("id = '5'").withColumn("id", F.lit("added")))
    c.delete(["0"])
    c.db.merge_branch("trial")
    return shown(c.rows())


@query("collection_transaction", f"WITH {_V} {_SHOW} v WHERE label <> 7 AND id <> '1'")
def collection_transaction(spark, directory):
    """One transaction is committed, one is rolled back by an error, and one meets a change by another writer and is refused."""
    c = collection(spark, directory)
    with c.db.transaction() as t:
        t["vectors"].delete_where({"label": 7})
    try:
        with c.db.transaction() as t:
            t["vectors"].clear()
            raise LookupError
    except LookupError:
        pass
    late = c.db.transaction()
    late["vectors"].clear()
    c.delete(["1"])
    try:
        late.commit()
        raise AssertionError("the transaction should have been refused")
    except Conflict:
        pass
    return shown(c.rows())


@query("collection_views", "SELECT 'live' AS view, count(*) FILTER (label = 2 AND vec_id > 50) AS n FROM embeddings UNION ALL SELECT 'stored', count(*) FILTER (label = 2) FROM embeddings UNION ALL SELECT 'refreshed', count(*) FILTER (label = 2 AND vec_id > 50) FROM embeddings")
def collection_views(spark, directory):
    """A view sees a deletion, a materialized one after its refresh only."""
    c = collection(spark, directory)
    text = "SELECT id FROM vectors WHERE label = 2 LIMIT 10000"
    c.db.create_view("live", text)
    c.db.create_view("stored", text, materialized=True)
    c.db.view("stored").count()
    c.delete([str(i) for i in range(51)])
    counts = {"live": c.db.view("live").count(), "stored": c.db.view("stored").count()}
    c.db.refresh("stored")
    counts["refreshed"] = c.db.view("stored").count()
    return spark.createDataFrame(list(counts.items()), "view string, n bigint")


@query("collection_schema", "SELECT vec_id::VARCHAR AS id, CASE WHEN label < 3 THEN 'label' ELSE 'name' END AS field FROM embeddings WHERE label < 3 OR label > 7")
def collection_schema(spark, directory):
    """Rows whose metadata break a schema: a label of the wrong type, a required name that is missing."""
    rows = vectors(spark, directory)
    label = F.when(F.col("label") < 3, F.to_json(F.struct(F.col("label").cast("string").alias("label"), F.lit("x").alias("name"))))
    label = label.when(F.col("label") > 7, F.to_json(F.struct("label"))).otherwise(F.to_json(F.struct("label", F.lit("x").alias("name"))))
    found = violations(rows.select(F.col("vec_id").cast("string").alias("id"), label.alias("metadata")), {"label": {"type": "integer"}, "name": {"type": "string", "required": True}})
    return found.select("id", "field")


@query("collection_json_round_trip", f"WITH {_V} SELECT 'vectors' AS collection, id, round(t, 4) AS total, metadata FROM v UNION ALL SELECT 'few', id, round(t, 4), metadata FROM v WHERE vec_id < 9")
def collection_json_round_trip(spark, directory):
    return _moved(spark, directory, "json")


@query("collection_file_round_trip", ORACLE["collection_json_round_trip"])
def collection_file_round_trip(spark, directory):
    return _moved(spark, directory, "file")


def _moved(spark: SparkSession, directory: str, how: str) -> DataFrame:
    """Two collections written and read into another database."""
    db = collection(spark, directory).db
    db.create("few", 64, "l2").insert(rows_of(spark, directory).where(F.col("id").cast("int") < 9))
    path, other = scratch(spark), Database(spark, scratch(spark))
    db.export_json(path) if how == "json" else db.save_file(path)
    other.import_json(path) if how == "json" else other.load_file(path)
    rows = [shown(other[n].rows()).select(F.lit(n).alias("collection"), "id", "total", "metadata") for n in other.names()]
    return rows[0].unionByName(rows[1])


@query("collection_bundle", f"WITH {_V} {_SHOW} v")
def collection_bundle(spark, directory):
    """A bundle imported elsewhere, after its digest was checked."""
    c = collection(spark, directory)
    path = scratch(spark)
    c.db.export_bundle("vectors", path)
    return shown(Database(spark, scratch(spark)).import_bundle(path, "copy").rows())


@query("collection_text", "SELECT doc_id::VARCHAR AS id, json_extract_string(metadata, '$.text') = text AS kept FROM (SELECT doc_id, text, json_object('text', text) AS metadata FROM documents WHERE length(text) > 0)")
def collection_text(spark, directory):
    """Documents inserted by their texts, which an embedder turns into vectors."""
    docs = table(spark, directory, "documents").where(F.length("text") > 0)
    c = Database(spark, scratch(spark)).create("notes", 32)
    c.insert_text(docs.select(F.col("doc_id").cast("string").alias("id"), "text"), lambda t: hashed_embedding(t, 32))
    kept = c.rows().join(docs.select(F.col("doc_id").cast("string").alias("id"), "text"), "id")
    return kept.select("id", (F.get_json_object("metadata", "$.text") == F.col("text")).alias("kept"))


@query("collection_hooks", f"WITH {_V} SELECT id, '{{\"label\":' || label || ',\"seen\":true}}' AS metadata FROM v WHERE label <> 0 AND id IN (SELECT id FROM v WHERE label <> 0 ORDER BY list_distance((SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3), (SELECT embedding::DOUBLE[] FROM embeddings e WHERE e.vec_id = v.vec_id)), vec_id LIMIT 8) AND vec_id % 2 = 1")
def collection_hooks(spark, directory):
    """A hook before rows are written rejects and changes some, a hook after a search filters its hits."""
    from spindrift.sources.collections import merged_json

    c = Database(spark, scratch(spark)).create("vectors", 64, "l2")
    c.before_insert.append(lambda rows: rows.where(F.get_json_object("metadata", "$.label") != "0"))
    c.before_insert.append(lambda rows: rows.withColumn("metadata", merged_json(F.col("metadata"), F.lit('{"seen":true}'))))
    c.after_search.append(lambda hits: hits.where(F.col("id").cast("int") % 2 == 1))
    c.insert(rows_of(spark, directory))
    return c.search(vector_of(spark, directory, 3), 8).select("id", "metadata")


@query("dedup_on_insert", "SELECT * FROM (VALUES ('again', '5'), ('close', '9')) t(id, existing)")
def dedup_on_insert(spark, directory):
    """Of three rows, one is a row that exists, one nearly so, one is new: the result names the first two and what they repeat."""
    c = collection(spark, directory)
    one = lambda n, id, vector: rows_of(spark, directory).where(f"id = '{n}'").select(F.lit(id).alias("id"), vector.alias("vector"), F.lit(None).cast("string").alias("metadata"))
    near = F.transform("vector", lambda x, i: x + F.when(i == 0, 0.01).otherwise(0.0))
    far = F.transform("vector", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    new = one("5", "again", F.col("vector")).unionByName(one("9", "close", near)).unionByName(one("11", "new", far))
    return c.insert_unless_near(new, 0.02, "version").select("id", "existing")


# ---- statements of the query language over a database -----------------------------------------------------------------


@query("ql_statements", "SELECT 'left' AS what, count(*)::BIGINT + 1 AS n FROM embeddings WHERE NOT (label = 3 OR vec_id IN (1, 2)) UNION ALL SELECT 'by_ids', count(*) FROM embeddings WHERE vec_id IN (1, 2) UNION ALL SELECT 'by_where', count(*) FROM embeddings WHERE label = 3 AND vec_id NOT IN (1, 2) UNION ALL SELECT 'collections', 1")
def ql_statements(spark, directory):
    db = collection(spark, directory).db
    say = lambda text, **params: db.query(text, params).first()[0]
    say("CREATE COLLECTION IF NOT EXISTS vectors DIMENSIONS 64")
    say("CREATE COLLECTION other DIMENSIONS 2 METRIC l2")
    say("INSERT INTO other VALUES ('a', $one, '{}'), ('b', $two)", one=[1.0, 0.0], two=[0.0, 1.0])
    say("INSERT INTO vectors VALUES ('x', $v)", v=vector_of(spark, directory))
    ids = say("DELETE FROM vectors IDS ('1', '2', 'none')")
    where = say("DELETE FROM vectors WHERE label = 3")
    say("DROP COLLECTION other")
    rows = {"by_ids": ids, "by_where": where, "collections": db.query("SHOW COLLECTIONS").count(), "left": db["vectors"].count()}
    return spark.createDataFrame(list(rows.items()), "what string, n bigint")


@query("ql_as_of", "SELECT 'snapshot' AS at, id FROM (SELECT vec_id::VARCHAR AS id FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) ORDER BY list_distance(embedding::DOUBLE[], q), vec_id LIMIT 6) UNION ALL SELECT 'now', id FROM (SELECT vec_id::VARCHAR AS id FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) WHERE label <> 1 ORDER BY list_distance(embedding::DOUBLE[], q), vec_id LIMIT 6) UNION ALL SELECT 'version', id FROM (SELECT vec_id::VARCHAR AS id FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) ORDER BY list_distance(embedding::DOUBLE[], q), vec_id LIMIT 6)")
def ql_as_of(spark, directory):
    """A search over a snapshot, over the first change, and over what is left after a deletion."""
    c = collection(spark, directory)
    c.snapshot("nightly")
    c.delete_where({"label": 1})
    q = {"q": vector_of(spark, directory)}
    one = lambda name, clause: c.db.query(f"SELECT id FROM vectors {clause} NEAREST_TO($q, metric = l2) LIMIT 6", q).select(F.lit(name).alias("at"), "id")
    return one("snapshot", "AS OF SNAPSHOT nightly").unionByName(one("now", "")).unionByName(one("version", "AS OF VERSION 1"))
