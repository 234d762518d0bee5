"""Queries of filters, grouped analytics, text search, versions and streams, and their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.filters import Json, Typed, compile_filter, filter_of_words
from spindrift.operators import aggregates, fusion, text, versions
from spindrift.runtime import shared_dir, table
from spindrift.sources import collections
from spindrift.streaming import changes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def r6(name: str):
    return F.round(name, 6).alias(name)


# ---- filters: over JSON text (events.props = {"k": n}), delta_ops.metadata, and typed columns -------------------------------

_K = "(json_extract(props, '$.k'))::DOUBLE"


def _json(name: str, spec: dict, sql: str) -> None:
    @query(name, f"SELECT event_id FROM events WHERE {sql}")
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return table(spark, directory, "events").where(compile_filter(spec, Json("props"))).select("event_id")


_json("filter_eq_ne", {"k": {"$ne": 3}, "$not": {"k": 5}}, f"coalesce({_K} <> 3, false) AND NOT coalesce({_K} = 5, false)")
_json("filter_range", {"k": {"$gte": 10, "$lt": 40}}, f"coalesce({_K} >= 10 AND {_K} < 40, false)")
_json("filter_in_nin", {"$or": [{"k": {"$in": [1, 2, 3]}}, {"k": {"$nin": list(range(90))}}]}, f"coalesce({_K} IN (1, 2, 3), false) OR coalesce({_K} NOT IN ({', '.join(map(str, range(90)))}), false)")
_json("filter_between", {"k": {"$between": [20, 30]}}, f"coalesce({_K} BETWEEN 20 AND 30, false)")
_json("filter_exists", {"$and": [{"k": {"$exists": True}}, {"missing": {"$exists": False}}]}, "json_exists(props, '$.k') AND NOT json_exists(props, '$.missing')")
_json("filter_type", {"k": {"$type": "number"}}, "json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')")
_json("filter_not_missing", {"$not": {"missing": {"$gt": 1}}}, "true")

_META = "json_valid(metadata) AND "


def _meta(name: str, spec: dict, sql: str) -> None:
    @query(name, f"SELECT delivery_id FROM (SELECT delivery_id, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM delta_ops) WHERE coalesce({sql}, false)")
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return table(spark, directory, "delta_ops").where(compile_filter(spec, Json("metadata"))).select("delivery_id")


_meta("filter_json_path", {"lang": "de", "price": {"$gt": 100}}, "m->>'$.lang' = 'de' AND json_type(m, '$.lang') = 'VARCHAR' AND (m->>'$.price')::DOUBLE > 100")
_meta("filter_array_contains", {"tags": {"$contains": "fjord"}}, "list_contains((m->'$.tags')::VARCHAR[], 'fjord')")
_meta("filter_all", {"tags": {"$all": ["fjord", "lumen"]}}, "list_contains((m->'$.tags')::VARCHAR[], 'fjord') AND list_contains((m->'$.tags')::VARCHAR[], 'lumen')")
_meta("filter_size", {"tags": {"$size": 2}}, "json_array_length(m, '$.tags') = 2 AND json_type(m, '$.tags') = 'ARRAY'")
_meta("filter_elem_match", {"tags": {"$elemMatch": {"$startsWith": "l"}}}, "len(list_filter((m->'$.tags')::VARCHAR[], lambda x: starts_with(x, 'l'))) > 0")


def _typed(name: str, source: str, key: str, spec: dict, sql: str) -> None:
    @query(name, f"SELECT {key} FROM {source} WHERE {sql}")
    def run(spark: SparkSession, directory: str) -> DataFrame:
        rows = table(spark, directory, source)
        return rows.where(compile_filter(spec, Typed(dict(rows.dtypes)))).select(key)


_typed("filter_contains", "part", "p_partkey", {"p_name": {"$contains": "e"}, "p_size": {"$lte": 25}}, "contains(p_name, 'e') AND p_size <= 25")
_typed("filter_prefix_suffix", "part", "p_partkey", {"$or": [{"p_type": {"$startsWith": "S"}}, {"p_brand": {"$endsWith": "3"}}]}, "starts_with(p_type, 'S') OR ends_with(p_brand, '3')")
_typed("filter_regex", "orders", "o_orderkey", {"o_orderpriority": {"$regex": ".*URGENT"}}, "regexp_full_match(o_orderpriority, '.*URGENT')")
_typed("filter_null", "documents", "doc_id", {"$or": [{"source": {"$exists": False}}, {"title": None}]}, "source IS NULL OR title IS NULL")


@query("filter_words", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def filter_words(spark, directory):
    rows = table(spark, directory, "orders")
    spec = filter_of_words("o_totalprice over 200000 and o_orderstatus is F", {"o_totalprice": "number", "o_orderstatus": "string"})
    return rows.where(compile_filter(spec, Typed(dict(rows.dtypes)))).select("o_orderkey")


# ---- grouped analytics -------------------------------------------------------------------------------------------------


@query("agg_group_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price, max(l_discount) AS most FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 HAVING count(*) > 100")
def agg_group_having(spark, directory):
    rows = aggregates.analytics(
        table(spark, directory, "lineitem"), ["l_returnflag", "l_linestatus"],
        {"n": ("count", "*"), "quantity": ("sum", "l_quantity"), "price": ("avg", "l_extendedprice"), "most": ("max", "l_discount")},
        where=F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"), having=F.col("n") > 100,
    )
    return rows.select("l_returnflag", "l_linestatus", "n", F.round("quantity", 2).alias("quantity"), F.round("price", 4).alias("price"), "most")


@query("agg_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, min(value) AS low FROM events GROUP BY 1")
def agg_count_distinct(spark, directory):
    return aggregates.analytics(table(spark, directory, "events"), ["event_type"], {"users": ("count_distinct", "user_id"), "n": ("count", "*"), "low": ("min", "value")})


@query("agg_empty", "SELECT count(*) AS n, coalesce(sum(value), 0.0) AS total, avg(value) AS mean FROM events WHERE event_type = 'none'")
def agg_empty(spark, directory):
    return aggregates.analytics(table(spark, directory, "events"), [], {"n": ("count", "*"), "total": ("sum", "value"), "mean": ("avg", "value")}, where=F.col("event_type") == "none")


@query("agg_top_groups", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1 ORDER BY balance DESC, 1 LIMIT 3")
def agg_top_groups(spark, directory):
    rows = aggregates.analytics(table(spark, directory, "customer"), ["c_mktsegment"], {"n": ("count", "*"), "balance": ("sum", "c_acctbal")})
    return rows.withColumn("balance", F.round("balance", 2)).orderBy(F.desc("balance"), "c_mktsegment").limit(3)


@query("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, directory):
    return table(spark, directory, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("agg_join", "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def agg_join(spark, directory):
    t = lambda n: table(spark, directory, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("field_statistics", " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM documents" for c in ("lang", "source", "title")))
def field_statistics(spark, directory):
    return aggregates.field_statistics(table(spark, directory, "documents"), ["lang", "source", "title"])


@query("events_time_bucket", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_time_bucket(spark, directory):
    return table(spark, directory, "events").groupBy(F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "events_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def events_session(spark, directory):
    rows = table(spark, directory, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = rows.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("latency_report", "SELECT collection, count(*) AS n, max(latency_ms) AS worst, sum((latency_ms > 100)::INT)::BIGINT AS slow FROM recorded_queries WHERE isfinite(latency_ms) AND latency_ms >= 0 GROUP BY 1")
def latency_report(spark, directory):
    x = F.col("latency_ms")
    rows = table(spark, directory, "recorded_queries").where((x >= 0) & (x < float("inf")) & ~F.isnan(x))
    return rows.groupBy("collection").agg(F.count("*").alias("n"), F.max(x).alias("worst"), F.sum((x > 100).cast("int")).alias("slow"))


# ---- text ------------------------------------------------------------------------------------------------------------------

_TERMS = ["recall", "snapshot", "writer"]
#: The forms of the terms that share their stem.
_FORMS = {t: ", ".join(f"'{t}{e}'" for e in ("", "s", "ed", "ing", "ted", "ting")) for t in _TERMS}
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_WORDS = f"d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda t: strlen(t) > 1 AND t NOT IN ({_STOP})) AS w FROM documents)"
_BM25 = f"""{_WORDS}, c AS (SELECT doc_id, len(w) AS l, {', '.join(f"len(list_filter(w, lambda t: t IN ({_FORMS[t]})))::DOUBLE AS t{i}" for i, t in enumerate(_TERMS))} FROM d),
s AS (SELECT count(*) AS n, avg(l) AS m, {', '.join(f'sum((t{i} > 0)::INT) AS d{i}' for i in range(3))} FROM c),
b AS (SELECT doc_id, {' + '.join(f'ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) * t{i} * 2.5 / (t{i} + 1.5 * (0.25 + 0.75 * l / m))' for i in range(3))} AS score FROM c, s)"""


@query("bm25_topk", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM b WHERE score > 0 ORDER BY b.score DESC, doc_id LIMIT 20")
def bm25_topk(spark, directory):
    found = text.bm25(table(spark, directory, "documents"), _TERMS)
    return found.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", r6("score"))


@query("bm25_all", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM b WHERE score > 0")
def bm25_all(spark, directory):
    return text.bm25(table(spark, directory, "documents"), _TERMS).select("doc_id", r6("score"))


_OVERLAP = f"""{_WORDS}, u AS (SELECT doc_id, list_distinct(w) AS u FROM d), s2 AS (SELECT count(*) AS n, {', '.join(f"sum(list_contains(u, '{t}')::INT) AS d{i}" for i, t in enumerate(_TERMS))} FROM u),
o AS (SELECT doc_id, ({' + '.join(f"CASE WHEN list_contains(u, '{t}') THEN ln((n + 1) / (d{i} + 1)) + 1 ELSE 0 END" for i, t in enumerate(_TERMS))}) / (sqrt(len(u)) * 3) AS score FROM u, s2 WHERE len(u) > 0)"""


@query("term_overlap_rerank", f"WITH {_OVERLAP} SELECT doc_id, round(score, 6) AS score FROM o WHERE score > 0")
def term_overlap_rerank(spark, directory):
    return text.term_overlap(table(spark, directory, "documents"), _TERMS, stem=False).select("doc_id", r6("score"))


@query(
    "rrf_hybrid",
    f"""WITH {_BM25}, t AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS tr FROM b WHERE score > 0 QUALIFY tr <= 30),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(list_cosine_distance(embedding::DOUBLE[], q.v), 9), vec_id) AS vr FROM embeddings, q QUALIFY vr <= 30)
SELECT coalesce(v.id, t.id) AS id, round(coalesce(0.5 / (60 + vr), 0) + coalesce(0.5 / (60 + tr), 0), 6) AS score FROM v FULL JOIN t ON v.id = t.id""",
)
def rrf_hybrid(spark, directory):
    from spindrift.operators.search import top_k
    from spindrift.plans.vector_queries import vector_of, vectors

    near = top_k(vectors(spark, directory), vector_of(spark, directory), 30).select(F.col("vec_id").alias("id"), F.round("distance", 9).alias("distance"))
    hits = text.bm25(table(spark, directory, "documents"), _TERMS).select(F.col("doc_id").alias("id"), F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(30)
    return fusion.hybrid(near, hits).select("id", r6("score"))


@query("postings", f"WITH {_WORDS} SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2")
def postings(spark, directory):
    return text.inverted(table(spark, directory, "documents"), stem=False)


@query(
    "chunk_fixed",
    """SELECT doc_id, ((s // 160))::INT AS chunk, trim(substring(text, s + 1, 200), ' ') AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 160)) AS s FROM documents WHERE length(text) > 0) WHERE length(trim(substring(text, s + 1, 200), ' ')) > 0""",
)
def chunk_fixed(spark, directory):
    return text.fixed_chunks(table(spark, directory, "documents"), 200, 40)


for _s in ("sentence", "recursive", "paragraph", "window"):
    QUERIES[f"chunk_{_s}"] = lambda spark, directory, s=_s: text.chunks(table(spark, directory, "documents"), s, 60 if s == "window" else 300, 10 if s == "window" else 30)


@query("dedup_exact", "SELECT doc_id, coalesce(CASE WHEN text IS NULL THEN doc_id END, min(doc_id) OVER (PARTITION BY text)) AS canonical, CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS n_copies FROM documents")
def dedup_exact(spark, directory):
    return text.exact_duplicates(table(spark, directory, "documents"))


@query("dedup_latest", "SELECT vector_id, delivery_id FROM delta_ops WHERE vector_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vector_id ORDER BY timestamp_ms DESC, delivery_id) = 1")
def dedup_latest(spark, directory):
    rows = table(spark, directory, "delta_ops").select("vector_id", "delivery_id", "timestamp_ms").where("vector_id is not null")
    return text.resolved(rows, "vector_id", "latest", "delivery_id", at="timestamp_ms").select("vector_id", "delivery_id")


@query("entity_counts", "WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z0-9,;] ([A-Z][a-z]{2,})', 1)) AS entity FROM documents WHERE text IS NOT NULL) SELECT doc_id, entity, count(*) AS n FROM m GROUP BY 1, 2")
def entity_counts(spark, directory):
    return text.entities(table(spark, directory, "documents"))


# ---- versions: the events of a user are versions of that user's record --------------------------------------------------------


@query("version_history", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS version FROM events")
def version_history(spark, directory):
    return versions.history(table(spark, directory, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", "version")


@query("version_latest", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def version_latest(spark, directory):
    return versions.as_of(table(spark, directory, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


_STATE = "SELECT user_id, event_type, value FROM events WHERE ts <= TIMESTAMP '{}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def _state(spark, directory, until: str) -> DataFrame:
    return versions.as_of(table(spark, directory, "events"), "user_id", ["ts", "event_id"], F.col("ts") <= F.lit(until).cast("timestamp_ntz"))


@query(
    "version_diff",
    f"""WITH b AS ({_STATE.format('2024-01-10')}), a AS ({_STATE.format('2024-01-20')}) SELECT coalesce(a.user_id, b.user_id) AS user_id,
CASE WHEN b.user_id IS NULL THEN 'added' WHEN a.user_id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL OR (a.event_type, a.value) IS DISTINCT FROM (b.event_type, b.value)""",
)
def version_diff(spark, directory):
    return versions.difference(_state(spark, directory, "2024-01-10"), _state(spark, directory, "2024-01-20"), "user_id", ["event_type", "value"])


@query("version_retained", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def version_retained(spark, directory):
    return versions.retained(table(spark, directory, "events"), "user_id", ["ts", "event_id"], 3).select("event_id")


@query("ttl_sweep", "SELECT entry_id FROM cache_entries WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2025-01-20'")
def ttl_sweep(spark, directory):
    return versions.unexpired(table(spark, directory, "cache_entries"), F.lit("2025-01-20").cast("timestamp_ntz")).select("entry_id")


@query("lifecycle", "SELECT doc_id, CASE WHEN date_diff('day', added_at::DATE, DATE '2025-02-01') >= 60 THEN 'expire' WHEN date_diff('day', added_at::DATE, DATE '2025-02-01') >= 20 THEN 'archive' ELSE 'keep' END AS action FROM documents")
def lifecycle(spark, directory):
    return versions.lifecycle(table(spark, directory, "documents"), "added_at", F.lit("2025-02-01").cast("date"), 20, 60).select("doc_id", "action")


@query("crdt_merge", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'")
def crdt_merge(spark, directory):
    return versions.last_writer(table(spark, directory, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error").select("user_id", "event_id")


# ---- import and export, streams ---------------------------------------------------------------------------------------------


@query("csv_export", "SELECT vec_id::VARCHAR AS id, len(embedding) AS width, '{\"label\":' || label || '}' AS metadata FROM embeddings")
def csv_export(spark, directory):
    """The rows that a CSV export writes, their vectors read again."""
    rows = table(spark, directory, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata"))
    return collections.csv_rows(rows).select("id", F.size(F.split("vector", ";")).cast("bigint").alias("width"), "metadata")


def _scratch(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "spindrift", spark.sparkContext.applicationId, uuid.uuid4().hex)


@query("jsonl_round_trip", "SELECT vec_id::VARCHAR AS id, round(list_sum(embedding::DOUBLE[]), 4) AS total, label FROM embeddings")
def jsonl_round_trip(spark, directory):
    """Every vector written as JSON lines and read again."""
    path = _scratch(spark)
    rows = table(spark, directory, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata"))
    collections.write_jsonl(rows, path)
    good, _ = collections.read_jsonl(spark, path)
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return good.select("id", F.round(total, 4).alias("total"), F.get_json_object("metadata", "$.label").cast("int").alias("label"))


def _stream(spark: SparkSession, directory: str) -> DataFrame:
    """The events as a stream, read from their file."""
    path = f"{directory}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(os.path.dirname(path) + "/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives for what lies there now."""
    spark = stream.sparkSession
    path = _scratch(spark)
    out = path + "/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", path + "/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out + "/batch=*")


@query("stream_watermark", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_watermark(spark, directory):
    """Daily windows over the stream; the delay exceeds the data's span, so that no row is late."""
    counts = changes.windowed(_stream(spark, directory), "ts", "60 days", "1 day", ["event_type"], [F.count("*").alias("n")])
    return _drain(counts, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, directory):
    return _drain(changes.deduplicated(_stream(spark, directory), "event_id", "ts", "60 days"), "append").select("event_id")


@query("stream_apply_changes", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'")
def stream_apply_changes(spark, directory):
    """The stream applied to a table batch by batch: the last event of each user, unless it is an error."""
    path = _scratch(spark)
    sink = changes.upsert_sink(path, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("user_id").isNotNull())
    rows = _stream(spark, directory)
    rows.writeStream.option("checkpointLocation", path + "/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    states = sorted(int(f) for f in _children(spark, path + "/state"))
    return spark.read.parquet(f"{path}/state/{states[-1]}").select("user_id", "event_id")


def _children(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
