import pytest
from pyspark.sql import functions as F

from spindrift.functions.filters import FilterError, Json, Typed, compile_filter, filter_of_words, mini_regex
from spindrift.operators import text
from spindrift.sources.collections import Conflict, Database, read_jsonl
from spindrift.streaming import changes

DOCS = [(1, '{"n": 10, "s": "10", "b": true, "a": ["x", "y"], "o": {"p": [5]}, "z": null}'), (2, '{"n": 10.0}'), (3, "{}"), (4, "no json"), (5, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id bigint, m string")


@pytest.mark.parametrize(
    "spec,ids",
    [
        ({"n": 10}, [1, 2]),
        ({"n": {"$ne": 10}}, []),
        ({"$not": {"n": 10}}, [3, 4, 5]),
        ({"s": 10}, []),
        ({"s": "10"}, [1]),
        ({"b": True}, [1]),
        ({"n": {"$gt": 9, "$lte": 10}}, [1, 2]),
        ({"s": {"$gt": 1}}, []),
        ({"n": {"$in": []}}, []),
        ({"n": {"$nin": []}}, [1, 2]),
        ({"a": {"$contains": "x"}}, [1]),
        ({"s": {"$contains": "1"}}, [1]),
        ({"a": {"$all": ["x", "y"]}}, [1]),
        ({"a": {"$size": 2}}, [1]),
        ({"s": {"$size": 2}}, [1]),
        ({"a": {"$elemMatch": {"$startsWith": "y"}}}, [1]),
        ({"o.p.0": 5}, [1]),
        ({"z": {"$exists": True}}, [1]),
        ({"z": None}, [1]),
        ({"n": {"$exists": False}}, [3, 4, 5]),
        ({"n": {"$type": "number"}}, [1, 2]),
        ({"o": {"$type": "object"}}, [1]),
        ({"n": {"$between": [10, 11]}}, [1, 2]),
        ({"$or": []}, []),
        ({"$and": []}, [1, 2, 3, 4, 5]),
        ({"$or": [{"b": True}, {"n": {"$gte": 10}}], "s": {"$exists": False}}, [2]),
    ],
)
def test_filters_over_json(docs, spec, ids):
    assert sorted(r.id for r in docs.where(compile_filter(spec, Json("m"))).collect()) == ids


@pytest.mark.parametrize("spec", [{}, {"$nor": []}, {"n": {}}, {"n": {"$near": 1}}, {"n": {"$gt": "a"}}, {"$and": {}}, {"n": {"$in": list(range(1001))}}])
def test_bad_filters(spec):
    with pytest.raises(FilterError):
        compile_filter(spec, Json("m"))


def test_filters_over_columns_and_words(spark):
    rows = spark.createDataFrame([(1, "open", 5.0), (2, None, 20.0)], "id bigint, status string, price double")
    fields = Typed(dict(rows.dtypes))
    assert [r.id for r in rows.where(compile_filter({"$not": {"status": "open"}}, fields)).collect()] == [2]
    spec = filter_of_words("price between 1 and 9 and status is open", {"price": "number", "status": "string"})
    assert spec == {"$and": [{"price": {"$between": [1.0, 9.0]}}, {"status": {"$eq": "open"}}]}
    assert filter_of_words("price at most 3", {"price": "number"}) == {"price": {"$lte": 3.0}}
    with pytest.raises(FilterError):
        filter_of_words("anything", {"price": "number"})


def test_mini_regex():
    import re

    assert re.match(mini_regex("a.c"), "abc") and not re.match(mini_regex("a.c"), "abcd")
    assert re.match(mini_regex("ab.*"), "ab+x") and not re.match(mini_regex("a+"), "aa")


def test_text(spark):
    docs = spark.createDataFrame([(1, "The writer writes a snapshot"), (2, "nothing"), (3, None), (4, "")], "doc_id bigint, text string")
    assert [r.doc_id for r in text.bm25(docs, ["snapshot"]).collect()] == [1]
    assert text.bm25(docs.limit(0), ["snapshot"]).count() == 0
    assert {(r.doc_id, r.canonical) for r in text.exact_duplicates(docs.union(docs.where("doc_id = 2").withColumn("doc_id", F.lit(9)))).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (9, 2)}
    assert [r.content for r in text.fixed_chunks(docs.where("doc_id = 1"), 10, 2).collect()][0] == "The writer"
    with pytest.raises(ValueError):
        text.fixed_chunks(docs, 2, 2)


def test_chunkers():
    long = "One two. Three four five! Six?\n\nSeven " + "x" * 50
    for split in text.CHUNKERS.values():
        assert split("", 10, 2) == []
    assert all(len(c) <= 20 for c in text.split_recursively(long, 20, 5))
    assert text.split_sentences("A b. C d. E f.", 9) == ["A b. C d.", "E f."]
    assert text.split_windows("a b c d e", 3, 1) == ["a b c", "c d e"]


def test_collections(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    c = db.create("notes", 2, "l2")
    row = lambda *r: spark.createDataFrame(list(r), "id string, vector array<float>, metadata string")
    c.insert(row(("a", [1.0, 0.0], '{"k": 1}'), ("b", [0.0, 1.0], None)))
    for bad in (("a", [1.0, 1.0], None), ("c", [1.0], None), ("c", [float("nan"), 0.0], None), ("", [1.0, 1.0], None)):
        with pytest.raises(ValueError):
            c.insert(row(bad))
    c.snapshot("before")
    c.upsert(row(("b", [5.0, 5.0], '{"k": 2}'), ("c", [9.0, 9.0], None)))
    assert c.count() == 3 and c.count({"k": {"$gte": 1}}) == 2
    assert [r.id for r in c.search([5.0, 5.0], 2).collect()] == ["b", "c"]
    db.alias("n", "notes")
    assert db["n"].delete(["c", "zz"]) == 1
    c.delete_where({"k": 1})
    assert [r.id for r in c.rows().collect()] == ["b"]
    c.resize(3)
    assert list(c.get("b").first().vector) == [5.0, 5.0, 0.0]
    c.restore("before")
    assert sorted(r.id for r in c.rows().collect()) == ["a", "b"]
    assert c.digest() == c.digest()
    with pytest.raises(ValueError):
        db.drop("notes")  # an alias names it
    assert db.unalias("n") and not db.unalias("n")
    db.drop("notes")
    assert db.names() == [] and db.vacuum() > 0


def test_writers_conflict(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    c = db.create("notes", 1)
    one = lambda i: spark.createDataFrame([(i, [1.0])], "id string, vector array<float>")
    stale = db.manifest()
    c.insert(one("a"))
    with pytest.raises(Conflict):
        db._publish(stale)  # a writer that read before the insert
    for i in range(20):
        c.upsert(one(f"x{i % 3}"))
    assert len(c.config()["segments"]) <= 17 and c.count() == 4 and len(db._numbers()) <= 8
    with pytest.raises(KeyError):
        c.update(one("none"))
    c.set_schema({"k": {"type": "integer", "required": True}})
    with pytest.raises(ValueError):
        c.insert(one("b"))
    assert c.insert_unless_near(one("c").withColumn("metadata", F.lit('{"k": 1}')), 0.1, "merge").count() == 1
    assert sorted(r.metadata for r in c.rows().collect() if r.metadata) == ['{"k":1}']


def test_jsonl(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"id": "a", "vector": [1, 2], "metadata": {"k": 1}}\n\n# note\nbroken\n{"id": "b"}\n')
    good, bad = read_jsonl(spark, str(path))
    assert [r.id for r in good.collect()] == ["a"] and sorted(r.error for r in bad.collect()) == ["no JSON", "no vector"]
    with pytest.raises(ValueError):
        read_jsonl(spark, str(path), strict=True)


def test_apply_changes_and_envelopes(spark):
    table = spark.createDataFrame([(1, "old", 1), (2, "kept", 1)], "id bigint, v string, at bigint")
    batch = spark.createDataFrame([(1, "mid", 2), (1, "new", 3), (3, None, 2)], "id bigint, v string, at bigint")
    assert {(r.id, r.v) for r in changes.apply_changes(table, batch, "id", ["at"], F.col("v").isNull()).collect()} == {(1, "new"), (2, "kept")}
    rows = spark.createDataFrame([('{"payload": {"op": "u", "after": "{}", "ts_ms": 5, "source": {"table": "t"}}}',), ("broken",), (None,)], "value string")
    assert [r.operation for r in changes.from_debezium(rows).collect()] == ["update", None, None]


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and {"p4_found", "p6_found"} <= set(entry.queries())
