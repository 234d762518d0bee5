from pyspark.sql import functions as F

from spindrift.operators import changefeed as C

OPS = "delivery_id bigint, batch_id bigint, sequence bigint, op_type string, collection string, vector_id string, timestamp_ms bigint, checksum string, source_id string"
LOGS = "batch_id bigint, source_id string"
T = 1_735_820_000_000


def ops(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], OPS)


def logs(spark, *rows):
    return spark.createDataFrame(list(rows), LOGS)


def test_copies_by_checksum_and_by_attributes(spark):
    feed = ops(spark, [
        (1, 1, 7, "Upsert", "c", "v", T, "AB"),
        (2, 2, 7, "upsert", "c", "v", T // 1000, "sha256:ab"),  # source, checksum and time in another dress
        (3, 1, 7, "UPSERT", "c", "v", T * 1000, None),  # no checksum: the attributes are equal
        (4, 1, 7, "upsert", "c", "v", T + 1, None),  # another time
        (5, 1, 7, "upsert", "c", "w", T, "cd"),  # the same sequence, used again
        (6, 3, 7, "upsert", "c", "v", T, "ab"),  # another source
        (7, 9, 7, "upsert", "c", "v", T, "ab"),  # a batch without log
        (8, 9, 7, "upsert", None, None, None, None),
        (9, 9, 7, "upsert", None, None, None, None),  # nulls equal each other
    ])
    book = logs(spark, (1, "Node-1"), (2, " node_1 "), (3, "node-2"), (1, "Node-1"))
    assert sorted(r[0] for r in C.repeated_deliveries(feed, book).collect()) == [2, 3, 9]
    assert sorted(r[0] for r in C.first_deliveries(feed, book).select("delivery_id").collect()) == [1, 4, 5, 6, 7, 8]


def test_a_missing_checksum_joins_what_it_matches(spark):
    feed = ops(spark, [(1, 1, 1, "upsert", "c", "v", T, None), (2, 1, 1, "upsert", "c", "v", T, "aa"), (3, 1, 1, "upsert", "c", "v", T, "aa")])
    assert sorted(r[0] for r in C.repeated_deliveries(feed, logs(spark, (1, "s"))).collect()) == [2, 3]


def test_a_chain_of_ties_is_one_message(spark):
    """Checksums s0, s1, ... and attributes v0, v1, ...: each v is shared by two checksums and has a delivery without checksum."""
    rows, n = [], 12
    for i in range(n):
        rows += [(len(rows) + 1, 1, 1, "upsert", "c", f"v{i}", T, f"s{i}"), (len(rows) + 2, 1, 1, "upsert", "c", f"v{i}", T, f"s{i + 1}"), (len(rows) + 3, 1, 1, "upsert", "c", f"v{i}", T, None)]
    rows.append((len(rows) + 1, 1, 1, "upsert", "c", "v0", T + 1, None))  # another time: apart
    feed = ops(spark, rows[::-1])
    assert sorted(r[0] for r in C.repeated_deliveries(feed, logs(spark, (1, "s"))).collect()) == list(range(2, 3 * n + 1))


def test_identifiers_are_aggregated_by_hash(spark, capsys):
    rows = C.deliveries(ops(spark, []), logs(spark)).groupBy(*C.IDENTITY, "checksum").agg(F.min_by("delivery_id", "delivery_id").alias("first"))
    rows.explain()
    plan = capsys.readouterr().out
    assert "HashAggregate(keys=[source" in plan and "SortAggregate(key=[source" not in plan


def test_empty_tables(spark):
    assert C.repeated_deliveries(ops(spark, []), logs(spark)).count() == 0
    assert C.current_keys(ops(spark, []), logs(spark)).count() == 0


def test_current_records(spark):
    feed = ops(spark, [
        (1, 1, 2, "upsert", "c", "late", T + 5, "a"),
        (2, 1, 1, "Upsert", "c", "late", T + 1, "b"),  # arrives later, is older
        (3, 1, 3, "upsert", "c", "gone", T, "c"),
        (4, 1, 4, "Delete", "c", "gone", T + 1, "d"),
        (5, 1, 5, "upsert", "c", "tie", T, "e"),
        (6, 1, 6, "upsert", "c", "tie", T, "f"),  # equal times: the sequence decides
        (7, 1, 7, "upsert", "d", "old", T, "g"),
        (8, 1, 8, "drop_collection", "d", "", T // 1000, "h"),  # in seconds; takes what was written up to it
        (9, 1, 9, "upsert", "d", "new", T + 1, "i"),
        (10, 1, 9, "upsert", None, "x", T, "j"),
        (11, 1, 9, "upsert", "c", None, T, "k"),
        (12, 1, 9, "noise", "c", "tie", T + 9, "l"),
        (13, 1, 6, "upsert", "c", "tie", T, "f"),
    ])
    for book in (logs(spark, (1, "s")), None):
        found = {(r.collection, r.vector_id): r.sequence for r in C.current_keys(feed, book).collect()}
        assert found == {("c", "late"): 2, ("c", "tie"): 6, ("d", "new"): 9}


def test_changes_merge_into_a_base(spark):
    base = spark.createDataFrame([("c", "kept", 1, T - 9), ("c", "gone", 2, T - 9)], "collection string, vector_id string, sequence bigint, at bigint")
    feed = ops(spark, [(1, 1, 3, "delete", "c", "gone", T, "a"), (2, 1, 4, "upsert", "c", "new", T, "b")])
    assert {r.vector_id for r in C.current_keys(feed, logs(spark, (1, "s")), base).collect()} == {"kept", "new"}


def test_units_of_time(spark):
    rows = spark.createDataFrame([(T // 1000,), (T,), (T * 1000,), (T * 1_000_000,), (None,)], "t bigint")
    assert [r[0] for r in rows.select(C.epoch_millis(F.col("t"))).collect()] == [T // 1000 * 1000, T, T, T, None]
