"""Sinks: batches that come twice or late, rows beyond a buffer, days that go, and what a log of inserts and updates stands for."""

import random
from functools import partial

from pyspark.sql import functions as F

from oddsloom.sources import feeds
from oddsloom.streaming import sinks

DAY = 86_400_000
SCHEMA = "at long, n long"


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_a_repeated_batch_changes_nothing_and_days_are_pruned(spark, tmp_path):
    path = str(tmp_path / "changes")
    rows = [(d * DAY + n, n) for d in range(4) for n in range(5)] + [(None, 99)]
    df = spark.createDataFrame(rows, SCHEMA)
    for batch in (0, 1, 0, 1, 1):
        sinks.append(df.where(f"n % 2 = {batch}"), batch, path, "at")
    assert rows_of(sinks.days(spark, path, df.schema), "at", "n") == sorted(rows, key=repr)
    one = sinks.days(spark, path, df.schema, "1970-01-02", "1970-01-02")
    filters = one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert rows_of(one, "n") == [(n,) for n in range(5)] and "day" in filters and "1970-01-02" in filters
    assert sinks.drop_old(spark, path, "1970-01-04", 1) == ["1970-01-01", "1970-01-02"] and sinks.drop_old(spark, path, "1970-01-04", 1) == []
    assert rows_of(sinks.days(spark, path, df.schema), "at", "n") == sorted(rows[10:], key=repr)
    assert sinks.drop_old(spark, str(tmp_path / "none"), "1970-01-04") == []


def test_stream_into_days(spark, tmp_path):
    df = spark.createDataFrame([(d * DAY, n) for d in range(2) for n in range(20)], SCHEMA)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    path, seen = str(tmp_path / "out"), []

    def twice(batch_rows, batch):
        seen.append(batch)
        for _ in range(2):
            sinks.append(batch_rows, batch, path, "at")

    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    source.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) > 1 and rows_of(sinks.days(spark, path, df.schema), "at", "n") == rows_of(df, "at", "n")


def test_rows_beyond_the_buffer_are_counted(spark):
    df = spark.createDataFrame([(t * 1_000, t) for t in range(200)], SCHEMA)
    for most, kept in ((150, 150), (200, 200), (500, 200), (0, 0)):
        rows, dropped = sinks.bounded(df, "at", ["n"], most, width=7_000)
        assert rows_of(rows, "n") == sorted(((n,) for n in range(kept)), key=repr) and rows_of(dropped, "dropped") == [(200 - kept,)]
    assert rows_of(sinks.bounded(df.limit(0), "at", ["n"])[1], "dropped") == [(0,)]


def by_hand(written):
    table = {}
    for r in sorted((r for r in written if r["kind"] == "insert"), key=lambda r: (r["batch"], r["at"], r["a"])):
        table.setdefault(r["k"], [r["a"], r["b"]])
    for r in sorted((r for r in written if r["kind"] == "update"), key=lambda r: (r["batch"], r["at"], r["b"] or 0)):
        if r["k"] in table and r["b"] is not None:
            table[r["k"]][1] = r["b"]
    return sorted(((k, *v) for k, v in table.items()), key=repr)


def test_inserts_before_updates(spark, tmp_path):
    draw = random.Random(5)
    rows = [{"k": draw.choice([None, *range(30)]), "kind": draw.choice(["insert", "update", "update"]), "at": draw.randrange(8), "a": draw.randrange(9), "b": draw.choice([None, draw.randrange(9)]), "batch": draw.randrange(4)} for _ in range(160)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "k long, kind string, at long, a long, b long, n long")
    path = str(tmp_path / "log")
    for batch in (2, 0, 3, 2, 1):
        sinks.log(df.where(f"n = {batch}"), batch, path)
    inserts = {}
    for r in rows:  # inserts of equal place and value a are told apart by b, null first
        if r["kind"] == "insert":
            inserts.setdefault((r["k"], r["batch"], r["at"], r["a"]), []).append(r["b"])
    plain = [{**r, "b": min(inserts[r["k"], r["batch"], r["at"], r["a"]], key=lambda b: (b is not None, b)) if r["kind"] == "insert" else r["b"]} for r in rows]
    got = sinks.current(sinks.logged(spark, path, df.schema), ["k"], "at", ["a", "b"], ["b"])
    assert rows_of(got, "k", "a", "b") == by_hand(plain)
    assert sinks.current(sinks.logged(spark, path, df.schema).limit(0), ["k"], "at", ["a", "b"], ["b"]).count() == 0


def test_one_broken_response_in_ten_minutes(spark):
    rows = [("x", 0, "a", False), ("x", 599_999, "b", False), ("x", 600_000, "c", True), ("x", 600_001, "e", False), ("x", 600_001, "d", False), ("y", 5, "f", False)]
    judged = spark.createDataFrame(rows, "bk string, at long, text string, ok boolean")
    assert rows_of(sinks.broken(judged, ["bk"], "at", ["text"]), "bk", "text") == [("x", "a"), ("x", "d"), ("y", "f")]
    assert rows_of(sinks.broken(judged, ["bk"], "at", ["text"], 1), "text") == [("a",), ("b",), ("d",), ("f",)]


def test_rows_of_one_time_have_an_order(spark):
    rows = [("k", 5, "b", True), ("k", 5, "c", True), ("k", 5, "a", True), ("k", 9, "z", False), ("l", 1, None, True)]
    for _ in range(3):
        random.shuffle(rows)
        messages = spark.createDataFrame(rows, "k string, at long, v string, healthy boolean")
        assert rows_of(feeds.freshest(messages, ["k"], "at"), "k", "at", "v") == [("k", 5, "c"), ("l", 1, None)]
        plain = messages.where("healthy").drop("healthy")
        assert rows_of(feeds.upsert(plain.limit(0), plain, ["k"], "at"), "k", "v") == [("k", "c"), ("l", None)]
        journal = plain.withColumn("removed", F.col("k") == "l")
        assert rows_of(feeds.replay_journal(plain.limit(0), journal, ["k"]), "k", "v") == [("k", "c")]


def test_a_log_is_shuffled_before_it_is_aggregated(spark, capsys):
    df = spark.createDataFrame([(1, "insert", 1, 5, 7, 0)], "k long, kind string, at long, a long, b long, batch long")
    sinks.current(df, ["k"], "at", ["a", "b"], ["b"]).explain()
    plan = capsys.readouterr().out
    assert plan.count("Aggregate(") > 0 and plan.rindex("Aggregate(") < plan.index("Exchange ")  # plans are printed from the last step up
