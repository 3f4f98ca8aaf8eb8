from __future__ import annotations

import json
import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from riskloom.functions.flags import flag_rows
from riskloom.operators.windows import select_trailing_window, windowed_features
from riskloom.schemas import TRANSACTION
from riskloom.sources import offline, tables
from riskloom.sources.messages import file_messages, kafka_messages, parse_labels, parse_transactions
from riskloom.streaming.layers import Layers, wait_for_all, wait_for_any
from riskloom.streaming.online import flag_table, user_feature_table
from riskloom.streaming.quarantine import quarantine_counts, read_quarantine, write_quarantine

NOON = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


def message(i, user="user_0001", minute=0.0, **changes):
    at = NOON + timedelta(minutes=minute)
    row = {
        "transaction_id": f"0f1e2d3c-4b5a-6978-8796-{i:012d}", "user_id": user, "amount": 100.0,
        "merchant_category": "travel", "merchant_country": "US", "merchant_name": "shop",
        "card_last4": "1234", "timestamp": at.replace(tzinfo=None).isoformat(), **changes,
    }
    return json.dumps(row)


class Feed:
    """Text files read one per micro-batch, in the order they were added."""

    def __init__(self, spark, path, parser=parse_transactions):
        self.spark, self.path, self.parser, self.n = spark, path, parser, 0
        path.mkdir(parents=True, exist_ok=True)

    def add(self, *lines):
        file = self.path / f"{self.n:05d}.txt"
        file.write_text("\n".join(lines) + "\n")
        os.utime(file, (time.time() - 10000 + self.n,) * 2)
        self.n += 1

    def stream(self):
        return self.parser(file_messages(self.spark, str(self.path), files_per_batch=1))

    def batch(self):
        return self.parser(self.spark.read.text(str(self.path)))


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path / "in")


@pytest.fixture
def layers(tmp_path):
    return Layers(root=str(tmp_path / "out"), checkpoints=str(tmp_path / "checkpoints"), once=True,
                  quarantine_fallback=str(tmp_path / "fallback"))


def shown(df):
    return sorted(map(str, df.collect()))


def test_malformed_messages_keep_their_text(spark, feed):
    feed.add(message(1), '{"transaction_id": "cut', "null", message(2, timestamp="garbage"), message(3, amount="x"))
    rows = feed.batch().collect()
    assert [r.corrupt for r in rows] == [False, True, True, False, True]
    assert rows[1].transaction_id is None and rows[1].raw == '{"transaction_id": "cut'
    assert rows[3].event_time is None and rows[3].amount == 100.0


def test_labels_are_parsed(spark, tmp_path, layers):
    feed = Feed(spark, tmp_path / "labels", parse_labels)
    feed.add('{"transaction_id":"t","user_id":"u","is_fraud":true,"label_timestamp":"2024-01-01T12:00:30"}')
    wait_for_all({"labels": layers.start_labels(feed.stream())})
    row = offline.read_labels(spark, layers.labels).selectExpr("*", "unix_seconds(label_time) s").first()
    assert row.is_fraud is True and row.s == int(NOON.timestamp()) + 30


def test_closed_windows_come_out_once_and_equal_the_batch(spark, feed, layers):
    for m in range(0, 40, 4):
        feed.add(*[message(100 * m + i, f"user_000{i % 3}", m + i) for i in range(4)])
    wait_for_all({"silver": layers.start_silver(feed.stream())})
    silver = offline.read_silver(spark, layers.silver)
    # The newest event is at 12:39, so windows up to 12:29 are closed.
    closed = windowed_features(feed.batch()).where("window_end <= timestamp'2024-01-01 12:29:00'")
    assert shown(silver.drop("event_date")) == shown(closed) and closed.count() > 50


def test_reading_one_day_of_windows_prunes_the_others(spark, feed, layers):
    feed.add(*[message(i, minute=60 * 6 * i) for i in range(9)])
    wait_for_all({"silver": layers.start_silver(feed.stream())})
    day = offline.read_silver(spark, layers.silver).where("event_date = date'2024-01-02'")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and day.count() == 20


def test_late_events(spark, feed, layers):
    feed.add(message(1, minute=0), message(2, minute=20))   # watermark 12:10 after this batch
    feed.add(message(3, minute=20.5))                       # the batch that still runs behind it
    feed.add(message(4, minute=1))                          # too late for every window it belongs to
    feed.add(message(5, minute=60))                         # closes everything before 12:50
    wait_for_all({"silver": layers.start_silver(feed.stream())})
    silver = offline.read_silver(spark, layers.silver)
    total = silver.where("window_start = timestamp'2024-01-01 12:00:00'").first()
    assert total.txn_count_5min == 1
    assert silver.where("window_start = timestamp'2024-01-01 12:20:00'").first().txn_count_5min == 2


def test_restart_continues_where_it_stopped(spark, feed, layers):
    for m in (0, 1, 2):
        feed.add(message(m, minute=m))
    wait_for_all({"silver": layers.start_silver(feed.stream())})
    assert offline.read_silver(spark, layers.silver, required=False).count() == 0
    for m in (3, 30):
        feed.add(message(m, minute=m))
    wait_for_all({"silver": layers.start_silver(feed.stream())})
    silver = offline.read_silver(spark, layers.silver)
    closed = windowed_features(feed.batch()).where("window_end <= timestamp'2024-01-01 12:20:00'")
    assert shown(silver.drop("event_date")) == shown(closed)
    wait_for_all({"silver": layers.start_silver(feed.stream())})
    assert offline.read_silver(spark, layers.silver).count() == closed.count()


def test_repeated_deliveries_count_once_when_asked(spark, feed, layers):
    feed.add(message(1), message(1), message(2))
    feed.add(message(2), message(3, minute=30))
    wait_for_all({"silver": layers.start_silver(feed.stream(), deduplicate=True)})
    counts = {r.txn_count_5min for r in offline.read_silver(spark, layers.silver).collect()}
    assert counts == {2}


def test_all_layers_from_a_dirty_feed(spark, feed, layers, tmp_path):
    label_feed = Feed(spark, tmp_path / "labels", parse_labels)
    label_feed.add('{"transaction_id":"t","user_id":"u","is_fraud":false,"label_timestamp":"x"}')
    feed.add(message(1), message(2, user="bad"), "{oops", message(3, amount=None))
    feed.add(message(4, minute=1, merchant_country="XX"), message(5, minute=2, merchant_country="NG", amount=700.0))
    queries = layers.start_all(feed.stream(), label_feed.stream())
    assert set(queries) == {"bronze", "user_features", "flags", "silver", "labels", "rejected"}
    wait_for_all(queries)

    bronze = offline.read_bronze(spark, layers.bronze)
    assert bronze.count() == 6 and bronze.where("transaction_id is null").count() == 1
    raw = spark.read.json(f"{layers.bronze}/*/part-*.json")
    assert raw.where("raw = '{oops'").count() == 1

    flags = flag_table(f"{layers.online}/transaction_flags").read(spark)
    assert {r.transaction_id[-1]: (r.is_foreign, r.is_high_amount, r.is_suspicious) for r in flags.collect()} == {
        "1": (0, 0, 0), "5": (1, 1, 1)}
    users = user_feature_table(f"{layers.online}/user_features").read(spark).collect()
    assert [(r.user_id, r.txn_count_5min, r.total_amount_5min) for r in users] == [("user_0001", 2, 800.0)]

    records = read_quarantine(spark, layers.quarantine)
    assert {r.kind: r.n for r in quarantine_counts(records).collect()} == {"transaction": 4}
    errors = {e for r in records.collect() for e in r.errors}
    assert {"Invalid user_id format: bad", "amount is required", "Invalid merchant_country: XX"} <= errors
    assert offline.read_labels(spark, layers.labels).first().label_time is None


def test_rows_that_fail_after_aggregation_are_quarantined(spark, feed, layers):
    feed.add(message(1, user="bad"), message(2, amount=-5.0, user="user_0002"), message(3))
    queries = layers.start_all(feed.stream(), feed.stream().selectExpr(
        "transaction_id", "user_id", "true is_fraud", "timestamp label_timestamp", "event_time label_time"),
        validate=False)
    assert "rejected" not in queries
    wait_for_all(queries)
    counts = {r.kind: r.n for r in quarantine_counts(read_quarantine(spark, layers.quarantine)).collect()}
    assert counts == {"user_features": 2, "transaction_flags": 2}
    users = user_feature_table(f"{layers.online}/user_features").read(spark)
    assert [r.user_id for r in users.collect()] == ["user_0001"]


def test_quarantine_uses_the_fallback_and_never_raises(spark, tmp_path):
    bad = spark.createDataFrame([("u", 1.5, ["e1", "e2"])], "user_id string, amount double, errors array<string>")
    blocked = tmp_path / "file"
    blocked.write_text("not a folder")
    fallback = str(tmp_path / "fallback")
    assert write_quarantine(bad, str(blocked / "x"), "transaction", 3, fallback)
    row = read_quarantine(spark, fallback).first()
    assert (row.kind, row.batch_id, row.errors) == ("transaction", 3, ["e1", "e2"])
    assert json.loads(row.record) == {"user_id": "u", "amount": 1.5} and row.quarantined_at
    assert write_quarantine(bad, str(blocked / "x"), "transaction", 3) is False


def test_quarantine_replay_replaces_its_batch_only(spark, tmp_path):
    path = str(tmp_path / "q")
    bad = spark.createDataFrame([("u", None, ["e"])], "user_id string, amount double, errors array<string>")
    for kind, batch_id in (("a", 0), ("a", 1), ("b", 1), ("a", 1), ("a", 0)):
        assert write_quarantine(bad, path, kind, batch_id)
    records = read_quarantine(spark, path)
    assert {(r.kind, r.batch_id) for r in records.collect()} == {("a", 0), ("a", 1), ("b", 1)}
    assert records.count() == 3 and '"amount":null' in records.first().record


def test_replayed_log_gives_the_same_features(spark, feed, layers):
    feed.add(*[message(i, f"user_000{i % 2}", i / 3) for i in range(30)])
    wait_for_all({"bronze": layers.start_bronze(feed.stream())})
    replay = offline.read_bronze(spark, layers.bronze)
    assert shown(windowed_features(replay)) == shown(windowed_features(feed.batch()))
    assert shown(flag_rows(replay)) == shown(flag_rows(feed.batch()))
    assert set(TRANSACTION.names) <= set(replay.columns)


def test_one_failing_query_stops_the_rest(spark, feed, layers):
    running = Layers(root=layers.root, checkpoints=layers.checkpoints, triggers={"bronze": 1, "silver": 1})
    feed.add(message(1))
    failing = feed.stream().withColumn("amount", F.raise_error(F.lit("boom")).cast("double"))
    queries = {"bronze": running.start_bronze(feed.stream()), "silver": running.start_silver(failing)}
    with pytest.raises(Exception, match="boom"):
        wait_for_any(spark, queries, 60)
    assert not any(q.isActive for q in queries.values())
    spark.streams.resetTerminated()


def test_kafka_source_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka_messages(spark, "raw_transactions", "localhost:9092").isStreaming


def test_stream_of_the_given_table_equals_the_batch(spark, small_dir, layers):
    stream = tables.with_time_text(tables.transactions(tables.stream_events(spark, small_dir)))
    wait_for_all({"q": layers.start_user_features(stream, cents=True)})
    batch = select_trailing_window(
        windowed_features(tables.transactions(tables.read_events(spark, small_dir)), cents=True))
    table = user_feature_table(f"{layers.online}/user_features").merged(spark)
    assert shown(table.select(batch.columns)) == shown(batch)
