"""Online features out of keyed state."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskloom.operators.windows import select_trailing_window, windowed_features
from riskloom.sources import tables
from riskloom.streaming.keyed import keyed_feature_table, user_panes
from riskloom.streaming.layers import wait_for_all
from riskloom.streaming.quarantine import quarantine_counts, read_quarantine
from test_streaming import Feed, feed, layers, message, shown  # noqa: F401


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def table_of(layers):
    return keyed_feature_table(f"{layers.online}/keyed_features")


def batch(feed):
    """Each transaction once, whatever was delivered."""
    return select_trailing_window(windowed_features(feed.batch().dropDuplicates(["transaction_id"])))


@pytest.mark.parametrize("splits", [1, 5])
def test_late_and_repeated_events_after_restarts_equal_the_batch(spark, feed, layers, splits):  # noqa: F811
    rng, sent = random.Random(splits), []
    for b in range(6):
        lines = [message(100 * b + i, f"user_000{i % 3}", 4 * b + rng.uniform(-6, 4), amount=rng.randrange(1, 9999) / 100) for i in range(12)]
        feed.add(*lines, *rng.sample(sent, min(len(sent), 5)), lines[0])
        sent = lines
        if b % 2:
            wait_for_all({"q": layers.start_keyed_features(feed.stream(), splits)})
    want = batch(feed)
    assert shown(table_of(layers).merged(spark).select(want.columns)) == shown(want)


def test_one_row_for_each_part_and_batch(spark, feed, layers):  # noqa: F811
    for b in range(3):
        feed.add(*[message(100 * b + i, f"user_000{i % 2}", b + i / 50) for i in range(40)])
    wait_for_all({"q": layers.start_keyed_features(feed.stream(), 4)})
    rows = table_of(layers).stored(spark).groupBy("batch_id", "user_id", "split").count().collect()
    assert {r["count"] for r in rows} == {1} and len(rows) <= 3 * 2 * 4
    # A busy user is several parts.
    assert len({r["split"] for r in rows if r["user_id"] == "user_0000"}) == 4


def test_state_goes_when_the_watermark_has_passed(spark, feed, layers):  # noqa: F811
    feed.add(message(1), message(2, user="user_0002"))
    feed.add(message(3, user="user_0003", minute=60))
    feed.add(message(4, user="user_0003", minute=61))
    (query,) = {layers.start_keyed_features(feed.stream(), 1)}
    wait_for_all({"q": query})
    state = query.lastProgress["stateOperators"][0]["customMetrics"]
    assert state["numExpiredTimers"] >= 0
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{layers.checkpoints}/keyed_features")
    assert {r["key"]["user_id"] for r in held.select("key").collect()} == {"user_0003"}


def test_an_event_behind_the_watermark_is_left_out(spark, feed, layers):  # noqa: F811
    feed.add(message(1), message(2, minute=30))
    feed.add(message(3, minute=30.2))
    feed.add(message(4, minute=1), message(5, minute=30.4))
    wait_for_all({"q": layers.start_keyed_features(feed.stream(), 1)})
    (row,) = table_of(layers).merged(spark).collect()
    assert row["txn_count_5min"] == 3


def test_odd_rows(spark, feed, layers):  # noqa: F811
    feed.add(message(1, amount=None), message(2), message(3, minute=0.5, amount=1e30), message(4, user=None), message(5, timestamp="garbage"),
             message(6, user="user_0002", amount=None), message(7, user="user_0003", amount=0.1), message(8, user="user_0003", amount=0.2))
    wait_for_all({"q": layers.start_keyed_features(feed.stream())})
    rows = {r["user_id"]: r for r in table_of(layers).merged(spark).collect()}
    assert set(rows) == {"user_0003"}  # sums that can't be had, and a null user, are invalid
    assert (rows["user_0003"]["txn_count_5min"], rows["user_0003"]["total_amount_5min"]) == (2, 0.3)
    assert {r["kind"]: r["n"] for r in quarantine_counts(read_quarantine(spark, layers.quarantine)).collect()} == {"user_features": 3}


def test_a_merge_keeps_what_is_needed(spark, feed, layers):  # noqa: F811
    for b in range(5):
        feed.add(*[message(10 * b + i, f"user_000{i % 4}", 3 * b) for i in range(b + 1)])
    wait_for_all({"q": layers.start_keyed_features(feed.stream(), 2)})
    table, want = table_of(layers), batch(feed)
    table.compact(spark, 3)
    assert shown(table.merged(spark).select(want.columns)) == shown(want)
    assert [r["user_id"] for r in table.merged(spark, "user_0001").collect()] == ["user_0001"]
    asked = spark.createDataFrame([("user_0002",), ("nobody",)], "user_id string")
    assert [r["user_id"] for r in table.merged(spark, asked).collect()] == ["user_0002"]


def test_events_without_time_are_in_no_pane(spark, small_dir):
    stream = tables.with_time_text(tables.transactions(tables.stream_events(spark, small_dir)))
    assert user_panes(stream.withColumn("event_time", F.col("event_time"))).isStreaming


def test_panes_leave_the_state_as_they_are_held(spark, feed, layers):  # noqa: F811
    amounts = {"user_0001": [1e16, 0.1], "user_0002": [9e19, 9e19], "user_0003": [0.3], "user_0004": [1e-7, 5e18]}
    n = iter(range(1, 100))
    feed.add(*[message(next(n), user, amount=a) for user, own in amounts.items() for a in own])
    feed.add(message(next(n), "user_0001", amount=2.5))
    wait_for_all({"q": layers.start_keyed_features(feed.stream(), 1)})
    panes = {r["user_id"]: r["panes"][0] for r in table_of(layers).stored(spark).orderBy("batch_id").collect()}
    amounts["user_0001"].append(2.5)
    for user, own in amounts.items():
        total = sum(Decimal(repr(a)) for a in own)
        want = (None, 1) if user == "user_0002" else (total, 0)
        assert (panes[user]["total"], panes[user]["lost"]) == want
        assert (panes[user]["n"], panes[user]["n_amounts"], panes[user]["largest"]) == (len(own), len(own), max(own))
