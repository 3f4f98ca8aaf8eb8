"""Nothing is lost on the way: times, amounts, windows, null keys."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators import online as on
from riskloom.operators.asof import pit_join
from riskloom.operators.monitoring import amount_histogram
from riskloom.operators.validation import clean_requests, with_errors
from riskloom.operators.velocity import flag_over_limit
from riskloom.operators.windows import select_trailing_window, trailing_features, windowed_features
from riskloom.plans import queries
from riskloom.sources import offline
from riskloom.sources.messages import file_messages, parse_transactions
from riskloom.streaming.layers import Layers, wait_for_all
from riskloom.streaming.online import user_feature_table
from riskloom.streaming.quarantine import QuarantineCounter, read_quarantine, write_quarantine

NOON = datetime(2024, 1, 1, 12)
TXN = "user_id string, amount double, event_time timestamp"


def at(minutes):
    return NOON + timedelta(minutes=minutes)


def test_the_raw_log_keeps_microseconds(spark, tmp_path):
    """An entity 120.0005 s after a window's end has no match, stored or not."""
    source = tmp_path / "in"
    source.mkdir()
    times = ["2024-01-01T12:00:30", "2024-01-01T12:06:00.000500", "2024-01-01T12:08:00.000500"]
    (source / "a.txt").write_text("\n".join(
        f'{{"transaction_id": "t{i}", "user_id": "user_0001", "amount": 5.0, "merchant_category": "travel", '
        f'"merchant_country": "US", "merchant_name": "m", "card_last4": "1", "timestamp": "{t}"}}'
        for i, t in enumerate(times)))
    layers = Layers(root=str(tmp_path / "out"), checkpoints=str(tmp_path / "c"), once=True)
    wait_for_all({"q": layers.start_bronze(parse_transactions(file_messages(spark, str(source))))})
    stored = offline.read_bronze(spark, layers.bronze)
    direct = parse_transactions(spark.read.text(str(source)))
    assert sorted(r["event_time"] for r in stored.collect()) == sorted(r["event_time"] for r in direct.collect())
    windows = windowed_features(direct.where("transaction_id = 't0'"))  # the last ends at 12:05 and 12:06
    for rows in (stored, direct):
        entities = rows.select("transaction_id", "user_id", F.col("event_time").alias("event_timestamp"))
        got = {r["transaction_id"]: r["txn_count_5min"] for r in pit_join(entities, windows).collect()}
        assert got["t1"] == 1 and got["t2"] is None


def touched(spark, rows, new):
    both = windowed_features(spark.createDataFrame(rows + new, TXN))
    hit = windowed_features(spark.createDataFrame(new, TXN)).select("user_id", "window_start")
    return both.join(hit, ["user_id", "window_start"], "left_semi")


@pytest.mark.parametrize("compact", [False, True])
def test_compaction_follows_event_time(spark, tmp_path, compact):
    """Wall-clock time runs ahead, then an event comes that is not late."""
    table = user_feature_table(str(tmp_path / "t"))
    first, late = [("user_0001", 1.0, at(16))], [("user_0001", 1.0, at(14))]
    table.write_batch(touched(spark, [], first), 0, F.lit(at(16)))
    if compact:
        table.compact(spark, 0, F.lit(at(40)))
    table.write_batch(touched(spark, first, late), 1, F.lit(at(41)))
    (row,) = table.merged(spark).collect()
    assert (row["window_start"], row["txn_count_5min"], row["total_amount_5min"]) == (at(12), 2, 2.0)


def test_compaction_drops_what_no_event_can_touch_and_no_reader_sees(spark, tmp_path):
    table = user_feature_table(str(tmp_path / "t"))
    rows = [("old", 1.0, at(0)), ("new", 1.0, at(60))]
    table.write_batch(windowed_features(spark.createDataFrame(rows, TXN)), 0, F.lit(at(60)))
    table.compact(spark, 0, F.lit(at(61)))
    assert {r["user_id"] for r in table.stored(spark).collect()} == {"old", "new"}  # not expired yet
    table.compact(spark, 1, F.lit(at(90)))
    assert {r["user_id"] for r in table.stored(spark).collect()} == {"new"}


def test_an_invalid_trailing_window_is_not_replaced(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(
        f'{{"transaction_id": "t{i}", "user_id": "user_0001", "amount": {a}, "merchant_category": "travel", '
        f'"merchant_country": "US", "merchant_name": "m", "card_last4": "1", "timestamp": "2024-01-01T12:0{m}:00"}}'
        for i, (a, m) in enumerate([(-5.0, 0), (3.0, 3)])))
    layers = Layers(root=str(tmp_path / "out"), checkpoints=str(tmp_path / "c"), once=True)
    wait_for_all({"q": layers.start_user_features(parse_transactions(file_messages(spark, str(source))))})
    table = user_feature_table(f"{layers.online}/user_features")
    assert table.stored(spark).count() == 8 and table.merged(spark).count() == 0
    assert read_quarantine(spark, layers.quarantine).count() == 1


def test_only_the_asked_users_are_merged(spark, tmp_path):
    table = user_feature_table(str(tmp_path / "t"))
    rows = [(f"user_{i:04d}", 1.0, at(0)) for i in range(50)]
    table.write_batch(windowed_features(spark.createDataFrame(rows, TXN)), 0)
    asked = spark.createDataFrame([("user_0003",), ("user_0099",)], "user_id string")
    got = table.merged(spark, asked)
    assert [r["user_id"] for r in got.collect()] == ["user_0003"]
    # The restriction comes before the first aggregation.
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("LeftSemi") > text.rindex("Aggregate [user_id")


def test_amounts_are_summed_exactly_or_visibly_not(spark):
    def windows(*amounts):
        df = spark.createDataFrame([("u", a, NOON) for a in amounts], TXN)
        a, b = select_trailing_window(windowed_features(df)).first(), trailing_features(df).first()
        assert str(a) == str(b)
        return a

    w = windows(0.004, 0.004, 1e17)
    assert (w["txn_count_5min"], w["total_amount_5min"]) == (3, float(1e17 + 0.008))
    assert windows(0.1, 0.2)["total_amount_5min"] == 0.3
    for bad in (float("nan"), 1e21, float("inf")):
        w = windows(10.0, bad)
        assert w["txn_count_5min"] == 2 and w["total_amount_5min"] is None and w["avg_amount_5min"] is None
    df = spark.createDataFrame([(a,) for a in (0.004, 0.004, 12.0)], "amount double")
    assert amount_histogram(df).first()["total"] == 12.008
    assert amount_histogram(df.unionByName(spark.createDataFrame([(1e30,)], "amount double"))).first()["total"] is None


def test_null_keys_count_as_one_key(spark):
    rows = [(1, None, NOON), (2, None, at(0.5)), (3, "u", at(0.5)), (4, None, at(3)), (5, "u", None), (6, None, None)]
    got = flag_over_limit(spark.createDataFrame(rows, "i int, user_id string, event_time timestamp"), limit=1).collect()
    assert {r["i"]: (r["n_trailing"], r["over_limit"]) for r in got} == {
        1: (1, False), 2: (2, True), 3: (1, False), 4: (1, False), 5: (0, False), 6: (0, False)}


def test_infinities_exceed_the_maximum(spark):
    inf = float("inf")
    df = spark.createDataFrame(
        [("0f1e2d3c-4b5a-6978-8796-000000000001", "user_0001", a, "travel", "US", "t") for a in (inf, -inf, float("nan"))],
        "transaction_id string, user_id string, amount double, merchant_category string, merchant_country string, timestamp string")
    assert [r["errors"] for r in with_errors(df, "transaction").collect()] == [
        ["amount exceeds maximum: Infinity"], ["amount must be positive: -Infinity"], ["amount must be positive: NaN"]]
    assert [r["errors"] for r in clean_requests(df).collect()] == [
        ["amount exceeds maximum allowed value"], ["amount must be positive"], ["amount must be a finite number"]]


def test_amounts_as_text_have_no_exponent(spark):
    values = [12345678.9, 100.0, 0.1, 0.05, 0.0, 1e16, 123456789012.25, -2.5]
    df = spark.createDataFrame([("t", "u", v, 0, 0, 0, NOON) for v in values],
                               "transaction_id string, user_id string, amount double, is_foreign int, "
                               "is_high_amount int, is_suspicious int, updated_at timestamp")
    got = [r["a"] for r in on.flag_hashes(df).select(F.col("fields")["amount"].alias("a")).collect()]
    assert got == ["12345678.9", "100.0", "0.1", "0.05", "0.0", "10000000000000000.0", "123456789012.25", "-2.5"]


@pytest.mark.parametrize("every", [0, 4])
def test_many_batches_equal_the_batch(spark, small_dir, every):
    got = queries.trailing_update_multibatch(spark, small_dir, compact_every=every)
    want = queries.trailing_direct(spark, small_dir)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_some_users_have_no_windows(spark, small_dir):
    rows = queries.entities(spark, small_dir).count()
    unknown = queries.cold_start_users(spark, small_dir).count()
    assert 0.05 * rows < unknown < 0.5 * rows


def test_rejected_rows_are_counted_also_when_nothing_can_be_written(spark, tmp_path):
    bad = spark.createDataFrame([("u", ["e"]), ("v", ["e"])], "user_id string, errors array<string>")
    counter = QuarantineCounter()
    assert write_quarantine(bad, str(tmp_path / "q"), "user_features", 0, counter=counter)
    blocked = tmp_path / "file"
    blocked.write_text("x")
    for _ in range(2):  # a replayed batch counts once
        assert not write_quarantine(bad, str(blocked / "q"), "user_features", 1, counter=counter)
    assert (counter.met("user_features"), counter.lost("user_features"), counter.met("other")) == (4, 2, 0)
