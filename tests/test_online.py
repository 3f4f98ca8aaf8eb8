from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators import online as on
from riskloom.operators.windows import select_trailing_window, windowed_features
from riskloom.streaming.online import flag_table, put_hashes, user_feature_table

NOON = datetime(2024, 1, 1, 12)
TXN = "user_id string, amount double, event_time timestamp"


def ts(text):
    return F.lit(text).cast("timestamp")


def touched(spark, seen, new):
    """What an update-mode batch emits: complete aggregates of the windows ``new`` falls into."""
    all_windows = windowed_features(spark.createDataFrame(seen + new, TXN), cents=True)
    hit = windowed_features(spark.createDataFrame(new, TXN), cents=True)
    return all_windows.join(hit.select("user_id", "window_start"), ["user_id", "window_start"], "left_semi")


def micro_batches(seed, n_batches=8):
    rng = random.Random(seed)
    batches = []
    for b in range(n_batches):
        rows = []
        for _ in range(30):
            late = 4 if rng.random() < 0.2 else 0
            at = NOON + timedelta(minutes=2 * b - late, seconds=rng.randrange(120))
            user = "user_0000" if rng.random() < 0.4 else f"user_000{rng.randrange(1, 8)}"
            rows.append((user, rng.randrange(1, 10000) / 100, at))
        batches.append(rows)
    return batches


def shown(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", range(2))
def test_merge_after_late_events_equals_the_batch(spark, tmp_path, seed):
    table = user_feature_table(str(tmp_path / "t"))
    batches, seen = micro_batches(seed), []
    for i, new in enumerate(batches):
        table.write_batch(touched(spark, seen, new), i)
        seen += new
        if i == 4:
            table.compact(spark, i)
    whole = select_trailing_window(windowed_features(spark.createDataFrame(seen, TXN), cents=True))
    assert shown(table.merged(spark).select(whole.columns)) == shown(whole)
    # A replay of the last batch changes nothing.
    table.write_batch(touched(spark, seen[: -len(batches[-1])], batches[-1]), len(batches) - 1)
    assert shown(table.merged(spark).select(whole.columns)) == shown(whole)


def test_a_late_event_leaves_no_older_or_stale_window(spark, tmp_path):
    table = user_feature_table(str(tmp_path / "t"))
    first = [("user_0001", 1.0, NOON + timedelta(minutes=16))]
    late_inside = [("user_0001", 2.0, NOON + timedelta(minutes=14))]
    table.write_batch(touched(spark, [], first), 0)
    table.write_batch(touched(spark, first, late_inside), 1)
    row = table.merged(spark).selectExpr("*", "date_format(window_start, 'HH:mm') s").first()
    assert (row.s, row.txn_count_5min, row.total_amount_5min) == ("12:12", 2, 3.0)


def test_rows_expire(spark, tmp_path):
    table = user_feature_table(str(tmp_path / "t"))
    rows = [("user_0001", 1.0, NOON)]
    table.write_batch(touched(spark, [], rows), 0, ts("2024-01-01 12:00:00"))
    assert table.read(spark, ts("2024-01-01 12:04:59.999")).count() == 1
    assert table.read(spark, ts("2024-01-01 12:05:00")).count() == 0
    assert table.read(spark).count() == 0
    assert table.get(spark, "user_0001", ts("2024-01-01 12:01:00")).count() == 1
    assert table.get(spark, "user_0002", ts("2024-01-01 12:01:00")).count() == 0


def test_empty_table(spark, tmp_path):
    assert user_feature_table(str(tmp_path / "none")).read(spark).count() == 0


def test_flags_newest_batch_wins_and_expire_after_an_hour(spark, tmp_path):
    table = flag_table(str(tmp_path / "f"))
    schema = "transaction_id string, user_id string, amount double, is_foreign int, is_high_amount int, is_suspicious int"
    table.write_batch(spark.createDataFrame([("a", "u", 1.0, 0, 0, 0), ("b", "u", 2.0, 1, 0, 0)], schema), 0, ts("2024-01-01 12:00:00"))
    table.write_batch(spark.createDataFrame([("a", "u", 9.0, 0, 0, 0)], schema), 1, ts("2024-01-01 12:30:00"))
    assert {r.transaction_id: r.amount for r in table.read(spark, ts("2024-01-01 12:59:00")).collect()} == {"a": 9.0, "b": 2.0}
    assert [r.transaction_id for r in table.read(spark, ts("2024-01-01 13:00:00")).collect()] == ["a"]
    table.compact(spark, 1, ts("2024-01-01 13:00:00"))
    table.write_batch(spark.createDataFrame([("c", "u", 3.0, 0, 0, 0)], schema), 2, ts("2024-01-01 13:10:00"))
    assert {r.transaction_id for r in table.read(spark, ts("2024-01-01 13:20:00")).collect()} == {"a", "c"}


def test_an_unfinished_base_is_ignored(spark, tmp_path):
    table = flag_table(str(tmp_path / "f"))
    schema = "transaction_id string, user_id string, amount double, is_foreign int, is_high_amount int, is_suspicious int"
    table.write_batch(spark.createDataFrame([("a", "u", 1.0, 0, 0, 0)], schema), 0)
    (tmp_path / "f" / "base" / "batch_id=7").mkdir(parents=True)
    assert table.read(spark).count() == 1


def test_vacuum_keeps_what_readers_need(spark, tmp_path):
    table = user_feature_table(str(tmp_path / "t"))
    batches, seen = micro_batches(5), []
    for i, new in enumerate(batches):
        table.write_batch(touched(spark, seen, new), i)
        seen += new
        if i in (1, 3, 5):
            table.compact(spark, i)
            table.vacuum(spark)
    kept = {part: sorted(p.name for p in (tmp_path / "t" / part).glob("batch_id=*")) for part in ("base", "deltas")}
    assert kept == {"base": ["batch_id=3", "batch_id=5"],
                    "deltas": ["batch_id=4", "batch_id=5", "batch_id=6", "batch_id=7"]}
    whole = select_trailing_window(windowed_features(spark.createDataFrame(seen, TXN), cents=True))
    assert shown(table.merged(spark).select(whole.columns)) == shown(whole)


def test_hashes(spark):
    rows = spark.createDataFrame(
        [("user_0042", 3, 123.456789, 41.1523, 99.999, NOON, NOON, NOON),
         ("user_0043", 1, 12345678.9, 12345678.0, 0.5, NOON, NOON, NOON)],
        "user_id string, txn_count_5min long, total_amount_5min double, avg_amount_5min double, "
        "max_amount_5min double, window_start timestamp, window_end timestamp, updated_at timestamp")
    got = {r.key: r for r in on.user_hashes(rows).collect()}
    fields = got["user_features:user_0042"].fields
    assert (fields["txn_count_5min"], fields["total_amount_5min"], fields["avg_amount_5min"],
            fields["max_amount_5min"]) == ("3", "123.46", "41.15", "100.0")
    assert set(fields) == {"user_id", "txn_count_5min", "total_amount_5min", "avg_amount_5min",
                           "max_amount_5min", "window_start", "window_end", "updated_at"}
    assert got["user_features:user_0042"].ttl == 300
    assert got["user_features:user_0043"].fields["total_amount_5min"] == "12345678.9"
    back = {r.user_id: r for r in on.from_hashes(on.user_hashes(rows)).collect()}
    assert back["user_0042"].total_amount_5min == 123.46 and back["user_0043"].avg_amount_5min == 12345678.0


def test_external_store_is_written_from_the_tasks(spark, tmp_path):
    class FolderStore:
        def __init__(self, path):
            self.path = path

        def put(self, key, fields, ttl):
            (self.path / key.replace(":", "_")).write_text(json.dumps({"fields": fields, "ttl": ttl}))

        def close(self):
            pass

    rows = spark.range(20).selectExpr(
        "concat('t', id) transaction_id", "'user_0001' user_id", "1500.0D amount", "true is_foreign",
        "true is_high_amount", "false is_suspicious", "timestamp'2024-01-01 12:00:00' updated_at").repartition(4)
    put_hashes(on.flag_hashes(rows), lambda: FolderStore(tmp_path))
    files = list(tmp_path.iterdir())
    assert len(files) == 20
    got = json.loads((tmp_path / "txn_flags_t3").read_text())
    assert got["ttl"] == 3600 and got["fields"]["amount"] == "1500.0"
    assert got["fields"]["scored_at"] == "2024-01-01T12:00:00.000000+00:00"


def test_materialise_newest_closed_window(spark):
    txns = spark.createDataFrame([("a", 1.0, NOON), ("a", 2.0, NOON + timedelta(minutes=3)), ("b", 5.0, NOON)], TXN)
    got = on.materialize(windowed_features(txns), ts("2024-01-01 12:01:00"), ts("2024-01-01 12:05:00"))
    assert {r.user_id: r.total_amount_5min for r in got.collect()} == {"a": 3.0, "b": 5.0}
