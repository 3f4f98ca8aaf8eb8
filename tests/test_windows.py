from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from riskloom.operators.windows import (
    latest_window, select_trailing_window, trailing_features, windowed_features,
)

NOON = datetime(2024, 1, 1, 12)
SCHEMA = "user_id string, amount double, event_time timestamp"


def minutely(n, user="user_1"):
    return [(user, 100.0, NOON + timedelta(minutes=i, seconds=30)) for i in range(n)]


def as_dicts(df):
    # The driver's zone must not matter, so times are compared as text.
    return [r.asDict() for r in df.selectExpr(
        "*", "date_format(window_start, 'HH:mm') AS start", "date_format(window_end, 'HH:mm') AS end"
    ).collect()]


@pytest.mark.parametrize("n, start, end", [(5, "12:00", "12:05"), (7, "12:02", "12:07")])
def test_trailing_window_covers_five_minutes(spark, n, start, end):
    txns = spark.createDataFrame(minutely(n), SCHEMA)
    (row,) = as_dicts(select_trailing_window(windowed_features(txns)))
    assert (row["txn_count_5min"], row["total_amount_5min"]) == (5, 500.0)
    assert (row["start"], row["end"]) == (start, end)


def test_newest_window_is_not_the_trailing_one(spark):
    txns = spark.createDataFrame(minutely(5), SCHEMA)
    (row,) = as_dicts(latest_window(windowed_features(txns)))
    assert row["txn_count_5min"] == 1


def test_users_are_independent(spark):
    rows = minutely(5) + [("user_2", 900.0, NOON + timedelta(minutes=2, seconds=10))]
    got = {r["user_id"]: r for r in as_dicts(
        select_trailing_window(windowed_features(spark.createDataFrame(rows, SCHEMA))))}
    assert {u: r["txn_count_5min"] for u, r in got.items()} == {"user_1": 5, "user_2": 1}
    assert got["user_2"]["max_amount_5min"] == 900.0


def test_columns_are_kept(spark):
    windows = windowed_features(spark.createDataFrame(minutely(3), SCHEMA))
    assert select_trailing_window(windows).columns == windows.columns
    shuffled = windows.select(*reversed(windows.columns))
    assert select_trailing_window(shuffled).columns == shuffled.columns


def test_event_on_the_minute_belongs_to_the_window_it_starts(spark):
    txns = spark.createDataFrame([("user_1", 1.0, NOON)], SCHEMA)
    got = sorted((r["start"], r["end"]) for r in as_dicts(windowed_features(txns)))
    assert got == [("11:56", "12:01"), ("11:57", "12:02"), ("11:58", "12:03"),
                   ("11:59", "12:04"), ("12:00", "12:05")]


def test_rows_without_time_or_amount(spark):
    rows = [("user_1", 5.0, None), ("user_1", None, NOON), (None, 7.0, NOON)]
    got = as_dicts(windowed_features(spark.createDataFrame(rows, SCHEMA)))
    by_user = defaultdict(set)
    for r in got:
        by_user[r["user_id"]].add((r["txn_count_5min"], r["total_amount_5min"], r["avg_amount_5min"]))
    assert by_user == {"user_1": {(1, None, None)}, None: {(1, 7.0, 7.0)}}


def random_transactions(seed, n=400, users=4, hot_share=1 / 3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        user = "user_0" if rng.random() < hot_share else f"user_{rng.randrange(1, users)}"
        at = NOON + timedelta(microseconds=rng.randrange(40 * 60 * 1_000_000))
        rows.append((user, rng.randrange(1, 100000) / 100, at))
    return rows


def brute_windows(rows):
    groups = defaultdict(list)
    for user, amount, at in rows:
        minute = at.replace(second=0, microsecond=0)
        for back in range(5):
            groups[user, minute - timedelta(minutes=back)].append(amount)
    return {
        (u, s.strftime("%H:%M")): (len(a), round(sum(a), 2), max(a)) for (u, s), a in groups.items()
    }


@pytest.mark.parametrize("seed", range(3))
def test_windows_against_brute_force(spark, seed):
    rows = random_transactions(seed)
    got = as_dicts(windowed_features(spark.createDataFrame(rows, SCHEMA), cents=True))
    assert len(got) == len({(r["user_id"], r["start"]) for r in got})
    assert brute_windows(rows) == {
        (r["user_id"], r["start"]): (r["txn_count_5min"], r["total_amount_5min"], r["max_amount_5min"])
        for r in got
    }
    assert all(r["avg_amount_5min"] == r["total_amount_5min"] / r["txn_count_5min"] for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_direct_trailing_equals_selection(spark, seed):
    txns = spark.createDataFrame(random_transactions(seed), SCHEMA)
    chosen = select_trailing_window(windowed_features(txns, cents=True))
    direct = trailing_features(txns, cents=True)
    assert sorted(map(str, chosen.collect())) == sorted(map(str, direct.collect()))
