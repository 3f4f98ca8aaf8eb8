from __future__ import annotations

import random
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from riskloom.functions.vector import feature_matrix
from riskloom.operators.asof import pit_join
from riskloom.operators.training import coverage, labeled_transactions, training_set
from riskloom.operators.windows import windowed_features
from riskloom.schemas import FEATURE_ORDER, USER_VIEW

NOON = datetime(2024, 1, 1, 12)
TXN = "transaction_id string, user_id string, amount double, merchant_country string, event_time timestamp"
LABEL = "transaction_id string, is_fraud boolean, label_time timestamp"


def at(minute, second=0, micro=0):
    return NOON + timedelta(minutes=minute, seconds=second, microseconds=micro)


@pytest.fixture(scope="module")
def history(spark):
    rows = [(f"u1-{i}", "user_1", 100.0, "US", at(i, 30)) for i in range(7)]
    rows += [("u2-0", "user_2", 900.0, "NG", at(3, 10)), ("u3-0", "user_3", 50.0, "US", at(5))]
    txns = spark.createDataFrame(rows, TXN)
    labels = spark.createDataFrame([(r[0], r[0] == "u2-0", at(60)) for r in rows], LABEL)
    silver = windowed_features(txns.where("user_id <> 'user_3'"))
    return training_set(txns, labels, silver)


def test_every_labelled_row_is_kept(history):
    rows = {r.transaction_id: r for r in history.collect()}
    assert len(rows) == 9 and rows["u2-0"].fraud == 1


def test_only_the_past_is_seen(history):
    counts = {r.transaction_id: r.txn_count_5min for r in history.collect()}
    assert [counts[f"u1-{i}"] for i in range(7)] == [None, 1, 2, 3, 4, 5, 5]
    totals = {r.transaction_id: r.total_amount_5min for r in history.collect()}
    assert totals["u1-5"] == 500.0


def test_rows_without_history_become_zero(history):
    rows = {r.transaction_id: r for r in feature_matrix(history, "transaction_id").collect()}
    for name in ("u1-0", "u2-0", "u3-0"):
        assert [rows[name][f] for f in FEATURE_ORDER[:4]] == [0, 0, 0, 0]
    assert rows["u2-0"].is_suspicious == 1.0


def test_coverage(history):
    got = coverage(history).first()
    assert (got.n_rows, got.n_matched) == (9, 6)


def brute(entities, features, ttl):
    out = []
    for key, user, t in entities:
        seen = [(w, v) for u, w, v in features if u == user and t is not None and w <= t]
        hit = max(seen, default=None)
        if hit and ttl and t - hit[0] > timedelta(seconds=ttl):
            hit = None
        out.append((key, None if hit is None else hit[1]))
    return sorted(out)


def case(seed, on_grid):
    rng = random.Random(seed)
    features, seen = [], set()
    for i in range(300):
        user = "hot" if rng.random() < 0.4 else f"u{rng.randrange(4)}"
        minute = rng.randrange(60 * 24 * 3) if not on_grid else rng.randrange(90)
        stamp = at(minute) if on_grid else at(minute, rng.randrange(60), rng.randrange(10**6))
        if (user, stamp) not in seen:
            seen.add((user, stamp))
            features.append((user, stamp, i))
    span = 100 if on_grid else 60 * 24 * 3
    entities = []
    for i in range(600):
        user = rng.choice(["hot", "hot", "u0", "u1", "u2", "u3", "nobody"])
        t = at(rng.randrange(span), rng.choice([0, 0, 30, 59]), rng.choice([0, 0, 1, 999999]))
        entities.append((i, user, t))
    # Copies of one instant, an unknown time and an unknown user.
    entities += [(1000 + i, "hot", entities[0][2]) for i in range(200)]
    entities += [(2000, "hot", None), (2001, None, at(1))]
    return entities, features


def joined(spark, entities, features, view):
    e = spark.createDataFrame(entities, "id int, user_id string, event_timestamp timestamp")
    f = spark.createDataFrame(features, "user_id string, window_end timestamp, v long")
    view = replace(view, fields={"v": "bigint"})
    return sorted((r.id, r.v) for r in pit_join(e, f, view).collect())


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("ttl, step", [(120, 60), (120, 0), (300, 60), (90, 60), (0, 0), (0, 60)])
def test_on_grid_against_brute_force(spark, seed, ttl, step):
    entities, features = case(seed, on_grid=True)
    got = joined(spark, entities, features, replace(USER_VIEW, ttl=ttl, step=step))
    assert got == brute(entities, features, ttl)


@pytest.mark.parametrize("ttl", [0, 3600, 100000])
def test_any_time_against_brute_force(spark, ttl):
    entities, features = case(7, on_grid=False)
    got = joined(spark, entities, features, replace(USER_VIEW, ttl=ttl, step=0))
    assert got == brute(entities, features, ttl)


def test_times_off_the_declared_grid_are_refused(spark):
    with pytest.raises(Exception, match="not a multiple of 60 s"):
        joined(spark, [(1, "u", at(5))], [("u", at(4, 30), 1)], USER_VIEW)


def test_bounds_are_inclusive(spark):
    features = [("u", at(5), 1)]
    entities = [(1, "u", at(5)), (2, "u", at(7)), (3, "u", at(7, 0, 1)), (4, "u", at(4, 59, 999999))]
    for step in (0, 60):
        got = joined(spark, entities, features, replace(USER_VIEW, step=step))
        assert got == [(1, 1), (2, 1), (3, None), (4, None)]


def test_features_by_reference(spark, history):
    assert USER_VIEW.select_refs(["user_transaction_features:avg_amount_5min"]) == ["avg_amount_5min"]
    for ref in ("other:avg_amount_5min", "user_transaction_features:nope", "avg_amount_5min"):
        with pytest.raises(ValueError):
            USER_VIEW.select_refs([ref])


def test_label_join_drops_unlabelled(spark):
    txns = spark.createDataFrame(
        [(f"t{i}", "user_1", 1.0, "US", at(i)) for i in (1, 2, 3)], TXN)
    labels = spark.createDataFrame([("t1", False, at(9)), ("t2", True, at(9))], LABEL)
    got = {r.transaction_id: r.fraud for r in labeled_transactions(txns, labels).collect()}
    assert got == {"t1": 0, "t2": 1}


def test_runs_by_period_read_one_period_and_one_snapshot(spark, tmp_path):
    from riskloom.operators.snapshots import PeriodicJoin
    from riskloom.schemas import FeatureView

    rng = random.Random(2)
    day = datetime(2024, 1, 1)
    fields = {"x": "bigint"}
    features = spark.createDataFrame(
        [(f"u{rng.randrange(6)}", day + timedelta(minutes=n * 7), n) for n in range(1000)] + [(None, day, 1), ("u1", None, 2)],
        "user_id string, window_end timestamp, x bigint").withColumn("event_date", F.to_date("window_end"))
    entities = spark.createDataFrame(
        [(f"u{rng.randrange(8)}", day + timedelta(minutes=rng.randrange(7200)), n) for n in range(500)],
        "user_id string, event_timestamp timestamp, id int").withColumn("event_date", F.to_date("event_timestamp"))
    features.write.partitionBy("event_date").parquet(str(tmp_path / "f"))
    entities.write.partitionBy("event_date").parquet(str(tmp_path / "e"))
    features, entities = (spark.read.parquet(str(tmp_path / x)) for x in "fe")
    for ttl in (0, 3600):
        view = FeatureView("v", "user_id", "window_end", fields, ttl=ttl)
        runs = PeriodicJoin(str(tmp_path / f"p{ttl}"), view)
        first = int(day.replace(tzinfo=timezone.utc).timestamp()) // 86_400
        for number in [first, first, *range(first + 1, first + 6)]:  # the first one twice
            runs.run(entities, features, number)
        whole = pit_join(entities, features, view, keep_timestamp=True)
        columns = [c for c in whole.columns if c != "event_date"]
        assert sorted(map(str, runs.joined(spark).select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
    assert spark.read.parquet(f"{runs.path}/snapshots/period={first + 3}").count() == 6
    plan = runs._inside(features, "window_end", first + 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    read = runs._inside(features, "window_end", first + 2).select(F.input_file_name()).distinct().collect()
    assert {r[0].split("event_date=")[1][:10] for r in read} == {"2024-01-03"}
