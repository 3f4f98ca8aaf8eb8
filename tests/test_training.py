from __future__ import annotations

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators import model as ml
from riskloom.operators import training as tr
from riskloom.operators.evaluate import confusion_metrics, roc_auc
from riskloom.schemas import FEATURE_ORDER
from riskloom.sources import offline

DAY = datetime(2024, 1, 1)


def test_first_label_wins(spark):
    rows = [("a", True, DAY + timedelta(hours=1)), ("a", False, DAY),
            ("b", True, DAY), ("b", False, DAY),
            ("c", True, None), ("c", False, DAY + timedelta(days=999)),
            ("d", True, None), ("e", True, datetime(1960, 1, 1)), ("e", False, DAY)]
    df = spark.createDataFrame(rows, "transaction_id string, is_fraud boolean, label_time timestamp")
    got = {r.transaction_id: (r.is_fraud, r.label_time) for r in tr.first_labels(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": False, "b": False, "c": False, "d": True, "e": True}
    assert got["d"][1] is None and got["a"][1] is not None


def test_known_and_cold_users_partition_the_rows(spark):
    entities = spark.createDataFrame(
        [(i, u) for i, u in enumerate(["a"] * 50 + ["b", "c", None])], "id int, user_id string")
    features = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "user_id string")
    known = {r.id for r in tr.with_known_user(entities, features).collect()}
    cold = {r.id for r in tr.cold_start(entities, features).collect()}
    assert known == {*range(50), 51} and cold == {50, 52}


@pytest.mark.parametrize("legit, fraud, ok", [(50, 2, False), (300, 10, True), (300, 4, False), (4, 300, False)])
def test_guard(spark, legit, fraud, ok):
    rows = spark.createDataFrame([(0,)] * legit + [(1,)] * fraud, "fraud int")
    if ok:
        assert tr.require_enough(rows) is rows
    else:
        with pytest.raises(tr.TrainingDataError, match="Not enough"):
            tr.require_enough(rows)


def brute_test_ids(rows, fraction=0.2, seed=42):
    chosen = set()
    for label in {c for _, c in rows}:
        ids = sorted((i for i, c in rows if c == label),
                     key=lambda i: hashlib.md5(f"{i}|{seed}".encode()).hexdigest())
        chosen |= set(ids[: math.floor(fraction * len(ids) + 0.5)])
    return chosen


@pytest.mark.parametrize("n, n_fraud", [(100, 10), (1000, 37), (5, 1), (3000, 1500)])
def test_split_is_exact_and_stratified(spark, n, n_fraud):
    rows = [(f"t{i}", int(i < n_fraud)) for i in range(n)]
    df = spark.createDataFrame(rows, "transaction_id string, fraud int")
    got = tr.stratified_split(df).collect()
    assert len(got) == n
    assert {r.transaction_id for r in got if r.is_test} == brute_test_ids(rows)


def test_copies_of_a_row_stay_together(spark):
    rows = [("copied", 0)] * 300 + [(f"t{i}", i % 5 == 0) for i in range(600)]
    df = spark.createDataFrame([(a, int(b)) for a, b in rows], "transaction_id string, fraud int")
    got = tr.stratified_split(df).collect()
    assert len(got) == 900
    assert len({r.is_test for r in got if r.transaction_id == "copied"}) == 1


def test_metrics(spark):
    y, said = [1, 0, 1, 1, 0, 0, 1, 0], [1, 0, 1, 0, 0, 1, 1, 0]
    got = confusion_metrics(spark.createDataFrame(list(zip(y, said)), "fraud int, prediction int")).first()
    assert (got.accuracy, got.precision, got.recall, got.f1_score) == (0.75, 0.75, 0.75, 0.75)


def test_metrics_without_positives(spark):
    got = confusion_metrics(spark.createDataFrame([(0, 0)], "fraud int, prediction int")).first()
    assert (got.accuracy, got.precision, got.recall, got.f1_score) == (1.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("digits, ranges", [(1, 1000), (2, 7), (6, 50), (6, 1000)])
def test_auc_against_pairs(spark, digits, ranges):
    rng = random.Random(digits * ranges)
    rows = [(int(rng.random() < 0.3), round(rng.random() ** 3, digits)) for _ in range(400)]
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    got = roc_auc(spark.createDataFrame(rows, "fraud int, probability double"), ranges=ranges).first()
    assert got.roc_auc == wins / (len(pos) * len(neg))


def test_split_leaves_rows_where_they_are(spark):
    # Rows of a class must not meet in one task: what is shuffled are counts, the cuts go to every task.
    df = spark.range(400).select(F.col("id").cast("string").alias("transaction_id"), (F.col("id") % 9 == 0).cast("int").alias("fraud"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        split = tr.stratified_split(df)
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan
        assert [r["n"] for r in split.where("is_test").groupBy("fraud").agg(F.count("*").alias("n")).orderBy("fraud").collect()] == [71, 9]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_auc_needs_both_classes(spark):
    got = roc_auc(spark.createDataFrame([(1, 0.5), (1, 0.7)], "fraud int, probability double")).first()
    assert got.roc_auc is None


@pytest.fixture(scope="module")
def small_model(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        foreign, high = rng.random() < 0.3, rng.random() < 0.4
        suspicious = foreign and (high or rng.random() < 0.5)
        rows.append((rng.randrange(20) / 1.0, rng.random() * 5000, rng.random() * 2500, rng.random() * 5000,
                     float(foreign), float(high), float(suspicious), int(suspicious and high)))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in FEATURE_ORDER) + ", fraud int")
    return ml.train(df, trees=3), df


def test_model_learns_the_rule_and_survives_saving(spark, small_model, tmp_path):
    model, df = small_model
    scored = ml.predict(model, df)
    assert scored.columns == [*FEATURE_ORDER, "fraud", "probability", "prediction"]
    metrics = ml.evaluate(scored)
    assert metrics["accuracy"] == 1.0 and metrics["roc_auc"] == 1.0
    ml.save(model, str(tmp_path / "model"))
    again = ml.predict(ml.load(str(tmp_path / "model")), df)
    assert again.collect() == scored.collect()


def test_importances_and_run_table(spark, small_model, tmp_path):
    model, df = small_model
    table = ml.importance_table(spark, model).collect()
    assert sorted(r.feature for r in table) == sorted(FEATURE_ORDER)
    assert [r.importance for r in table] == sorted(r.importance for r in table)
    path = str(tmp_path / "runs")
    for run in ("a", "b"):
        ml.log_run(spark, path, run, {"trees": 3}, ml.evaluate(ml.predict(model, df)))
    runs = spark.read.parquet(path).orderBy("run_id").collect()
    assert [r.run_id for r in runs] == ["a", "b"] and runs[0].params == {"trees": "3"}
    assert runs[0].roc_auc == 1.0


def test_offline_errors_are_distinct(spark, tmp_path):
    with pytest.raises(offline.MissingDataError):
        offline.read_bronze(spark, str(tmp_path / "nowhere"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(offline.UnreadableDataError):
        offline.read_labels(spark, str(tmp_path / "bad"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "part-0.json").write_text("")
    with pytest.raises(offline.EmptyDataError):
        offline.read_bronze(spark, str(tmp_path / "empty"))
    assert issubclass(offline.MissingDataError, tr.TrainingDataError)


def test_bronze_reads_part_files_only(spark, tmp_path):
    (tmp_path / "part-0.json").write_text('{"transaction_id":"a","amount":1.5}\n')
    (tmp_path / "part-1.json").write_text("")
    (tmp_path / "other.json").write_text('{"transaction_id":"b"}\n')
    assert [r.transaction_id for r in offline.read_bronze(spark, str(tmp_path)).collect()] == ["a"]
