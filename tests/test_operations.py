"""Observed counts, incremental materialisation, pruned lookups, counter rates and sketches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators import monitoring as mon
from riskloom.operators.windows import latest_window, windowed_features
from riskloom.session import read_file, write_file
from riskloom.streaming.materialize import materialized_table
from riskloom.streaming.online import flag_table, user_feature_table
from riskloom.streaming.quarantine import QuarantineCounter, read_quarantine, write_quarantine

NOON = datetime(2024, 1, 1, 12)
BAD = "user_id string, amount double, errors array<string>"
TXN = "user_id string, amount double, event_time timestamp"


def bad(spark, n):
    return spark.createDataFrame([(f"u{i}", 1.0, ["e"]) for i in range(n)], BAD)


def test_counts_of_the_writing_job_survive_a_restart(spark, tmp_path):
    path, counts = str(tmp_path / "q"), str(tmp_path / "counts")
    first = QuarantineCounter(counts)
    for batch_id, n in ((0, 3), (1, 5), (1, 4), (2, 0)):  # the second batch is replayed
        assert write_quarantine(bad(spark, n), path, "transaction", batch_id, counter=first)
    assert first.met("transaction") == 7 and read_quarantine(spark, path).count() == 7
    second = QuarantineCounter(counts)
    assert write_quarantine(bad(spark, 2), path, "transaction", 3, counter=second)
    blocked = tmp_path / "file"
    blocked.write_text("no folder")
    assert not write_quarantine(bad(spark, 6), str(blocked / "x"), "transaction", 4, counter=second)
    third = QuarantineCounter(counts)
    assert (third.met("transaction", spark), third.lost("transaction", spark), third.met("other", spark)) == (15, 6, 0)


def test_a_counter_stays_small(spark):
    counter = QuarantineCounter()
    for batch_id in range(500):
        counter.add("a", batch_id, 2, True)
    counter.add("a", 499, 5, False)
    counter.add("b", None, 1, True)
    counter.add("b", None, 1, True)
    assert (counter.met("a"), counter.lost("a"), counter.met("b")) == (1003, 5, 2)
    assert len(counter._kinds) == 2 and len(counter._kinds["a"]) == 5


def test_counting_reads_the_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(rows):
        for r in rows:
            seen.add(1)
            yield r

    rows = spark.createDataFrame(bad(spark, 40).rdd.mapPartitions(look), BAD)
    counter = QuarantineCounter()
    assert write_quarantine(rows, str(tmp_path / "q"), "transaction", 0, counter=counter)
    assert counter.met("transaction") == seen.value == 40


def test_small_files(spark, tmp_path):
    path = str(tmp_path / "a" / "b.json")
    assert read_file(spark, path) is None
    for content in (b"one", b"", bytes(range(256))):
        write_file(spark, path, content)
        assert read_file(spark, path) == content
    assert [p.name for p in (tmp_path / "a").iterdir() if p.suffix != ".crc"] == ["b.json"]


# Materialisation ---------------------------------------------------------------------


def windows(spark, minutes, users=5, seed=1):
    rng = random.Random(seed)
    rows = [(f"user_000{rng.randrange(users)}", rng.randrange(1, 999) / 10, NOON + timedelta(minutes=m, seconds=rng.randrange(60)))
            for m in minutes for _ in range(3)]
    return windowed_features(spark.createDataFrame(rows, TXN))


def rows_of(df):
    return sorted(map(str, df.collect()))


def at(minute):
    return F.lit((NOON + timedelta(minutes=minute)).isoformat(sep=" ")).cast("timestamp")


@pytest.mark.parametrize("crash", ["before data", "after data", "half mark"])
def test_a_run_that_dies_changes_nothing(spark, tmp_path, crash):
    closed = windows(spark, range(40))
    table = materialized_table(str(tmp_path / "t"))
    assert table.advance(closed, at(10)) == 0
    before = rows_of(table.merged(spark))
    if crash != "before data":
        table.write_rows(closed, 1, at(10), at(33))
    if crash == "half mark":
        (tmp_path / "t" / "marks" / "batch_id=1").mkdir(parents=True)
    assert rows_of(table.merged(spark)) == before
    assert table.advance(closed, at(20)) == 1
    again = materialized_table(str(tmp_path / "t"))
    again.compact(spark, 1)
    assert again.advance(closed) == 2
    want = latest_window(closed)
    assert rows_of(again.merged(spark).select(want.columns)) == rows_of(want)


def test_runs_without_news_leave_the_mark(spark, tmp_path):
    closed = windows(spark, range(10))
    table = materialized_table(str(tmp_path / "t"))
    assert table.advance(closed.limit(0)) == -1 and table.merged(spark).count() == 0
    assert [table.advance(closed, at(12)), table.advance(closed, at(12)), table.advance(closed, at(5))] == [0, 0, 0]
    assert table.mark(spark) == spark.range(1).select(at(12)).first()[0]


# Lookups --------------------------------------------------------------------------------


def files_read(df):
    """Files the scans of a plan have read."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            found += node.metrics().apply("numFiles").value()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_a_lookup_reads_the_buckets_of_its_users(spark, tmp_path):
    table = user_feature_table(str(tmp_path / "t"))
    rows = [(f"user_{i:04d}", 1.0, NOON) for i in range(400)]
    for batch_id in range(3):
        table.write_batch(windowed_features(spark.createDataFrame(rows, TXN)), batch_id)
    table.compact(spark, 0)
    everything = files_read(table.merged(spark))
    asked = spark.createDataFrame([("user_0003",), ("user_0003",), ("nobody",)], "user_id string")
    got = table.merged(spark, asked)
    assert [r["user_id"] for r in got.collect()] == ["user_0003"]
    assert everything == 3 * table.buckets and files_read(got) <= 2 * 3
    assert files_read(table.merged(spark, "user_0003")) == 3
    assert "In(user_id" in got._jdf.queryExecution().executedPlan().toString()
    many = spark.createDataFrame([(f"user_{i:04d}",) for i in range(300)], "user_id string")
    assert table.merged(spark, many).count() == 300


def test_rows_without_key_are_kept(spark, tmp_path):
    table = flag_table(str(tmp_path / "f"))
    schema = "transaction_id string, user_id string, amount double, is_foreign int, is_high_amount int, is_suspicious int"
    table.write_batch(spark.createDataFrame([(None, "u", 1.0, 0, 0, 0), ("a", "u", 2.0, 0, 0, 0)], schema), 0)
    assert table.merged(spark).count() == 2
    assert table.merged(spark, spark.createDataFrame([(None,), ("a",)], "transaction_id string")).count() == 1


# Rates and sketches ----------------------------------------------------------------------


def prometheus_like(samples, t, seconds):
    """The rate by its definition, sample by sample."""
    seen = sorted((at_, v) for at_, v in samples if t - seconds < at_ <= t)
    if len(seen) < 2:
        return None
    increase = sum(b if b < a else b - a for (_, a), (_, b) in zip(seen, seen[1:]))
    covered, mean = seen[-1][0] - seen[0][0], (seen[-1][0] - seen[0][0]) / (len(seen) - 1)
    before, after = seen[0][0] - (t - seconds), t - seen[-1][0]
    if increase > 0 and seen[0][1] >= 0:
        before = min(before, covered * (seen[0][1] / increase))
    whole = covered + (before if before < mean * 1.1 else mean / 2) + (after if after < mean * 1.1 else mean / 2)
    return increase * (whole / covered) / seconds


@pytest.mark.parametrize("seed", range(2))
def test_rates_of_counters_with_restarts_and_gaps(spark, seed):
    rng, series = random.Random(seed), {}
    for name in ("a", "b", None):
        value, held, t = 0, [], 1_704_110_400 + rng.randrange(60)
        for _ in range(60):
            t += rng.choice([15, 15, 15, 60, 400])
            value = rng.randrange(5) if rng.random() < 0.1 else value + rng.randrange(20)
            held.append((t, float(value)))
        series[name] = held
    rows = [(name, t, v) for name, held in series.items() for t, v in held]
    df = spark.createDataFrame(rows + [("a", None, 1.0), ("b", 1_704_110_400, None)], "level string, time long, value double").repartition(5)
    got = {(r["level"], int(r["evaluated_at"].timestamp())): r["per_second"] for r in mon.counter_rate(df, "level", seconds=300, step=60)
           .withColumn("evaluated_at", F.col("evaluated_at")).collect()}
    for name, held in series.items():
        for t in range(held[0][0] // 60 * 60, held[-1][0] + 600, 60):
            want = prometheus_like(held, t, 300)
            assert (name, t) in got if want is not None else (name, t) not in got
            if want is not None:
                assert abs(got[name, t] - want) < 1e-9


def test_merged_sketches_keep_the_rank_error(spark):
    rng = random.Random(4)
    rows = [(rng.lognormvariate(3, 2), NOON + timedelta(seconds=rng.randrange(600))) for _ in range(20_000)]
    df = spark.createDataFrame(rows + [(None, NOON), (float("nan"), NOON), (1.0, None)], "amount double, event_time timestamp")
    quantiles = {f"q{i}": i / 20 for i in range(1, 20)}
    sketches = mon.quantile_sketches(df)
    assert sketches.count() == 10 and sketches.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    for r in mon.merged_quantiles(sketches, quantiles, seconds=300).collect():
        start = r["interval_start"].timestamp()
        values = sorted(v for v, t in rows if start <= t.timestamp() < start + 300)
        assert r["n"] == len(values)
        for name, q in quantiles.items():
            below, upto = sum(v < r[name] for v in values), sum(v <= r[name] for v in values)
            assert below / len(values) - mon.RANK_ERROR <= q <= upto / len(values) + mon.RANK_ERROR
    assert mon.merged_quantiles(mon.quantile_sketches(df.limit(0)), quantiles).count() == 0
