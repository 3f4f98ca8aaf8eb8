"""What the plans look like: shuffles, skew, pushdown, and no Python or cross joins."""

from __future__ import annotations

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from riskloom.functions.flags import with_flags
from riskloom.operators import asof, velocity
from riskloom.operators.asof import pit_join
from riskloom.operators.scoring import lookup
from riskloom.operators.training import first_labels, labeled_transactions, with_known_user
from riskloom.operators.velocity import flag_over_limit
from riskloom.operators.windows import select_trailing_window, trailing_features, windowed_features
from riskloom.plans import queries
from riskloom.schemas import FeatureView
from riskloom.streaming.online import user_feature_table

STREAMS = {n for n in queries.QUERIES if n.endswith(("_stream", "_multibatch", "_layers"))} | {
    "bronze_replay", "bronze_exact", "materialize_incremental", "pit_join_by_period", "layer_counts",
    "quarantine_fallback", "fail_fast_errors", "windows_with_state", "late_drops",
    "quarantine_observed"}
MODELS = queries.MODEL_QUERIES | {"score_with_model", "gbt_test_rows", "gbt_metrics_agree"}
# Exact Shapley values are numpy batches.
MODELS |= {"shapley_adds_up", "shapley_fixed_trees", "gain_importances_fixed"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|round|single)", plan(df).split("Initial Plan")[0]))


@contextmanager
def conf(spark, **settings):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - STREAMS - MODELS))
def test_no_cross_joins_and_no_python(spark, small_dir, name):
    text = plan(queries.queries()[name](spark, small_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in text


@pytest.fixture(scope="module")
def txns(spark, small_dir):
    return queries.txns(spark, small_dir)


@pytest.mark.parametrize("build, n", [
    (windowed_features, 2),
    (lambda t: select_trailing_window(windowed_features(t)), 2),
    (trailing_features, 3),
])
def test_shuffles_of_windows(spark, txns, build, n):
    assert shuffles(build(txns)) == n


def test_aggregations_hash_and_combine_before_the_shuffle(spark, txns, small_dir):
    for df in (windowed_features(txns), select_trailing_window(windowed_features(txns)),
               first_labels(queries.labels(spark, small_dir))):
        text = plan(df)
        assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
        assert "partial_" in text


def test_flags_do_not_block_pushdown(spark, small_dir):
    df = with_flags(spark.read.parquet(f"{small_dir}/events.parquet"), "event_type", "value").where(
        "is_high_amount = 1")
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,500.0)" in plan(df) or "(value" in plan(df)
    kept = df.where("value > 40").select("event_id")
    assert "GreaterThan(value,40.0)" in plan(kept) and "props" not in plan(kept)


def test_key_lookup_reaches_the_scan(spark, tmp_path, txns):
    table = user_feature_table(str(tmp_path / "t"))
    table.write_batch(windowed_features(txns), 0)
    text = plan(table.get(spark, "user_0001"))
    assert text.count("FileScan") == text.count("EqualTo(user_id,user_0001)") == 1


def test_pruning_reads_only_what_a_projection_needs(spark, small_dir):
    text = plan(windowed_features(queries.txns(spark, small_dir)).select("user_id", "txn_count_5min"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("props" not in s and "event_type" not in s for s in schemas)


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
}


def hot_rows(spark, n=60000):
    """A third of the rows has one id, one user and one minute; they come from 16 tasks."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 16).select(
        F.when(hot, "copied").otherwise(F.concat(F.lit("t"), "id")).alias("transaction_id"),
        F.when(hot, "user_0000").otherwise(F.concat(F.lit("user_"), F.lpad((F.col("id") % 900 + 1).cast("string"), 4, "0")))
        .alias("user_id"),
        (F.col("id") % 700 + 1).cast("double").alias("amount"),
        F.md5(F.col("id").cast("string")).alias("merchant_country"),
        F.timestamp_seconds(F.lit(1704110400) + F.when(hot, 600).otherwise(F.col("id") % 3600))
        .alias("event_time"),
        F.lit(False).alias("is_fraud"),
    )


def skew_joins(df):
    rows = df.collect()
    return rows, len(re.findall(r"skew=true", plan(df).split("Initial Plan")[0]))


def test_hot_transaction_is_split_in_the_label_join(spark):
    with conf(spark, **SKEW):
        rows = hot_rows(spark)
        labels = rows.select("transaction_id", "is_fraud", F.col("event_time").alias("label_time"))
        got, split = skew_joins(labeled_transactions(rows, labels))
        assert len(got) == 60000 and split == 1


def test_hot_user_and_minute_are_split_in_the_as_of_join(spark):
    with conf(spark, **SKEW):
        rows = hot_rows(spark)
        entities = rows.withColumnRenamed("event_time", "event_timestamp")
        df = pit_join(entities, windowed_features(rows))
        got, split = skew_joins(df)
        assert len(got) == 60000 and split == 1


@pytest.mark.parametrize("build", [
    lambda rows: with_known_user(rows, windowed_features(rows)),
    lambda rows: lookup(rows, trailing_features(rows)),
    flag_over_limit,
])
def test_hot_user_is_split_in_the_other_joins(spark, build):
    with conf(spark, **SKEW):
        got, split = skew_joins(build(hot_rows(spark)))
        assert len(got) == 60000 and split == 1


def test_hot_user_reaches_no_window_as_raw_rows(spark):
    """The rows of the hot user and minute are combined before they are distributed by user."""
    with conf(spark, **SKEW):
        df = windowed_features(hot_rows(spark))
        assert df.where("user_id = 'user_0000'").count() == 5
        assert df.agg(F.max("txn_count_5min")).first()[0] == 20000


def test_trailing_counts_use_a_running_sum(spark, txns):
    """A frame that slides at its lower end is added up anew for every row."""
    frames = re.findall(r"specifiedwindowframe\(([^)]*)", plan(flag_over_limit(txns)))
    assert frames and all("unboundedpreceding" in f.lower() for f in frames)


# Small tables keep all their shuffle partitions.
MANY = SKEW | {"spark.sql.adaptive.coalescePartitions.enabled": "false"}


def busy_minute(spark, n=60000):
    """One user, one minute, all instants distinct."""
    return spark.range(0, n, 1, 16).select(
        F.concat(F.lit("t"), "id").alias("transaction_id"), F.lit("user_0001").alias("user_id"),
        F.col("id").alias("i"),
        F.timestamp_micros(F.lit(1704110400000000) + F.col("id") * 1000).alias("event_time"),
    )


@contextmanager
def limits_seen(monkeypatch, module):
    """The frames that get cut into ranges while this is open."""
    seen = []
    real = module.in_ranges
    monkeypatch.setattr(module, "in_ranges", lambda *a: seen.append(real(*a)) or seen[-1])
    yield seen


def test_busy_minute_is_split_in_the_as_of_join(spark, monkeypatch):
    with conf(spark, **MANY), limits_seen(monkeypatch, asof) as ranged:
        rows = busy_minute(spark)
        entities = rows.withColumnRenamed("event_time", "event_timestamp")
        # A feature row every 7 seconds and a half, half a millisecond after an entity row.
        features = rows.where("i % 7500 = 0").select(
            "user_id", (F.col("event_time") + F.expr("interval 500 microseconds")).alias("at"),
            F.when(F.col("i") != 7500, F.col("i")).alias("seen"))
        view = FeatureView(name="v", entity="user_id", timestamp="at", fields={"seen": "bigint"}, ttl=0, step=0)
        got = pit_join(entities, features, view, keep_timestamp=True)
        text = plan(got)
        assert ranged[0].select("_range").distinct().count() > 4
        assert "SortAggregate" not in text and shuffles(got) <= 8
        found = {r["i"]: (r["seen"], r["at"] is not None) for r in got.collect()}
        assert len(found) == 60000
        for i, (seen, matched) in found.items():
            last = (i - 1) // 7500 * 7500
            assert matched == (i > 0) and seen == (last if i > 0 and last != 7500 else None)


def test_busy_minute_is_split_in_the_trailing_counts(spark, monkeypatch):
    with conf(spark, **MANY), limits_seen(monkeypatch, velocity) as ranged:
        rows = busy_minute(spark).withColumn(
            "user_id", F.when(F.col("i") % 2 == 0, F.col("user_id")))
        got = flag_over_limit(rows, seconds=20).select("user_id", "i", "n_trailing").collect()
        assert ranged[0].select("_range").distinct().count() > 4
        assert len(got) == 60000
        assert all(r["n_trailing"] == min(r["i"] // 2 + 1, 10000) for r in got)
