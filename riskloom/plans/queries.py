"""The registered queries: each operator over the given tables.

Every callable takes (spark, sf_dir) and returns a frame of plain columns.
Times are shown as text in UTC so that any client prints the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.flags import flag_rows, register_sql, with_flags
from riskloom.functions.vector import feature_matrix, has_window, risk_level, rule_label, with_feature_vector
from riskloom.operators import explain as ex
from riskloom.operators import model as ml
from riskloom.operators import monitoring as mon
from riskloom.operators import online as on
from riskloom.operators import gains, shapley
from riskloom.operators import training as tr
from riskloom.operators import validation as val
from riskloom.operators.asof import pit_join
from riskloom.operators.evaluate import confusion_metrics, roc_auc
from riskloom.operators.snapshots import PeriodicJoin
from riskloom.operators.scoring import lookup, rule_probability, score
from riskloom.operators.velocity import flag_over_limit
from riskloom.operators.windows import (
    closed_windows, latest_window, select_trailing_window, trailing_features, windowed_features,
)
from riskloom.schemas import FEATURE_ORDER, SLIDING, USER_VIEW, WINDOW_FEATURES, FeatureView
from riskloom.plans.fixed import SHAPLEY_UNIT, TREES
from riskloom.session import configure, stream_partitions, work_dir, write_file
from riskloom.sources import offline, tables
from riskloom.sources.messages import parse_transactions
from riskloom.streaming.keyed import keyed_feature_table
from riskloom.streaming.layers import Layers, wait_for_all
from riskloom.streaming.materialize import materialized_table
from riskloom.streaming.online import flag_table, user_feature_table
from riskloom.streaming.quarantine import QuarantineCounter, read_quarantine, write_quarantine
from riskloom.streaming.quarantine import quarantine_counts as count_quarantined
from riskloom.streaming.state import dropped_by_watermark, open_windows

# Importances used where a query must not depend on a trained model.
FIXED_IMPORTANCES = [0.22, 0.16, 0.12, 0.14, 0.10, 0.08, 0.18]

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}

# The score above which the fixed rule calls a transaction fraud.
DECISION = 0.5

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Show timestamps as text."""
    return df.select(*[
        F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema
    ])


# Inputs -----------------------------------------------------------------------


def txns(spark, sf):
    return tables.transactions(tables.read_events(configure(spark), sf))


def txn_stream(spark, sf):
    return tables.with_time_text(tables.transactions(tables.stream_events(configure(spark), sf)))


def dirty(spark, sf):
    return tables.dirty_transactions(txns(spark, sf))


def labels(spark, sf):
    return tables.labels(txns(spark, sf))


def windows(spark, sf):
    return windowed_features(txns(spark, sf), cents=True)


def entities(spark, sf):
    t = txns(spark, sf)
    return tr.labeled_transactions(t, tables.labels(t))


def training(spark, sf):
    t = txns(spark, sf)
    return tr.training_set(t, tables.labels(t), windowed_features(t, cents=True))


def stored(df, name):
    """Write a costly intermediate to the shared folder and continue from there."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def newest_time(spark, sf):
    """The newest event time, as a scalar subquery."""
    return txns(spark, sf).agg(F.max("event_time")).scalar()


def online_rows(spark, sf):
    """Trailing windows that expire after the last event of their user."""
    return on.with_expiry(trailing_features(txns(spark, sf), last_event="updated_at"), on.USER_FEATURES_TTL)


def online_live(spark, sf):
    return on.live(online_rows(spark, sf), newest_time(spark, sf))


def cleaned(spark, sf):
    return val.clean_requests(tables.requests(txns(spark, sf)))


def good_requests(spark, sf):
    return cleaned(spark, sf).where(val.is_valid()).drop("errors")


def scored_requests(spark, sf):
    return score(good_requests(spark, sf), online_live(spark, sf), rule_probability)


def scored_history(spark, sf):
    """Labelled transactions scored by the fixed rule on what was known then."""
    rows = with_feature_vector(training(spark, sf))
    return rule_probability(rows).withColumn("risk_level", risk_level(F.col("probability")))


def messages_text(df, column="errors"):
    return df.withColumn(column, F.array_join(column, "; "))


# Flags and projections -----------------------------------------------------------


def flags(spark, sf):
    return with_flags(txns(spark, sf)).select("transaction_id", *FEATURE_ORDER[4:])


def sql_flags(spark, sf):
    register_sql(configure(spark))
    return spark.sql(
        """SELECT transaction_id,
                  risk_is_foreign(merchant_country) AS is_foreign,
                  risk_is_high_amount(amount) AS is_high_amount,
                  risk_is_suspicious(merchant_country, amount) AS is_suspicious
           FROM {rows}""",
        rows=txns(spark, sf),
    )


def flag_projection(spark, sf):
    return flag_rows(txns(spark, sf))


def flags_of_dirty(spark, sf):
    return with_flags(dirty(spark, sf)).select("event_id", *FEATURE_ORDER[4:])


# Parsing --------------------------------------------------------------------------


def json_parse(spark, sf):
    parsed = parse_transactions(tables.messages(txns(spark, sf)))
    return parsed.select(
        "event_id", "transaction_id", "user_id", "amount", "merchant_category",
        "merchant_country", "merchant_name", "card_last4", "event_time", "corrupt",
    )


def parse_event_time(spark, sf):
    return dirty(spark, sf).select("event_id", "timestamp", "event_time")


# Windows ---------------------------------------------------------------------------


def trailing_window(spark, sf):
    return select_trailing_window(windows(spark, sf))


def trailing_direct(spark, sf):
    return trailing_features(txns(spark, sf), cents=True)


def latest_window_baseline(spark, sf):
    return latest_window(windows(spark, sf))


def windowed_dirty(spark, sf):
    return windowed_features(dirty(spark, sf), cents=True)


def closed_window_batch(spark, sf):
    mark = newest_time(spark, sf) - F.expr(f"interval {SLIDING.watermark} seconds")
    return closed_windows(windows(spark, sf), mark)


# Streams -------------------------------------------------------------------------------


def _layers(spark, name):
    return _layers_below(spark, work_dir(spark, name))


def _layers_below(spark, root, **more):
    return Layers(
        root=f"{root}/layers", checkpoints=f"{root}/checkpoints", once=True, partitions=stream_partitions(spark), **more)


def windowed_append_stream(spark, sf):
    layers = _layers(spark, "silver")
    wait_for_all({"silver": layers.start_silver(txn_stream(spark, sf), cents=True)})
    return offline.read_silver(spark, layers.silver).drop("event_date")


def trailing_update_stream(spark, sf):
    layers = _layers(spark, "user_features")
    wait_for_all({"q": layers.start_user_features(txn_stream(spark, sf), cents=True)})
    table = user_feature_table(f"{layers.online}/user_features")
    return table.merged(spark).drop("updated_at", "expires_at")


def flags_stream(spark, sf):
    layers = _layers(spark, "flags")
    wait_for_all({"q": layers.start_flags(txn_stream(spark, sf))})
    table = flag_table(f"{layers.online}/transaction_flags")
    return table.merged(spark).drop("updated_at", "expires_at")


# Micro-batches, and how late every tenth event is in them.
BATCHES, LATE_SECONDS = 16, 240
KEYED_BATCHES = 6


def trailing_update_multibatch(spark, sf, compact_every=4):
    """The online table after many batches with late events, merged on the way."""
    root = work_dir(configure(spark), "multibatch")
    layers = _layers_below(spark, root, compact_every=compact_every)
    stream = tables.batched_events(spark, sf, f"{root}/events", BATCHES, LATE_SECONDS)
    wait_for_all({"q": layers.start_user_features(tables.with_time_text(tables.transactions(stream)))})
    table = user_feature_table(f"{layers.online}/user_features")
    return table.merged(spark).drop("updated_at", "expires_at")


def flags_multibatch(spark, sf):
    """Flags of transactions some of which come again, with another amount, in the last batch."""
    root = work_dir(configure(spark), "flags-multibatch")
    layers = _layers_below(spark, root, compact_every=2)
    files = tables.write_batches(spark, sf, f"{root}/events", 4, LATE_SECONDS)
    again = tables.read_events(spark, sf).where("event_id % 20 = 0").withColumn("value", F.lit(100.0))
    again.repartition(files).write.mode("append").parquet(f"{root}/events")
    stream = tables.batch_stream(spark, f"{root}/events", files)
    wait_for_all({"q": layers.start_flags(tables.with_time_text(tables.transactions(stream)))})
    table = flag_table(f"{layers.online}/transaction_flags")
    return table.merged(spark).drop("updated_at", "expires_at")


def keyed_state_multibatch(spark, sf, compact_every=2):
    """The online table out of keyed state: late and repeated events, and a stop half-way."""
    root = work_dir(configure(spark), "keyed")
    layers = _layers_below(spark, root, compact_every=compact_every)
    for part in (range(KEYED_BATCHES // 2), range(KEYED_BATCHES // 2, KEYED_BATCHES)):
        files = tables.write_batches(spark, sf, f"{root}/events", KEYED_BATCHES, LATE_SECONDS, again=3, which=part)
        stream = tables.batch_stream(spark, f"{root}/events", files)
        wait_for_all({"q": layers.start_keyed_features(tables.with_time_text(tables.transactions(stream)))})
    table = keyed_feature_table(f"{layers.online}/keyed_features")
    return table.merged(spark).drop("updated_at", "expires_at")


# Minutes behind the newest event of what is delivered again when its windows are closed.
LONG_LATE = 40


def _stopped_twice(spark, sf):
    """Closed windows of a stream that stops half-way, goes on, and then meets events long behind."""
    root = work_dir(configure(spark), "stopped")
    layers = _layers_below(spark, root)
    half, queries = KEYED_BATCHES // 2, []
    for part in (range(half), range(half, KEYED_BATCHES), None):
        if part:
            files = tables.write_batches(spark, sf, f"{root}/events", KEYED_BATCHES, LATE_SECONDS, which=part)
        else:
            events = tables.read_events(spark, sf)
            last = events.agg(F.max("ts")).scalar()
            long_late = events.where(F.col("ts") < last - F.expr(f"interval {LONG_LATE * tables.SPEED} minutes"))
            long_late.repartition(files).write.mode("append").parquet(f"{root}/events")
        stream = tables.batch_stream(spark, f"{root}/events", files)
        queries.append(layers.start_silver(tables.with_time_text(tables.transactions(stream))))
        wait_for_all({"silver": queries[-1]})
    return layers, queries


def windows_with_state(spark, sf):
    """Closed windows of the layer and open ones from the state: all windows, after two stops."""
    layers, _ = _stopped_twice(spark, sf)
    closed = offline.read_silver(spark, layers.silver).drop("event_date")
    return closed.unionByName(open_windows(spark, f"{layers.checkpoints}/silver"))


def late_drops(spark, sf):
    """What the watermark left out, as the stream itself counted it."""
    layers, queries = _stopped_twice(spark, sf)
    return spark.createDataFrame([(dropped_by_watermark(*queries),)], "n_dropped bigint")


def quarantine_observed(spark, sf):
    """Rejected transactions as the writing jobs counted them, over a restart, beside what was stored."""
    root = work_dir(configure(spark), "observed")
    half = KEYED_BATCHES // 2
    for part in (range(half), range(half, KEYED_BATCHES)):
        # A new process each time: only the stored counts go on.
        layers = _layers_below(spark, root, rejected=QuarantineCounter(f"{root}/counts"))
        files = tables.write_batches(spark, sf, f"{root}/events", KEYED_BATCHES, 0, which=part)
        stream = tables.transactions(tables.batch_stream(spark, f"{root}/events", files))
        wait_for_all({"q": layers.start_rejected(tables.dirty_transactions(stream))})
    kept = QuarantineCounter(f"{root}/counts")
    return count_quarantined(read_quarantine(spark, layers.quarantine)).select(
        "kind", "n", F.lit(kept.met("transaction", spark)).cast("bigint").alias("n_met"),
        F.lit(kept.lost("transaction", spark)).cast("bigint").alias("n_lost"))


def bronze_exact(spark, sf):
    layers = _layers(spark, "bronze_exact")
    wait_for_all({"q": layers.start_bronze(txn_stream(spark, sf))})
    return offline.read_bronze(spark, layers.bronze).select("transaction_id", "event_time")


def training_set_from_layers(spark, sf):
    """The training set out of what the streams stored: raw log, labels and closed windows."""
    layers = _layers(spark, "training_layers")
    label_stream = tables.labels(txn_stream(spark, sf)).withColumn(
        "label_timestamp", tables.iso_text(F.col("label_time")))
    wait_for_all({
        "bronze": layers.start_bronze(txn_stream(spark, sf)),
        "labels": layers.start_labels(label_stream),
        "silver": layers.start_silver(txn_stream(spark, sf)),
    })
    rows = tr.training_set(
        offline.read_bronze(spark, layers.bronze), offline.read_labels(spark, layers.labels),
        offline.read_silver(spark, layers.silver))
    return tr.model_input(rows)


def bronze_replay(spark, sf):
    layers = _layers(spark, "bronze")
    wait_for_all({"q": layers.start_bronze(txn_stream(spark, sf))})
    return windowed_features(offline.read_bronze(spark, layers.bronze), cents=True)


def layer_counts(spark, sf):
    """Rows of every layer after all queries ran over a faulty feed and its labels, to the end."""
    layers = _layers(spark, "all-layers")
    feed, good = tables.dirty_transactions(txn_stream(spark, sf)), txn_stream(spark, sf)
    wait_for_all(layers.start_all(feed, tables.labels(good).withColumn(
        "label_timestamp", tables.iso_text(F.col("label_time")))))
    held = {
        "bronze": offline.read_bronze(spark, layers.bronze), "silver": offline.read_silver(spark, layers.silver),
        "labels": offline.read_labels(spark, layers.labels),
        "user_features": user_feature_table(f"{layers.online}/user_features").merged(spark),
        "flags": flag_table(f"{layers.online}/transaction_flags").merged(spark),
        "rejected": read_quarantine(spark, layers.quarantine).where("kind = 'transaction'"),
    }
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n") for name, rows in held.items()]
    return reduce(DataFrame.unionByName, counts)


def labels_stream(spark, sf):
    layers = _layers(spark, "labels")
    stream = tables.labels(txn_stream(spark, sf)).withColumn(
        "label_timestamp", tables.iso_text(F.col("label_time"))
    )
    wait_for_all({"q": layers.start_labels(stream)})
    return offline.read_labels(spark, layers.labels)


def rejected_stream(spark, sf):
    layers = _layers(spark, "rejected")
    wait_for_all({"q": layers.start_rejected(tables.dirty_transactions(txn_stream(spark, sf)))})
    records = read_quarantine(spark, layers.quarantine)
    return records.select(
        "kind",
        F.get_json_object("record", "$.event_id").cast("bigint").alias("event_id"),
        F.array_join("errors", "; ").alias("errors"),
    )


def scores_stream(spark, sf):
    """Requests scored on a stream against the online table another stream filled."""
    layers = _layers(spark, "scores")
    wait_for_all({"q": layers.start_user_features(txn_stream(spark, sf), cents=True)})
    table = user_feature_table(f"{layers.online}/user_features")
    requests = tables.requests(txn_stream(spark, sf))
    wait_for_all({"q": layers.start_scores(requests, lambda users: table.merged(spark, users), rule_probability)})
    return spark.read.parquet(layers.scores).select(
        "event_id", "user_id", "features_found", *FEATURE_ORDER, "probability", "risk_level"
    )


def model_scores_stream(spark, sf):
    """Requests scored on a stream by a trained model against the online table another stream filled."""
    model, _ = _fitted(spark, sf)
    layers = _layers(spark, "model-scores")
    wait_for_all({"q": layers.start_user_features(txn_stream(spark, sf))})
    table = user_feature_table(f"{layers.online}/user_features")
    requests = tables.requests(txn_stream(spark, sf))
    wait_for_all({"q": layers.start_scores(requests, lambda users: table.merged(spark, users), ml.scorer(model))})
    return spark.read.parquet(layers.scores).select(
        "event_id", "user_id", "features_found", *FEATURE_ORDER, _agrees())


# Validation -----------------------------------------------------------------------------


def validate_transactions(spark, sf):
    checked = val.with_errors(dirty(spark, sf), "transaction")
    return messages_text(checked.select("event_id", val.is_valid().alias("valid"), "errors"))


def validate_user_features(spark, sf):
    checked = val.with_errors(windowed_dirty(spark, sf), "user_features")
    return messages_text(
        checked.select("user_id", "window_start", val.is_valid().alias("valid"), "errors")
    )


def validate_flags(spark, sf):
    checked = val.with_errors(with_flags(dirty(spark, sf)), "transaction_flags")
    return messages_text(checked.select("event_id", val.is_valid().alias("valid"), "errors"))


def request_cleaning(spark, sf):
    return messages_text(cleaned(spark, sf).drop("amount"))


def _quarantined(spark, sf):
    """Invalid rows of both kinds, written to the quarantine and read back."""
    path = work_dir(configure(spark), "quarantine")
    bad_flags = val.invalid_rows(flag_rows(dirty(spark, sf)), "transaction_flags")
    bad_users = val.invalid_rows(select_trailing_window(windowed_dirty(spark, sf)), "user_features")
    for batch_id, (kind, rows) in enumerate(
        {"transaction_flags": bad_flags, "user_features": bad_users}.items()
    ):
        if not write_quarantine(rows, path, kind, batch_id):
            raise RuntimeError("quarantine could not be written")
    return read_quarantine(spark, path)


def quarantine_rows(spark, sf):
    return _quarantined(spark, sf).select(
        "kind", "batch_id",
        F.get_json_object("record", "$.transaction_id").alias("transaction_id"),
        F.get_json_object("record", "$.user_id").alias("user_id"),
        F.array_join("errors", "; ").alias("errors"),
    )


def quarantine_counts(spark, sf):
    return count_quarantined(_quarantined(spark, sf))


def fail_fast_errors(spark, sf):
    """What the fail-fast mode raises on faulty transactions; valid ones pass."""
    rows = dirty(spark, sf)
    val.require_valid(val.valid_rows(rows, "transaction"), "transaction")
    try:
        val.require_valid(rows, "transaction")
    except val.ValidationError as raised:
        return spark.createDataFrame([(e,) for e in raised.errors], "error string")
    raise AssertionError("faulty rows passed")


def quarantine_fallback(spark, sf):
    """Invalid rows where the first place can't be written: a file lies there."""
    root = work_dir(configure(spark), "fallback")
    write_file(spark, f"{root}/first", b"in the way")
    bad = val.invalid_rows(flag_rows(dirty(spark, sf)), "transaction_flags")
    if not write_quarantine(bad, f"{root}/first", "transaction_flags", 0, f"{root}/second"):
        raise RuntimeError("quarantine could not be written")
    return read_quarantine(spark, f"{root}/second").select(
        "kind", F.get_json_object("record", "$.transaction_id").alias("transaction_id"), F.array_join("errors", "; ").alias("errors"))


def error_counts(spark, sf):
    return val.error_counts(val.with_errors(dirty(spark, sf), "transaction"))


# Labels and training set --------------------------------------------------------------------


def labels_first_seen(spark, sf):
    return tr.first_labels(labels(spark, sf))


def cold_start_users(spark, sf):
    return tr.cold_start(entities(spark, sf), _seen_before(spark, sf)).select("transaction_id", "user_id")


def known_user_entities(spark, sf):
    return tr.with_known_user(entities(spark, sf), _seen_before(spark, sf)).select(
        "transaction_id", "user_id"
    )


def _seen_before(spark, sf):
    """Windows of the users seen before: here all but those whose number is a multiple of five."""
    number = F.substring("user_id", 6, 10).cast("int")
    return windows(spark, sf).where(number % 5 != 0)


def pit(spark, sf):
    return pit_join(entities(spark, sf), windows(spark, sf), keep_timestamp=True).drop(
        "amount", "merchant_country"
    )


NO_LIMIT_VIEW = FeatureView(
    name="any_age", entity="user_id", timestamp="window_end",
    fields=USER_VIEW.fields, ttl=0, step=0,
)


def pit_any_age(spark, sf):
    joined = pit_join(entities(spark, sf), windows(spark, sf), NO_LIMIT_VIEW, keep_timestamp=True)
    return joined.drop("amount", "merchant_country")


# Seconds of a period, so that the given tables hold several.
PERIOD = 1800


def pit_by_period(spark, sf):
    """The join without age limit, run period by period over new rows and one snapshot."""
    runs = PeriodicJoin(work_dir(configure(spark), "periods"), NO_LIMIT_VIEW, seconds=PERIOD)
    asked, known = stored(entities(spark, sf), "entities"), stored(windows(spark, sf), "windows")
    times = asked.select(runs.number(F.col("event_timestamp")).alias("p")).union(known.select(runs.number(F.col("window_end"))))
    span = times.agg(F.min("p").alias("first"), F.max("p").alias("last")).first()
    for number in range(span["first"], span["last"] + 1):
        runs.run(asked, known, number)
    return runs.joined(spark).drop("amount", "merchant_country", "period")


def pit_coverage(spark, sf):
    return tr.coverage(training(spark, sf)).withColumn(
        "coverage", F.try_divide("n_matched", "n_rows")
    )


def training_set(spark, sf):
    return tr.model_input(training(spark, sf))


def feature_matrix_of_all(spark, sf):
    rows = txns(spark, sf).withColumnRenamed("event_time", "event_timestamp")
    return feature_matrix(pit_join(rows, windows(spark, sf)), "transaction_id")


def rule_labels(spark, sf):
    rows = training(spark, sf)
    return with_feature_vector(rows).select("transaction_id", rule_label().alias("rule_fraud"))


def class_counts(spark, sf):
    return tr.class_counts(entities(spark, sf)).drop("fraud_rate")


def fraud_rate(spark, sf):
    return tr.class_counts(entities(spark, sf)).select("fraud_rate")


def training_guard(spark, sf):
    return tr.class_counts(tr.require_enough(entities(spark, sf))).select(
        "n_rows", "n_fraud",
        ((F.col("n_rows") >= tr.MIN_TRAINING_ROWS)
         & (F.least("n_fraud", "n_legit") >= tr.MIN_ROWS_PER_CLASS)).alias("enough"),
    )


def stratified_split(spark, sf):
    rows = entities(spark, sf).select("transaction_id", "fraud")
    return tr.stratified_split(stored(rows, "entities"))


def view_schema(spark, sf):
    refs = [f"{USER_VIEW.name}:{name}" for name in WINDOW_FEATURES]
    return windows(spark, sf).select(
        "user_id", "window_end",
        *[F.col(n).cast(USER_VIEW.fields[n]).cast("double").alias(n) for n in USER_VIEW.select_refs(refs)],
    )


# Online table ------------------------------------------------------------------------------


def online_user_features(spark, sf):
    return online_live(spark, sf)


def online_flags(spark, sf):
    t = txns(spark, sf)
    rows = on.with_expiry(
        flag_rows(t).withColumn("updated_at", F.col("event_time")), on.FLAGS_TTL
    )
    return on.live(rows, newest_time(spark, sf)).select(
        "transaction_id", "user_id", "amount", *FEATURE_ORDER[4:], "expires_at"
    )


def online_lookup(spark, sf):
    return lookup(good_requests(spark, sf), online_live(spark, sf)).select(
        "event_id", "user_id", "features_found", *WINDOW_FEATURES
    )


def store_keys(spark, sf):
    rows = online_live(spark, sf)
    fields = F.col("fields")
    return on.user_hashes(rows).select(
        "key", "ttl",
        fields["user_id"].alias("user_id"),
        fields["txn_count_5min"].alias("txn_count_5min"),
        fields["window_start"].alias("window_start"),
        fields["window_end"].alias("window_end"),
        fields["updated_at"].alias("updated_at"),
        fields["total_amount_5min"].cast("double").alias("total_amount_5min"),
        fields["max_amount_5min"].cast("double").alias("max_amount_5min"),
    )


def store_rounded(spark, sf):
    """The amounts as the store's text has them: rounded to cents."""
    fields = F.col("fields")
    names = ("total_amount_5min", "avg_amount_5min", "max_amount_5min")
    return on.user_hashes(online_live(spark, sf)).select("key", *[fields[n].cast("double").alias(n) for n in names])


def flag_keys(spark, sf):
    rows = flag_rows(txns(spark, sf)).withColumn("updated_at", F.col("event_time"))
    fields = F.col("fields")
    return on.flag_hashes(rows).select(
        "key", "ttl", *[fields[n].alias(n) for n in ("transaction_id", "user_id", "amount", *FEATURE_ORDER[4:])])


def materialize_latest(spark, sf):
    end = newest_time(spark, sf) - F.expr("interval 10 minutes")
    return on.materialize(windows(spark, sf), end - F.expr("interval 10 minutes"), end)


def _closed_stream(spark, sf, name):
    """Closed windows as a stream stored them."""
    layers = _layers(spark, name)
    wait_for_all({"silver": layers.start_silver(txn_stream(spark, sf))})
    return offline.read_silver(spark, layers.silver).drop("event_date")


def materialize_incremental(spark, sf):
    """Several runs over stored windows, one of which dies before its commit, then a merge."""
    closed = _closed_stream(spark, sf, "materialize")
    table = materialized_table(f"{work_dir(spark, 'materialized')}/rows")
    last = newest_time(spark, sf)

    def upto(minutes):
        return F.date_trunc("minute", last) - F.expr(f"interval {minutes} minutes")

    table.advance(closed, upto(60))
    # Rows without a mark, which go further than the next run.
    table.write_rows(closed, 1, upto(60), upto(15))
    table.advance(closed, upto(30))
    table.advance(closed, upto(30))
    table.compact(spark, 1)
    table.advance(closed)
    return table.merged(spark)


# Scoring, metrics, explanations --------------------------------------------------------------


def score_features(spark, sf):
    return scored_requests(spark, sf).select(
        "event_id", "user_id", "features_found", *FEATURE_ORDER, "probability", "risk_level"
    )


def risk_bands(spark, sf):
    return scored_history(spark, sf).select("transaction_id", "probability", "risk_level")


def predictions(spark, sf):
    return scored_history(spark, sf).withColumn(
        "prediction", (F.col("probability") > DECISION).cast("int")
    )


def confusion(spark, sf):
    return confusion_metrics(predictions(spark, sf))


def auc(spark, sf):
    return roc_auc(predictions(spark, sf))


def contributions_fixed(spark, sf):
    parts = ex.contributions(FIXED_IMPORTANCES)
    return scored_history(spark, sf).select(
        "transaction_id", *[part.alias(name) for name, part in parts.items()]
    )


def top3_contributors(spark, sf):
    top = ex.top_contributors(ex.contributions(FIXED_IMPORTANCES))
    return (
        scored_history(spark, sf)
        .select("transaction_id", F.posexplode(top).alias("place", "c"))
        .select("transaction_id", "place", "c.feature", "c.feature_value", "c.direction")
    )


def reasons(spark, sf):
    return scored_history(spark, sf).select(
        "transaction_id", F.array_join(ex.reasons(), "; ").alias("reasons")
    )


# Monitoring -------------------------------------------------------------------------------------


def risk_band_counts(spark, sf):
    return mon.counts_by(scored_history(spark, sf), "risk_level")


def lookup_found_counts(spark, sf):
    found = lookup(good_requests(spark, sf), online_live(spark, sf))
    return mon.counts_by(found, "features_found")


def window_found_counts(spark, sf):
    return mon.counts_by(training(spark, sf).withColumn("found", has_window()), "found")


def amount_histogram(spark, sf):
    return mon.amount_histogram(txns(spark, sf))


def histogram_quantile(spark, sf):
    buckets = mon.amount_histogram(
        txns(spark, sf).withColumn("interval_start", F.window("event_time", "5 minutes")["start"]),
        "interval_start",
    )
    return buckets.select(
        "interval_start", *[mon.histogram_quantile(q).alias(name) for name, q in QUANTILES.items()]
    )


def prediction_rate_5m(spark, sf):
    return mon.rate(scored_history(spark, sf), "risk_level", time="event_timestamp")


# Seconds between samples, and after which the sampled counters start anew.
SAMPLED, RESTARTED = 60, 2100


def _counters(spark, sf):
    """What a counter of each risk level shows every minute; it starts at zero again now and then."""
    rows = scored_history(spark, sf).where(F.col("event_timestamp").isNotNull())
    second = F.unix_seconds("event_timestamp")
    minutes = rows.groupBy("risk_level", (F.floor(second / SAMPLED) * SAMPLED + SAMPLED).alias("time")).agg(F.count("*").alias("n"))
    since = Window.partitionBy("risk_level", F.floor((F.col("time") - 1) / RESTARTED)).orderBy("time")
    return minutes.select("risk_level", "time", F.sum("n").over(since).alias("value"))


def counter_rate_5m(spark, sf):
    """Sliding rates of counters with restarts, and with gaps where nothing was counted."""
    return mon.counter_rate(_counters(spark, sf), "risk_level")


def sketched_quantiles(spark, sf):
    """Whether quantiles from merged sketches lie within the stated error of the exact ranks."""
    t = txns(spark, sf)
    merged = mon.merged_quantiles(mon.quantile_sketches(t), QUANTILES)
    names = F.stack(F.lit(len(QUANTILES)), *[
        x for name, q in QUANTILES.items() for x in (F.lit(name), F.lit(q), F.col(name))]).alias("name", "q", "found")
    found = merged.select("interval_start", "n", names)
    amounts = t.where(F.col("amount").isNotNull()).select(
        F.window("event_time", "5 minutes")["start"].alias("interval_start"), "amount")
    ranks = amounts.join(F.broadcast(found), "interval_start").groupBy("interval_start", "n", "name", "q").agg(
        F.count("*").alias("counted"), F.count_if(F.col("amount") < F.col("found")).alias("below"),
        F.count_if(F.col("amount") <= F.col("found")).alias("upto"))
    error = F.greatest(F.col("below") / F.col("counted") - F.col("q"), F.col("q") - F.col("upto") / F.col("counted"))
    return ranks.select("interval_start", "name", "n", (F.col("n") == F.col("counted")).alias("all_counted"), (error <= mon.RANK_ERROR).alias("within"))


def last_probability(spark, sf):
    return mon.last_value(scored_history(spark, sf), "probability", time="event_timestamp")


def velocity_60s(spark, sf):
    return flag_over_limit(txns(spark, sf), limit=2).select(
        "transaction_id", "user_id", "n_trailing", "over_limit"
    )


def velocity_of_dirty(spark, sf):
    """Events without a user count as one key; those without a time have no trailing minute."""
    return flag_over_limit(dirty(spark, sf), limit=2).select("event_id", "user_id", "n_trailing", "over_limit")


def exact_trailing_5m(spark, sf):
    return flag_over_limit(txns(spark, sf), limit=10, seconds=SLIDING.size).select(
        "transaction_id", "user_id", "n_trailing", "over_limit"
    )


# With a trained model (no SQL counterpart) ---------------------------------------------------------


def _fitted(spark, sf):
    """A model trained on the training part, saved and loaded, and the stored rows with ``is_test``."""
    rows = stored(tr.stratified_split(stored(tr.model_input(training(spark, sf)), "training")), "split")
    path = work_dir(spark, "model")
    ml.save(ml.train(rows.where(~F.col("is_test"))), path)
    return ml.load(path), rows


def _test_scores(model, rows):
    scored = ml.predict(model, rows.where("is_test"))
    return scored.select(
        "transaction_id", "fraud", "probability", "prediction",
        risk_level(F.col("probability")).alias("risk_level"),
    )


def _run_metrics(spark, model, rows):
    metrics = ml.evaluate(ml.predict(model, rows.where("is_test")))
    path = work_dir(spark, "runs")
    params = {"trees": ml.TREES, "depth": ml.TREE_DEPTH, "rate": ml.LEARNING_RATE}
    ml.log_run(spark, path, f"gbt-{uuid.uuid4().hex}", params, metrics)
    return spark.read.parquet(path).select("run_id", *ml.METRICS)


def gbt_scores(spark, sf):
    return _test_scores(*_fitted(spark, sf))


def explanations(spark, sf):
    model, rows = _fitted(spark, sf)
    scored = ml.predict(model, rows)
    facts = txns(spark, sf).select("transaction_id", "amount", "merchant_country")
    scored = scored.join(facts, "transaction_id")
    return ex.explain_with_model(scored, model).select(
        "transaction_id", "probability",
        F.to_json("explanation.shap_values").alias("shap_values"),
        F.to_json("explanation.top_contributors").alias("top_contributors"),
        F.array_join("explanation.reasons", "; ").alias("reasons"),
        "explanation.method",
    )


def shapley_adds_up(spark, sf):
    """Base value and Shapley values of a trained model against its log-odds, row by row."""
    model, rows = _fitted(spark, sf)
    known = shapley.of_model(model, spark)
    margin = vector_to_array("rawPrediction")[1] * 2
    scored = model.transform(rows.where("is_test")).select(
        "transaction_id", "fraud", *FEATURE_ORDER, margin.alias("log_odds"), vector_to_array("probability")[1].alias("probability"))
    explained = shapley.with_shapley(scored, known)
    added = F.col("base_value") + F.aggregate("shapley", F.lit(0.0), lambda a, v: a + v)
    logistic = 1 / (1 + F.exp(-added))
    return explained.select(
        "transaction_id", "fraud", F.size("shapley").alias("n_values"),
        (F.abs(added - F.col("log_odds")) < 1e-9).alias("adds_up"),
        (F.abs(logistic - F.col("probability")) < 1e-9).alias("gives_probability"))


def _fixed_tree(node) -> shapley.Node:
    if len(node) == 2:
        return shapley.Node(*map(float, node))
    feature, threshold, cover, left, right = node
    return shapley.Node(float(cover), 0.0, feature, threshold, _fixed_tree(left), _fixed_tree(right))


def shapley_fixed_trees(spark, sf):
    """Shapley values of fixed trees, as whole numbers of ``SHAPLEY_UNIT``."""
    known = shapley.explainer([(w, _fixed_tree(root)) for w, root in TREES], len(FEATURE_ORDER))
    rows = with_feature_vector(training(spark, sf))
    explained = shapley.with_shapley(rows, known)
    return explained.select("transaction_id", *[
        F.round(part * SHAPLEY_UNIT).cast("bigint").alias(name)
        for name, part in ex.exact_contributions().items()])


def gain_importances_fixed(spark, sf):
    """Second-order gains of the splits of fixed trees over the training set, in millionths."""
    trees = [(w, _fixed_tree(root)) for w, root in TREES]
    rows = stored(with_feature_vector(training(spark, sf)).select(*FEATURE_ORDER, "fraud"), "training")
    return gains.gain_importances(rows, trees).select(
        "feature", "n_splits", F.round(F.col("gain") * 1e6).cast("bigint").alias("gain"))


def gbt_importances(spark, sf):
    model, _ = _fitted(spark, sf)
    return ml.importance_table(spark, model)


def gbt_run_metrics(spark, sf):
    """Metrics on the test part, logged to a run table and read back."""
    return _run_metrics(spark, *_fitted(spark, sf))


# What a model's rows must satisfy whatever its probabilities are -----------------------------------


def _agrees():
    """Band and probability fit each other."""
    p = F.col("probability")
    band = F.when(p > 0.7, "HIGH").when(p > 0.4, "MEDIUM").otherwise("LOW")
    return (p.between(0, 1) & (F.col("risk_level") == band)).alias("band_agrees")


def score_with_model(spark, sf):
    """Requests scored by a trained model on the live rows of the online table."""
    model, _ = _fitted(spark, sf)
    scored = score(good_requests(spark, sf), online_live(spark, sf), ml.scorer(model))
    return scored.select("event_id", "user_id", "features_found", *FEATURE_ORDER, _agrees())


def gbt_test_rows(spark, sf):
    """The rows a model is tested on, and whether class and band follow from the probability."""
    return gbt_scores(spark, sf).select(
        "transaction_id", "fraud", _agrees(),
        ((F.col("probability") > DECISION) == (F.col("prediction") == 1)).alias("class_agrees"))


def gbt_metrics_agree(spark, sf):
    """The logged metrics against counts over the emitted predictions; importances add up to 1."""
    model, rows = _fitted(spark, sf)
    names = ml.METRICS[:-1]
    stacked = F.stack(F.lit(len(names)), *[x for m in names for x in (F.lit(m), F.col(m))]).alias("metric", "value")
    again = confusion_metrics(_test_scores(model, rows)).select(stacked)
    logged = _run_metrics(spark, model, rows).select(stacked).withColumnRenamed("value", "logged")
    compared = again.join(logged, "metric").select("metric", (F.abs(F.col("value") - F.col("logged")) < 1e-12).alias("agrees"))
    added = ml.importance_table(spark, model).agg((F.abs(F.sum("importance") - 1) < 1e-9).alias("agrees"))
    return compared.unionByName(added.select(F.lit("importances").alias("metric"), "agrees"))


QUERIES: dict[str, Query] = {
    "flags": flags,
    "sql_flags": sql_flags,
    "flag_projection": flag_projection,
    "flags_of_dirty": flags_of_dirty,
    "json_parse": json_parse,
    "parse_event_time": parse_event_time,
    "windowed_features": windows,
    "windowed_append_stream": windowed_append_stream,
    "closed_windows": closed_window_batch,
    "trailing_window": trailing_window,
    "trailing_direct": trailing_direct,
    "trailing_update_stream": trailing_update_stream,
    "latest_window_baseline": latest_window_baseline,
    "flags_stream": flags_stream,
    "trailing_update_multibatch": trailing_update_multibatch,
    "flags_multibatch": flags_multibatch,
    "keyed_state_multibatch": keyed_state_multibatch,
    "windows_with_state": windows_with_state,
    "late_drops": late_drops,
    "quarantine_observed": quarantine_observed,
    "bronze_replay": bronze_replay,
    "bronze_exact": bronze_exact,
    "training_set_from_layers": training_set_from_layers,
    "labels_stream": labels_stream,
    "layer_counts": layer_counts,
    "rejected_stream": rejected_stream,
    "scores_stream": scores_stream,
    "model_scores_stream": model_scores_stream,
    "validate_transactions": validate_transactions,
    "validate_user_features": validate_user_features,
    "validate_flags": validate_flags,
    "request_cleaning": request_cleaning,
    "quarantine_rows": quarantine_rows,
    "quarantine_counts": quarantine_counts,
    "error_counts": error_counts,
    "fail_fast_errors": fail_fast_errors,
    "quarantine_fallback": quarantine_fallback,
    "labels_first_seen": labels_first_seen,
    "labeled_transactions": entities,
    "cold_start_users": cold_start_users,
    "known_user_entities": known_user_entities,
    "pit_join": pit,
    "pit_join_any_age": pit_any_age,
    "pit_join_by_period": pit_by_period,
    "pit_coverage": pit_coverage,
    "training_set": training_set,
    "feature_matrix": feature_matrix_of_all,
    "rule_labels": rule_labels,
    "class_counts": class_counts,
    "fraud_rate": fraud_rate,
    "training_guard": training_guard,
    "stratified_split": stratified_split,
    "view_schema": view_schema,
    "online_user_features": online_user_features,
    "online_flags": online_flags,
    "online_lookup": online_lookup,
    "store_keys": store_keys,
    "store_rounded": store_rounded,
    "flag_keys": flag_keys,
    "materialize_latest": materialize_latest,
    "materialize_incremental": materialize_incremental,
    "score_features": score_features,
    "risk_bands": risk_bands,
    "confusion_metrics": confusion,
    "roc_auc": auc,
    "contributions_fixed": contributions_fixed,
    "top3_contributors": top3_contributors,
    "reasons": reasons,
    "risk_band_counts": risk_band_counts,
    "lookup_found_counts": lookup_found_counts,
    "window_found_counts": window_found_counts,
    "amount_histogram": amount_histogram,
    "histogram_quantile": histogram_quantile,
    "prediction_rate_5m": prediction_rate_5m,
    "counter_rate_5m": counter_rate_5m,
    "sketched_quantiles": sketched_quantiles,
    "last_probability": last_probability,
    "velocity_60s": velocity_60s,
    "velocity_of_dirty": velocity_of_dirty,
    "exact_trailing_5m": exact_trailing_5m,
    "gbt_scores": gbt_scores,
    "explanations": explanations,
    "gbt_importances": gbt_importances,
    "gbt_run_metrics": gbt_run_metrics,
    "score_with_model": score_with_model,
    "gbt_test_rows": gbt_test_rows,
    "gbt_metrics_agree": gbt_metrics_agree,
    "gain_importances_fixed": gain_importances_fixed,
    "shapley_adds_up": shapley_adds_up,
    "shapley_fixed_trees": shapley_fixed_trees,
}

# These depend on a trained model and have no SQL counterpart.
MODEL_QUERIES = {"gbt_scores", "explanations", "gbt_importances", "gbt_run_metrics"}


def _registered(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(build(configure(spark), sf_dir))

    return run


def queries() -> dict[str, Query]:
    return {name: _registered(build) for name, build in QUERIES.items()}
