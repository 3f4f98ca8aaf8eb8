"""Labels, labelled transactions and the training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.vector import has_window, with_feature_vector
from riskloom.operators.asof import pit_join
from riskloom.operators.joins import many_to_one
from riskloom.schemas import (
    FEATURE_ORDER, MIN_ROWS_PER_CLASS, MIN_TRAINING_ROWS, SEED, TEST_FRACTION, USER_VIEW,
    FeatureView,
)


class TrainingDataError(RuntimeError):
    """Offline data is missing, unreadable, empty or too small to train on."""


# Stands for a missing label time; later than any real one.
_UNDATED = 1 << 61


def first_labels(labels: DataFrame) -> DataFrame:
    """One label per transaction: the earliest, ties by value, undated ones last.

    Time and value are packed into one number, whose minimum is a hash
    aggregation that combines copies of a label before the shuffle.
    """
    micros = F.coalesce(F.unix_micros("label_time"), F.lit(_UNDATED))
    packed = micros * 2 + F.col("is_fraud").cast("bigint")
    first = F.shiftright("_first", 1)
    return (
        labels.groupBy("transaction_id")
        .agg(F.min(packed).alias("_first"))
        .select(
            "transaction_id",
            (F.col("_first").bitwiseAND(F.lit(1)) == 1).alias("is_fraud"),
            F.when(first != _UNDATED, F.timestamp_micros(first)).alias("label_time"),
        )
    )


def labeled_transactions(transactions: DataFrame, labels: DataFrame) -> DataFrame:
    """Entity rows: every transaction that has a label, with its class."""
    rows = transactions.select(
        "transaction_id", "user_id", "amount", "merchant_country",
        F.col("event_time").alias("event_timestamp"),
    )
    classes = first_labels(labels).select("transaction_id", F.col("is_fraud").cast("int").alias("fraud"))
    return many_to_one(rows, classes, ["transaction_id"], "inner")


def known_users(features: DataFrame, view: FeatureView = USER_VIEW) -> DataFrame:
    return features.select(view.entity).distinct()


def with_known_user(entities: DataFrame, features: DataFrame, view: FeatureView = USER_VIEW) -> DataFrame:
    """Entity rows whose key has any feature row."""
    return many_to_one(entities, known_users(features, view), [view.entity], "left_semi")


def cold_start(entities: DataFrame, features: DataFrame, view: FeatureView = USER_VIEW) -> DataFrame:
    """Entity rows whose key has no feature row at all."""
    return many_to_one(entities, known_users(features, view), [view.entity], "left_anti")


def training_set(
    transactions: DataFrame, labels: DataFrame, windows: DataFrame, view: FeatureView = USER_VIEW
) -> DataFrame:
    """Labelled transactions with the features known just before each."""
    return pit_join(labeled_transactions(transactions, labels), windows, view)


def model_input(training: DataFrame) -> DataFrame:
    """Key, class and the seven model inputs."""
    return with_feature_vector(training).select("transaction_id", "fraud", *FEATURE_ORDER)


def coverage(training: DataFrame) -> DataFrame:
    """Rows in all and rows with a window to look back at."""
    return training.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(has_window()).alias("n_matched"),
    )


def class_counts(training: DataFrame) -> DataFrame:
    return training.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("fraud") == 1).alias("n_fraud"),
        F.count_if(F.col("fraud") == 0).alias("n_legit"),
        F.avg("fraud").alias("fraud_rate"),
    )


def require_enough(
    training: DataFrame, min_rows: int = MIN_TRAINING_ROWS, min_per_class: int = MIN_ROWS_PER_CLASS
) -> DataFrame:
    """Raise rather than train on too little; returns the frame otherwise."""
    seen = class_counts(training).first()
    if seen["n_rows"] < min_rows or min(seen["n_fraud"], seen["n_legit"]) < min_per_class:
        raise TrainingDataError(
            f"Not enough labelled history to train: {seen['n_rows']} rows, {seen['n_fraud']} fraud "
            f"(need {min_rows} rows and {min_per_class} of each class)"
        )
    return training


def _split_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key), F.lit(f"|{seed}")))


def stratified_split(
    rows: DataFrame,
    label: str = "fraud",
    key: str = "transaction_id",
    fraction: float = TEST_FRACTION,
    seed: int = SEED,
) -> DataFrame:
    """Add ``is_test``: per class, the ``fraction`` of rows with the smallest hash.

    Exact in size and the same on every run. The cut is found without sorting a
    class: rows are counted per hash prefix, then per longer prefix inside the
    one in which the cut falls, and only the hashes of that (one in 2^36 of a
    class) are ranked. The rows themselves are never shuffled (a cut has one row
    per class and goes to every task), and copies of a key always land on the same
    side. The input is read four times, so pass a written or persisted frame when
    it is costly.
    """
    hashed = rows.select(F.col(label), _split_hash(key, seed).alias("_hash"))
    sizes = hashed.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    wanted = sizes.select(
        label, F.lit("").alias("_prefix"), F.lit(0).cast("bigint").alias("_below"),
        F.floor(F.col("_size") * fraction + 0.5).alias("_wanted"),
    )
    cut, known = wanted, 0
    for digits in PREFIXES:
        cut, known = _refined_cut(hashed, cut, label, known, digits), digits
    # When no hash of the cut prefix fits, the test part ends before the prefix.
    inside = (
        _running_counts(hashed, cut, label, known, 32)
        .where(F.col("_upto") <= F.col("_wanted"))
        .groupBy(label)
        .agg(F.max("_next").alias("_last"))
    )
    limits = cut.join(F.broadcast(inside), label, "left").select(
        label, F.coalesce("_last", "_prefix").alias("_last")
    )
    return (
        rows.withColumn("_hash", _split_hash(key, seed))
        .join(F.broadcast(limits), label, "left")
        .withColumn("is_test", F.coalesce(F.col("_hash") <= F.col("_last"), F.lit(False)))
        .drop("_hash", "_last")
    )


# Hexadecimal digits of the prefixes counted: at most 2^16, then 2^20 counts a class.
PREFIXES = (4, 9)


def _running_counts(hashed: DataFrame, cut: DataFrame, label: str, known: int, digits: int) -> DataFrame:
    """Rows below and in each prefix of ``digits`` digits inside the cut prefix of its class."""
    by_class = Window.partitionBy(label).orderBy("_next")
    return (
        hashed.withColumn("_prefix", F.substring("_hash", 1, known))
        .join(F.broadcast(cut), [label, "_prefix"])
        .groupBy(label, "_below", "_wanted", F.substring("_hash", 1, digits).alias("_next"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.col("_below") + F.sum("_n").over(by_class))
    )


def _refined_cut(hashed: DataFrame, cut: DataFrame, label: str, known: int, digits: int) -> DataFrame:
    """The prefix of ``digits`` digits in which the cut falls, and the rows below it."""
    first = F.min(F.struct(F.col("_next").alias("_prefix"), (F.col("_upto") - F.col("_n")).alias("_below"), "_wanted"))
    return (
        _running_counts(hashed, cut, label, known, digits)
        .where(F.col("_upto") >= F.col("_wanted"))
        .groupBy(label).agg(first.alias("_cut"))
        .select(label, "_cut.*")
    )
