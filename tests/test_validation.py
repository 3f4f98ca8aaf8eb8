from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.operators.validation import (
    ValidationError, clean_requests, error_counts, invalid_rows, require_valid, valid_rows, with_errors,
)
from riskloom.schemas import CATEGORIES, COUNTRIES

GOOD = dict(
    transaction_id="0f1e2d3c-4b5a-6978-8796-000000000001", user_id="user_0001", amount=100.5,
    merchant_category="groceries", merchant_country="US", timestamp="2024-01-01T10:00:00",
)
TXN = ("transaction_id string, user_id string, amount double, merchant_category string, "
       "merchant_country string, timestamp string")
USER = ("user_id string, txn_count_5min long, total_amount_5min double, avg_amount_5min double, "
        "max_amount_5min double")
FLAGS = "transaction_id string, user_id string, amount double, is_foreign {0}, is_high_amount {0}, is_suspicious {0}"


def errors_of(spark, kind, schema, *rows):
    return [r.errors for r in with_errors(spark.createDataFrame(rows, schema), kind).collect()]


def txn(**changes):
    return tuple({**GOOD, **changes}.values())


@pytest.mark.parametrize("changes, message", [
    ({}, None),
    ({"user_id": "bad"}, "Invalid user_id format: bad"),
    ({"user_id": "user_00011"}, "Invalid user_id format: user_00011"),
    ({"user_id": "user_0001\n"}, "Invalid user_id format: user_0001\n"),
    ({"user_id": None}, "Invalid user_id format: None"),
    ({"amount": -5.0}, "amount must be positive: -5.0"),
    ({"amount": 0.0}, "amount must be positive: 0.0"),
    ({"amount": None}, "amount is required"),
    ({"amount": float("nan")}, "amount must be positive: NaN"),
    ({"amount": 99999.99}, None),
    ({"amount": 100000.0}, "amount exceeds maximum: 100000.0"),
    ({"merchant_category": "gambling"}, "Invalid merchant_category: gambling"),
    ({"merchant_country": "XX"}, "Invalid merchant_country: XX"),
    ({"merchant_country": None}, "Invalid merchant_country: None"),
    ({"timestamp": ""}, "Invalid timestamp: "),
    ({"timestamp": None}, "Invalid timestamp: None"),
    ({"transaction_id": "not-a-uuid"}, "Invalid transaction_id format: not-a-uuid"),
    ({"transaction_id": GOOD["transaction_id"].upper()},
     "Invalid transaction_id format: " + GOOD["transaction_id"].upper()),
])
def test_transaction_rules(spark, changes, message):
    assert errors_of(spark, "transaction", TXN, txn(**changes)) == [[message] if message else []]


def test_all_errors_in_order(spark):
    (errors,) = errors_of(spark, "transaction", TXN, ("x", "y", None, "z", "w", None))
    assert [e.split(":")[0] for e in errors] == [
        "Invalid transaction_id format", "Invalid user_id format", "amount is required",
        "Invalid merchant_category", "Invalid merchant_country", "Invalid timestamp"]


def test_every_category_and_country_is_valid(spark):
    rows = [txn(merchant_category=c) for c in CATEGORIES] + [txn(merchant_country=c) for c in COUNTRIES]
    assert errors_of(spark, "transaction", TXN, *rows) == [[]] * 14


def test_user_features(spark):
    rows = [("user_0001", 5, 500.0, 100.0, 200.0), ("bad", 2, 100.0, 50.0, 60.0),
            ("user_0001", -1, -5.0, 10.0, None), ("user_0001", 0, 0.0, 0.0, 0.0)]
    assert errors_of(spark, "user_features", USER, *rows) == [
        [], ["Invalid user_id format: bad"],
        ["txn_count_5min must be non-negative: -1", "total_amount_5min must be non-negative: -5.0",
         "max_amount_5min is required"], []]


@pytest.mark.parametrize("kind, good, bad", [
    ("boolean", True, None), ("int", 1, 2), ("string", "true", "yes"),
])
def test_flag_rules(spark, kind, good, bad):
    rows = [("t", "user_0001", 1.0, good, good, good), ("t", "user_0001", 1.0, bad, good, good),
            ("t", None, None, good, good, good)]
    shown = "None" if bad is None else bad
    assert errors_of(spark, "transaction_flags", FLAGS.format(kind), *rows) == [
        [], [f"is_foreign must be boolean: {shown}"],
        ["Invalid user_id format: None", "amount must be positive: None"]]


def test_missing_column_stops_the_check(spark):
    df = spark.createDataFrame([("user_0001",)], "user_id string")
    with pytest.raises(ValidationError) as err:
        with_errors(df, "user_features")
    assert len(err.value.errors) == 4 and "Missing required field: txn_count_5min" in str(err.value)


def test_split_is_complete_and_agrees_with_errors(spark):
    df = spark.createDataFrame([txn(), txn(user_id=None), txn(amount=None), txn(amount=7.0)], TXN)
    assert valid_rows(df, "transaction").count() == 2
    assert invalid_rows(df, "transaction").count() == 2
    assert invalid_rows(df, "transaction").where(F.size("errors") == 0).count() == 0


def test_fail_fast(spark):
    good = spark.createDataFrame([txn()], TXN)
    assert require_valid(good, "transaction") is good
    with pytest.raises(ValidationError) as err:
        require_valid(spark.createDataFrame([txn(amount=-1.0), txn(amount=-2.0)], TXN), "transaction")
    assert err.value.errors == ["amount must be positive: 2 rows"]


def test_error_counts(spark):
    df = spark.createDataFrame([txn(), txn(user_id="a"), txn(user_id="b", amount=None)], TXN)
    got = {r.error_type: r.n for r in error_counts(with_errors(df, "transaction")).collect()}
    assert got == {"Invalid user_id format": 2, "amount is required": 1}


def test_request_rules(spark):
    rows = [(" user_1\t", 100000.0, " travel", "US "), ("  ", 100000.01, "travel", "US"),
            ("u", float("nan"), "", "US"), ("u", float("inf"), "a", " "), ("u", 0.0, "a", "b")]
    df = spark.createDataFrame(rows, "user_id string, amount double, merchant_category string, merchant_country string")
    got = clean_requests(df).collect()
    assert (got[0].user_id, got[0].merchant_category, got[0].merchant_country) == ("user_1", "travel", "US")
    assert [r.errors for r in got] == [
        [], ["user_id cannot be empty", "amount exceeds maximum allowed value"],
        ["amount must be a finite number", "merchant_category cannot be empty"],
        ["amount exceeds maximum allowed value", "merchant_country cannot be empty"],
        ["amount must be positive"]]
