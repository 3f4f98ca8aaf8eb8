from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.functions.flags import FLAG_COLUMNS, flag_rows, register_sql, with_flags
from riskloom.functions.vector import feature_matrix, risk_level, rule_label
from riskloom.schemas import FEATURE_ORDER, HIGH_AMOUNT, SUSPICIOUS_AMOUNT

SCHEMA = "merchant_country string, amount double"
CASES = [
    ("US", 10.0, (0, 0, 0)),
    ("US", 501.0, (0, 1, 0)),
    ("US", 500.0, (0, 0, 0)),
    ("NG", 200.0, (1, 0, 0)),
    ("NG", 201.0, (1, 0, 1)),
    ("CN", 800.0, (1, 1, 1)),
    ("us", 800.0, (1, 1, 1)),
    (None, 300.0, (1, 0, 1)),
    ("NG", None, (1, 0, 0)),
    (None, None, (1, 0, 0)),
    ("NG", float("nan"), (1, 0, 0)),
    ("NG", -5.0, (1, 0, 0)),
]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, c, a) for i, (c, a, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "i int, " + SCHEMA)


def test_flags(cases):
    got = with_flags(cases).orderBy("i").collect()
    assert [(r.is_foreign, r.is_high_amount, r.is_suspicious) for r in got] == [f for *_, f in CASES]


def test_sql_functions_agree(spark, cases):
    register_sql(spark)
    cases.createOrReplaceTempView("flag_cases")
    got = spark.sql(
        "SELECT risk_is_foreign(merchant_country) f, risk_is_high_amount(amount) h, "
        "risk_is_suspicious(merchant_country, amount) s FROM flag_cases ORDER BY i"
    ).collect()
    assert [tuple(r) for r in got] == [f for *_, f in CASES]


def test_flag_types_and_thresholds(cases):
    types = dict(with_flags(cases).dtypes)
    assert types["is_foreign"] == types["is_high_amount"] == types["is_suspicious"] == "int"
    assert 0 < SUSPICIOUS_AMOUNT < HIGH_AMOUNT


def test_flag_projection_columns(spark):
    row = spark.range(1).selectExpr(
        "'t' transaction_id", "'u' user_id", "1.0D amount", "'US' merchant_country",
        "'travel' merchant_category", "current_timestamp() event_time", "1 extra",
    )
    assert flag_rows(row).columns == FLAG_COLUMNS


def test_vector_order_and_missing_values(spark):
    rows = [(1, None, 1.0, float("nan"), 700.0, "US"), (2, 50.0, 25.0, 8000.0, 25.0, "NG")]
    df = spark.createDataFrame(
        rows, "txn_count_5min long, total_amount_5min double, avg_amount_5min double, "
        "max_amount_5min double, amount double, merchant_country string")
    got = feature_matrix(df)
    assert got.columns == FEATURE_ORDER and {t for _, t in got.dtypes} == {"double"}
    assert [tuple(r) for r in got.collect()] == [
        (1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0),
        (2.0, 50.0, 25.0, 8000.0, 1.0, 0.0, 0.0),
    ]


def test_vector_without_window_columns(spark):
    df = spark.createDataFrame([(700.0, "US")], "amount double, merchant_country string")
    assert tuple(feature_matrix(df).first()) == (0, 0, 0, 0, 0, 1, 0)


def test_risk_level_edges(spark):
    df = spark.createDataFrame([(0.7,), (0.71,), (0.4,), (0.41,), (0.0,)], "p double")
    got = [r[0] for r in df.select(risk_level(F.col("p"))).collect()]
    assert got == ["MEDIUM", "HIGH", "LOW", "MEDIUM", "LOW"]


def test_rule_label(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 1.0, 0.0), (1.0, 0.0, 1.0, 10.0), (1.0, 0.0, 0.0, 11.0), (0.0, 1.0, 0.0, 20.0)],
        "is_foreign double, is_high_amount double, is_suspicious double, txn_count_5min double")
    assert [r[0] for r in df.select(rule_label()).collect()] == [1, 0, 1, 0]
