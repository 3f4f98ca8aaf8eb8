"""The model input and what follows from a probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.flags import is_foreign, is_high_amount, is_suspicious
from riskloom.schemas import FEATURE_ORDER, HIGH_RISK, MEDIUM_RISK, WINDOW_FEATURES


def or_zero(value: Column) -> Column:
    """The value as a double; null and NaN become 0.0."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def with_feature_vector(
    df: DataFrame, amount: str = "amount", country: str = "merchant_country"
) -> DataFrame:
    """Replace the window columns by their zero-filled form and add the flags as doubles.

    Used unchanged for training rows, for requests and on streams, so both
    sides see the same input. Window columns that are missing altogether count
    as no recent activity.
    """
    a, c = F.col(amount), F.col(country)
    columns = {
        name: or_zero(F.col(name)) if name in df.columns else F.lit(0.0)
        for name in WINDOW_FEATURES
    }
    columns["is_foreign"] = is_foreign(c).cast("double")
    columns["is_high_amount"] = is_high_amount(a).cast("double")
    columns["is_suspicious"] = is_suspicious(c, a).cast("double")
    return df.withColumns(columns)


def feature_matrix(df: DataFrame, *keys: str) -> DataFrame:
    """Only the key columns and the seven inputs, in model order."""
    return with_feature_vector(df).select(*keys, *FEATURE_ORDER)


def rule_label() -> Column:
    """Rule that labels a feature row when no label exists (1 = fraud)."""
    large_and_odd = (F.col("is_suspicious") == 1) & (F.col("is_high_amount") == 1)
    burst_abroad = (F.col("txn_count_5min") > 10) & (F.col("is_foreign") == 1)
    return (large_and_odd | burst_abroad).cast("int")


def risk_level(probability: Column) -> Column:
    return (
        F.when(probability > HIGH_RISK, "HIGH")
        .when(probability > MEDIUM_RISK, "MEDIUM")
        .otherwise("LOW")
    )


def has_window(prefix: str = "") -> Column:
    """True when every window feature of the row is present."""
    found = F.lit(True)
    for name in WINDOW_FEATURES:
        found = found & F.col(prefix + name).isNotNull()
    return found
