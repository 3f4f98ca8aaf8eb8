"""Per-transaction flags as native column expressions and SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.schemas import FLAG_COLUMNS, HIGH_AMOUNT, HOME_COUNTRY, SUSPICIOUS_AMOUNT


def _above(amount: Column, threshold: float) -> Column:
    # Spark orders NaN above every number, so it has to be excluded by name.
    return (amount > F.lit(threshold)) & ~F.isnan(amount)


def is_foreign(country: Column) -> Column:
    """1 unless the country is the home country; an unknown country is foreign."""
    return F.when(country.eqNullSafe(HOME_COUNTRY), 0).otherwise(1)


def is_high_amount(amount: Column) -> Column:
    return F.when(_above(amount, HIGH_AMOUNT), 1).otherwise(0)


def is_suspicious(country: Column, amount: Column) -> Column:
    """1 for a foreign transaction above the suspicious amount."""
    home = country.eqNullSafe(HOME_COUNTRY)
    return F.when(~home & _above(amount, SUSPICIOUS_AMOUNT), 1).otherwise(0)


def with_flags(df: DataFrame, country: str = "merchant_country", amount: str = "amount") -> DataFrame:
    """Add the three flags, computed from the row's own amount and country."""
    c, a = F.col(country), F.col(amount)
    return df.withColumns({
        "is_foreign": is_foreign(c),
        "is_high_amount": is_high_amount(a),
        "is_suspicious": is_suspicious(c, a),
    })


def flag_rows(transactions: DataFrame) -> DataFrame:
    """The nine columns of the flag stream."""
    return with_flags(transactions).select(*FLAG_COLUMNS)


def register_sql(spark: SparkSession) -> None:
    """Make the flags callable from SQL. Catalyst inlines the bodies."""
    above = "amount > {0} AND NOT isnan(amount)"
    bodies = {
        "risk_is_foreign(country STRING)": f"NOT (country <=> '{HOME_COUNTRY}')",
        "risk_is_high_amount(amount DOUBLE)": above.format(HIGH_AMOUNT),
        "risk_is_suspicious(country STRING, amount DOUBLE)":
            f"NOT (country <=> '{HOME_COUNTRY}') AND " + above.format(SUSPICIOUS_AMOUNT),
    }
    for signature, test in bodies.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS INT "
            f"RETURN CASE WHEN {test} THEN 1 ELSE 0 END"
        )
