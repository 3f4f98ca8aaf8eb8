"""Validation rules as one array of messages per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.schemas import (
    AMOUNT_LIMIT, CATEGORIES, COUNTRIES, FLAG_FEATURES, TRANSACTION_ID_REGEX,
    USER_ID_REGEX, WINDOW_FEATURES,
)

REQUIRED = {
    "transaction": ["transaction_id", "user_id", "amount", "merchant_category",
                    "merchant_country", "timestamp"],
    "user_features": ["user_id", *WINDOW_FEATURES],
    "transaction_flags": ["transaction_id", "user_id", "amount", *FLAG_FEATURES],
}


class ValidationError(ValueError):
    """Raised by the fail-fast check; ``errors`` lists what was found."""

    def __init__(self, errors: list[str]):
        self.errors = list(errors)
        super().__init__("; ".join(self.errors))


def _shown(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def _error(broken: Column, prefix: str, name: str | None = None) -> Column:
    """The message when ``broken`` is true, else null."""
    text = F.lit(prefix) if name is None else F.concat(F.lit(prefix), _shown(name))
    return F.when(broken, text)


def _errors(checks: list[Column]) -> Column:
    return F.array_compact(F.array(*checks))


def _fails(test: Column) -> Column:
    """True when the test is false or unknown."""
    return ~F.coalesce(test, F.lit(False))


def _finite(name: str) -> Column:
    value = F.col(name).cast("double")
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def _user_id() -> Column:
    return _error(_fails(F.col("user_id").rlike(USER_ID_REGEX)), "Invalid user_id format: ", "user_id")


# The message texts below must equal the reference's.


def transaction_checks(countries: list[str] | None = None) -> list[Column]:
    """One message or null per rule, in the order they are reported."""
    amount = F.col("amount")
    # NaN is not positive; an infinity is, and exceeds the maximum.
    positive = ~F.isnan(amount.cast("double")) & (amount > 0)
    return [
        _error(_fails(F.col("transaction_id").rlike(TRANSACTION_ID_REGEX)),
               "Invalid transaction_id format: ", "transaction_id"),
        _user_id(),
        F.when(amount.isNull(), F.lit("amount is required"))
        .when(_fails(positive), F.concat(F.lit("amount must be positive: "), _shown("amount")))
        .when(amount >= AMOUNT_LIMIT, F.concat(F.lit("amount exceeds maximum: "), _shown("amount"))),
        _error(_fails(F.col("merchant_category").isin(CATEGORIES)),
               "Invalid merchant_category: ", "merchant_category"),
        _error(_fails(F.col("merchant_country").isin(countries or COUNTRIES)),
               "Invalid merchant_country: ", "merchant_country"),
        _error(_fails(F.length("timestamp") > 0), "Invalid timestamp: ", "timestamp"),
    ]


def user_feature_checks() -> list[Column]:
    checks = [_user_id()]
    for name in WINDOW_FEATURES:
        value = F.col(name)
        checks.append(
            F.when(value.isNull(), F.lit(f"{name} is required"))
            .when(value < 0, F.concat(F.lit(f"{name} must be non-negative: "), _shown(name)))
        )
    return checks


def flag_checks() -> list[Column]:
    """Flags may be booleans or the integers 0 and 1."""
    positive = _finite("amount") & (F.col("amount") > 0)
    checks = [_user_id(), _error(_fails(positive), "amount must be positive: ", "amount")]
    for name in FLAG_FEATURES:
        text = F.col(name).cast("string")
        checks.append(_error(_fails(text.isin("0", "1", "true", "false")),
                             f"{name} must be boolean: ", name))
    return checks


RULES = {
    "transaction": transaction_checks,
    "user_features": user_feature_checks,
    "transaction_flags": flag_checks,
}


def require_columns(df: DataFrame, kind: str) -> None:
    """Raise when a required column is absent; the other rules need them all."""
    missing = [c for c in REQUIRED[kind] if c not in df.columns]
    if missing:
        raise ValidationError([f"Missing required field: {c}" for c in missing])


def with_errors(df: DataFrame, kind: str) -> DataFrame:
    """Add the array column ``errors``, empty for a valid row."""
    require_columns(df, kind)
    return df.withColumn("errors", _errors(RULES[kind]()))


def is_valid() -> Column:
    return F.size("errors") == 0


def valid_rows(df: DataFrame, kind: str) -> DataFrame:
    """Rows that break no rule. Looks for a first error only and builds no array."""
    require_columns(df, kind)
    return df.where(F.coalesce(*RULES[kind]()).isNull())


def invalid_rows(df: DataFrame, kind: str) -> DataFrame:
    """Rows that break a rule, with their ``errors``."""
    require_columns(df, kind)
    return with_errors(df.where(F.coalesce(*RULES[kind]()).isNotNull()), kind)


def require_valid(df: DataFrame, kind: str) -> DataFrame:
    """Fail-fast mode: raise when any row is invalid, else return the frame."""
    bad = invalid_rows(df, kind)
    # Only the distinct kinds of error come to the driver; the rules bound them.
    found = error_counts(bad).orderBy("error_type").collect()
    if found:
        raise ValidationError([f"{r['error_type']}: {r['n']} rows" for r in found])
    return df


def error_type(message: Column) -> Column:
    """The rule a message belongs to: its text before the offending value."""
    return F.split_part(message, F.lit(":"), F.lit(1))


def error_counts(checked: DataFrame) -> DataFrame:
    """Rows per kind of error."""
    return (
        checked.select(F.explode("errors").alias("message"))
        .groupBy(error_type(F.col("message")).alias("error_type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def clean_requests(requests: DataFrame) -> DataFrame:
    """Trim the text fields of scoring requests and add their ``errors``.

    The upper bound is inclusive here, unlike in the transaction rule.
    """
    texts = ["user_id", "merchant_category", "merchant_country"]
    trimmed = requests.withColumns(
        {c: F.regexp_replace(c, r"\A\s+|\s+\z", "") for c in texts}
    )
    amount = F.col("amount")
    amount_error = (
        F.when(amount <= 0, F.lit("amount must be positive"))
        .when((amount > AMOUNT_LIMIT) & ~F.isnan(amount.cast("double")),
              F.lit("amount exceeds maximum allowed value"))
        .when(_fails(_finite("amount")), F.lit("amount must be a finite number"))
    )
    blank = [_error(_fails(F.length(c) > 0), f"{c} cannot be empty") for c in texts]
    return trimmed.withColumn("errors", _errors([blank[0], amount_error, *blank[1:]]))
