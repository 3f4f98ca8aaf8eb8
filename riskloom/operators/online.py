"""The online rows: latest values per key that live for a limited time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.windows import latest_window, newest, select_trailing_window
from riskloom.schemas import FLAG_FEATURES, FLAGS_TTL, SLIDING, USER_FEATURES_TTL, SlidingSpec


def newest_per_key(rows: DataFrame, keys: list[str], version: str = "batch_id") -> DataFrame:
    """The row with the greatest version of each key, whole, also among copies."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), version).alias("_row"))
        .select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in rows.columns])
    )


def current_windows(deltas: DataFrame) -> DataFrame:
    """Each window as the newest batch that touched it left it.

    ``updated_at`` becomes the time any window of the user was last touched.
    """
    touched = F.max("updated_at").over(Window.partitionBy("user_id"))
    return newest(deltas, ["user_id", "window_start"], "batch_id").withColumn("updated_at", touched)


def merge_user_windows(deltas: DataFrame, spec: SlidingSpec = SLIDING) -> DataFrame:
    """One row per user out of all windows the batches touched.

    A batch carries complete aggregates, so the newest batch of a window wins;
    then the trailing window is chosen per user. Choosing first and letting the
    last batch win would put an older or stale window in place after a late event.
    """
    rows = [c for c in deltas.columns if c != "batch_id"]
    return select_trailing_window(current_windows(deltas).select(*rows), spec)


def with_expiry(rows: DataFrame, ttl: int) -> DataFrame:
    return rows.withColumn(
        "expires_at", F.col("updated_at") + F.expr(f"interval {ttl} seconds")
    )


def live(rows: DataFrame, as_of: Column) -> DataFrame:
    """Rows that have not expired at ``as_of``."""
    return rows.where(F.col("expires_at") > as_of)


def materialize(windows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Online rows from closed windows that end in ``(start, end]``: the newest per user."""
    inside = windows.where((F.col("window_end") > start) & (F.col("window_end") <= end))
    rows = latest_window(inside).withColumn("updated_at", F.col("window_end"))
    return with_expiry(rows, USER_FEATURES_TTL)


def _decimal_text(value: Column) -> Column:
    """A double rounded to cents, written without an exponent and with no idle zero."""
    return F.regexp_replace(
        F.round(value, 2).cast("decimal(38,2)").cast("string"), r"(\.[0-9])0\z", "$1"
    )


def _plain_text(value: Column) -> Column:
    """A double with all its digits, written without an exponent where it has at most 18 on either side."""
    digits = F.regexp_replace(value.try_cast("decimal(38,18)").cast("string"), r"0+\z", "")
    whole = F.abs(value) < F.lit(1e17)
    # Below a thousandth the text of the double may have more digits than fit.
    fits = whole & ((value == 0) | (F.abs(value) >= F.lit(1e-3)))
    return F.when(fits, F.regexp_replace(digits, r"\.\z", ".0")).otherwise(value.cast("string"))


def _instant(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def _now_text(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def _string_map(fields: dict[str, Column]) -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(k) for k in fields]), F.array(*fields.values())
    )


def user_hashes(rows: DataFrame) -> DataFrame:
    """Key, string map and TTL of user rows, for a store that holds text."""
    fields = {"user_id": F.col("user_id"), "txn_count_5min": F.col("txn_count_5min").cast("string")}
    for name in ("total_amount_5min", "avg_amount_5min", "max_amount_5min"):
        fields[name] = _decimal_text(F.col(name))
    fields["window_start"] = _instant(F.col("window_start"))
    fields["window_end"] = _instant(F.col("window_end"))
    fields["updated_at"] = _now_text(F.col("updated_at"))
    return rows.select(
        F.concat(F.lit("user_features:"), F.col("user_id")).alias("key"),
        _string_map(fields).alias("fields"),
        F.lit(USER_FEATURES_TTL).alias("ttl"),
    )


def flag_hashes(rows: DataFrame) -> DataFrame:
    """Key, string map and TTL of flag rows."""
    fields = {
        "transaction_id": F.col("transaction_id"),
        "user_id": F.col("user_id"),
        "amount": _plain_text(F.col("amount")),
        **{name: F.col(name).cast("string") for name in FLAG_FEATURES},
        "scored_at": _now_text(F.col("updated_at")),
    }
    return rows.select(
        F.concat(F.lit("txn_flags:"), F.col("transaction_id")).alias("key"),
        _string_map(fields).alias("fields"),
        F.lit(FLAGS_TTL).alias("ttl"),
    )


def from_hashes(hashes: DataFrame) -> DataFrame:
    """User rows read back from their text form; unreadable numbers become null."""
    text = F.col("fields")
    numbers = ["total_amount_5min", "avg_amount_5min", "max_amount_5min"]
    return hashes.select(
        text["user_id"].alias("user_id"),
        text["txn_count_5min"].try_cast("double").alias("txn_count_5min"),
        *[text[n].try_cast("double").alias(n) for n in numbers],
    )
