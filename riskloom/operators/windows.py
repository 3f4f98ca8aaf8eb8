"""Sliding-window features per user, and the choice of one window per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.schemas import SLIDING, SlidingSpec


def _seconds(n: int) -> str:
    return f"{n} seconds"


def exact_sum(amount: Column) -> Column:
    """A sum that is the same in every order: 18 digits on either side of the point.

    An amount that this cannot hold (NaN, an infinity, 1e20 or more) makes the
    sum null instead of being left out.
    """
    exact = amount.try_cast("decimal(38,18)")
    lost = F.count_if(amount.isNotNull() & exact.isNull())
    return F.when(lost == 0, F.try_sum(exact))


def _total(cents: bool) -> list[Column]:
    """The sum, and how many amounts it could not hold."""
    amount = F.col("amount")
    if not cents:
        return [F.sum(amount).alias("total"), F.lit(0).cast("bigint").alias("lost")]
    exact = amount.try_cast("decimal(38,18)")
    return [F.try_sum(exact).alias("total"), F.count_if(amount.isNotNull() & exact.isNull()).alias("lost")]


def window_columns(end: Column, spec: SlidingSpec) -> list[Column]:
    """The columns of a window from its measures."""
    size = F.expr(f"interval {spec.size} seconds")
    total = F.when(F.col("lost") == 0, F.col("total").cast("double"))
    return [
        F.col("user_id"),
        (end - size).alias("window_start"),
        end.alias("window_end"),
        F.col("n").alias("txn_count_5min"),
        total.alias("total_amount_5min"),
        F.try_divide(total, F.col("n_amounts").cast("double"))
        .alias("avg_amount_5min"),
        F.col("largest").alias("max_amount_5min"),
    ]


def _measures(cents: bool) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.count("amount").alias("n_amounts"),
        *_total(cents),
        F.max("amount").alias("largest"),
    ]


def _merged() -> list[Column]:
    return [
        F.sum("n").alias("n"),
        F.sum("n_amounts").alias("n_amounts"),
        F.try_sum("total").alias("total"),
        F.sum("lost").alias("lost"),
        F.max("largest").alias("largest"),
    ]


def _panes(transactions: DataFrame, spec: SlidingSpec, cents: bool, *more: Column) -> DataFrame:
    """One row per user and slide interval, numbered from the epoch.

    Rows without event time belong to no interval. ``more`` are further measures.
    """
    pane = F.floor(F.unix_seconds("event_time") / spec.slide)
    return (
        transactions
        .where(F.col("event_time").isNotNull())
        .groupBy("user_id", pane.alias("pane"))
        .agg(*_measures(cents), *more)
    )


def _pane_end(pane: Column, spec: SlidingSpec) -> Column:
    return F.timestamp_seconds((pane + 1) * spec.slide)


def watermarked(transactions: DataFrame, spec: SlidingSpec = SLIDING) -> DataFrame:
    return transactions.withWatermark("event_time", _seconds(spec.watermark))


def windowed_features(
    transactions: DataFrame,
    spec: SlidingSpec = SLIDING,
    cents: bool = True,
    has_watermark: bool = False,
) -> DataFrame:
    """Count, sum, average and maximum per user and sliding window.

    On a stream this is one watermarked window aggregation. On a table each
    transaction is aggregated into its slide interval first, so the fivefold
    expansion into windows works on intervals: what crosses the second shuffle
    grows with users and minutes, however many transactions one user has.
    """
    if transactions.isStreaming:
        late_limited = transactions if has_watermark else watermarked(transactions, spec)
        windows = (
            late_limited
            .groupBy(F.window("event_time", _seconds(spec.size), _seconds(spec.slide)), "user_id")
            .agg(*_measures(cents))
        )
        return windows.select(*window_columns(F.col("window.end"), spec))
    # An interval belongs to the windows that end with it or up to size - slide
    # later. Distribution by user is kept by explode, so it also serves the
    # aggregation and whatever is grouped by user next.
    last_panes = F.sequence("pane", F.col("pane") + spec.panes - 1)
    return (
        _panes(transactions, spec, cents)
        .repartition("user_id")
        .withColumn("last_pane", F.explode(last_panes))
        .groupBy("user_id", "last_pane")
        .agg(*_merged())
        .select(*window_columns(_pane_end(F.col("last_pane"), spec), spec))
    )


def newest(df: DataFrame, keys: list[str | Column], order: str) -> DataFrame:
    """The row with the greatest ``order`` per key, where no key has that value twice.

    Column by column, which for numbers and times is a hash aggregation.
    """
    names = [k for k in keys if isinstance(k, str)]
    rest = [c for c in df.columns if c not in (*names, order)]
    return df.groupBy(*keys).agg(
        F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest]
    )


def _newest_by_phase(df: DataFrame, time: str, phase: Column) -> DataFrame:
    """Per user, the newest row of each residue of time modulo the window length.

    Rows at most one window length behind a user's newest time all have
    different residues, so they are all kept, in one row per residue and user,
    and the aggregation combines before it shuffles.
    """
    return newest(df, ["user_id", phase.alias("_phase")], time).drop("_phase")


def select_trailing_window(windows: DataFrame, spec: SlidingSpec = SLIDING) -> DataFrame:
    """Per user, the oldest window that still contains the newest activity.

    The window with the newest start has only just opened; the one chosen here
    reaches back furthest among those that end after that start. Expects one
    row per user and window start.
    """
    phase = F.pmod(F.floor(F.unix_seconds("window_start") / spec.slide), F.lit(spec.panes))
    opened = F.max("window_start").over(Window.partitionBy("user_id"))
    reach = F.expr(f"interval {spec.size} seconds")
    recent = (
        _newest_by_phase(windows, "window_start", phase)
        .withColumn("_opened", opened)
        .where(F.col("window_start") > F.col("_opened") - reach)
    )
    # At most one row a phase is left; the user's oldest is taken column by column.
    rest = [c for c in windows.columns if c not in ("user_id", "window_start")]
    return recent.groupBy("user_id").agg(
        F.min("window_start").alias("window_start"), *[F.min_by(c, "window_start").alias(c) for c in rest]
    ).select(*windows.columns)


def trailing_features(
    transactions: DataFrame, spec: SlidingSpec = SLIDING, cents: bool = True, last_event: str | None = None
) -> DataFrame:
    """The trailing window of each user straight from transactions.

    Same rows as ``select_trailing_window(windowed_features(..))`` without
    building the other windows: the newest intervals of a user are added up.
    ``last_event`` names a further column for the time of the user's last event.
    """
    last = [last_event] if last_event else []
    return trailing_of_panes(
        _panes(transactions, spec, cents, *[F.max("event_time").alias(name) for name in last]), spec, last)


def merged_panes(pieces: DataFrame, last: list[str]) -> DataFrame:
    """One row per user and interval out of several pieces; of ``last`` columns the maximum."""
    return pieces.groupBy("user_id", "pane").agg(*_merged(), *[F.max(name).alias(name) for name in last])


def trailing_of_panes(panes: DataFrame, spec: SlidingSpec, last: list[str]) -> DataFrame:
    """The trailing window of each user from one row per user and interval.

    Of the columns ``last`` the window has the maximum.
    """
    recent = (
        _newest_by_phase(panes, "pane", F.pmod(F.col("pane"), F.lit(spec.panes)))
        .withColumn("newest", F.max("pane").over(Window.partitionBy("user_id")))
        .where(F.col("pane") > F.col("newest") - spec.panes)
    )
    return (
        recent.groupBy("user_id", "newest")
        .agg(*_merged(), *[F.max(name).alias(name) for name in last])
        .select(*window_columns(_pane_end(F.col("newest"), spec), spec), *last)
    )


def latest_window(windows: DataFrame) -> DataFrame:
    """Per user, the window with the newest start.

    Covers only about the last minute; kept to show that the trailing choice
    differs, and used to materialise closed windows.
    """
    return newest(windows, ["user_id"], "window_start").select(*windows.columns)


def closed_windows(windows: DataFrame, watermark: Column) -> DataFrame:
    """The windows an append-mode stream has emitted once it reached ``watermark``."""
    return windows.where(F.col("window_end") <= watermark)

