"""Counters, histograms, rates and quantiles over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.windows import exact_sum
from riskloom.schemas import AMOUNT_BOUNDS


def counts_by(df: DataFrame, *labels: str) -> DataFrame:
    """A counter with labels."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def bucket_name(bound: float) -> str:
    return f"le_{bound}"


def amount_histogram(
    df: DataFrame, *groups: str | Column, value: str = "amount", bounds: list[float] = AMOUNT_BOUNDS
) -> DataFrame:
    """Cumulative bucket counts, ``le_inf``, the count and the sum, in one pass.

    The sum is exact, and null where a value cannot be summed exactly.
    """
    x = F.col(value)
    observed = df.where(x.isNotNull())
    return observed.groupBy(*groups).agg(
        *[F.count_if(x <= b).alias(bucket_name(b)) for b in bounds],
        F.count(F.lit(1)).alias("le_inf"),
        exact_sum(x).cast("double").alias("total"),
    )


def histogram_quantile(q: float, bounds: list[float] = AMOUNT_BOUNDS) -> Column:
    """Quantile of a histogram row, linear inside the bucket it falls in.

    The first bucket starts at 0; beyond the last bound that bound is returned.
    An expression on the bucket columns, so it adds no shuffle.
    """
    wanted = F.lit(float(q)) * F.col("le_inf")
    result = F.when(F.col("le_inf") == 0, F.lit(None).cast("double"))
    low, before = 0.0, F.lit(0)
    for bound in bounds:
        upto = F.col(bucket_name(bound))
        share = F.try_divide(wanted - before, (upto - before).cast("double"))
        result = result.when(
            upto >= wanted, F.coalesce(F.lit(low) + F.lit(float(bound) - low) * share, F.lit(float(bound)))
        )
        low, before = float(bound), upto
    return result.otherwise(F.lit(float(bounds[-1])))


def rate(
    df: DataFrame, *labels: str, time: str = "event_time", seconds: int = 300
) -> DataFrame:
    """Events per second and label in consecutive intervals."""
    return (
        df.where(F.col(time).isNotNull())
        .groupBy(F.window(time, f"{seconds} seconds"), *labels)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("window.start").alias("interval_start"), *labels,
            "n", (F.col("n") / F.lit(float(seconds))).alias("per_second"),
        )
    )


def last_value(df: DataFrame, value: str, time: str = "event_time", key: str = "transaction_id") -> DataFrame:
    """The value of the newest row; ties in time go to the greatest key."""
    order = F.struct(F.col(time), F.col(key))
    return df.where(F.col(time).isNotNull()).agg(F.max_by(value, order).alias(value))


def counter_rate(
    samples: DataFrame, *labels: str, time: str = "time", value: str = "value", seconds: int = 300, step: int = 60
) -> DataFrame:
    """Per-second increase of counters over sliding intervals, evaluated every ``step`` seconds.

    ``samples`` holds what counters showed: a time, a value and labels that name the
    series. An evaluation at t sees the samples in (t - seconds, t]; with fewer than two
    it gives nothing. Where a counter shows less than before it has started anew, and
    what it shows counts as increase. The increase between first and last sample is
    extended to the ends of the interval, by half a mean distance of samples at most
    where the series begins or ends inside, and never below a counter of zero.

    A sample is repeated for the seconds / step evaluations that see it; what a group
    holds is the samples of one interval, so no series is one task's work.
    """
    at = F.col(time).cast("double")
    first_seen = F.ceil(at / step) * step
    # An evaluation at the sample's own time plus ``seconds`` no longer sees it.
    evaluated = F.sequence(first_seen, F.ceil((at + seconds) / step) * step - step, F.lit(step).cast("bigint"))
    seen = samples.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(
        *labels, F.explode(evaluated).alias("_t"), F.struct(at.alias("at"), F.col(value).cast("double").alias("v")).alias("_s"))
    groups = seen.groupBy(*labels, "_t").agg(F.sort_array(F.collect_list("_s")).alias("s")).where(F.size("s") > 1)
    s, n = F.col("s"), F.size("s")
    first, last = F.element_at(s, 1), F.element_at(s, -1)
    added = F.aggregate(
        F.slice(s, 2, n), F.struct(F.lit(0.0).alias("sum"), first["v"].alias("before")),
        lambda a, x: F.struct(
            (a["sum"] + F.when(x["v"] < a["before"], x["v"]).otherwise(x["v"] - a["before"])).alias("sum"),
            x["v"].alias("before")),
        lambda a: a["sum"])
    base = groups.select(
        *labels, F.col("_t"), n.alias("n"), added.alias("increase"), first["v"].alias("shown"),
        (last["at"] - first["at"]).alias("covered"),
        (first["at"] - (F.col("_t") - seconds)).alias("before"), (F.col("_t") - last["at"]).alias("after"))
    mean = F.col("covered") / (F.col("n") - 1)
    to_zero = F.col("covered") * (F.col("shown") / F.col("increase"))
    before = F.when((F.col("increase") > 0) & (F.col("shown") >= 0) & (to_zero < F.col("before")), to_zero).otherwise(F.col("before"))

    def extended(distance: Column) -> Column:
        return F.when(distance < mean * 1.1, distance).otherwise(mean / 2)

    whole = F.col("covered") + extended(before) + extended(F.col("after"))
    return base.where(F.col("covered") > 0).select(
        F.timestamp_seconds("_t").alias("evaluated_at"), *labels, F.col("n").cast("bigint").alias("n_samples"), "increase",
        (F.col("increase") * (whole / F.col("covered")) / seconds).alias("per_second"))


# Items a sketch keeps at its largest level; the error of a rank is about 1.7 / k.
SKETCH_K, RANK_ERROR = 200, 0.0133


def quantile_sketches(
    df: DataFrame, *labels: str, value: str = "amount", time: str = "event_time", seconds: int = 60
) -> DataFrame:
    """A mergeable quantile sketch of each interval and label: a few kilobytes however many values.

    Null and NaN values are left out, as are rows without time.
    """
    x = F.col(value).cast("double")
    return (
        df.where(F.col(time).isNotNull() & x.isNotNull() & ~F.isnan(x))
        .groupBy(F.window(time, f"{seconds} seconds")["start"].alias("interval_start"), *labels)
        .agg(F.kll_sketch_agg_double(x, SKETCH_K).alias("sketch"), F.count(F.lit(1)).alias("n"))
    )


def merged_quantiles(
    sketches: DataFrame, quantiles: dict[str, float], *labels: str, seconds: int = 300
) -> DataFrame:
    """Quantiles over longer intervals out of the sketches of shorter ones."""
    return (
        sketches.groupBy(F.window("interval_start", f"{seconds} seconds")["start"].alias("interval_start"), *labels)
        .agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"), F.sum("n").alias("n"))
        .select(
            "interval_start", *labels, "n",
            *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in quantiles.items()])
    )
