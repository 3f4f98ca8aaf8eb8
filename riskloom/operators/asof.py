"""Point-in-time join: the newest feature row not after each entity row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ranges import earlier_ranges, in_ranges, with_start
from riskloom.schemas import USER_VIEW, FeatureView


def pit_join(
    entities: DataFrame,
    features: DataFrame,
    view: FeatureView = USER_VIEW,
    time: str = "event_timestamp",
    refs: list[str] | None = None,
    keep_timestamp: bool = False,
) -> DataFrame:
    """Attach to each entity row the last feature row of its key with
    ``timestamp <= time``, at most ``view.ttl`` seconds old (inclusive).

    Every entity row is kept; without a match its features are null.
    """
    names = view.select_refs(refs) if refs else list(view.fields)
    features = features.select(view.entity, view.timestamp, *names)
    if view.step and view.ttl:
        joined = _join_on_grid(entities, features, view, time)
    else:
        joined = _join_in_ranges(entities, features, view, time)
    if view.ttl:
        fresh = F.unix_micros(time) - F.unix_micros(view.timestamp) <= view.ttl * 1_000_000
        joined = joined.withColumns(
            {c: F.when(fresh, F.col(c)) for c in [view.timestamp, *names]}
        )
    kept = [view.timestamp] if keep_timestamp else []
    return joined.select(*entities.columns, *kept, *names)


def _join_on_grid(entities, features, view, time):
    """Feature times lie on a grid, so rows of the same grid step see the same row.

    Each feature row is repeated for the steps it answers for: up to its
    successor or its expiry, at most ``ttl / step + 1`` of them. That leaves one
    row per key and step, and entity rows are shuffled once, for an equi-join.
    A busy key is spread over its steps, and a busy step is split by AQE.
    """
    stamp = F.col(view.timestamp)
    step = F.floor(F.unix_seconds(stamp) / view.step)
    on_grid = F.unix_micros(stamp) % (view.step * 1_000_000) == 0
    checked = F.when(on_grid, step).otherwise(
        F.raise_error(F.lit(f"{view.timestamp} is not a multiple of {view.step} s")).cast("bigint")
    )
    successor = F.lead("_step").over(Window.partitionBy(view.entity).orderBy("_step"))
    last_step = F.col("_step") + view.ttl // view.step
    answers = (
        features.where(stamp.isNotNull())
        .withColumn("_step", checked)
        .withColumn("_until", F.least(last_step, successor - 1))
        .where(F.col("_until") >= F.col("_step"))
        .withColumn("_step", F.explode(F.sequence("_step", "_until")))
        .drop("_until")
    )
    asked = entities.withColumn("_step", F.floor(F.unix_seconds(time) / view.step))
    return asked.join(answers, [view.entity, "_step"], "left").drop("_step")


def _join_in_ranges(entities, features, view, time):
    """Any timestamps and any age: a running last feature row, cut into ranges.

    Entity and feature rows are laid out together by key and time, whole, so
    both are computed once and nothing is joined back. Inside a range a window
    carries the last feature row forward; where a limit cuts a key, the ranges
    before hand over theirs. Features at the instant of an entity row come first.
    """
    columns = [c for c in features.columns if c != view.entity]
    held = features.where(F.col(view.timestamp).isNotNull() & F.col(view.entity).isNotNull()).select(
        F.col(view.entity).alias("_key"), F.col(view.timestamp).alias("_t"), F.lit(0).alias("_side"),
        F.struct(*columns).alias("_row"), F.lit(None).cast(entities.schema).alias("_asked"),
    )
    asked = entities.select(
        F.col(view.entity).alias("_key"), F.col(time).alias("_t"), F.lit(1).alias("_side"),
        F.lit(None).cast(features.select(*columns).schema).alias("_row"), F.struct(*entities.columns).alias("_asked"),
    )
    # Rows of one instant may be many; their contents tell them apart.
    ranged = in_ranges(held.unionByName(asked), "_key", "_t", "_side", F.xxhash64("_asked"))

    is_feature = F.col("_side") == 0
    row = F.col("_row")
    newest = ranged.groupBy("_key", "_range").agg(
        F.max(F.when(is_feature, F.col("_t"))).alias("_newest"),
        *[F.max_by(row[c], F.when(is_feature, F.col("_t"))).alias(f"_newest_{c}") for c in columns],
    )
    last = F.when(F.col("_newest").isNotNull(), F.struct(*[F.col(f"_newest_{c}").alias(c) for c in columns]))
    starts = newest.select(
        "_key", "_range", F.last(last, ignorenulls=True).over(earlier_ranges("_key")).alias("_before")
    ).where(F.col("_before").isNotNull())

    so_far = (
        Window.partitionBy("_range", "_key").orderBy("_t", "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    answered = ranged.withColumn("_in", F.last("_row", ignorenulls=True).over(so_far)).where(~is_feature)
    # An entity row without a time is before everything.
    hit = F.when(F.col("_t").isNotNull(), F.coalesce("_in", "_before"))
    return with_start(answered, starts, "_key").withColumn("_hit", hit).select(
        *[F.col("_asked")[c].alias(c) for c in entities.columns],
        *[F.col("_hit")[c].alias(c) for c in columns],
    )
