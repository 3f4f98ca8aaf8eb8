"""Join of a large table with a table that has at most one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def many_to_one(
    many: DataFrame, one: DataFrame, keys: list[str], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Equi-join in which one key may hold any share of the rows of ``many``.

    AQE splits an oversized partition of a join only when both inputs come
    straight out of a shuffle. ``one`` usually comes out of an aggregation on
    the same keys, whose partitioning the join would reuse. Joining on a hash of
    the keys as well asks for a partitioning the aggregation does not have, so
    its (small) result is shuffled and a hot key of ``many`` can be split over
    tasks. Where AQE measures ``one`` below the broadcast limit it broadcasts it.
    With ``null_safe`` null is a key like any other.
    """
    extra = F.xxhash64(*keys)
    if null_safe:
        renamed = one.withColumn("_key_hash", extra).withColumnsRenamed(
            {k: f"_one_{k}" for k in [*keys, "_key_hash"]})
        left = many.withColumn("_key_hash", extra)
        same = [F.col(k).eqNullSafe(F.col(f"_one_{k}")) for k in keys]
        joined = left.join(renamed, [F.col("_key_hash") == F.col("_one__key_hash"), *same], how)
        return joined.drop("_key_hash", *[f"_one_{k}" for k in [*keys, "_key_hash"]])
    joined = many.withColumn("_key_hash", extra).join(
        one.withColumn("_key_hash", extra), [*keys, "_key_hash"], how
    )
    return joined.drop("_key_hash")
