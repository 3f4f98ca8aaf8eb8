"""Enrichment of requests from the online table, and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.vector import risk_level, with_feature_vector
from riskloom.operators.joins import many_to_one
from riskloom.schemas import WINDOW_FEATURES


def lookup(requests: DataFrame, online: DataFrame) -> DataFrame:
    """Left-join requests to the live rows of the online table, one per user.

    Adds the window features as stored and whether a row was found. ``requests``
    may be a stream.
    """
    stored = online.select("user_id", *WINDOW_FEATURES)
    joined = many_to_one(requests, stored.withColumn("_hit", F.lit(True)), ["user_id"])
    return joined.withColumn("features_found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def score(
    requests: DataFrame, online: DataFrame, probability: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Score requests: lookup, model input, probability and risk level.

    ``probability`` adds the column of that name to a frame holding the seven
    inputs: a fitted model's ``scorer`` or a fixed rule.
    """
    vectors = with_feature_vector(lookup(requests, online))
    scored = probability(vectors)
    return scored.withColumns({
        "risk_level": risk_level(F.col("probability")),
        "fraud_probability": F.round("probability", 4),
    })


def rule_probability(df: DataFrame) -> DataFrame:
    """A fixed score on the model inputs, for monitoring and checks without a model."""
    return df.withColumn("probability", F.least(F.lit(1.0), rule_score()))


def rule_score() -> Column:
    return (
        F.lit(0.05)
        + F.lit(0.4) * F.col("is_suspicious")
        + F.lit(0.3) * F.col("is_high_amount")
        + F.lit(0.02) * F.col("txn_count_5min")
    )

