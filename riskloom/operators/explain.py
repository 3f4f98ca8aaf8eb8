"""Contributions, top contributors and reasons for a score."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import shapley
from riskloom.operators.model import importances
from riskloom.schemas import (
    FEATURE_MAXIMA, FEATURE_ORDER, FLAG_FEATURES, FLAG_WEIGHT, HIGH_AMOUNT, MEDIUM_RISK,
    SUSPICIOUS_AMOUNT,
)

# --- fixed values: wording of the reasons and the limits they name -----------
SUSPICIOUS_REASON = f"Foreign transaction exceeds suspicious threshold (${SUSPICIOUS_AMOUNT}) — country="
FOREIGN_REASON = "Foreign merchant country (%s)"
HIGH_AMOUNT_REASON = f"High-value transaction ($%.2f > ${HIGH_AMOUNT} threshold)"
HIGH_VELOCITY, HIGH_VELOCITY_REASON = 10, "High velocity: %.0f transactions in last 5 minutes"
SOME_VELOCITY, SOME_VELOCITY_REASON = 5, "Elevated velocity: %.0f transactions in last 5 minutes"
PEAK_AMOUNT, PEAK_REASON = 1000, "Peak amount in window is high ($%.2f)"
LARGE_TOTAL, TOTAL_REASON = 5000, "Large total volume in window ($%.2f in 5 min)"
MODEL_REASON = "Model flagged transaction — pattern matches historical fraud"
NO_REASON = "No strong fraud indicators in this transaction"
UP, DOWN = "increases risk", "decreases risk"
METHOD, EXACT_METHOD = "importance_fallback", "shap"
# --- end of fixed values ------------------------------------------------------


def normalised(importances: list[float] | None) -> list[float]:
    """Importances summing to 1; equal ones when there is not one per feature."""
    n = len(FEATURE_ORDER)
    if importances is None or len(importances) != n:
        return [1 / n] * n
    total = float(sum(importances))
    return [float(i) / total if total > 0 else float(i) for i in importances]


def contributions(importances: list[float] | None) -> dict[str, Column]:
    """One expression per feature: importance times how active the feature is.

    Window features count from 0 up to their maximum and are cut off above only;
    flags pull down when 0 and up when 1.
    """
    weights = normalised(importances)
    columns = {}
    for name, weight, top in zip(FEATURE_ORDER, weights, FEATURE_MAXIMA):
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        if name in FLAG_FEATURES:
            activity = (value * 2 - 1) * FLAG_WEIGHT
        else:
            activity = F.least(value / F.lit(top), F.lit(1.0))
        columns[name] = F.lit(weight) * activity
    return columns


def exact_contributions(values: str = "shapley") -> dict[str, Column]:
    """One expression per feature out of an array of Shapley values in model input order."""
    return {name: F.get(F.col(values), F.lit(i)) for i, name in enumerate(FEATURE_ORDER)}


def top_contributors(parts: dict[str, Column], n: int = 3) -> Column:
    """The ``n`` largest contributions by absolute value, ties in feature order."""
    entries = F.array(*[
        F.struct(
            (-F.abs(part)).alias("rank"),
            F.lit(i).alias("position"),
            F.lit(name).alias("feature"),
            F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias("feature_value"),
            part.alias("part"),
        )
        for i, (name, part) in enumerate(parts.items())
    ])
    return F.transform(
        F.slice(F.array_sort(entries), 1, n),
        lambda e: F.struct(
            e["feature"].alias("feature"),
            e["feature_value"].alias("feature_value"),
            F.round(e["part"], 4).alias("contribution"),
            F.when(e["part"] > 0, UP).otherwise(DOWN).alias("direction"),
        ),
    )


def reasons(
    probability: str = "probability", country: str = "merchant_country", amount: str = "amount"
) -> Column:
    """Reasons in order of severity, or one default text."""
    named = F.nullif(F.col(country), F.lit(""))
    peak, average = F.col("max_amount_5min"), F.col("avg_amount_5min")
    own = F.coalesce(F.col(amount), F.when(peak != 0, peak).otherwise(average))
    count, total = F.col("txn_count_5min"), F.col("total_amount_5min")
    found = F.array_compact(F.array(
        F.when(F.col("is_suspicious") != 0,
               F.concat(F.lit(SUSPICIOUS_REASON), F.coalesce(named, F.lit("foreign"))))
        .when(F.col("is_foreign") != 0,
              F.format_string(FOREIGN_REASON, F.coalesce(named, F.lit("non-US")))),
        F.when(F.col("is_high_amount") != 0, F.format_string(HIGH_AMOUNT_REASON, own)),
        F.when(count > HIGH_VELOCITY, F.format_string(HIGH_VELOCITY_REASON, count.cast("double")))
        .when(count > SOME_VELOCITY, F.format_string(SOME_VELOCITY_REASON, count.cast("double"))),
        F.when(peak > PEAK_AMOUNT, F.format_string(PEAK_REASON, peak)),
        F.when(total > LARGE_TOTAL, F.format_string(TOTAL_REASON, total)),
    ))
    default = F.when(F.col(probability) > MEDIUM_RISK, MODEL_REASON).otherwise(NO_REASON)
    return F.when(F.size(found) == 0, F.array(default)).otherwise(found)


def explain(
    scored: DataFrame, importances: list[float] | None = None, values: str | None = None
) -> DataFrame:
    """Add ``explanation``: contributions (as ``shap_values``), top contributors,
    reasons and method.

    ``values`` names an array of exact Shapley values (``shapley.with_shapley``);
    without it the contributions are estimated from importances.
    """
    parts = exact_contributions(values) if values else contributions(importances)
    by_name = F.map_from_arrays(
        F.array(*[F.lit(name) for name in parts]),
        F.array(*[F.round(part, 4) for part in parts.values()]),
    )
    return scored.withColumn("explanation", F.struct(
        by_name.alias("shap_values"),
        top_contributors(parts).alias("top_contributors"),
        reasons().alias("reasons"),
        F.lit(EXACT_METHOD if values else METHOD).alias("method"),
    ))


def explain_with_model(scored: DataFrame, model: PipelineModel) -> DataFrame:
    """``explain`` by exact Shapley values where the model's trees can be read, else by its importances."""
    known = shapley.of_model(model, scored.sparkSession)
    if known is None:
        return explain(scored, importances(model))
    return explain(shapley.with_shapley(scored, known, "_shapley"), values="_shapley").drop("_shapley", "base_value")
