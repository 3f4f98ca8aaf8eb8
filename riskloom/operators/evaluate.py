"""Metrics of a prediction table."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import shared_dir


def _ratio(part: Column, whole: Column) -> Column:
    """The quotient, 0.0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion_metrics(
    predictions: DataFrame, label: str = "fraud", prediction: str = "prediction"
) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 in one pass."""
    actual, said = F.col(label) == 1, F.col(prediction) == 1
    counts = predictions.agg(
        F.count_if(actual & said).alias("tp"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(~actual & ~said).alias("tn"),
        F.count_if(actual & ~said).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
    })


def roc_auc(
    predictions: DataFrame, label: str = "fraud", score: str = "probability", ranges: int = 1000
) -> DataFrame:
    """Exact area under the ROC curve, ties counted half, as one row.

    Rows are combined per distinct score first. The running count of negatives
    is then built inside score ranges and over the range totals, so no task
    sorts all scores. The counts per score are checkpointed, so the predictions
    are computed once. Null when one class is absent.
    """
    shared_dir(predictions.sparkSession)
    by_score = predictions.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"),
    ).checkpoint()
    # Range limits only balance the work; any limits give the same result.
    steps = [i / ranges for i in range(1, ranges)]
    limits = sorted(set(by_score.approxQuantile("score", steps, 1 / (2 * ranges))))
    ranged = Bucketizer(
        splits=[float("-inf"), *limits, float("inf")], inputCol="score", outputCol="range"
    ).transform(by_score) if limits else by_score.withColumn("range", F.lit(0.0))

    inside = Window.partitionBy("range").orderBy("score")
    totals = ranged.groupBy("range").agg(F.sum("neg").alias("range_neg"))
    # At most ``ranges`` rows are left to be added up in one place.
    below = totals.select(
        "range",
        (F.sum("range_neg").over(Window.orderBy("range")) - F.col("range_neg")).alias("below_range"),
    )
    placed = (
        ranged.withColumn("below", F.sum("neg").over(inside) - F.col("neg"))
        .join(F.broadcast(below), "range")
    )
    doubled = F.col("pos").cast("decimal(19,0)") * (
        2 * (F.col("below") + F.col("below_range")) + F.col("neg")
    ).cast("decimal(19,0)")
    return placed.agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(doubled).cast("double").alias("_u"),
    ).select(
        "n_pos", "n_neg",
        F.try_divide(F.col("_u"), 2.0 * F.col("n_pos") * F.col("n_neg")).alias("roc_auc"),
    )
