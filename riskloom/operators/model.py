"""Boosted trees on the seven inputs with Spark ML, and the run table.

Trees only see into which bin of each input a row falls, so boosting works on the
combinations of bins that occur, weighted by their rows: the rows are read to find the
limits of the bins and once more to be counted, however many trees there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.evaluate import confusion_metrics, roc_auc
from riskloom.schemas import FEATURE_ORDER, LEARNING_RATE, SEED, TREE_DEPTH, TREES
from riskloom.session import shared_dir, work_dir

METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]


# Bins of an input, and the share of the rows by which a limit of one may be off its rank.
BINS, RANK_ERROR = 32, 1 / 3200
# Inputs with about so many values or fewer have their values counted.
FEW_VALUES = 10_000
# Combinations of bins in one partition.
CELLS = 50_000


def value_limits(counted: list[tuple[float, int]], limits: int) -> list[float]:
    """Limits between values, given in order with their counts: all, or about evenly spaced ones.

    The same as Spark's trees find on the values.
    """
    middle = [(a + b) / 2 for (a, _), (b, _) in zip(counted, counted[1:])]
    if len(middle) <= limits:
        return middle
    step = sum(n for _, n in counted) / (limits + 1)
    out, before, wanted = [], counted[0][1], step
    for limit, (_, n) in zip(middle, counted[1:]):
        if abs(before - wanted) < abs(before + n - wanted):
            out.append(limit)
            wanted += step
        before += n
    return out


def bin_limits(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Of each input the upper limits (inclusive) of all bins but the last, from all rows."""
    seen = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.approx_count_distinct(f).alias(f) for f in features]).first()
    limits = min(bins, seen["_n"]) - 1
    many = [f for f in features if seen[f] > FEW_VALUES]
    ranks = [i / bins for i in range(1, bins)]
    found = dict(zip(many, rows.approxQuantile(many, ranks, RANK_ERROR))) if many else {}
    for f in features:
        if f in found:
            found[f] = sorted(set(found[f]))
        else:
            counts = rows.where(F.col(f).isNotNull()).groupBy(F.col(f).cast("double").alias("v")).count().collect()
            found[f] = value_limits(sorted((r["v"], r["count"]) for r in counts), limits)
    return [found[f] for f in features]


def _cells(rows: DataFrame, features: list[str], limits: list[list[float]], label: str) -> DataFrame:
    """Every combination of bins and class, and how many rows have it.

    Their number is bounded by that of the bins, whatever the rows.
    """
    # A bucket does not hold its upper limit, a bin does. Without limits any one does.
    splits = [[-math.inf, *[math.nextafter(x, math.inf) for x in own or [0.0]], math.inf] for own in limits]
    names = [f"_bin_{f}" for f in features]
    binned = Bucketizer(splitsArray=splits, inputCols=features, outputCols=names).transform(rows)
    # Sums are plain numbers; what a Bucketizer gives is marked as categories without an order.
    return binned.groupBy(*[(F.col(n) + F.lit(0.0)).alias(f) for n, f in zip(names, features)], label).agg(
        F.count(F.lit(1)).cast("double").alias("_rows"))


def _on_values(spark: SparkSession, model: GBTClassificationModel, limits: list[list[float]]) -> GBTClassificationModel:
    """A model of bins as the same model of the values: its node table with other thresholds."""
    binned, path = work_dir(spark, "binned-model"), work_dir(spark, "value-model")
    model.write().save(binned)
    split = F.col("nodeData.split")
    number = F.floor(split["leftCategoriesOrThreshold"][0]).cast("int")
    table = F.array(*[F.array(*[F.lit(x) for x in own]).cast("array<double>") for own in limits])
    # Leaves have no split.
    limit = F.when(split["featureIndex"] >= 0, F.get(F.get(table, split["featureIndex"]), number))
    threshold = F.when(limit.isNotNull(), F.array(limit)).otherwise(split["leftCategoriesOrThreshold"])
    nodes = spark.read.parquet(f"{binned}/data")
    nodes.withColumn("nodeData", F.col("nodeData").withField("split.leftCategoriesOrThreshold", threshold)).write.parquet(f"{path}/data")
    spark.read.parquet(f"{binned}/treesMetadata").write.parquet(f"{path}/treesMetadata")
    spark.read.text(f"{binned}/metadata").write.text(f"{path}/metadata")
    return GBTClassificationModel.load(path)


def train(
    rows: DataFrame,
    label: str = "fraud",
    trees: int = TREES,
    depth: int = TREE_DEPTH,
    rate: float = LEARNING_RATE,
    seed: int = SEED,
) -> PipelineModel:
    """Fit on rows that hold the seven inputs and an integer class.

    Boosting builds on the previous trees' residuals; Spark cuts that lineage
    every ten trees in the shared checkpoint folder. The rows are read a few times
    before, so pass a written or persisted frame when they are costly.
    """
    spark = rows.sparkSession
    shared_dir(spark)
    rows = rows.select(*[F.col(f).cast("double").alias(f) for f in FEATURE_ORDER], label)
    limits = bin_limits(rows, FEATURE_ORDER)
    path = work_dir(spark, "cells")
    _cells(rows, FEATURE_ORDER, limits, label).write.parquet(path)
    cells = spark.read.parquet(path)
    cells = cells.repartition(-(-cells.count() // CELLS) or 1)
    assembler = VectorAssembler(inputCols=FEATURE_ORDER, outputCol="features")
    boosting = GBTClassifier(
        labelCol=label, featuresCol="features", weightCol="_rows", maxIter=trees, maxDepth=depth,
        stepSize=rate, seed=seed, checkpointInterval=10, maxBins=BINS,
    )
    return PipelineModel([assembler, _on_values(spark, boosting.fit(assembler.transform(cells)), limits)])


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``probability`` of fraud and the class ``prediction``."""
    return (
        model.transform(rows)
        .withColumn("probability", vector_to_array("probability")[1])
        .drop("features", "rawPrediction")
    )


def scorer(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """The model as the ``probability`` argument of ``scoring.score``."""
    return lambda df: predict(model, df)


def importances(model: PipelineModel) -> list[float]:
    """Feature importances in model input order."""
    return [float(v) for v in model.stages[-1].featureImportances.toArray()]


def importance_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    rows = list(zip(FEATURE_ORDER, importances(model)))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy("importance")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def evaluate(predictions: DataFrame, label: str = "fraud") -> dict[str, float]:
    """Accuracy, precision, recall, F1 and ROC-AUC of a prediction table.

    Class and score are checkpointed, so the predictions are computed once.
    """
    shared_dir(predictions.sparkSession)
    predictions = predictions.select(label, "prediction", "probability").checkpoint()
    counts = confusion_metrics(predictions, label).first()
    found = {name: counts[name] for name in METRICS[:-1]}
    found["roc_auc"] = roc_auc(predictions, label).first()["roc_auc"]
    return found


def log_run(spark: SparkSession, path: str, run_id: str, params: dict, metrics: dict) -> None:
    """Append one run, its parameters and its metrics, to a Parquet run table."""
    row = [(run_id, {k: str(v) for k, v in params.items()}, *[metrics[m] for m in METRICS])]
    columns = ", ".join(f"{m} double" for m in METRICS)
    (
        spark.createDataFrame(row, f"run_id string, params map<string,string>, {columns}")
        .withColumn("logged_at", F.current_timestamp())
        .coalesce(1)
        .write.mode("append").parquet(path)
    )
