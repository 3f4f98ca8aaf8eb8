from __future__ import annotations

import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskloom.operators import model as ml
from riskloom.operators import shapley
from riskloom.schemas import FEATURE_ORDER


def labelled(spark, n, seed=9):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [float(rng.randrange(1, 8)), rng.uniform(0, 900), rng.uniform(0, 300), rng.uniform(0, 600), *[float(rng.random() < 0.4) for _ in range(3)]]
        rows.append((*x, int(x[1] > 400 and x[4] > 0 or x[6] > 0 and rng.random() < 0.8)))
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in FEATURE_ORDER) + ", fraud int").cache()


def test_trees_equal_those_on_the_rows(spark):
    df = labelled(spark, 500)
    assembler = VectorAssembler(inputCols=FEATURE_ORDER, outputCol="features")
    boosting = GBTClassifier(labelCol="fraud", featuresCol="features", maxIter=2, maxDepth=3, stepSize=0.1, seed=42)
    want = Pipeline(stages=[assembler, boosting]).fit(df)
    got = ml.train(df, trees=2, depth=3)
    assert max(abs(a - b) for a, b in zip(ml.importances(got), ml.importances(want))) < 1e-9
    pairs = zip(ml.predict(got, df).collect(), ml.predict(want, df).collect())
    assert max(abs(a["probability"] - b["probability"]) for a, b in pairs) < 1e-9


def test_boosting_reads_combinations_of_bins_not_rows(spark, monkeypatch):
    seen, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows, *a: seen.append(rows.count()) or fit(self, rows, *a))
    base = labelled(spark, 60)
    # The same bins, whatever the rows: values differ a little within them.
    many = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn(
        "total_amount_5min", F.floor("total_amount_5min") + F.col("i") / 1000).drop("i")
    trained = ml.train(many, trees=2, depth=2)
    assert len(seen) == 1 and seen[0] < many.count() / 20
    # Nodes still weigh as many rows as they have.
    path = shapley.work_dir(spark, "binned-test")
    trained.stages[-1].write().save(path)
    assert {root.cover for _, root in shapley.saved_trees(spark, path)} == {6000.0}


def test_limits_of_bins(spark, monkeypatch):
    assert ml.value_limits([(1.0, 5), (2.0, 1), (4.0, 1)], 31) == [1.5, 3.0]
    assert ml.value_limits([(3.0, 5)], 31) == [] and ml.value_limits([], 31) == []
    assert ml.value_limits([(float(i), 1) for i in range(12)], 3) == [2.5, 5.5, 8.5]
    rows = spark.range(2000).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"), F.lit(None).cast("double").alias("c"))
    a, b, c = ml.bin_limits(rows, ["a", "b", "c"])
    assert len(a) == 31 and b == [] and c == []
    monkeypatch.setattr(ml, "FEW_VALUES", 10)
    many, _, _ = ml.bin_limits(rows, ["a", "b", "c"])
    assert len(many) == 31 and max(abs(x - y) for x, y in zip(a, many)) < 3
