"""Importances of features as the gain of their splits, from sums over all rows.

Boosting fits a tree to the gradients of the loss at what the trees before it give. The
gain of a split is how much better its two sides fit their rows than the node did:
half of G²/H of the sides less that of the node, with G and H the sums of first and second
derivatives of the logistic loss. One pass over the rows adds up G and H of every node
of every tree; a task hands on two numbers for each node, whatever it has read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.shapley import Node
from riskloom.schemas import FEATURE_ORDER


def _numbered(root: Node) -> list[tuple[Node, int, int]]:
    """Nodes with the numbers of their children (0 for none), the root first."""
    nodes, at = [(root, 0, 0)], 0
    while at < len(nodes):
        node = nodes[at][0]
        if node.left is not None:
            nodes[at] = (node, len(nodes), len(nodes) + 1)
            nodes += [(node.left, 0, 0), (node.right, 0, 0)]
        at += 1
    return nodes


def node_sums(rows: DataFrame, trees: list[tuple[float, Node]], label: str = "fraud", base: float = 0.0) -> DataFrame:
    """tree, node, gradient, hessian and n of every node; null and NaN features as the model sees them.

    ``trees`` are weights and roots in the order of boosting, in log-odds; ``base`` is the
    log-odds before the first. Rows without a class take no part.
    """
    numbered = [(weight, _numbered(root)) for weight, root in trees]
    features = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURE_ORDER])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(nodes), 3)) for _, nodes in numbered]
        for batch in batches:
            y = batch["y"].to_numpy()
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            margin = np.full(len(y), base)
            for (weight, nodes), own in zip(numbered, sums):
                p = 1 / (1 + np.exp(-margin))
                g, h = p - y, p * (1 - p)
                here = {0: np.arange(len(y))}
                for number, (node, left, right) in enumerate(nodes):
                    at = here.pop(number)
                    own[number] += g[at].sum(), h[at].sum(), len(at)
                    if left:
                        goes = x[at, node.feature] <= node.threshold
                        here[left], here[right] = at[goes], at[~goes]
                    else:
                        margin[at] += weight * node.value
        tree = np.repeat(np.arange(len(sums)), [len(s) for s in sums])
        node = np.concatenate([np.arange(len(s)) for s in sums]) if sums else np.empty(0, np.int64)
        all_ = np.concatenate(sums) if sums else np.empty((0, 3))
        yield pa.RecordBatch.from_pydict({
            "tree": pa.array(tree, pa.int64()), "node": pa.array(node, pa.int64()), "gradient": pa.array(all_[:, 0]),
            "hessian": pa.array(all_[:, 1]), "n": pa.array(all_[:, 2].astype(np.int64))})

    summed = rows.where(F.col(label).isNotNull()).select(features.alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(
        run, "tree bigint, node bigint, gradient double, hessian double, n bigint")
    return summed.groupBy("tree", "node").agg(*[F.sum(c).alias(c) for c in ("gradient", "hessian", "n")])


def gain_importances(rows: DataFrame, trees: list[tuple[float, Node]], label: str = "fraud", base: float = 0.0) -> DataFrame:
    """feature, its splits and their total gain, for every feature, least first."""
    splits = [
        (tree, number, left, right, FEATURE_ORDER[node.feature])
        for tree, (_, root) in enumerate(trees) for number, (node, left, right) in enumerate(_numbered(root)) if left]
    spark = rows.sparkSession
    # A row for each split of the model.
    known = F.broadcast(spark.createDataFrame(splits, "tree bigint, node bigint, left bigint, right bigint, feature string"))
    sums = node_sums(rows, trees, label, base)
    side = F.when(F.col("hessian") > 0, F.col("gradient") * F.col("gradient") / F.col("hessian")).otherwise(0.0)
    part = sums.select("tree", "node", (side / 2).alias("fit"))
    roles = known.select("tree", "feature", F.explode(F.array(
        F.struct(F.col("node"), F.lit(-1.0).alias("sign")), F.struct(F.col("left").alias("node"), F.lit(1.0).alias("sign")),
        F.struct(F.col("right").alias("node"), F.lit(1.0).alias("sign")))).alias("r")).select("tree", "feature", "r.node", "r.sign")
    gains = part.join(F.broadcast(roles), ["tree", "node"]).groupBy("feature").agg(
        F.sum(F.col("fit") * F.col("sign")).alias("gain"), F.count_if(F.col("sign") < 0).alias("n_splits"))
    names = F.broadcast(spark.createDataFrame([(f,) for f in FEATURE_ORDER], "feature string"))
    return names.join(gains, "feature", "left").select(
        "feature", F.coalesce("n_splits", F.lit(0)).alias("n_splits"), F.coalesce("gain", F.lit(0.0)).alias("gain")
    ).orderBy("gain", "feature")
