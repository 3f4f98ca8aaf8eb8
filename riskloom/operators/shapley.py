"""Exact Shapley values of boosted trees, per row.

The value of a set of features is what a tree gives on average when only they are
known: at a split on a known feature the row's side is taken, at any other split both
sides, weighted by the training rows that went there. The values of all features and
the base value (nothing known) add up to the tree's result.

A leaf contributes to the features on its path only, and what it contributes depends on
nothing but which of them agree with the path. So for every leaf the contributions are
worked out once for all patterns of agreement, 2 to the power of the features on its
path; a row then needs the pattern of each leaf and adds up rows of those tables. The
tables are numpy arrays of the size of the model and go along with the tasks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.schemas import FEATURE_ORDER
from riskloom.session import work_dir

# Features on one path: a leaf's table has 2 to the power of this many rows at most.
MAX_PATH = 16
# Rows evaluated at a time.
ROWS = 4_096


@dataclass(frozen=True)
class Node:
    """A split (``value <= threshold`` goes left) or, without children, a leaf.

    ``cover`` is the weight of the training rows that reached it.
    """

    cover: float
    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass(frozen=True)
class Leaf:
    """Conditions by feature, what share of rows goes the path at that feature's splits, and the table."""

    features: list[int]
    # For each feature (low, high]: the values that agree with the path.
    low: list[float]
    high: list[float]
    table: np.ndarray


@dataclass(frozen=True)
class Explainer:
    """Base value and leaf tables of a sum of weighted trees."""

    base: float
    leaves: list[Leaf]
    n_features: int

    def values(self, rows: np.ndarray) -> np.ndarray:
        """The Shapley values of each row (rows x features); NaN goes right, as in the trees."""
        out = np.zeros((len(rows), self.n_features))
        for start in range(0, len(rows), ROWS):
            part, into = rows[start:start + ROWS], out[start:start + ROWS]
            for leaf in self.leaves:
                pattern = np.zeros(len(part), np.intp)
                for bit, (f, low, high) in enumerate(zip(leaf.features, leaf.low, leaf.high)):
                    agrees = np.ones(len(part), bool)
                    if high < math.inf:
                        agrees &= part[:, f] <= high
                    if low > -math.inf:
                        agrees &= ~(part[:, f] <= low)
                    pattern |= agrees.astype(np.intp) << bit
                into[:, leaf.features] += leaf.table[pattern]
        return out


def _table(shares: list[float], value: float) -> np.ndarray:
    """What a leaf adds to each feature of its path, for every pattern of agreement.

    With the features of A known, the leaf adds its value times 1 or 0 for each of A by
    whether it agrees, times the share of each other. A feature's Shapley value is the
    mean over all orders of what knowing it changes.
    """
    m = len(shares)
    weights = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
    agrees = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float)
    out = np.zeros((1 << m, m))
    for i in range(m):
        # Sums over the sets of k others, for every k, one other at a time.
        sums = [np.ones(1 << m)]
        for j in (j for j in range(m) if j != i):
            known, unknown = [s * agrees[:, j] for s in sums], [s * shares[j] for s in sums]
            sums = [unknown[0], *(u + k for u, k in zip(unknown[1:], known)), known[-1]]
        out[:, i] = value * (agrees[:, i] - shares[i]) * sum(w * s for w, s in zip(weights, sums))
    return out


def explainer(trees: list[tuple[float, Node]], n_features: int) -> Explainer:
    """The leaf tables of ``trees``, pairs of weight and root."""
    base, leaves = 0.0, []
    for weight, root in trees:
        # Node, and by feature: low, high and share of the path so far.
        open_ = [(root, {})]
        while open_:
            node, path = open_.pop()
            if node.left is None:
                base += weight * node.value * math.prod(s for _, _, s in path.values())
                if len(path) > MAX_PATH:
                    raise ValueError(f"a path with more than {MAX_PATH} features")
                if path:
                    features = sorted(path)
                    leaves.append(Leaf(
                        features, [path[f][0] for f in features], [path[f][1] for f in features],
                        _table([path[f][2] for f in features], weight * node.value)))
                continue
            low, high, share = path.get(node.feature, (-math.inf, math.inf, 1.0))
            for child, bounds in (
                (node.left, (low, min(high, node.threshold))), (node.right, (max(low, node.threshold), high)),
            ):
                taken = child.cover / node.cover if node.cover else 0.0
                open_.append((child, {**path, node.feature: (*bounds, share * taken)}))
    return Explainer(base, leaves, n_features)


def brute_force(trees: list[tuple[float, Node]], row: list[float], n_features: int) -> list[float]:
    """Shapley values by their definition, over all subsets of the features. For tests."""

    def given(node: Node, known: frozenset) -> float:
        if node.left is None:
            return node.value
        if node.feature in known:
            return given(node.left if row[node.feature] <= node.threshold else node.right, known)
        return sum(c.cover / node.cover * given(c, known) for c in (node.left, node.right))

    def worth(known: frozenset) -> float:
        return sum(w * given(root, known) for w, root in trees)

    out = []
    for i in range(n_features):
        others = [j for j in range(n_features) if j != i]
        total = 0.0
        for k in range(n_features):
            weight = math.factorial(k) * math.factorial(n_features - k - 1) / math.factorial(n_features)
            total += weight * sum(
                worth(frozenset((*s, i))) - worth(frozenset(s)) for s in combinations(others, k))
        out.append(total)
    return out


def saved_trees(spark: SparkSession, path: str) -> list[tuple[float, Node]]:
    """Weights and trees of a boosted model saved at ``path``, from its node tables.

    The node table has a row for each node of the model, which is what arrives here.
    """
    weights = {r[0]: r[2] for r in spark.read.parquet(f"{path}/treesMetadata").collect()}
    nodes: dict[int, dict[int, object]] = defaultdict(dict)
    table = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", F.col("nodeData.impurityStats")[0].alias("weight"), "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories")
    for r in table.collect():
        nodes[r["treeID"]][r["id"]] = r

    def node(of: dict, number: int) -> Node:
        r = of[number]
        if r["leftChild"] < 0:
            return Node(float(r["weight"]), r["prediction"])
        if r["numCategories"] != -1:
            raise ValueError("a split by categories")
        return Node(
            float(r["weight"]), 0.0, r["featureIndex"], r["leftCategoriesOrThreshold"][0],
            node(of, r["leftChild"]), node(of, r["rightChild"]))

    return [(weights[t], node(nodes[t], 0)) for t in sorted(nodes)]


def of_model(model: PipelineModel, spark: SparkSession) -> Explainer | None:
    """The explainer of a fitted pipeline's boosted trees, in log-odds; None for a model without node tables.

    A probability is the logistic function of twice the sum of the trees.
    """
    path = work_dir(spark, "explained-model")
    try:
        model.stages[-1].write().overwrite().save(path)
        trees = saved_trees(spark, path)
    except (AnalysisException, AttributeError):
        return None
    return explainer([(2.0 * w, root) for w, root in trees], len(FEATURE_ORDER))


def shapley_values(known: Explainer, features: list[str] = FEATURE_ORDER) -> Column:
    """An array of the features' Shapley values, null and NaN as the model sees them."""

    @F.arrow_udf("array<double>")
    def run(rows: pa.Array) -> pa.Array:
        n = known.n_features
        matrix = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        flat = known.values(matrix).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), pa.array(flat))

    return run(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]))


def with_shapley(rows: DataFrame, known: Explainer, name: str = "shapley") -> DataFrame:
    """Add the array of Shapley values and ``base_value``."""
    return rows.withColumns({name: shapley_values(known), "base_value": F.lit(known.base)})
