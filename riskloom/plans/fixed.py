"""Inputs of checks that must not depend on a trained model."""

from __future__ import annotations

# Trees as (weight, node), a node as (feature, threshold, cover, left, right) or (cover, value).
# All shares of covers are sums of powers of two, and a path has at most three features.
TREES = [
    (1.0, (4, 0.5, 64,
           (5, 0.5, 48, (36, -0.5), (12, 0.25)),
           (0, 2.0, 16, (12, 0.5), (1, 1500.0, 4, (1, 1.0), (3, 2.0))))),
    (0.5, (3, 512.0, 64,
           (0, 1.0, 32, (16, -1.0), (6, 0.5, 16, (4, 0.0), (12, 0.5))),
           (6, 0.5, 32, (24, 0.25), (8, 2.0)))),
    (0.25, (1, 600.0, 64,
            (1, 128.0, 56, (28, -2.0), (28, 1.0)),
            (2, 300.0, 8, (2, 0.5), (3, 700.0, 6, (3, 1.0), (3, 4.0))))),
]
# The Shapley values of these trees are whole numbers of one over this.
SHAPLEY_UNIT = 3 << 20
