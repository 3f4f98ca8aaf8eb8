from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import negatives

COLUMNS = "vec_id long, embedding array<float>, label int, score int, ROW int"


def brute(rows, positives=5, keep=3):
    good = []
    for v, e, label in rows:
        if v is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            good.append((v, label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for a, own, x in good:
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), v, label) for v, label, y in good if v != a and len(x) == len(y))
        for s, p, _ in [r for r in scored if r[2] == own][:positives]:
            low, high = 50 * -s, 95 * -s
            fit = [(v, -t) for t, v, label in scored if label != own and low <= 100 * -t <= high][:keep]
            out += [(a, p, i + 1, v, -s, t) for i, (v, t) in enumerate(fit)]
    return sorted(out)


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], COLUMNS).repartition(parts)
    got = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute(rows)
    return got


def vectors(n, dim, seed, labels=4, same=0, hot=0):
    rng = random.Random(seed)
    return [(i, [1.0] * dim if i < same else [rng.uniform(-1, 1) for _ in range(dim)], 0 if i < hot else rng.randrange(labels))
            for i in range(n)]


@pytest.mark.parametrize("shard,anchors,fan,rows,buckets", [(8192, 1024, 32, 128, 16), (23, 2, 3, 1, 2)])
def test_against_brute_force(spark, monkeypatch, shard, anchors, fan, rows, buckets):
    for name, value in (("SHARD", shard), ("ANCHORS", anchors), ("FAN_IN", fan), ("ROWS", rows), ("BUCKETS", buckets)):
        monkeypatch.setattr(negatives, name, value)
    assert len(check(spark, vectors(400, 6, 1))) > 50
    check(spark, vectors(300, 4, 2, same=120, hot=150))  # equal vectors, ties everywhere, a hot label
    check(spark, vectors(200, 3, 3, labels=150))  # hardly any positives


def test_odd_rows(spark):
    rows = vectors(120, 3, 4) + [
        (50, [0.5, 0.5, 0.5], 1), (50, [0.5, 0.5, 0.5], 1), (7, [1.0, 1.0, 1.0], 2), (None, [1.0, 1.0, 1.0], 1), (200, None, 1),
        (201, [1.0, None, 1.0], 1), (202, [1.0, float("nan"), 1.0], 1), (203, [float("inf")] * 3, 1), (204, [1.0, 1.0, 1.0], None),
        (250, [1.0, 2.0], 1), (251, [1.0, 2.0], 1), (252, [0.5, 1.5], 2), (300, [], 1), (301, [], 1), (350, [0.1] * 9, 1)]
    check(spark, rows)


def test_few_rows(spark):
    for rows in ([], vectors(1, 3, 1), vectors(2, 3, 1), vectors(9, 3, 1)[1:]):
        check(spark, rows, parts=1)


def test_all_of_one_label_have_no_negatives(spark):
    assert check(spark, [(i, v, 7) for i, v, _ in vectors(120, 4, 5)]) == []


def test_packed_scores_are_exact():
    rng = np.random.default_rng(0)
    for top in (1, 3, 300, 1 << 14, 1 << 25):
        for shift in (0, 7 * top):
            a = rng.integers(-top, top, (5, 33)) + shift
            c = rng.integers(-top // 3 - 2, top, (19, 33)) + shift
            want = [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in c] for x in a]
            assert negatives.packed_scores(a, c).tolist() == want


def test_fields_are_shared_and_wide_enough():
    a, c = np.full((1, 64), 511), np.full((3, 64), 511)
    bits = negatives.field_bits(a, c)
    assert 53 // bits == 2 and 64 * 511 * 511 < 1 << bits
    # The largest possible sums beside each other leave their neighbours alone.
    c[1] = 0
    assert negatives.packed_scores(a, c).tolist() == [[64 * 511 * 511, 0, 64 * 511 * 511]]


def test_products_beyond_long_are_held_at_its_ends():
    top = 1 << 40
    assert negatives.packed_scores(np.full((1, 2), top), np.array([[top, top], [-top, -top]])).tolist() == [[(1 << 63) - 1, -(1 << 63) + 1]]
