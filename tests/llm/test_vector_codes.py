from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from riskloom.llm import vector_codes as codes

COLUMNS = "vec_id long, embedding array<float>, label int, code string, ERROR int"


def brute(rows, entries, rounds=4):
    good = sorted(
        (v, [math.floor(1024 * float(np.float32(x))) for x in e], label) for v, e, label in rows
        if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ) if rows else []
    size = len(good[0][1]) if good else 0
    fits = [g for g in good if len(g[1]) == size and size and size % 4 == 0]
    part = size // 4
    cut = [[g[1][i * part:(i + 1) * part] for g in fits] for i in range(4)]
    books = [c[:entries] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for i in range(4):
            held = {}
            for x in cut[i]:
                held.setdefault(nearest(x, books[i])[1], []).append(x)
            books[i] = [[sum(c) // len(held[n]) for c in zip(*held[n])] if n in held else e for n, e in enumerate(books[i])]
    out, errors = [], {}
    for v, e, label in good:
        if len(e) == size and fits:
            found = [nearest(e[i * part:(i + 1) * part], books[i]) for i in range(4)]
            code, error = "".join(f"{n:02x}" for _, n in found), min(sum(d for d, _ in found), codes.LARGEST)
            errors[label] = errors.get(label, 0) + error
        else:
            code = error = None
        out.append((v, code, error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = {k: min(e, codes.LARGEST) for k, e in errors.items()}
    return sorted(((v, c, e, errors.get(label), digest) for v, c, e, label in out), key=repr)


def check(spark, rows, entries=16, parts=3):
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], COLUMNS).repartition(parts)
    got = sorted(map(tuple, codes.compress(df, entries).collect()), key=repr)
    assert got == brute(rows, entries)
    return got


def vectors(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-1, 1) * spread for _ in range(dim)], rng.choice([0, 1, 1, None])) for i in range(n)]


@pytest.mark.parametrize("block,leaf", [(4096, 32), (17, 2)])
def test_against_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(codes, "BLOCK", block)
    monkeypatch.setattr(codes, "LEAF", leaf)
    check(spark, vectors(150, 8, 1))
    # Few different values: ties, equal entries, entries that lose all their parts.
    rng = random.Random(2)
    check(spark, [(i, [rng.choice([0.0, 0.25]) for _ in range(8)], 1) for i in range(120)])


def test_odd_rows(spark):
    rows = vectors(60, 4, 3) + [
        (3, [0.5] * 4, 1), (3, [0.5] * 4, 1), (None, [1.0] * 4, 1), (200, None, 1), (201, [1.0, None, 1.0, 1.0], 1),
        (202, [float("nan")] * 4, 1), (203, [float("-inf")] * 4, None), (204, [1.0] * 8, 1), (205, [], 9), (206, [1.0, 2.0, 3.0], 1),
        (207, [1000.0, -1000.0, 3.0, 4.0], None)]
    check(spark, rows)
    check(spark, rows, entries=1)


def test_few_rows(spark):
    assert check(spark, []) == []
    check(spark, vectors(1, 4, 1))
    check(spark, vectors(5, 4, 1), entries=256)
    check(spark, [(1, [1.0, 2.0, 3.0], 1), (2, [1.0] * 4, 1)])  # the first can't be cut: no codebook


def test_large_components_stay_exact(spark):
    for spread in (1e5, 1e9):  # 64-bit distances, and errors beyond 63 bits
        check(spark, vectors(40, 8, 5, spread))


def test_dual_tree_equals_all_distances():
    rng = np.random.default_rng(1)
    clusters = rng.integers(0, 12, (700, 1)) * 500 + rng.integers(0, 4, (700, 4))
    for points, k in ((rng.integers(-900, 900, (333, 6)), 40), (clusters, 30), (rng.integers(0, 2, (200, 2)), 9), (clusters[:1], 1)):
        book = points[rng.integers(0, len(points), k)]
        parts, entries = codes.Tree(points, 8), codes.Tree(book, 1)
        found, error = np.empty(len(points), np.int64), np.empty(len(points), object)
        sums, counts = codes.assign(parts, entries, found, error)
        away = ((parts.points[:, None].astype(int) - book) ** 2).sum(2)
        assert (found == away.argmin(1)).all() and list(error) == away.min(1).tolist()
        want = np.zeros_like(book)
        np.add.at(want, away.argmin(1), parts.points)
        assert (sums == want).all() and (counts == np.bincount(away.argmin(1), minlength=k)).all()
        assert sorted(parts.order) == list(range(len(points)))


def test_clustered_parts_are_assigned_as_whole_nodes():
    rng = np.random.default_rng(2)
    centres = np.arange(16)[:, None] * np.array([[4000, 0, 0, 0]])
    points = np.repeat(centres, 64, axis=0) + rng.integers(0, 30, (1024, 4))
    parts, entries = codes.Tree(points, 32), codes.Tree(centres, 1)
    whole, (leaf, _) = codes.descend(parts, entries, np.float64)
    covered = sum(parts.edges[level][n + 1] - parts.edges[level][n] for level, n, _ in whole)
    assert covered == 1024 and not len(leaf)
