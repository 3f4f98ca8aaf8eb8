from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import topk


def brute(rows, k=5):
    good = []
    for i, (v, e) in enumerate(rows):
        if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            good.append((i, v, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for _, q, a in good:
        if q % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), v) for _, v, b in good if v != q and len(a) == len(b))
        out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(v, e, 1, 2) for v, e in rows], "vec_id long, embedding array<float>, score int, ROW int").repartition(parts)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def vectors(n, dim, seed, same=0):
    rng = random.Random(seed)
    return [(i, [1.0] * dim if i < same else [rng.uniform(-1, 1) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("shard,queries,fan,rows", [(8192, 1024, 32, 256), (37, 2, 3, 1)])
def test_against_brute_force(spark, monkeypatch, shard, queries, fan, rows):
    for name, value in (("SHARD", shard), ("QUERIES", queries), ("FAN_IN", fan), ("ROWS", rows)):
        monkeypatch.setattr(topk, name, value)
    check(spark, vectors(400, 8, 1))
    check(spark, vectors(400, 4, 2, same=180))  # a group of equal vectors, ties everywhere


def test_odd_rows(spark):
    rows = vectors(120, 3, 4) + [
        (50, [0.5, 0.5, 0.5]), (50, [0.5, 0.5, 0.5]), (7, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (200, None),
        (201, [1.0, None, 1.0]), (202, [1.0, float("nan"), 1.0]), (203, [float("inf")] * 3), (250, [1.0, 2.0]),
        (251, [1.0, 2.0]), (300, []), (301, []), (350, [0.1] * 9)]
    check(spark, rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame(vectors(9, 3, 1)[1:], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_fewer_than_k(spark):
    check(spark, vectors(3, 2, 5))


def test_large_numbers_are_exact():
    random_ = np.random.default_rng(0)
    for top in (100, 1 << 14, 1 << 25, 1 << 28):
        q, c = random_.integers(-top, top, (4, 32)), random_.integers(-top, top, (6, 32))
        want = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in c] for x in q]
        assert topk.tile_scores(q, c).astype(np.int64).tolist() == want


def test_nothing_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 37)
    df = spark.createDataFrame(vectors(400, 8, 1), "vec_id long, embedding array<float>").repartition(4)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute(vectors(400, 8, 1))
    # Blocks that are repeated for every shard would go through the driver.
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_copies_are_few():
    for n, q in ((720_000, 14_400), (15_000_000, 300_000), (1_000_000, 1_000_000), (100_000_000, 1_000), (5, 0), (0, 0)):
        groups, blocks = topk.dealt(n, q, 512 * n, 512 * q, 8)
        assert n * blocks + q * groups <= 16 * n
        assert n * q <= 1.5 * groups * blocks * topk.PAIRS


@pytest.mark.parametrize("pairs,held,piece,crowd", [(500, 1 << 20, 64, 1), (1 << 34, 200, 1 << 20, 10_000), (100, 300, 1, 3)])
def test_many_small_tiles(spark, monkeypatch, pairs, held, piece, crowd):
    for name, value in (
            ("PAIRS", pairs), ("HELD", held), ("PIECE", piece), ("CROWD", crowd), ("TILES", 1), ("SHARD", 37), ("QUERIES", 2), ("ROWS", 3)):
        monkeypatch.setattr(topk, name, value)
    rows = vectors(300, 4, 6, same=60)
    check(spark, rows + [(v, e) for v, e in rows if v % 5 == 0] + vectors(60, 3, 7) + [(0, [2.0])], parts=3)


@pytest.mark.parametrize("shard,rows,crowd,top", [(8192, 256, 32, 1), (37, 3, 1, 1), (600, 7, 10_000, 3_000), (90, 50, 4, 1_000_000)])
def test_tile(monkeypatch, shard, rows, crowd, top):
    # Workers import the module, so these limits don't reach them.
    for name, value in (("SHARD", shard), ("ROWS", rows), ("CROWD", crowd)):
        monkeypatch.setattr(topk, name, value)
    given = [(i % 700, [top * x for x in e]) for i, (_, e) in enumerate(vectors(1500, 4, 9, same=200))]
    random.Random(1).shuffle(given)
    tile = topk.Tile(4, 5)
    whole = np.floor(256 * np.array([e for _, e in given], np.float32).astype(float)).astype("<i8")
    ids = np.array([v for v, _ in given])

    def pieces(asks, chosen, n):
        for a in range(0, len(chosen), n):
            some = chosen[a:a + n]
            matrix = topk._narrow(whole[some])
            yield {"asks": asks, "ids": ids[some].tobytes(), "numbers": some.tobytes(), "kind": matrix.dtype.str, "matrix": matrix.tobytes()}

    for piece in (*pieces(True, np.flatnonzero(ids % 50 == 0), 11), *pieces(False, np.arange(len(ids)), 29)):
        tile.add(piece)
    got = [r for batch in tile.result(3) for r in batch.to_pylist()]
    assert {r["part"] for r in got} == {3}
    queries = {}
    for r in got:
        queries.setdefault((r["query_id"], r["row"]), []).append((-r["score"], r["vec_id"]))
    out = [(q, n + 1, v, -s) for (q, _), found in queries.items() for n, (s, v) in enumerate(sorted(found))]
    assert sorted(out) == brute(given)


def test_wide_numbers(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-top, top)) for _ in range(6)]) for i, top in enumerate([3, 1000, 1_000_000, 10_000_000] * 40)]
    check(spark, rows + [(161, [1.0, -100_000_000.0, 0.0, 0.0, 0.0, 0.0])])


def test_lists_keep_order_and_ties():
    lists = topk.Lists(2, 2)
    lists.add(np.array([0, 0, 0, 1]), np.array([9, 4, 7, 5]), np.array([3, 3, 8, -topk._MOST - 1]))
    assert lists.ids[0].tolist() == [7, 4] and lists.scores[0].tolist() == [8, 3] and lists.count.tolist() == [2, 1]
    # A later id has to be better, a smaller one as good; a list that isn't full takes any.
    assert lists.bars(slice(0, 2), 4).tolist() == [4, topk._LEAST]
    assert lists.bars(slice(0, 1), 3).tolist() == [3]
    lists.add(np.array([0]), np.array([3]), np.array([3]))
    assert lists.ids[0].tolist() == [7, 3]
