"""Hard negatives by Kronecker-packed products.

An anchor's positives are its best rows of the same label; its hard negatives for a
positive are the best rows of other labels whose score lies in a window below the
positive's score. Scores are inner products of whole numbers, computed for several
candidates at once: components are biased to be non-negative, the same component of
several candidates is laid into separate fields of one wide integer, that integer is
multiplied once by the anchor's component, and the fields of the sum are the exact
scores less what the biases add. A field is as wide as the largest possible sum of
the tile, so fields never run into each other. The wide integer is a 64-bit number
(as a float's 53-bit significand while that holds two fields, where the products can
be one matrix product; else as a 63-bit integer), beyond that a Python integer of
``WIDE`` fields.

Rows are dealt by hash into shards of bounded size, within buckets of labels, so a
label of any share is split. Anchors meet only the shards of their own bucket in
search of positives, and all shards in search of negatives; a pair of blocks is one
tile. A tile gives the best of each anchor, lists are merged shard by shard in a
tree, so no anchor's candidates are gathered in one place and none is dropped.

Rows whose vec_id, label or vector is null, or that hold a null or non-finite
component, take no part; vectors meet those of their own length. An anchor skips every
row of its own id. A vec_id that repeats counts each time, as anchor, positive and
negative. Ties go to the smaller vec_id. An anchor without another row of its label,
or with no row in a window, gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stored
from riskloom.llm.topk import whole_numbers

# Candidates of a shard and anchors of a block, for vectors of up to 64 components;
# of longer ones fewer, so that a block holds at most so many components.
SHARD, ANCHORS = 8_192, 1_024
COMPONENTS = 64
# Groups of labels that are dealt into shards of their own.
BUCKETS = 16
# Anchors whose scores against a shard are held at once.
ROWS = 128
# Lists merged at a time.
FAN_IN = 32
# Fields of a Python integer.
WIDE = 32


def field_bits(anchors: np.ndarray, candidates: np.ndarray) -> int:
    """Bits that hold any sum of products of the (non-negative) components."""
    top = int(anchors.max(initial=0)) * int(candidates.max(initial=0)) * anchors.shape[1]
    return max(1, top.bit_length())


def packed_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, several candidates to a multiplication.

    A product beyond 63 bits counts as the largest or smallest long.
    """
    n, size = candidates.shape
    if not len(anchors) or not n or not size:
        return np.zeros((len(anchors), n), np.int64)
    a_low, c_low = int(anchors.min()), int(candidates.min())
    tops = [max(abs(low), abs(int(x.max()))) for low, x in ((a_low, anchors), (c_low, candidates))]
    # Sums of lows, too, have to stay exact.
    exact = np.int64 if max(1, tops[0]) * max(1, tops[1]) * size < 1 << 58 and max(tops) < 1 << 58 else object
    a, c = anchors.astype(exact) - a_low, candidates.astype(exact) - c_low
    bits = field_bits(a, c)
    small = bits <= 53 and exact is np.int64
    carrier, fields = (np.float64, 53 // bits) if small else (object, WIDE)
    full = np.zeros((-(-n // fields) * fields, size), np.int64 if small else object)
    full[:n] = c
    lanes = full.reshape(-1, fields, size)
    wide = lanes[:, 0].copy()
    for f in range(1, fields):
        wide += lanes[:, f] << (bits * f)
    product = np.dot(a.astype(carrier), wide.astype(carrier).T)
    if small:
        product = product.astype(np.int64)
    out = np.empty((len(a), len(wide), fields), product.dtype)
    for f in range(fields):
        out[:, :, f] = (product >> (bits * f)) & ((1 << bits) - 1)
    packed = out.reshape(len(a), -1)[:, :n]
    # With a = a' + A and c = c' + C: sum ac = sum a'c' + C sum a' + A sum c' + size A C.
    scores = packed + c_low * a.sum(1)[:, None] + (a_low * c.sum(1) + size * a_low * c_low)[None]
    if scores.dtype == object:
        scores = np.clip(scores, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)
    return scores


def first_of_rows(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest allowed scores of every row; of equal ones the first columns."""
    i, j = np.nonzero(allowed)
    s = scores[i, j]
    order = np.lexsort((j, -s, i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


def best_of_label(q: dict, c: dict, k: int) -> tuple[np.ndarray, ...]:
    """Anchor row, candidate id and score of the k best other rows of the anchor's label."""
    found = []
    for a in range(0, len(q["ids"]), ROWS):
        at = slice(a, a + ROWS)
        same = (q["labels"][at, None] == c["labels"]) & (q["ids"][at, None] != c["ids"])
        used = np.flatnonzero(same.any(0))
        s, same = packed_scores(q["matrix"][at], c["matrix"][used]), same[:, used]
        if len(used) > 4 * k:
            # Below the k-th of a row's allowed scores nothing has to be sorted.
            bar = np.partition(np.where(same, s, np.iinfo(np.int64).min), len(used) - k, axis=1)[:, len(used) - k]
            same &= s >= bar[:, None]
        i, j = first_of_rows(s, same, k)
        found.append((q["rows"][at][i], c["ids"][used[j]], s[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def best_in_windows(q: dict, c: dict, k: int) -> tuple[np.ndarray, ...]:
    """Anchor row, place of the positive, candidate id and score of the k best rows of each window.

    ``q["low"]`` and ``q["high"]`` hold the windows, one column for each positive;
    a column of a missing positive is an empty window.
    """
    found = []
    for a in range(0, len(q["ids"]), ROWS):
        at = slice(a, a + ROWS)
        s = packed_scores(q["matrix"][at], c["matrix"])
        low, high = q["low"][at], q["high"][at]
        open_ = low <= high
        floor = np.where(open_, low, np.iinfo(np.int64).max).min(1)
        i, j = np.nonzero((s >= floor[:, None]) & (q["labels"][at, None] != c["labels"]))
        v, own = s[i, j], q["ids"][at][i] != c["ids"][j]
        i, j, v = i[own], j[own], v[own]
        order = np.lexsort((j, -v, i))
        i, j, v = i[order], j[order], v[order]
        for p in range(low.shape[1]):
            inside = np.flatnonzero((v >= low[i, p]) & (v <= high[i, p]))
            r = i[inside]
            inside = inside[np.arange(len(r)) - np.searchsorted(r, r) < k]
            found.append((
                q["rows"][at][i[inside]], np.full(len(inside), p, np.int64), c["ids"][j[inside]], v[inside]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4


def _blocks(rows: DataFrame, keys: list[str], lists: dict[str, int] | None = None) -> DataFrame:
    """One row per key: ids, labels, row numbers and the matrix of its vectors, by id.

    ``lists`` names columns of whole-number lists of fixed length to be kept, too.
    """
    lists = lists or {}

    def run(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        order = np.lexsort((table["row"].to_numpy(), ids))

        def held(column: str, width: int):
            flat = table[column].combine_chunks().flatten().to_numpy().astype("<i8")
            return pa.array([flat.reshape(len(ids), width)[order].tobytes()], pa.binary())

        return pa.table({
            **{k: table[k][:1] for k in keys},
            **{k: pa.array([table[c].to_numpy()[order].astype("<i8").tobytes()], pa.binary())
               for k, c in (("ids", "vec_id"), ("labels", "label"), ("rows", "row"))},
            "matrix": held("v", table["size"][0].as_py()),
            **{k: held(k, w) for k, w in lists.items()},
        })

    kinds = ", ".join([f"{k} bigint" for k in keys] + [f"{k} binary" for k in ("ids", "labels", "rows", "matrix", *lists)])
    return rows.groupBy(*keys).applyInArrow(run, kinds)


def _tiles(pairs: DataFrame, find: Callable, out: list[str], lists: dict[str, int]) -> DataFrame:
    """``find(anchors, candidates)`` on every pair of blocks; columns ``out`` and the shard."""

    def arrays(row: dict, prefix: str, widths: dict[str, int]) -> dict[str, np.ndarray]:
        got = {k: np.frombuffer(row[prefix + k], "<i8") for k in ("ids", "labels", "rows", "matrix", *widths)}
        got["matrix"] = got["matrix"].reshape(len(got["ids"]), row["size"])
        return got | {k: got[k].reshape(len(got["ids"]), w) for k, w in widths.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                found = find(arrays(row, "", lists), arrays(row, "c_", {}))
                yield pa.RecordBatch.from_pydict({
                    **{k: pa.array(v, pa.int64()) for k, v in zip(out, found)},
                    "part": np.full(len(found[0]), row["part"], np.int64),
                })

    return pairs.mapInArrow(run, ", ".join(f"{k} bigint" for k in [*out, "part"]))


def _merged(lists: DataFrame, keys: list[str], parts: int, k: int) -> DataFrame:
    """The k best of every key out of its lists, ``FAN_IN`` lists at a time, with their ranks."""
    while True:
        parts = math.ceil(parts / FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("bigint"))
        best = Window.partitionBy(*keys, "part").orderBy(F.desc("score"), "found")
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if parts <= 1:
            return lists.drop("part")
        lists = lists.drop("rank")


def _pieces(n: int, components: int, rows: int) -> int:
    return max(1, math.ceil(n / rows), math.ceil(components / (rows * COMPONENTS)))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors`` has vec_id, embedding and label, a whole number (or ``label`` gives it);
    ``is_anchor`` says which rows ask. ``window`` holds the least and the greatest score
    of a negative, in hundredths of the positive's score.
    """
    least, most = window
    rows = stored(
        vectors.select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            (F.col("label") if label is None else label).cast("bigint").alias("label"),
            whole_numbers(F.col("embedding")).alias("v"),
            F.coalesce(is_anchor, F.lit(False)).alias("asks"),
            F.monotonically_increasing_id().alias("row"),
        ).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
        .withColumn("size", F.size("v").cast("bigint"))
        .withColumn("bucket", F.pmod(F.xxhash64("label", F.lit(11)), F.lit(BUCKETS))),
        "labelled-vectors",
    )
    # At most BUCKETS rows of counts.
    counts = {r["bucket"]: r for r in rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("size").alias("c"), F.count_if("asks").alias("q"),
        F.coalesce(F.sum(F.when(F.col("asks"), F.col("size"))), F.lit(0)).alias("qc"),
    ).collect()}
    first, shards, blocks, parts = [0] * BUCKETS, [1] * BUCKETS, [1] * BUCKETS, 0
    for b in range(BUCKETS):
        first[b] = parts
        if b in counts:
            shards[b] = _pieces(counts[b]["n"], counts[b]["c"], SHARD)
            blocks[b] = _pieces(counts[b]["q"], counts[b]["qc"], ANCHORS)
            parts += shards[b]

    def of_bucket(numbers: list[int]) -> Column:
        return F.get(F.array(*[F.lit(n).cast("bigint") for n in numbers]), F.col("bucket").cast("int"))

    # The place goes by the row's number: copies of a vector spread like any rows.
    place = F.xxhash64("row", F.lit(5))
    candidates = _blocks(
        rows.withColumn("part", of_bucket(first) + F.pmod(place, of_bucket(shards))), ["size", "part"]
    ).select("size", "part", *[F.col(k).alias(f"c_{k}") for k in ("ids", "labels", "rows", "matrix")])
    asked = rows.where("asks").withColumn("block", F.pmod(place, of_bucket(blocks)))

    own = _blocks(asked, ["size", "bucket", "block"]).withColumn(
        "part", F.explode(F.sequence(of_bucket(first), of_bucket(first) + of_bucket(shards) - 1)))
    near = _tiles(
        own.join(candidates, ["size", "part"]), lambda q, c: best_of_label(q, c, positives),
        ["row", "found", "score"], {})
    best = _merged(near, ["row"], parts, positives).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("found").alias("id"), "score"))).alias("best"))
    best = stored(best, "positives")

    def column(value: Callable[[Column], Column], missing: int) -> Column:
        """One number for each positive, ``missing`` where there are fewer."""
        got = F.transform("best", value)
        return F.concat(got, F.array_repeat(F.lit(missing).cast("bigint"), F.lit(positives) - F.size("best")))

    hundred = F.lit(100).cast("decimal(20,0)")
    with_windows = asked.join(best, "row").withColumns({
        "positive": column(lambda p: p["id"], 0),
        "of": column(lambda p: p["score"], 0),
        "low": column(lambda p: F.ceil(p["score"].cast("decimal(38,0)") * least / hundred).cast("bigint"), 1),
        "high": column(lambda p: F.floor(p["score"].cast("decimal(38,0)") * most / hundred).cast("bigint"), 0),
    })
    lists = {"positive": positives, "of": positives, "low": positives, "high": positives}
    everywhere = _blocks(with_windows, ["size", "bucket", "block"], lists).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, parts - 1)).cast("bigint"))))
    below = _tiles(
        everywhere.join(candidates, ["size", "part"]), lambda q, c: best_in_windows(q, c, negatives),
        ["row", "place", "found", "score"], lists)
    chosen = _merged(below, ["row", "place"], parts, negatives)
    at = F.col("place").cast("int")
    return chosen.join(with_windows.select("row", F.col("vec_id").alias("anchor_id"), "positive", "of"), "row").select(
        "anchor_id", F.get("positive", at).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("found").alias("negative_id"), F.get("of", at).alias("positive_score"), F.col("score").alias("negative_score"))
