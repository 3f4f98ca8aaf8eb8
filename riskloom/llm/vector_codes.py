"""Compression of vectors to codes: product quantisation by dual-tree Lloyd rounds.

A vector of whole numbers is cut into ``PARTS`` equal consecutive parts; each part is
coded by the nearest of up to 256 entries of its position's codebook. The codebooks
start as the parts of the rows of smallest id. A round assigns every part and moves an
entry to the floored mean of its parts; entries without parts stay. Everything is
whole numbers, so results don't depend on how rows are dealt.

Assignment descends two trees together, one over the parts of a block of vectors and
one over the entries, both kd-trees with bounding boxes. For a pair of nodes the boxes
give the least and the greatest possible distance. An entry node goes for a part node
when its least distance exceeds the smallest greatest distance of the others (equal
ones stay, as ties go to the lower index). A part node that is left with one entry is
assigned whole: its cached sum and count are added, no part is looked at. Parts of the
leaves that stay uncertain get exact distances to the entries their leaf is left with.

Trees of the parts are built once, block by block where the rows lie (no shuffle), and
stored; a round reads them in one map with the codebooks in its closure and adds up at
most ``PARTS`` x 256 sums a task. The driver holds the codebooks only.

Rows whose vector or vec_id is null, or that hold a null or non-finite component, are
dropped. Vectors whose length differs from the smallest id's, or that can't be cut into
``PARTS`` equal parts, have no codebook: their code and error are null and add nothing.
A vec_id that repeats is coded each time; among the first entries, rows of equal id
come in order of their vectors. Null labels belong together. An error beyond 63 bits
counts as the largest long. Without rows the result is empty. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored
from riskloom.operators.joins import many_to_one

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Vectors of a block for up to 64 components, fewer of longer ones; parts of a leaf.
BLOCK, LEAF = 4_096, 32
COMPONENTS = 64
LARGEST = (1 << 63) - 1


def carrier(*groups: np.ndarray) -> type:
    """A number type in which squared distances between rows of the groups are exact."""
    top = max((abs(int(x)) for g in groups if g.size for x in (g.min(), g.max())), default=0)
    size = max((g.shape[1] for g in groups), default=0)
    bound = 4 * top * top * max(1, size)
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


class Tree:
    """A kd-tree over rows: an order of them and, level by level, nodes of halves of it."""

    def __init__(self, points: np.ndarray, leaf: int, order: np.ndarray | None = None) -> None:
        n = len(points)
        self.edges = [np.array([0, n])]
        while np.diff(self.edges[-1]).max() > leaf:
            e = self.edges[-1]
            self.edges.append(np.unique(np.concatenate([e, (e[:-1] + e[1:]) // 2])))
        self.order = self._split(points) if order is None else order
        self.points = points[self.order] if order is None else points
        self.low = [np.minimum.reduceat(self.points, e[:-1], axis=0) for e in self.edges]
        self.high = [np.maximum.reduceat(self.points, e[:-1], axis=0) for e in self.edges]

    def _split(self, points: np.ndarray) -> np.ndarray:
        """Halve every node across its widest component."""
        order = np.arange(len(points))
        for above, below in zip(self.edges, self.edges[1:]):
            for a, b in zip(above[:-1], above[1:]):
                middle = below[np.searchsorted(below, a) + 1]
                if middle < b:
                    rows = points[order[a:b]]
                    widest = int(np.argmax(rows.max(0) - rows.min(0)))
                    order[a:b] = order[a:b][np.argpartition(rows[:, widest], middle - a)]
        return order

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child of each node and how many it has, one level below."""
        above, below = self.edges[level], self.edges[level + 1]
        first = np.searchsorted(below, above[nodes])
        return first, np.searchsorted(below, above[nodes + 1]) - first


def _expand(tree: Tree, level: int, mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace the nodes of pairs by their children."""
    first, many = tree.children(level, mine)
    again = np.repeat(np.arange(len(mine)), many)
    within = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
    return first[again] + within, other[again]


def _bounds(parts: Tree, at: int, p: np.ndarray, entries: Tree, level: int, e: np.ndarray, kind: type):
    """Least and greatest squared distance of each pair of nodes, component by component."""
    least, most = np.zeros(len(p), kind), np.zeros(len(p), kind)
    pl, ph, el, eh = (x.astype(kind) for x in (parts.low[at], parts.high[at], entries.low[level], entries.high[level]))
    for d in range(pl.shape[1]):
        up, down = el[e, d] - ph[p, d], pl[p, d] - eh[e, d]
        gap = np.maximum(np.maximum(up, down), 0)
        least += gap * gap
        # The far ends lie (high - low) of either side further apart.
        far = np.maximum(eh[e, d] - pl[p, d], ph[p, d] - el[e, d])
        most += far * far
    return least, most


def descend(parts: Tree, entries: Tree, kind: type):
    """Whole nodes (level, node, entry) and the leaves left uncertain with their entries (leaf, entry).

    Entries are named by their place in the tree's order.
    """
    at = level = 0
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole = []
    while len(p):
        if level + 1 < len(entries.edges):
            e, p = _expand(entries, level, e, p)
            level += 1
        if at + 1 < len(parts.edges):
            p, e = _expand(parts, at, p, e)
            at += 1
        order = np.lexsort((e, p))
        p, e = p[order], e[order]
        least, most = _bounds(parts, at, p, entries, level, e, kind)
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        counts = np.diff(np.r_[starts, len(p)])
        keep = least <= np.repeat(np.minimum.reduceat(most, starts), counts)
        p, e = p[keep], e[keep]
        single = level + 1 == len(entries.edges)
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        counts = np.diff(np.r_[starts, len(p)])
        if single:
            sure = np.repeat(counts == 1, counts)
            whole += [(at, int(a), int(b)) for a, b in zip(p[sure], e[sure])]
            p, e = p[~sure], e[~sure]
            if at + 1 == len(parts.edges):
                return whole, (p, e)
    return whole, (p, e)


def nearest(points: np.ndarray, entries: np.ndarray, kind: type, allowed: np.ndarray | None = None):
    """Index of the nearest entry of each point, the lower one of equals, and its exact distance."""
    index, distance = np.empty(len(points), np.int64), np.empty(len(points), object if kind is object else np.int64)
    c = entries.astype(kind)
    norm = (c * c).sum(1)
    for a in range(0, len(points), BLOCK):
        x = points[a:a + BLOCK].astype(kind)
        d = (x * x).sum(1)[:, None] - 2 * np.dot(x, c.T) + norm
        if allowed is not None:
            d = np.where(allowed[a:a + BLOCK], d, d.max(initial=0) + 1)
        index[a:a + BLOCK] = np.argmin(d, axis=1)
        distance[a:a + BLOCK] = d[np.arange(len(x)), index[a:a + BLOCK]]
    return index, distance


def assign(parts: Tree, entries: Tree, found: np.ndarray | None = None, error: np.ndarray | None = None):
    """Sum and count of the parts of every entry (entries in codebook order).

    With ``found`` and ``error``, arrays in the parts' order, these receive each part's
    entry and squared distance.
    """
    kind = carrier(parts.points, entries.points)
    k, size = entries.points.shape
    exact = object if kind is object else np.int64
    sums, counts = np.zeros((k, size), exact), np.zeros(k, np.int64)
    whole, (leaf, entry) = descend(parts, entries, kind)
    cached = np.concatenate([np.zeros((1, size), exact), np.cumsum(parts.points.astype(exact), axis=0)])
    for level, node, e in whole:
        a, b = parts.edges[level][node], parts.edges[level][node + 1]
        own = entries.order[e]
        sums[own] += cached[b] - cached[a]
        counts[own] += b - a
        if found is not None:
            away = parts.points[a:b].astype(exact) - entries.points[e].astype(exact)
            found[a:b], error[a:b] = own, (away * away).sum(1)
    if len(leaf):
        nodes, place = np.unique(leaf, return_inverse=True)
        lengths = np.diff(parts.edges[-1])[nodes]
        starts = parts.edges[-1][nodes]
        rows = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        left = np.zeros((len(nodes), k), bool)
        left[place, entries.order[entry]] = True
        book = np.empty_like(entries.points)
        book[entries.order] = entries.points
        index, distance = nearest(parts.points[rows], book, kind, np.repeat(left, lengths, axis=0))
        np.add.at(sums, index, parts.points[rows].astype(exact))
        counts += np.bincount(index, minlength=k)
        if found is not None:
            found[rows], error[rows] = index, distance
    return sums, counts


def _trees(rows: DataFrame, size: int, label_type: str) -> DataFrame:
    """Blocks of rows as they lie: ids, labels and, for each part, its order and its ordered rows."""
    part = size // PARTS
    limit = max(1, min(BLOCK, BLOCK * COMPONENTS // max(1, size)))

    def block(table: pa.Table) -> pa.RecordBatch:
        flat = table["v"].combine_chunks().flatten().to_numpy().astype("<i8").reshape(table.num_rows, size)
        trees = [Tree(flat[:, i * part:(i + 1) * part], LEAF) for i in range(PARTS)]
        out = {name: pa.ListArray.from_arrays([0, table.num_rows], table[name].combine_chunks()) for name in ("vec_id", "label")}
        out["orders"] = pa.array([[t.order.astype("<i8").tobytes() for t in trees]], pa.list_(pa.binary()))
        out["points"] = pa.array([[t.points.astype("<i8").tobytes() for t in trees]], pa.list_(pa.binary()))
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, limit):
                piece = batch.slice(start, limit)
                if n + piece.num_rows > limit:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if held:
            yield block(pa.Table.from_batches(held))

    return rows.select("vec_id", "label", "v").mapInArrow(
        run, f"vec_id array<bigint>, label array<{label_type}>, orders array<binary>, points array<binary>")


def _read(points: bytes, part: int) -> np.ndarray:
    return np.frombuffer(points, "<i8").reshape(-1, part)


def _sums(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, entry, position, sum and count over all blocks, for entries that have parts."""
    part = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [Tree(b, 1) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for held in batch["points"]:
                for i, points in enumerate(held):
                    blob = _read(points.as_py(), part)
                    s, n = assign(Tree(blob, LEAF, np.arange(len(blob))), entries[i])
                    sums[i] += s
                    counts[i] += n
        for i, (s, n) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({
                "part": np.full(len(used) * part, i, np.int64),
                "entry": np.repeat(used, part),
                "position": np.tile(np.arange(part), len(used)),
                "sum": pa.array([Decimal(int(x)) for x in s[used].ravel()], pa.decimal128(38, 0)),
                "n": np.repeat(n[used], part),
            })

    kinds = "part bigint, entry bigint, position bigint, sum decimal(38,0), n bigint"
    return blocks.select("points").mapInArrow(run, kinds).groupBy("part", "entry", "position").agg(
        F.sum("sum").cast("decimal(38,0)").alias("sum"), F.sum("n").alias("n"))


def _codes(blocks: DataFrame, books: list[np.ndarray], label_type: str) -> DataFrame:
    """vec_id, label, code and error of every row."""
    part = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [Tree(b, 1) for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch["vec_id"][row].values
                codes, errors = np.empty((len(ids), len(books)), np.uint8), np.zeros(len(ids), object)
                orders, points = batch["orders"][row].as_py(), batch["points"][row].as_py()
                for i in range(len(books)):
                    blob, order = _read(points[i], part), np.frombuffer(orders[i], "<i8")
                    found, error = np.empty(len(blob), np.int64), np.empty(len(blob), object)
                    assign(Tree(blob, LEAF, np.arange(len(blob))), entries[i], found, error)
                    codes[order, i] = found
                    errors[order] += error
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids, "label": batch["label"][row].values,
                    "code": [c.tobytes().hex() for c in codes],
                    "error": pa.array([min(int(x), LARGEST) for x in errors], pa.int64()),
                })

    return blocks.mapInArrow(run, f"vec_id bigint, label {label_type}, code string, error bigint")


def books_text(books: list[np.ndarray]) -> str:
    """All components by part, entry and position, comma-joined."""
    return ",".join(str(int(x)) for b in books for x in b.ravel())


def train_codebooks(blocks: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Lloyd rounds from the given codebooks over stored blocks."""
    for _ in range(rounds):
        moved = [b.copy() for b in books]
        # At most as many numbers as the codebooks hold.
        for r in _sums(blocks, books).toLocalIterator():
            moved[r["part"]][r["entry"], r["position"]] = int(r["sum"]) // r["n"]
        books = moved
    return books


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that takes part.

    ``vectors`` has vec_id, embedding and label. A code has two hex digits a part, so
    there are at most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must lie between 1 and 256")
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    label_type = vectors.schema["label"].dataType.simpleString()
    rows = stored(
        vectors.select(
            F.col("vec_id").cast("bigint").alias("vec_id"), "label",
            F.when(F.col("embedding").isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale))).alias("v"),
        ).where("vec_id IS NOT NULL AND v IS NOT NULL"),
        "whole-vectors",
    )
    first = rows.orderBy("vec_id", "v").limit(1).collect()
    size = len(first[0]["v"]) if first else 0
    if not size or size % PARTS:
        codes, digest = rows.select(
            "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")), ""
    else:
        fits = rows.where(F.size("v") == size)
        start = np.array([r["v"] for r in fits.orderBy("vec_id", "v").limit(entries).collect()], np.int64)
        part = size // PARTS
        blocks = stored(_trees(fits, size, label_type), "part-trees")
        books = train_codebooks(blocks, [start[:, i * part:(i + 1) * part] for i in range(PARTS)], rounds)
        digest = books_text(books)
        others = rows.where(F.size("v") != size).select(
            "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
        codes = stored(_codes(blocks, books, label_type).unionByName(others), "codes")
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = codes.groupBy("label").agg(
        F.when(whole > LARGEST, F.lit(LARGEST)).otherwise(whole.cast("bigint")).alias("label_error"))
    return many_to_one(codes, by_label, ["label"], null_safe=True).select(
        "vec_id", "code", "error", "label_error",
        F.lit(hashlib.sha256(digest.encode()).hexdigest()).alias("codebooks_sha256"))
