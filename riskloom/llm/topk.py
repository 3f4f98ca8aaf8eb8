"""Exact top-k search by inner product: tiles of queries and shards.

Vectors are packed where they lie into pieces, one binary matrix of the narrowest
whole numbers each. Pieces of candidates are dealt into groups, pieces of queries into
blocks; a group meets a block as one tile, for which both are copied, and so many groups
and blocks are chosen that copies of either side weigh about the same. A tile is one
task: it holds its queries and takes the candidates shard by shard, each a few matrix
products, of which only scores that reach a query's k-th best so far are looked at. The
lists of the groups are merged in a tree, so no query's candidates are gathered in one
place. Nothing but the number of rows reaches the driver and nothing is broadcast.

Vectors become whole numbers, floor(256 * x). Products are exact: 32-bit floats
are used only where every sum stays below 2**24, 64-bit floats below 2**53, and
64-bit whole numbers beyond. Rows whose vector or id is null, or that hold a null
or non-finite component, take no part; vectors meet those of their own length. A
query skips every row of its own id. A vec_id that repeats is a candidate each
time, and a query row that repeats gets its list each time. Ties go to the smaller
vec_id. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.llm.common import stored

# Candidates scored at once, and queries of a piece.
SHARD = 8_192
QUERIES = 1_024
# Lists merged at a time.
FAN_IN = 32
# Queries whose scores against a shard are held at once.
ROWS = 256
# Pairs of a tile, and tiles for each core if there are fewer pairs.
PAIRS = 1 << 34
TILES = 4
# Bytes of a piece, and of either side of a tile, at eight a component.
PIECE = 4 << 20
HELD = 128 << 20
# Stored pieces are read a row group at a time.
GROUPS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1"}
# Scores of a query in a shard that are sorted; of more the best are found first.
CROWD = 32

_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole_numbers(embedding: Column) -> Column:
    """floor(256 * x) of every component; null if the vector takes no part."""
    x = embedding.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * 256)))


def _narrow(v: np.ndarray) -> np.ndarray:
    for kind in ("<i2", "<i4"):
        if v.min(initial=0) >= np.iinfo(kind).min and v.max(initial=0) <= np.iinfo(kind).max:
            return v.astype(kind)
    return v.astype("<i8")


def _pieces(rows: DataFrame) -> DataFrame:
    """Pieces of candidates, which are all rows, and pieces of the rows that ask.

    ``place`` counts a task's pieces of either kind, from the task's number on.
    """
    most = {False: max(1, SHARD // 8), True: QUERIES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, places = defaultdict(list), defaultdict(int), {}

        def piece(asks: bool, size: int) -> pa.RecordBatch:
            ids, numbers, matrix = (np.concatenate(x) for x in zip(*held.pop((asks, size)), strict=True))
            place, places[asks] = places[asks], places[asks] + 1
            return pa.RecordBatch.from_pylist([{
                "asks": asks, "size": size, "place": place, "n": counts.pop((asks, size)), "least": int(ids.min()),
                "kind": matrix.dtype.str, "ids": ids.tobytes(), "numbers": numbers.tobytes() if asks else b"",
                "matrix": matrix.tobytes(),
            }])

        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == size))
                ids, numbers = (own[c].to_numpy().astype("<i8") for c in ("vec_id", "number"))
                places = places or dict.fromkeys(most, int(numbers[0]) >> 33)
                matrix = own["v"].flatten().to_numpy().reshape(len(ids), size)
                for asks, chosen in ((False, np.arange(len(ids))), (True, np.flatnonzero(own["asks"].to_numpy(zero_copy_only=False)))):
                    step = max(1, min(most[asks], PIECE // (8 * size + 8)))
                    for a in range(0, len(chosen), step):
                        some = chosen[a:a + step]
                        held[asks, size].append((ids[some], numbers[some], _narrow(matrix[some])))
                        counts[asks, size] += len(some)
                        if counts[asks, size] >= step:
                            yield piece(asks, size)
            if sum(8 * (size + 2) * n for (_, size), n in counts.items()) > 4 * PIECE:
                yield from [piece(*key) for key in list(held)]
        yield from [piece(*key) for key in list(held)]

    return rows.mapInArrow(
        run, "asks boolean, size bigint, place bigint, n bigint, least bigint, kind string, "
             "ids binary, numbers binary, matrix binary")


def _top(v: np.ndarray) -> int:
    return max(int(v.max(initial=0)), -int(v.min(initial=0)))


def _kind(q_top: int, c_top: int, size: int):
    top = q_top * c_top * size
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64


def tile_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows."""
    kind = _kind(_top(q), _top(c), q.shape[1])
    return q.astype(kind) @ c.astype(kind).T


def best_places(s: np.ndarray, bars: np.ndarray, k: int):
    """Row and column of the scores that may be among the k best of their row.

    Scores below their row's bar are left out; the columns are in the order of the ids, so
    of a crowded table the first of equal score stay.
    """
    rows = np.flatnonzero(s.max(axis=1) >= bars)
    s = s[rows] if len(rows) < len(s) else s
    wanted = s >= bars[rows, None]
    if np.count_nonzero(wanted) > CROWD * len(rows):
        n = min(k, s.shape[1])
        bar = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n][:, None]
        above, equal = s > bar, s == bar
        wanted &= above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= n - above.sum(1, keepdims=True)))
    i, j = np.divmod(np.flatnonzero(wanted), s.shape[1])
    return rows[i], j


class Lists:
    """The k best candidates so far of each of n queries: greater scores, then smaller ids first."""

    def __init__(self, n: int, k: int):
        self.k, self.count = k, np.zeros(n, np.int64)
        self.scores, self.ids = np.full((n, k), _LEAST), np.zeros((n, k), np.int64)

    def bars(self, some: slice, least: int) -> np.ndarray:
        """The score a candidate needs to matter to the queries; ids from ``least`` on lose a tie with smaller ones."""
        last = self.scores[some, -1]
        later = (self.count[some] == self.k) & (self.ids[some, -1] <= least) & (last < _MOST)
        return last + later

    def add(self, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates of the queries ``i``, which may repeat."""
        which, at = np.unique(i, return_inverse=True)
        old = np.arange(self.k) < self.count[which, None]
        row = np.concatenate([at, np.nonzero(old)[0]])
        ids = np.concatenate([ids, self.ids[which][old]])
        scores = np.concatenate([scores, self.scores[which][old]])
        # The complement falls as the score rises, without overflow.
        order = np.lexsort((ids, ~scores, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, rank = (x[rank < self.k] for x in (order, row, rank))
        self.scores[which[row], rank], self.ids[which[row], rank] = scores[order], ids[order]
        self.count[which] = np.bincount(row, minlength=len(which))


class Tile:
    """Queries of one length and their lists, to which candidates come shard by shard."""

    def __init__(self, size: int, k: int):
        self.size, self.k, self.asked, self.waiting, self.lists = size, k, [], [], None
        self.room: dict[type, np.ndarray] = {}

    def add(self, piece: dict) -> None:
        ids = np.frombuffer(piece["ids"], "<i8")
        matrix = np.frombuffer(piece["matrix"], piece["kind"]).reshape(len(ids), self.size)
        if piece["asks"]:
            self.asked.append((ids, np.frombuffer(piece["numbers"], "<i8"), matrix))
        elif self.asked or self.lists:
            self.waiting.append((ids, matrix))
            n = sum(len(x) for x, _ in self.waiting)
            if n >= SHARD or 8 * n * self.size >= HELD:
                self.search()

    def search(self) -> None:
        """Put the waiting candidates into the lists."""
        if not self.waiting:
            return
        if self.lists is None:
            self.query_ids, self.numbers, self.q = (np.concatenate(x) for x in zip(*self.asked, strict=True))
            self.tops = [_top(self.q[a:a + ROWS]) for a in range(0, len(self.q), ROWS)]
            self.asked, self.lists = [], Lists(len(self.q), self.k)
        ids, c = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting = []
        # The first few candidates give bars for the others of their shard.
        starts = [0] if self.lists.count.all() else [0, 256, 1024, 4096]
        for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
            if a < len(ids):
                some = np.argsort(ids[a:b], kind="stable")
                self._search(ids[a:b][some], c[a:b][some])

    def _place(self, kind, rows: int, columns: int) -> np.ndarray:
        """Memory for scores, used again and again."""
        if kind not in self.room or self.room[kind].size < rows * columns:
            self.room[kind] = np.empty(rows * columns, kind)
        return self.room[kind][:rows * columns].reshape(rows, columns)

    def _search(self, ids: np.ndarray, c: np.ndarray) -> None:
        top, least, as_kind = _top(c), int(ids[0]), {}
        own = [np.searchsorted(ids, self.query_ids, side) for side in ("left", "right")]
        for slab, a in enumerate(range(0, len(self.q), ROWS)):
            some = slice(a, a + ROWS)
            kind = _kind(self.tops[slab], top, self.size)
            if kind not in as_kind:
                as_kind[kind] = c.astype(kind).T
            s = np.matmul(self.q[some].astype(kind), as_kind[kind], out=self._place(kind, len(self.q[some]), len(ids)))
            first, end = (x[some] for x in own)
            for i in np.flatnonzero(first < end):
                s[i, first[i]:end[i]] = _LEAST
            i, j = best_places(s, self.lists.bars(some, least).astype(kind), self.k)
            scores = s[i, j].astype(np.int64)
            i, j, scores = (x[(first[i] > j) | (j >= end[i])] for x in (i, j, scores))
            if len(i):
                self.lists.add(i + a, ids[j], scores)

    def result(self, part: int) -> Iterator[pa.RecordBatch]:
        self.search()
        for a in range(0, len(self.q) if self.lists else 0, QUERIES):
            some = slice(a, a + QUERIES)
            i, rank = np.nonzero(np.arange(self.k) < self.lists.count[some, None])
            i += a
            yield pa.RecordBatch.from_pydict({
                "query_id": self.query_ids[i], "row": self.numbers[i], "part": np.full(len(i), part, np.int64),
                "vec_id": self.lists.ids[i, rank], "score": self.lists.scores[i, rank],
            })


def _tiles(pieces: DataFrame, blocks: int, k: int) -> DataFrame:
    """The lists of every tile; a tile's pieces lie together, its queries before its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                piece = batch.slice(n, 1).to_pylist()[0]
                if key != (piece["tile"], piece["size"]):
                    if tile:
                        yield from tile.result(key[0] // blocks)
                    key, tile = (piece["tile"], piece["size"]), Tile(piece["size"], k)
                tile.add(piece)
        if tile:
            yield from tile.result(key[0] // blocks)

    return pieces.mapInArrow(run, "query_id bigint, row bigint, part bigint, vec_id bigint, score bigint")


def dealt(n: int, q: int, n_bytes: int, q_bytes: int, cores: int) -> tuple[int, int]:
    """In how many groups n candidates and in how many blocks q queries are dealt."""
    tiles = max(TILES * cores, math.ceil(n * q / PAIRS))
    blocks = max(round(math.sqrt(tiles * q / max(n, 1))), math.ceil(q_bytes / HELD))
    blocks = max(1, min(blocks, math.ceil(q / QUERIES)))
    groups = max(math.ceil(tiles / blocks), math.ceil(n_bytes / HELD))
    return max(1, min(groups, math.ceil(n / SHARD))), blocks


def _merge(lists: DataFrame, parts: int, k: int) -> DataFrame:
    """The k best of every query out of its lists, ``FAN_IN`` lists at a time."""
    while True:
        parts = math.ceil(parts / FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("bigint"))
        best = Window.partitionBy("query_id", "row", "part").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if parts <= 1:
            return lists.drop("part")
        lists = lists.drop("rank")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each query row.

    ``vectors`` has vec_id and embedding; ``is_query`` says which rows ask.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), whole_numbers(F.col("embedding")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("number"),
    ).where("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("size", F.size("v").cast("bigint"))
    pieces = stored(_pieces(rows), "vectors", **GROUPS)
    asks, n, weight = F.col("asks"), F.col("n"), 8 * F.col("n") * F.col("size")
    counts = pieces.agg(*[F.coalesce(F.sum(F.when(of, x)), F.lit(0)) for x in (n, weight) for of in (~asks, asks)]).first()
    groups, blocks = dealt(*counts, pieces.sparkSession.sparkContext.defaultParallelism)
    each = lambda last: F.sequence(F.lit(0).cast("bigint"), F.lit(last - 1).cast("bigint"))
    group, block = F.pmod("place", F.lit(groups)), F.pmod("place", F.lit(blocks))
    tiles = F.when(asks, F.transform(each(groups), lambda g: g * blocks + block)).otherwise(
        F.transform(each(blocks), lambda b: group * blocks + b))
    together = pieces.withColumn("tile", F.explode(tiles)).repartitionById(groups * blocks, F.col("tile").cast("int"))
    lists = _tiles(together.sortWithinPartitions("tile", "size", F.desc("asks"), "least"), blocks, k)
    lists = _merge(lists, groups, k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
