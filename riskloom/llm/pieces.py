"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut where no piece can lie across (before white space,
around line ends), the distinct parts are joined into one text and its suffixes
are sorted by as many characters as the longest piece has. A binary search, for
all pieces at once and character by character, gives each piece its range of
occurrences. These are the edges of the lattice; sorted by position they are
relaxed: of all neighbouring symbols whose union is an edge, the one with the best
score is joined, leftmost first, until none is left. This is what the byte-pair
models of the library do (their result isn't the path of the greatest sum), so the
ids equal the library's. Models of another kind are refused. Characters without a
piece become byte pieces.

Null and empty texts have no ids and decode to an empty text. U+2581 stands for a
space in these models, so a text that contains it decodes to a space there. Rows
that repeat are encoded once each, an empty table gives an empty result, other
columns are not looked at. Ids are 32-bit, little-endian, in one binary value.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import whole_text

SPACE = "▁"
_PARTS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
# Characters of text that are cut into parts together, and of new parts that are
# matched together: the first bounds a batch, the second the arrays of its edges.
BATCH = 4_000_000
MATCHED = 500_000
# Encoded parts a worker remembers.
REMEMBERED = 250_000
# Longer parts are relaxed one by one.
LONG = 200
_NONE = np.int64(1) << 30


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields, in the wire format of protocol buffers."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, message[at:at + size]
            at += size


def model_kind(content: bytes) -> str:
    """How a SentencePiece model encodes, as its file says."""
    # Fixed values of the format: field 2 is the trainer's settings, whose field 3 is the kind.
    kinds = {1: "unigram", 2: "bpe", 3: "word", 4: "char"}
    spec = b"".join(v for n, v in _fields(content) if n == 2 and isinstance(v, bytes))
    return kinds.get(next((v for n, v in _fields(spec) if n == 3), 1), "unknown")


class Model:
    """Pieces, scores and kinds of a SentencePiece byte-pair model."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            kind = model_kind(file.read())
        if kind != "bpe":
            raise ValueError(f"only byte-pair models are supported, not {kind}: {path}")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(SPACE in texts[i].lstrip(SPACE) or ("\n" in texts[i] and len(texts[i]) > 1) for i in plain):
            raise ValueError("pieces that lie across white space are not supported")
        scores = np.array([-sp.get_score(i) for i in range(n)])
        # Best score first; equal scores share a rank.
        self.rank = np.unique(scores, return_inverse=True)[1].astype(np.int64)
        self.unknown = sp.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.uint32)
        self.raw = [t.replace(SPACE, " ").encode("utf-8", "replace") for t in texts]
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(texts[i][3:-1], 16)] = i
                self.raw[i] = bytes([int(texts[i][3:-1], 16)])
            elif sp.is_control(i):
                self.raw[i] = b""
        self.raw[self.unknown] = " ⁇ ".encode()
        self.char_ids = np.full(0x110001, -1, np.int64)
        for i in plain:
            if len(texts[i]) == 1:
                self.char_ids[ord(texts[i])] = i
        longer = [i for i in plain if len(texts[i]) > 1]
        self.ids = np.array(longer, np.int64)
        self.lengths = np.array([len(texts[i]) for i in longer], np.int64)
        self.width = int(self.lengths.max(initial=1))
        self.codes = np.zeros((len(longer), self.width), np.int64)
        for row, i in enumerate(longer):
            self.codes[row, :len(texts[i])] = [ord(c) + 1 for c in texts[i]]
        self.remembered: dict[str, bytes] = {}


def suffix_array(codes: np.ndarray, width: int) -> np.ndarray:
    """Positions in order of the ``width`` or more codes that start there."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(2, np.int64)])
    rank = np.unique((padded[:n] << 42) | (padded[1:n + 1] << 21) | padded[2:n + 2], return_inverse=True)[1]
    known = 3
    while known < width:
        after = np.zeros(n, np.int64)
        after[:max(0, n - known)] = rank[known:] + 1
        rank = np.unique(rank.astype(np.int64) * (n + 2) + after, return_inverse=True)[1]
        known *= 2
    return np.argsort(rank, kind="stable")


def occurrences(model: Model, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, the range of suffixes that start with it."""
    n = len(codes)
    text = np.concatenate([codes, np.zeros(model.width, np.int64)])
    low, high = np.zeros(len(model.ids), np.int64), np.full(len(model.ids), n, np.int64)
    for j in range(model.width):
        now = np.flatnonzero((model.lengths > j) & (low < high))
        wanted = model.codes[now, j]
        for upper in (False, True):
            a, b = low[now], high[now]
            while len(open_ := np.flatnonzero(a < b)):
                middle = (a[open_] + b[open_]) >> 1
                here = text[order[middle] + j]
                right = here <= wanted[open_] if upper else here < wanted[open_]
                a[open_] = np.where(right, middle + 1, a[open_])
                b[open_] = np.where(right, b[open_], middle)
            if upper:
                top = a
            else:
                bottom = a
        low[now], high[now] = bottom, top
    high[model.lengths == 0] = 0
    return low, high


class _Edges:
    """Occurrences of pieces, sorted by position and length."""

    def __init__(self, model: Model, codes: np.ndarray):
        order = suffix_array(codes, model.width)
        low, high = occurrences(model, codes, order)
        count = np.maximum(high - low, 0)
        at = np.arange(count.sum())
        at -= np.repeat(np.cumsum(count) - count - low, count)
        # Places and lengths in one number, whatever the longest piece is.
        self.width = model.width + 1
        key = order[at] * self.width
        del at
        key += np.repeat(model.lengths, count)
        by_place = np.argsort(key)
        self.keys = key[by_place]
        del key
        self.piece_ids = np.repeat(model.ids.astype(np.int32), count)[by_place]

    def find(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The piece over each stretch, or -1."""
        size = end - start
        if not len(self.keys):
            return np.full(len(start), -1, np.int64)
        key = np.where(size < self.width, start * self.width + size, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.piece_ids[at], -1)


def _relax_together(model: Model, edges: _Edges, start: np.ndarray, unit: np.ndarray):
    """Join symbols of all units at once, one join a unit and round."""
    end = start + 1
    piece = np.full(len(start), -1, np.int64)

    def best_of(left, right):
        found = edges.find(start[left], end[right])
        found[unit[left] != unit[right]] = -1
        return found

    i = np.arange(len(start) - 1)
    pair = np.append(best_of(i, i + 1), -1) if len(start) else np.empty(0, np.int64)
    done = []
    while len(start):
        heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        key = (np.where(pair >= 0, model.rank[pair], _NONE) << 32) | np.arange(len(start))
        best = np.minimum.reduceat(key, heads)
        going = (best >> 32) < _NONE
        if not going.all():
            stay = np.repeat(going, np.diff(np.append(heads, len(start))))
            done.append((start[~stay], end[~stay], piece[~stay], unit[~stay]))
            moved = np.cumsum(stay) - 1
            start, end, piece, unit, pair = (x[stay] for x in (start, end, piece, unit, pair))
            best = moved[best[going] & 0xFFFFFFFF]
        else:
            best = best & 0xFFFFFFFF
        if not len(best):
            break
        end[best], piece[best] = end[best + 1], pair[best]
        keep = np.ones(len(start), bool)
        keep[best + 1] = False
        moved = np.cumsum(keep) - 1
        start, end, piece, unit, pair = (x[keep] for x in (start, end, piece, unit, pair))
        best = moved[best]
        pair[best] = -1
        right = best[best + 1 < len(start)]
        pair[right] = best_of(right, right + 1)
        left = best[best > 0] - 1
        pair[left] = best_of(left, left + 1)
    if not done:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*done))


def _relax_alone(model: Model, edges: _Edges, first: int, last: int):
    """Join the symbols of one long unit from a heap of its pairs."""
    n = last - first
    start = np.arange(first, last)
    found = edges.find(start[:-1], start[:-1] + 2)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end, piece, alive = [first + i + 1 for i in range(n)], [-1] * n, [True] * n
    heap = [(int(model.rank[p]), i, first + i + 2, int(p)) for i, p in enumerate(found.tolist()) if p >= 0]
    heapq.heapify(heap)

    def offer(i):
        j = after[i]
        if j < n:
            p = int(edges.find(np.array([first + i]), np.array([end[j]]))[0])
            if p >= 0:
                heapq.heappush(heap, (int(model.rank[p]), i, end[j], p))

    while heap:
        _, i, stop, p = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], piece[i], alive[j] = stop, p, False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    kept = [i for i in range(n) if alive[i]]
    return [first + i for i in kept], [end[i] for i in kept], [piece[i] for i in kept]


def encode_units(model: Model, units: list[str]) -> list[bytes]:
    """Ids of each unit."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    points = np.frombuffer("\0".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = points + 1
    codes[(starts + sizes)[:-1]] = 0  # between units
    edges = _Edges(model, codes)
    short = sizes <= LONG
    unit = np.repeat(np.arange(len(units)), sizes)
    place = np.arange(len(unit)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    here = short[unit]
    parts = [_relax_together(model, edges, place[here], unit[here])]
    for u in np.flatnonzero(~short).tolist():
        a, b, p = _relax_alone(model, edges, int(starts[u]), int(starts[u] + sizes[u]))
        parts.append((np.array(a), np.array(b), np.array(p), np.full(len(a), u)))
    start, end, piece, unit = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(start, kind="stable")
    start, piece, unit = start[order], piece[order], unit[order]
    char = points[start]
    ids = np.where(piece >= 0, piece, model.char_ids[char])
    # Characters without a piece: one byte piece for ASCII, several for others.
    bare = ids < 0
    ids = np.where(bare & (char < 128), model.byte_ids[np.minimum(char, 127)], ids).astype("<u4")
    wide = np.flatnonzero(bare & (char >= 128))
    count = np.ones(len(ids), np.int64)
    if len(wide):
        coded = [np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8) for c in char[wide].tolist()]
        count[wide] = [len(c) for c in coded]
        at = np.cumsum(count) - count
        ids = np.repeat(ids, count)
        for k, c in zip(at[wide].tolist(), coded):
            ids[k:k + len(c)] = model.byte_ids[c]
    per_unit = np.bincount(unit, count, len(units)).astype(np.int64)
    blob, ends = ids.tobytes(), (4 * np.cumsum(per_unit)).tolist()
    return [blob[a:b] for a, b in zip([0, *ends], ends)]


def encode_texts(model: Model, texts: list[str]) -> list[bytes]:
    """Ids of each text."""
    number: dict[str, int] = {}
    rows, sizes = [], []
    for text in texts:
        found = _PARTS.findall(SPACE + text.replace(" ", SPACE)) if text else []
        rows.append(np.array([number.setdefault(u, len(number)) for u in found], np.int32))
        sizes.append(len(found))
    if not number:
        return [b""] * len(texts)
    units = list(number)
    coded = [model.remembered.get(u) for u in units]
    new, size = [], 0
    for i, unit in enumerate(units):
        if coded[i] is None:
            new.append(i)
            size += len(unit)
        if new and (size >= MATCHED or i == len(units) - 1):
            for k, ids in zip(new, encode_units(model, [units[k] for k in new])):
                coded[k] = ids
                if len(model.remembered) < REMEMBERED and len(units[k]) <= LONG:
                    model.remembered[units[k]] = ids
            new, size = [], 0
    flat = np.frombuffer(b"".join(coded), "<u4")
    count = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    begin = np.cumsum(count) - count
    row = np.concatenate(rows)
    per_row = count[row]
    out = flat[np.repeat(begin[row] - (np.cumsum(per_row) - per_row), per_row) + np.arange(per_row.sum())]
    ends = np.concatenate([[0], np.cumsum(per_row)])[np.cumsum(sizes)] * 4
    blob = out.astype("<u4").tobytes()
    return [blob[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def decode_ids(model: Model, ids: bytes) -> str:
    """The text of the ids; the space the encoder puts in front is taken off."""
    raw, n = model.raw, len(model.raw)
    text = b"".join([raw[i] if i < n else b"" for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
    return text.removeprefix(" ")


_MODELS: dict[str, Model] = {}


def load(path: str) -> Model:
    """The model of a file, read once in each worker."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode(docs: DataFrame, model_file: str, decoded: bool = False) -> DataFrame:
    """doc_id, text (null as empty) and ids of every document; with ``decoded`` also the ids' text."""

    def flush(model, ids, texts):
        coded = encode_texts(model, texts)
        back = {"decoded": pa.array([decode_ids(model, c) for c in coded], pa.string())} if decoded else {}
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()),
            "ids": pa.array(coded, pa.binary()), **back,
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids, texts, size = load(model_file), [], [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if size >= BATCH:
                    yield flush(model, ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield flush(model, ids, texts)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text string, ids binary" + (", decoded string" if decoded else ""))


def decode(ids: Column, model_file: str) -> Column:
    """The text of a column of ids."""

    @F.arrow_udf("string")
    def run(blobs: pa.Array) -> pa.Array:
        model = load(model_file)
        return pa.array([decode_ids(model, b or b"") for b in blobs.to_pylist()], pa.string())

    return run(ids)
