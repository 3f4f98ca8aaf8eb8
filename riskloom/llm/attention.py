"""Language-model scores: word counts, and a causal self-attention model.

Base score: every word's count over all training texts, smoothed. Words are held
as 64-bit hashes, made once. Frequent words (at most ``HEAD``) go to every task; the rest of
a document's words meet their counts in a join, so nothing of the vocabulary's
size passes through the driver or one task.

Model: one layer of causal self-attention over subwords. It predicts a class of
subwords; within a class the counts over all training texts decide. Classes come
from what stands before each type, and the output starts from how often each class
follows each type, both counted over all training tokens. What attention adds to
that is trained on every window of every training text: in each of a few rounds a task
goes step by step through its share of the round's windows, and the rounds go on from the
mean of what the tasks found, weighted by windows. A text is cut into windows of ``CONTEXT`` subwords and the ``STEP`` after
them: the context is only looked back on, so each subword is scored once, with at
least ``CONTEXT`` before it where the text has them. Windows go through in batches
with one mask.

A null or empty text is its end alone. Without training texts the base score is 0
and the model is uniform. Rows that repeat are scored once each, an empty table
gives an empty result, other columns are not looked at.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import held_out, scratch, stored, whole_text, words_of
from riskloom.operators.joins import many_to_one

HOLD_OUT = 10
SMOOTHING = 0.1
# Words whose counts go to every task (16 bytes each).
HEAD = 1 << 20
# Words a task counts before it hands the counts on.
COUNTED = 2_000_000

CONTEXT, STEP = 16, 32
SPAN = CONTEXT + STEP
WIDTH = 16
CLASSES = 64
TYPES = 4096
RARE = 64
# Windows of a step of the training, and rounds after which tasks share what they learned.
BATCH, ROUNDS = 96, 8
# A corpus of fewer windows than this product is gone over several times, in one round.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 3_000, 8
# Windows a task holds at once while it learns.
HELD = 20_000
CHUNK = 64
BUCKETS = 128
# Weight of a class's own share beside the counts after a type.
PRIOR = 16.0
# Subwords whose pairs are counted at once.
PAIRS = 500_000
RATE = 0.01
SHAPES = {"E": (TYPES + 3, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH),
          "r": (WIDTH, WIDTH), "U": (WIDTH, CLASSES), "b": (CLASSES,), "rel": (SPAN,)}
# Sums of parameters over tasks are whole numbers, so that their order doesn't show.
UNIT = 1 << 20
_FAR = np.float32(-1e9)


# Parameters after training, from those at the start, types of subwords, classes of types and the prior.
Learn = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray | None], dict[str, np.ndarray]]
# From types, columns, their number and whether to look back to counts of types by columns.
Gather = Callable[[np.ndarray, np.ndarray, int, bool], np.ndarray]


# Subwords ------------------------------------------------------------------------


def load_ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The encoding of a file, read once in each worker."""
    if path not in _ENCODINGS:
        _ENCODINGS[path] = load_ranks(path)
    return _ENCODINGS[path]


# The model -------------------------------------------------------------------------


@dataclass(frozen=True)
class Attention:
    """Tables by subword type, and the way from subwords to types and classes.

    Subword ids are 0 to n - 1; n is the end, n + 1 the start, n + 2 nothing.
    """

    type_of: np.ndarray
    class_of: np.ndarray
    within: np.ndarray  # log10 probability of a subword in its class
    tables: dict[str, np.ndarray]

    @property
    def end(self) -> int:
        return len(self.within) - 1


def windows_of(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of a text's windows; ``end + 2`` fills up."""
    n = len(ids) + 1
    count = -(-n // STEP)
    flat = np.full(CONTEXT + count * STEP, end + 2, np.int64)
    flat[CONTEXT] = end + 1
    flat[CONTEXT + 1:CONTEXT + n] = ids
    target = np.full(count * STEP, end + 2, np.int64)
    target[:n - 1] = ids
    target[n - 1] = end
    inputs = flat[np.arange(count)[:, None] * STEP + np.arange(SPAN)]
    return inputs, target.reshape(count, STEP)


def _mask() -> tuple[np.ndarray, np.ndarray]:
    """Distance of a window's queries to its inputs, and what they must not see."""
    back = np.arange(STEP)[:, None] + CONTEXT - np.arange(SPAN)[None]
    return np.maximum(back, 0), np.where(back < 0, _FAR, np.float32(0))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _buckets(seed: int) -> np.ndarray:
    """Types in so many columns."""
    return np.random.default_rng(seed).integers(0, BUCKETS, TYPES + 3)


def _classes(inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray, seed: int,
             seen: np.ndarray | None = None) -> np.ndarray:
    """Classes of types that follow alike types (k-means on what stands before).

    ``seen`` counts what stands before a type; without it the windows are counted.
    """
    random = np.random.default_rng(seed)
    before = random.integers(0, BUCKETS, TYPES + 3)
    if seen is None:
        seen = np.zeros((TYPES + 3, BUCKETS), np.float32)
        real = targets < TYPES + 2
        np.add.at(seen, (targets[real], before[inputs[:, CONTEXT:][real]]), 1)
    rows = np.sqrt(seen / np.maximum(seen.sum(1, keepdims=True), 1))
    used = np.flatnonzero(seen.sum(1) > 0)
    out = np.zeros(TYPES + 3, np.int64)
    if not len(used):
        return out
    mass = np.sqrt(weight[used] + 1)
    centres = rows[random.choice(used, min(CLASSES, len(used)), replace=False, p=mass / mass.sum())]
    for _ in range(8):
        nearest = (rows[used] @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows[used] * mass[:, None])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
    out[used] = nearest
    return out


def train_attention(counts: np.ndarray, samples: list[np.ndarray], steps: int = 250, batch: int = BATCH,
                    rate: float = RATE, seed: int = 5, gather: Gather | None = None,
                    learn: Learn | None = None) -> Attention:
    """Fit the model; ``counts`` by subword with the end last, ``samples`` rows of SPAN + 1 subwords.

    A sample is a window's inputs and the subword after them. ``gather`` counts pairs of
    neighbours over all training tokens; without it only the samples tell of context. ``learn``
    trains on windows that are elsewhere; without it ``steps`` batches of samples are drawn.
    """
    end = len(counts) - 1
    # Frequent subwords are types of their own, the rest share some.
    order = np.argsort(-counts[:end], kind="stable")
    type_of = np.empty(end + 3, np.int64)
    own = min(TYPES - RARE, end)
    type_of[order[:own]] = np.arange(own)
    type_of[order[own:]] = TYPES - RARE + np.arange(end - own) % RARE
    type_of[end:] = [TYPES, TYPES + 1, TYPES + 2]
    weight = np.bincount(type_of[:end + 1], counts, TYPES + 3)
    x = np.array(samples, np.int64).reshape(len(samples), SPAN + 1)
    x = type_of[x]
    inputs, targets = x[:, :SPAN], x[:, CONTEXT + 1:]
    seen = gather(type_of, _buckets(seed)[type_of], BUCKETS, True) if gather else None
    class_of_type = _classes(inputs, targets, weight, seed, seen)
    class_of = class_of_type[type_of[:end + 1]]
    smooth = counts + 0.1
    within = np.log10(smooth / np.bincount(class_of, smooth, CLASSES)[class_of])

    random = np.random.default_rng(seed)
    p = {name: random.normal(0, 0.3, shape) for name, shape in SHAPES.items() if name not in ("b", "rel")}
    totals = np.bincount(class_of, counts, CLASSES) + 1
    p["b"] = np.log(totals / totals.sum())
    p["rel"] = np.zeros(SPAN)
    prior = None
    if gather:
        after, share = gather(type_of, class_of_type[type_of], CLASSES, False), totals / totals.sum()
        prior = np.log((after + PRIOR * share) / (after.sum(1, keepdims=True) + PRIOR)) - p["b"]
    back, hidden = _mask()
    if learn:
        p = learn(p, type_of, class_of_type, prior)
    elif len(inputs):
        adam = Adam(p, rate)
        for _ in range(steps):
            pick = random.integers(0, len(inputs), batch)
            adam.step(_gradients(p, inputs[pick], targets[pick], class_of_type, back, hidden, prior))
    scale = 1 / math.sqrt(WIDTH)
    tables = {
        "Q": p["E"] @ p["q"] * scale, "K": p["E"] @ p["k"], "V": p["E"] @ p["v"], "R": p["E"] @ p["r"],
        "U": p["U"], "b": p["b"], "bias": p["rel"][back] + hidden,
    }
    if prior is not None:
        tables["P"] = prior
    return Attention(type_of, class_of, within, {n: a.astype(np.float32) for n, a in tables.items()})


class Adam:
    """Steps of gradient descent by the running moments of the gradients, in place."""

    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.steps = p, rate, 0
        self.m, self.s = ({n: np.zeros_like(a) for n, a in p.items()} for _ in range(2))

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        first, second = 1 - 0.9**self.steps, 1 - 0.98**self.steps
        for name, g in gradients.items():
            m, s = self.m[name], self.s[name]
            m *= 0.9
            m += 0.1 * g
            s *= 0.98
            g = g * g
            g *= 0.02
            s += g
            change = np.sqrt(s / second)
            change += 1e-8
            np.divide(m, change, out=change)
            change *= self.rate / first
            self.p[name] -= change


def _gradients(p, x, y, class_of_type, back, hidden, prior=None) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss of a batch of windows; ``prior`` by type is fixed.

    Numbers have the kind of ``p``. Attention and chances stay unnormalised; their sums
    are divided by where there are few columns.
    """
    kind, size = p["E"].dtype.type, len(x)
    scale = kind(1 / math.sqrt(WIDTH))
    e = p["E"].take(x, axis=0)
    flat, own = e.reshape(-1, WIDTH), e[:, CONTEXT:].reshape(-1, WIDTH)

    def rows(table):
        return table.reshape(size, -1, WIDTH)

    q, k, v, r = rows(own @ p["q"] * scale), rows(flat @ p["k"]), rows(flat @ p["v"]), own @ p["r"]
    bias = p["rel"].take(back) + hidden.astype(kind)
    a = q @ k.transpose(0, 2, 1)
    a += bias
    # Where exponents could grow too large their maximum is taken off first.
    if np.abs(q).max() * np.abs(k).max() * WIDTH + np.abs(p["rel"]).max() >= 80:
        a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    # Before a text's first window there is nothing; behind its end no target is real.
    a[x[:, 0] == TYPES + 2, :, :CONTEXT] = 0
    total = a.sum(axis=2).reshape(-1, 1)
    seen = (a @ v).reshape(-1, WIDTH)
    seen /= total
    z = seen + r
    chance = z @ p["U"]
    chance += p["b"]
    if prior is not None:
        chance += prior.take(x[:, CONTEXT:].ravel(), axis=0)
    if max(-chance.min(), chance.max()) >= 80:
        chance -= chance.max(axis=1, keepdims=True)
    np.exp(chance, out=chance)
    sums = chance.sum(axis=1)
    y = y.ravel()
    real = y != TYPES + 2
    chance[np.arange(len(y)), class_of_type.take(y)] -= sums
    wrong = (real / (sums * max(1, real.sum()))).astype(kind)[:, None]
    dz = chance @ p["U"].T
    dz *= wrong
    du, db = (z * wrong).T @ chance, wrong[:, 0] @ chance
    # What the softmax of attention takes off.
    mean = (dz * seen).sum(axis=1).reshape(size, -1, 1)
    dz_seen = rows(dz / total)
    ds = rows(dz) @ v.transpose(0, 2, 1)
    ds -= mean
    ds *= a
    ds /= total.reshape(size, -1, 1)
    dq, dk = (ds @ k).reshape(-1, WIDTH) * scale, (ds.transpose(0, 2, 1) @ q).reshape(-1, WIDTH)
    dv = (a.transpose(0, 2, 1) @ dz_seen).reshape(-1, WIDTH)
    de = dk @ p["k"].T
    de += dv @ p["v"].T
    rows(de)[:, CONTEXT:] += rows(dq @ p["q"].T + dz @ p["r"].T)
    table, x = np.empty_like(p["E"]), x.ravel()
    for j in range(WIDTH):
        table[:, j] = np.bincount(x, de[:, j], len(table))
    return {
        "E": table, "q": own.T @ dq, "k": flat.T @ dk, "v": flat.T @ dv, "r": own.T @ dz, "U": du, "b": db,
        "rel": np.bincount(back.ravel(), (ds.sum(0) * (hidden == 0)).ravel(), SPAN).astype(kind),
    }


def attention_scores(model: Attention, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text's subwords and end."""
    t, end = model.tables, model.end
    pairs = [windows_of(ids, end) for ids in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x, _ in pairs])
    x, y = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
    x = model.type_of[x]
    first = x[:, 0] == TYPES + 2
    # Where exponents could grow too large their maximum is taken off first.
    span = np.abs(t["Q"]).sum(1).max() * np.abs(t["K"]).max() + np.abs(t["bias"][t["bias"] > _FAR / 2]).max()
    # What a type says of the next class by itself.
    alone = t["R"] @ t["U"] + t["b"] + t.get("P", np.float32(0))
    reach = max(np.abs(alone).max(0) + np.abs(t["V"] @ t["U"]).max(0))
    ones, classes = np.ones(SPAN, np.float32), np.ones(CLASSES, np.float32)
    out = np.zeros(len(texts))
    for a in range(0, len(x), CHUNK):
        xi, yi = x[a:a + CHUNK], y[a:a + CHUNK]
        own = xi[:, CONTEXT:]
        s = t["Q"].take(own, axis=0) @ t["K"].take(xi, axis=0).transpose(0, 2, 1)
        s += t["bias"]
        s[first[a:a + CHUNK], :, :CONTEXT] = _FAR
        if span >= 80:
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        z = s @ t["V"].take(xi, axis=0)
        z /= (s @ ones)[:, :, None]
        level = z.reshape(-1, WIDTH) @ t["U"]
        level += alone.take(own.ravel(), axis=0)
        if reach >= 80:
            level -= level.max(axis=1, keepdims=True)
        yi = yi.ravel()
        real = np.flatnonzero(yi <= end)
        wanted = yi[real]
        chosen = level[real, model.class_of[wanted]].astype(np.float64)
        np.exp(level, out=level)
        chosen -= np.log((level @ classes)[real])
        points = chosen / math.log(10) + model.within[wanted]
        out += np.bincount(np.repeat(owner[a:a + CHUNK], STEP)[real], points, len(texts))
    return out


# Counts over the corpus ---------------------------------------------------------------


def _hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    split = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = [w for ws in split for w in ws]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat)), sizes


def word_counts(texts: DataFrame) -> DataFrame:
    """h (hash) and c (count) of every word; a column ``words`` holds a text's hashes."""

    def counted(parts):
        h, c = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_pydict({"h": h.view(np.int64), "c": c.astype(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            h = np.frombuffer(b"".join(batch["words"].to_pylist()), "<u8")
            parts.append(h)
            size += len(h)
            if size >= COUNTED:
                yield counted(parts)
                parts, size = [], 0
        if size:
            yield counted(parts)

    return texts.mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _frequent_from(words: DataFrame, most: int = HEAD) -> int:
    """The least power of two such that at most ``most`` words have that count."""
    steps = words.groupBy(F.floor(F.log2("c")).alias("b")).agg(F.count("*").alias("n")).collect()
    total, bar = 0, 1 << 62
    for b, n in sorted(((r["b"], r["n"]) for r in steps), reverse=True):
        total += n
        if total > most:
            break
        bar = 1 << b
    return bar


def subword_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """Counts of all subwords in the training texts (one number per subword)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch["ids"].to_pylist()), "<u4")
            counts += np.bincount(ids, minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": used, "n": counts[used]})

    out = np.zeros(size, np.float64)
    for r in tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def pair_counts(tokens: DataFrame, end: int, type_of: np.ndarray, column_of: np.ndarray, width: int,
                back: bool) -> np.ndarray:
    """Counts over all training tokens of (type, column of its neighbour), as a table of types by ``width``.

    The neighbour is the subword before (``back``) or after; a text begins with the start and ends with
    the end. Tasks add up their own table, so its size bounds what is shuffled per task and collected.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(
        ((type_of * width).astype(np.int32), column_of.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, columns = shared.value
        counts = np.zeros((TYPES + 3) * width, np.int64)
        start, stop = np.array([end + 1], "<u4"), np.array([end], "<u4")

        def count(parts):
            x = np.concatenate(parts)
            r, c = rows.take(x), columns.take(x)
            cells = r[1:] + c[:-1] if back else r[:-1] + c[1:]
            counts[:] += np.bincount(cells[x[1:] != end + 1], minlength=len(counts))

        for batch in batches:
            parts, size = [], 0
            for blob in batch["ids"].to_pylist():
                parts += [start, np.frombuffer(blob, "<u4"), stop]
                size += len(blob) // 4
                if size >= PAIRS:
                    count(parts)
                    parts, size = [], 0
            if parts:
                count(parts)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cell": used, "n": counts[used]})

    summed = tokens.select("ids").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((TYPES + 3) * width, np.float64)
    out[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return out.reshape(TYPES + 3, width)


def window_count(tokens: DataFrame) -> int:
    """How many windows the texts have."""
    subwords = F.octet_length("ids") / 4
    return tokens.agg(F.coalesce(F.sum(F.ceil((subwords + 1) / STEP)), F.lit(0)).alias("n")).first()["n"]


def _held_windows(batches: Iterator[pa.RecordBatch], end: int, type_of: np.ndarray):
    """Types of inputs and targets of all windows, at most about ``HELD`` at once and never a part of a text."""
    held, size = [], 0
    for batch in batches:
        for blob in batch["ids"].to_pylist():
            inputs, targets = windows_of(np.frombuffer(blob, "<u4"), end)
            held.append((type_of.take(inputs), type_of.take(targets)))
            size += len(inputs)
            if size >= HELD:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def learn_windows(tokens: DataFrame, end: int, p: dict[str, np.ndarray], type_of: np.ndarray,
                  class_of_type: np.ndarray, prior: np.ndarray | None) -> dict[str, np.ndarray]:
    """Parameters trained on every window of ``tokens``, each in one of the rounds.

    A round deals out rows by number, so it has its share of every task's rows. The driver gets
    one set of parameters a round, summed by Spark; what is shuffled follows the cores. How
    rows are spread over tasks shows in the parameters, the order of the sums doesn't.
    """
    spark = tokens.sparkSession
    windows, enough = window_count(tokens), SAMPLE_TEXTS * SAMPLE_WINDOWS
    if not windows:
        return p
    rounds, again = max(1, min(ROUNDS, windows // max(1, enough))), max(1, -(-enough // windows))
    fixed = spark.sparkContext.broadcast((
        type_of.astype(np.int32), class_of_type, None if prior is None else prior.astype(np.float32)))
    flat = np.concatenate([p[n].ravel() for n in SHAPES]).astype(np.float32)
    columns = [f"v{j}" for j in range(WIDTH)]

    for i in range(rounds):
        start = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], i=i, start=start) -> Iterator[pa.RecordBatch]:
            types, classes, prior = fixed.value
            mine = _unpacked(start.value.copy())
            adam, done, (back, hidden) = Adam(mine, RATE), 0, _mask()
            for inputs, targets in _held_windows(batches, end, types):
                random = np.random.default_rng((i, done))
                for _ in range(again):
                    order = random.permutation(len(inputs))
                    for a in range(0, len(order), BATCH):
                        pick = order[a:a + BATCH]
                        adam.step(_gradients(mine, inputs[pick], targets[pick], classes, back, hidden, prior))
                done += len(inputs)
            if done:
                moved = np.concatenate([mine[n].ravel() for n in SHAPES]).astype(np.float64) - start.value
                rows = np.rint(moved * done * UNIT).astype(np.int64).reshape(-1, WIDTH)
                # The last row holds the number of windows.
                rows = np.append(rows, np.full((1, WIDTH), done), axis=0)
                yield pa.RecordBatch.from_pydict(
                    {"part": np.arange(len(rows)), **{c: np.ascontiguousarray(rows[:, j]) for j, c in enumerate(columns)}})

        dealt = tokens.where(F.pmod("node", F.lit(rounds)) == i).select("ids").coalesce(
            2 * spark.sparkContext.defaultParallelism)
        sums = dealt.mapInArrow(run, "part bigint, " + ", ".join(f"{c} bigint" for c in columns)).groupBy("part").agg(
            *[F.sum(c).alias(c) for c in columns]).toArrow()
        moved = np.zeros((len(flat) // WIDTH + 1, WIDTH))
        moved[sums["part"].to_numpy()] = np.stack([sums[c].to_numpy() for c in columns], axis=1)
        if done := moved[-1, 0]:
            flat = (flat + moved[:-1].ravel() / (done * UNIT)).astype(np.float32)
        start.unpersist()
    return {n: a.astype(np.float64) for n, a in _unpacked(flat).items()}


def _unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters by name, as parts of one row of numbers."""
    sizes = np.cumsum([math.prod(shape) for shape in SHAPES.values()])
    return {n: a.reshape(SHAPES[n]) for n, a in zip(SHAPES, np.split(flat, sizes[:-1]))}


def _score_rows(texts: DataFrame, ranks: str) -> tuple[DataFrame, DataFrame, int, int, float]:
    """Scored rows with the words whose counts are still to be joined, those words' counts,
    the least count of a frequent word, the number of training tokens and the divisor."""
    spark = texts.sparkSession
    end = encoding(ranks).n_vocab

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks).encode_ordinary
        for batch in batches:
            column = batch["text"].to_pylist()
            h, sizes = _hashes(column)
            h = h.astype("<u8", copy=False)
            last = np.cumsum(sizes)
            yield pa.RecordBatch.from_pydict({
                "node": batch["node"], "doc_id": batch["doc_id"], "held_out": batch["held_out"],
                "ids": pa.array([np.array(encode(t), "<u4").tobytes() for t in column], pa.binary()),
                "words": pa.array([h[a:b].tobytes() for a, b in zip(last - sizes, last)], pa.binary())})

    # Subwords and hashes of words are all that is needed of a text.
    tokens = stored(
        texts.select(F.monotonically_increasing_id().alias("node"), "doc_id", "held_out", "text").mapInArrow(
            read, "node bigint, doc_id bigint, held_out boolean, ids binary, words binary"), "lm-subwords")
    learned = tokens.where("not held_out")
    n_texts = learned.count()

    words = stored(word_counts(learned.select("words")), "lm-words", leave=True)
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, distinct = size["n"] + n_texts, size["v"] + (n_texts > 0)
    below = n_all + SMOOTHING * (distinct + 1)
    bar = _frequent_from(words)
    head = words.where(F.col("c") >= bar).toArrow()
    order = np.argsort(head["h"].to_numpy().view(np.uint64))
    head_h, head_c = head["h"].to_numpy().view(np.uint64)[order], head["c"].to_numpy()[order]

    counts = np.append(subword_counts(learned, end), n_texts)
    model = train_attention(counts, [], gather=lambda *how: pair_counts(learned, end, *how),
                            learn=lambda *how: learn_windows(learned, end, *how))
    shared = spark.sparkContext.broadcast((head_h, np.log10((head_c + SMOOTHING) / below), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head_h, head_points, model = shared.value
            ids = [np.frombuffer(b, "<u4") for b in batch["ids"].to_pylist()]
            blobs = batch["words"].to_pylist()
            h, sizes = np.frombuffer(b"".join(blobs), "<u8"), np.fromiter((len(b) // 8 for b in blobs), np.int64, len(blobs))
            row = np.repeat(np.arange(len(ids)), sizes)
            # Words repeat within a batch, and a search in order is a quick one.
            words, which = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(head_h, words), max(0, len(head_h) - 1))
            known = (head_h[at] == words if len(head_h) else np.zeros(len(words), bool))[which]
            at = at[which]
            points = head_points[at[known]]
            rest_row, rest_h = row[~known], h[~known]
            order = np.lexsort((rest_h, rest_row))
            rest_row, rest_h = rest_row[order], rest_h[order]
            new = np.ones(len(rest_h), bool)
            new[1:] = (rest_h[1:] != rest_h[:-1]) | (rest_row[1:] != rest_row[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(rest_h)))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rest_row[first], minlength=len(ids)))]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "node": batch["node"], "doc_id": batch["doc_id"], "held_out": batch["held_out"],
                "n_tokens": sizes + 1,
                "known": np.bincount(row[known], minlength=len(ids)) + int(n_texts > 0),
                "points": np.bincount(row[known], points, len(ids)) + math.log10((n_texts + SMOOTHING) / below),
                "score": attention_scores(model, ids),
                "rest": pa.ListArray.from_arrays(offsets, rest_h[first].view(np.int64)),
                "times": pa.ListArray.from_arrays(offsets, times.astype(np.int64)),
            })

    scored = stored(
        tokens.mapInArrow(run, "node bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, "
                               "points double, score double, rest array<bigint>, times array<bigint>"), "lm-rows", leave=True)
    return scored, words, bar, n_all, below


def score_texts(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out(HOLD_OUT).alias("held_out"), whole_text().alias("text"))
    with scratch(docs.sparkSession):
        rows, words, bar, n_all, below = _score_rows(texts, ranks)
    rest = rows.select("node", F.explode(F.arrays_zip("rest", "times")).alias("w")).select(
        "node", F.col("w.rest").alias("h"), F.col("w.times").alias("times"))
    counted = rest.join(words.where(F.col("c") < bar), "h", "left")
    found = counted.groupBy("node").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + SMOOTHING) / below)).alias("rest_points"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rest_known"))
    return many_to_one(rows.drop("rest", "times"), found, ["node"], "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("points") + F.coalesce("rest_points", F.lit(0.0))).alias("base_score"), "score",
    )
