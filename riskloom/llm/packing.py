"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of documents. A window of ``window`` tokens is ``window /
grain`` slots; in each window every queue is owed its share of the slots, takes
whole slots and carries the rest, its deficit, to the next window. The shares of a
round add up to one window. Queues are the leaves of a tree; at each fork the
slots that have come by so far are divided between the two sides in proportion,
rounded, so what a queue has taken after any number of slots has a closed form
that never falls, and so has its inverse. A deficit therefore never has to pass
from task to task: any task can work out the deficits at any window, and the
place of a document follows from its position in its queue alone.

A queue that runs dry leaves the round and the others' shares grow (a new phase).
What is left of a queue at the end of its phase, about a window's slots, is laid out end to end after the last phase. The last window is cut into powers
of two, so no sequence needs padding.

Input: ``doc_id``, ``text`` and ``source``. A null text is empty, a null source
is a queue of its own, rows that repeat a document are packed once each, an empty
table gives an empty result, and other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import look_up, stored, whole_text

WINDOW = 1024
GRAIN = 128
# Shares are whole numbers out of this, which keeps all products within 64 bits.
RESOLUTION = 1 << 20
# More sources than this share queues by hash, and so do their targets: the schedule, a
# number for each queue and phase, goes to every task.
MAX_QUEUES = 2_000
END_ID = 0

# Texts of these characters alone split the same way in both tokenizer libraries
# (tests compare them); the faster one takes them, the other takes the rest.
_PLAIN = re.compile(r"[\x00-ɏ‐-…]*")


# On the way to a queue: what is owed to the left side of a fork, to both sides,
# and whether the queue is on the right.
Fork = tuple[int, int, bool]


@dataclass(frozen=True)
class Phase:
    """Windows in which the same queues take part, by queue number.

    The queues, in order, are the leaves of a tree: each range of them is halved.
    """

    first_window: int
    windows: int
    active: np.ndarray
    reach: np.ndarray  # sums of the shares of the first 0, 1, 2, .. active queues
    taken: np.ndarray  # slots of an active queue that earlier phases used

    def place(self, queue: int) -> int:
        """The queue's place among the active ones, -1 if it is none."""
        at = int(np.searchsorted(self.active, queue))
        return at if at < len(self.active) and self.active[at] == queue else -1

    def forks(self, place: int) -> list[Fork]:
        low, high, out = 0, len(self.active), []
        while high - low > 1:
            middle = low + (high - low) // 2
            right = place >= middle
            out.append((int(self.reach[middle] - self.reach[low]), int(self.reach[high] - self.reach[low]), right))
            low, high = (middle, high) if right else (low, middle)
        return out

    def shared(self, n: int) -> np.ndarray:
        """Of the first n slots of the phase, those of each active queue."""
        low, high, slots = np.array([0]), np.array([len(self.active)]), np.array([n])
        while (high - low > 1).any():
            middle = low + (high - low) // 2
            whole = high - low <= 1
            a, t = self.reach[middle] - self.reach[low], self.reach[high] - self.reach[low]
            left = np.where(whole, 0, _left(slots, a, np.maximum(t, 1)))
            # A single queue stays as the right side of nothing.
            low, high, slots = (
                np.stack([x, y], axis=1).ravel() for x, y in ((low, middle), (middle, high), (left, slots - left)))
            kept = high > low
            low, high, slots = low[kept], high[kept], slots[kept]
        return slots


@dataclass(frozen=True)
class Schedule:
    queues: dict[str, int]
    phases: list[Phase]
    windows: int
    body: list[int]  # tokens of a queue that the phases place
    tail: list[int]  # where the rest of a queue starts after the last phase
    tail_tokens: int
    window: int
    grain: int


def _left(n, a, t):
    """Of n slots of a fork, those of its left side: n * a / t, rounded."""
    return (2 * n * a + t) // (2 * t)


def plan_schedule(tokens: dict[str, int], targets: dict[str, float] | None = None,
                  window: int = WINDOW, grain: int = GRAIN) -> Schedule:
    """The rounds for queues of so many tokens.

    ``targets`` are the wanted proportions; without them every window gets the
    proportions of the whole corpus. A queue without a target gets the least share.
    """
    if window % grain:
        raise ValueError("a window must be a whole number of slots")
    slots, names = window // grain, sorted(tokens)
    left = np.array([tokens[n] // grain for n in names], np.int64)
    wanted = [float((targets or tokens).get(n, 0)) for n in names]
    whole = sum(wanted) or 1.0
    share = np.array([max(1, round(RESOLUTION * x / whole)) for x in wanted], np.int64)
    taken, phases, windows = np.zeros(len(names), np.int64), [], 0
    active = np.flatnonzero(left)
    while len(active):
        reach = np.concatenate([[0], np.cumsum(share[active])])
        # Each fork may round a queue up by part of a slot; none may be overdrawn.
        spare = 1 + len(active).bit_length()

        def lasting(reach=reach, spare=spare):
            return (left[active] - spare) * reach[-1] // (share[active] * slots)

        count = max(0, int(lasting().min()))
        if count:
            phase = Phase(windows, count, active, reach, taken[active])
            phases.append(phase)
            used = phase.shared(count * slots)
            taken[active] += used
            left[active] -= used
            windows += count
        # What stops the phase is a queue with about a window's slots left.
        active = active[lasting() >= 1]
    taken = taken.tolist()
    body = [taken[i] * grain for i in range(len(names))]
    rests = [tokens[n] - b for n, b in zip(names, body)]
    tail = np.concatenate([[0], np.cumsum(rests, dtype=np.int64)]).tolist()
    return Schedule({n: i for i, n in enumerate(names)}, phases, windows, body,
                    tail[:-1], tail[-1], window, grain)


def slot_places(s: Schedule, queue: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and slot in it, for slots of one queue."""
    per = s.window // s.grain
    sequence, place = np.empty_like(slots), np.empty_like(slots)
    # A queue is in the first phases and, once it has left, in no further one.
    places = [p for p in (phase.place(queue) for phase in s.phases) if p >= 0]
    firsts = np.array([int(phase.taken[at]) for phase, at in zip(s.phases, places)])
    phase_of = np.searchsorted(firsts, slots, "right") - 1
    for number in np.unique(phase_of):
        phase, first = s.phases[number], firsts[number]
        forks, here = phase.forks(places[number]), phase_of == number
        k = slots[here] - first
        # From the queue's own count of slots up to the phase's.
        n = k
        for a, t, right in reversed(forks):
            n = (2 * n + 1) * t // (2 * (t - a)) if right else -((2 * n + 1) * t // (-2 * a)) - 1
        window = n // per
        # In a window the queues stand in the order of the tree.
        low, high, before = window * per, (window + 1) * per, np.zeros_like(k)
        for a, t, right in forks:
            x, y = _left(low, a, t), _left(high, a, t)
            if right:
                before += y - x
                low, high = low - x, high - y
            else:
                low, high = x, y
        sequence[here] = phase.first_window + window
        place[here] = before + k - low
    return sequence, place


def _tail_sequences(s: Schedule) -> tuple[np.ndarray, np.ndarray]:
    """Starts, in the tail, of its sequences, and where it ends."""
    full = s.tail_tokens // s.window
    starts, at = [i * s.window for i in range(full)], full * s.window
    size = s.window
    while at < s.tail_tokens:
        while size > s.tail_tokens - at:
            size //= 2
        starts.append(at)
        at += size
    return np.array(starts, dtype=np.int64), np.array([*starts, at], dtype=np.int64)[1:]


def cut_pieces(s: Schedule, queue: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Pieces of documents at ``start`` in their queues.

    Returns document number, start in the document, length, sequence, offset.
    """
    body, tail = np.array(s.body, dtype=np.int64), np.array(s.tail, dtype=np.int64)
    edge, end = body[queue], start + size
    doc_parts, from_parts, to_parts, seq_parts, off_parts = [], [], [], [], []
    for q in np.unique(queue):
        own = np.flatnonzero((queue == q) & (start < edge))
        if not len(own):
            continue
        first = start[own] // s.grain
        stop = np.minimum(end[own], edge[own])
        count = (stop - 1) // s.grain - first + 1
        doc = np.repeat(own, count)
        ahead = np.cumsum(count) - count
        slot = np.repeat(first - ahead, count) + np.arange(len(doc))
        begin = np.maximum(slot * s.grain, start[doc])
        over = np.minimum(np.minimum((slot + 1) * s.grain, end[doc]), body[q])
        sequence, place = slot_places(s, int(q), slot)
        doc_parts.append(doc)
        from_parts.append(begin)
        to_parts.append(over)
        seq_parts.append(sequence)
        off_parts.append(place * s.grain + begin - slot * s.grain)
    starts, stops = _tail_sequences(s)
    for d in np.flatnonzero(end > edge):
        shift = tail[queue[d]] - edge[d]  # from the queue's to the tail's positions
        a, b = max(start[d], edge[d]) + shift, end[d] + shift
        i, j = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
        number = np.arange(i, j)
        begin, over = np.maximum(starts[i:j], a), np.minimum(stops[i:j], b)
        doc_parts.append(np.full(j - i, d))
        from_parts.append(begin - shift)
        to_parts.append(over - shift)
        seq_parts.append(s.windows + number)
        off_parts.append(begin - starts[i:j])
    if not doc_parts:
        return (np.empty(0, np.int64),) * 5
    doc, begin, over, seq, off = (np.concatenate(x) for x in (doc_parts, from_parts, to_parts, seq_parts, off_parts))
    order = np.lexsort((begin, doc))
    doc, begin, over, seq, off = (x[order] for x in (doc, begin, over, seq, off))
    # Neighbouring slots of a document in one sequence are one piece.
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1]) | (off[1:] != off[:-1] + over[:-1] - begin[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(doc)) - 1
    doc, begin = doc[head], begin[head]
    return doc, begin - start[doc], over[last] - begin, seq[head], off[head]


def load_encoder(tokenizer: str):
    """A function from text to ids, the same as the tokenizer file gives alone."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    fast = None
    ranks = tokenizer.removesuffix(".json") + ".tiktoken"
    try:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                 mergeable_ranks=merges, special_tokens={})
    except (ModuleNotFoundError, FileNotFoundError):  # no rank file beside this tokenizer
        pass
    specials = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if fast is not None and _PLAIN.fullmatch(text) and not any(t in text for t in specials):
            return fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids

    return encode


_ENCODERS: dict[str, object] = {}


def encoder(tokenizer: str):
    """The encoder of a file, loaded once in each worker."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = load_encoder(tokenizer)
    return _ENCODERS[tokenizer]


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents with their ids, end id included, and their place in their task's part of the queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            starts, sizes, blobs = [], [], []
            for text, queue in zip(batch["text"].to_pylist(), batch["queue"].to_pylist()):
                ids = encode(text)
                ids.append(END_ID)
                starts.append(at.get(queue, 0))
                sizes.append(len(ids))
                at[queue] = starts[-1] + len(ids)
                blobs.append(np.array(ids, "<u4").tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "queue": batch["queue"],
                "part": pa.array([part] * len(sizes), pa.int32()), "start": pa.array(starts, pa.int64()),
                "size": pa.array(sizes, pa.int64()), "ids": pa.array(blobs, pa.binary()),
            })

    return docs.mapInArrow(run, "doc_id bigint, queue string, part int, start bigint, size bigint, ids binary")


def _queues(docs: DataFrame) -> DataFrame:
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    if docs.select(name.alias("q")).distinct().limit(MAX_QUEUES + 1).count() > MAX_QUEUES:
        name = _shared_queue(name)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"), name.alias("queue"))


def _shared_queue(name: Column) -> Column:
    return F.concat(F.lit("#"), F.pmod(F.xxhash64(name), F.lit(MAX_QUEUES)).cast("string"))


def _wanted(spark: SparkSession, targets: dict[str, float], queues: Iterable[str]) -> dict[str, float]:
    """Targets by queue: of queues that sources share, the sum of their sources' targets."""
    named = {f"={source}": float(share) for source, share in targets.items()}
    if not any(q.startswith("#") for q in queues):
        return named
    rows = spark.createDataFrame(list(named.items()), "name string, share double")
    return {r["queue"]: r["share"] for r in rows.groupBy(_shared_queue(F.col("name")).alias("queue")).agg(F.sum("share").alias("share")).collect()}


def pack(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None,
         window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """Pieces of all documents: where each lies, and its ids (32-bit, little-endian).

    Columns: doc_id, queue, start, length, doc_tokens, sequence_id, offset, ids.
    ``targets`` gives wanted proportions by source. Two stages read the texts'
    ids; what the driver sees is one total per queue (at most ``MAX_QUEUES``). Ids stay
    where they are while the places of tasks' queues are few enough to be sent to them.
    """
    tokens = stored(tokenize(_queues(docs), tokenizer), "packing-tokens")
    parts = tokens.groupBy("part", "queue").agg(F.sum("size").alias("size"))
    # One row per task and queue: where the task's part of the queue starts.
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(
        parts.select("part", "queue", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")),
        "packing-parts",
    )
    totals = {r["queue"]: r["n"] for r in bases.groupBy("queue").agg(F.sum("size").alias("n")).collect()}
    wanted = _wanted(docs.sparkSession, targets, totals) if targets else None
    schedule = plan_schedule(totals, wanted, window, grain)
    placed = look_up(tokens, bases.select("part", "queue", "base"), ["part", "queue"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.array([schedule.queues[q] for q in batch["queue"].to_pylist()], np.int64)
            size = batch["size"].to_numpy()
            start = batch["base"].to_numpy() + batch["start"].to_numpy()
            doc, begin, length, sequence, offset = cut_pieces(schedule, number, start, size)
            blobs = batch["ids"].to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"].take(pa.array(doc)), "queue": batch["queue"].take(pa.array(doc)),
                "start": begin, "length": length, "doc_tokens": size[doc],
                "sequence_id": sequence, "offset": offset,
                "ids": pa.array([blobs[d][4 * a:4 * (a + n)] for d, a, n in
                                 zip(doc.tolist(), begin.tolist(), length.tolist())], pa.binary()),
            })

    return placed.mapInArrow(
        run, "doc_id bigint, queue string, start bigint, length bigint, doc_tokens bigint, "
             "sequence_id bigint, offset bigint, ids binary")
