from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from odd import no_documents, odd_documents
from tokenizers import Tokenizer

from riskloom.llm import packing
from riskloom.llm.queries import QUERIES, tokenizer

FILE = tokenizer("byte_bpe_50k.json")


def all_pieces(tokens, docs, **how):
    """Schedule, and the pieces of documents of these sizes in order."""
    s = packing.plan_schedule(tokens, **how)
    queue, start, size, at = [], [], [], defaultdict(int)
    for name, n in docs:
        queue.append(s.queues[name])
        start.append(at[name])
        size.append(n)
        at[name] += n
    return s, packing.cut_pieces(s, np.array(queue), np.array(start), np.array(size)), queue, size


def check_layout(pieces, size, window):
    doc, start, length, seq, off = pieces
    for d, n in enumerate(size):
        own = doc == d
        assert start[own][0] == 0 and (start[own][1:] == (start[own] + length[own])[:-1]).all()
        assert length[own].sum() == n and (length[own] > 0).all()
    filled = defaultdict(list)
    for s, o, n in zip(seq.tolist(), off.tolist(), length.tolist()):
        filled[s].append((o, n))
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == window or at & (at - 1) == 0 and at < window
    assert sorted(filled) == list(range(len(filled)))


@pytest.mark.parametrize("seed", range(12))
def test_every_token_once_and_no_padding(seed):
    random = np.random.default_rng(seed)
    names = [f"s{i}" for i in range(random.integers(1, 30))]
    docs = [(names[random.integers(0, len(names)) if random.random() < 0.7 else 0], int(random.integers(1, 900)))
            for _ in range(random.integers(1, 300))]
    tokens = defaultdict(int)
    for name, n in docs:
        tokens[name] += n
    targets = {n: float(random.integers(1, 9)) for n in names} if seed % 2 else None
    s, pieces, _, size = all_pieces(dict(tokens), docs, targets=targets, window=64, grain=8)
    check_layout(pieces, size, 64)


def test_windows_keep_the_target_and_carry_deficits():
    docs = [("a", 100)] * 900 + [("b", 100)] * 700 + [("c", 50)] * 1000
    tokens = {"a": 90_000, "b": 70_000, "c": 50_000}
    s, (doc, _, length, seq, _), queue, _ = all_pieces(tokens, docs, targets={"a": 5, "b": 3, "c": 2}, window=64, grain=8)
    until = s.phases[0].windows
    assert until > 1500
    owner = np.array(queue)[doc]
    for name, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        got = np.bincount(seq[owner == s.queues[name]], length[owner == s.queues[name]], s.windows)[:until]
        ahead = np.cumsum(got) - np.arange(1, until + 1) * 64 * share
        assert np.abs(ahead).max() <= 2 * 8  # two slots


def test_shares_stay_within_64_bits():
    tokens = {f"s{i}": 10**13 // (i + 1) for i in range(20)}
    s = packing.plan_schedule(tokens)
    for name, q in s.queues.items():
        slots = np.array([0, s.body[q] // packing.GRAIN - 1])
        seq, place = packing.slot_places(s, q, slots)
        assert (seq >= 0).all() and (seq < s.windows).all() and (place < 8).all() and seq[0] < seq[1]


def test_tokenizers_agree_on_plain_text():
    slow, fast = Tokenizer.from_file(FILE), packing.encoder(FILE)
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2027)]]
    random = np.random.default_rng(1)
    texts = ["a" + c + c + "1" + c + " " + c + "b" for c in chars]
    texts += ["".join(random.choice(chars, 200)) for _ in range(300)]
    texts += ["<|endoftext|> x", "日本 <|endoftext|>", ""]
    for t in texts:
        assert fast(t) == slow.encode(t, add_special_tokens=False).ids, t


def check_table(rows, docs):
    """``docs``: (doc_id, text); ids that repeat must have equal texts."""
    slow = Tokenizer.from_file(FILE)
    want = defaultdict(list)
    for doc, text in docs:
        want[doc].append(np.array([*slow.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    assert set(got) == set(want)
    for doc, pieces in got.items():
        copies = len(want[doc])
        covered = defaultdict(int)
        for r in pieces:
            fits = [ids for ids in want[doc] if len(ids) == r["doc_tokens"]
                    and zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
            assert fits
            covered[r["doc_tokens"]] += r["length"]
        assert sum(covered.values()) == sum(map(len, want[doc])), (doc, copies)
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 1024 or at & (at - 1) == 0 and at < 1024


def test_query(spark, small_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    check_table(QUERIES["op1_mixture_packing"](spark, small_dir).collect(), docs)


def test_odd_rows_and_targets(spark):
    from pyspark.sql import functions as F

    docs = odd_documents(spark)
    want = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for targets in (None, {"a": 1.0, "b": 3.0}):
        packed = packing.pack(docs, FILE, targets)
        check_table(packed.withColumn("ids_crc32", F.crc32("ids")).collect(), want)
    assert packing.pack(no_documents(spark), FILE).count() == 0


def test_many_sources_share_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"text {i} " * (i % 9), f"s{i % 11}") for i in range(60)], "doc_id long, text string, source string")
    rows = packing.pack(docs, FILE).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert len({r["queue"] for r in rows}) <= 3
    check_table(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_thousand_sources_keep_their_targets():
    random = np.random.default_rng(3)
    names = [f"s{i:04d}" for i in range(1000)]
    tokens = {n: int(random.integers(50_000, 5_000_000)) for n in names}
    targets = {n: float(random.integers(1, 50)) for n in names}
    s = packing.plan_schedule(tokens, targets)
    share = np.array([targets[n] for n in sorted(names)]) / sum(targets.values())
    phase = s.phases[0]
    assert phase.windows > 1000 and len(phase.active) == 1000
    for windows in (1, 2, 17, 333, phase.windows):
        taken = phase.shared(windows * 8)
        assert taken.sum() == windows * 8
        # Shares are whole numbers, which over many windows adds a little.
        assert np.abs(taken - windows * 8 * share).max() <= 2 + windows * 8 * 1000 / packing.RESOLUTION
    # Every slot of a queue has a place of its own.
    seen = set()
    for name in random.choice(names, 25, replace=False):
        q = s.queues[name]
        slots = np.arange(min(s.body[q] // packing.GRAIN, 2000))
        sequence, place = packing.slot_places(s, q, slots)
        new = set(zip(sequence.tolist(), place.tolist()))
        assert len(new) == len(slots) and not new & seen and (place < 8).all() and (np.diff(sequence) >= 0).all()
        seen |= new
    assert sum(s.body) + s.tail_tokens == sum(tokens.values()) and s.tail_tokens < 1000 * 60 * packing.GRAIN


def test_shared_queues_share_targets(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    targets = {f"s{i}": float(i + 1) for i in range(6)}
    got = packing._wanted(spark, targets, ["#0", "#1"])
    assert set(got) <= {"#0", "#1"} and sum(got.values()) == sum(targets.values())
    assert packing._wanted(spark, targets, ["=s0"]) == {f"={k}": v for k, v in targets.items()}


def test_large_tables_of_places_are_joined_by_shuffle(spark, monkeypatch, small_dir):
    from riskloom.llm import common

    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "source").limit(60).repartition(3)
    order = ["doc_id", "start", "length"]
    want = sorted(map(tuple, packing.pack(docs.orderBy("doc_id").coalesce(1), FILE).select(*order).collect()))
    monkeypatch.setattr(common, "FEW", -1)
    got = sorted(map(tuple, packing.pack(docs.orderBy("doc_id").coalesce(1), FILE).select(*order).collect()))
    assert got == want
