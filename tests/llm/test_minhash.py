from __future__ import annotations

import random

import numpy as np
from odd import no_documents, odd_documents

from riskloom.llm import common, minhash
from riskloom.llm.common import words_of
from riskloom.llm.queries import QUERIES


def shingle_set(text):
    w = words_of(text or "")
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    """component_id by row number; docs are (doc_id, text)."""
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = {}
    for i, s in enumerate(sets):
        for g in s:
            by_shingle.setdefault(g, []).append(i)
    pairs = {(i, j) for own in by_shingle.values() for j in own for i in own if i < j}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    return [(doc, len(s), ids.get(find(i))) for i, ((doc, _), s) in enumerate(zip(docs, sets))]


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(docs)))


def edited(base, changes, rng):
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def test_query(spark, small_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    rows = QUERIES["op6_minhash_dedup"](spark, small_dir).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == sorted(brute(docs))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_large_groups_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    docs = [(10_000 - i, edited(base, rng.randrange(0, 4), rng)) for i in range(700)]
    docs += [(20_000 + i, " ".join(base)) for i in range(80)]
    check(spark, docs)


def test_chains_of_many_outsiders(spark, monkeypatch):
    # Small blocks, so that both ways of comparing outsiders are taken.
    monkeypatch.setattr(minhash, "BLOCK", 6)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = [(i, edited(base, rng.choice([0, 1, 2, 3, 4, 6]), rng)) for i in range(150)]
    step = list(base)
    for i in range(60):
        step[(2 * i) % 120] = f"c{i}"
        docs.append((1000 + i, " ".join(step)))
    check(spark, docs)


def test_few_outsiders_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(common, "FEW", 3)  # no table is small enough to broadcast
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    docs = [(i, edited(base, rng.choice([0, 0, 0, 1, 5]), rng)) for i in range(160)]
    check(spark, docs)


def test_signature_estimates_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64))
    b = np.concatenate([a[:1700], np.random.default_rng(2).integers(0, 1 << 63, 300, dtype=np.uint64)])
    got = (minhash.signature(a) == minhash.signature(np.unique(b))).mean()
    assert abs(got - 1700 / 2300) < 0.15
    assert (minhash.signature(a) == minhash.signature(a[::-1].copy())).all()


def test_case_white_space_and_short_texts(spark):
    docs = [(5, "A b\nC"), (3, "a  B c"), (9, "a b"), (10, "a b c d e"), (11, "A B C D E"), (12, "É a b c d"),
            (13, "é a b c d"), (14, "one"), (15, "ONE\t"), (16, " "), (17, None), (18, ""), (7, "a b\x1cc")]
    check(spark, docs)


def test_odd_rows_and_one_of_each_group(spark):
    docs = odd_documents(spark)
    assert minhash.near_duplicates(docs).count() == docs.count()
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    # One of the equal rows 1, one of 8 and 9; rows without words all stay.
    assert ids == sorted(map(str, [1, 2, 3, 4, None, 5, 6, 7, 8, None]))
    assert minhash.near_duplicates(no_documents(spark)).count() == 0 == minhash.deduplicate(no_documents(spark)).count()


def test_a_hot_group_is_split(spark):
    """A third of the rows are near copies: no task of the comparison gets them all."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    docs = [(i, edited(base, 1, rng)) for i in range(600)]
    docs += [(1000 + i, " ".join(f"x{rng.randrange(10**9)}" for _ in range(30))) for i in range(1200)]
    check(spark, docs)
