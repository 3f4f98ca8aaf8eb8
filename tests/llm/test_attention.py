from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import no_documents, odd_documents

from riskloom.llm import attention as at
from riskloom.llm.queries import QUERIES, tokenizer

FILE = tokenizer("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def is_held(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 10 == 0


def check_base(rows, docs):
    """docs: (doc_id, text); rows of one id are compared as a set."""
    counts = Counter()
    for doc, text in docs:
        if not is_held(doc):
            counts.update(words(text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for doc, text in docs:
        w = words(text)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((str(doc), is_held(doc), len(w), sum(counts[x] > 0 for x in w), n, round(base, 4)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-3
    assert len(got) == len(want) and all(r["score"] < 0 for r in rows)


@pytest.mark.parametrize("head", [40, 1 << 20])
def test_query(spark, small_dir, monkeypatch, head):
    original = at._frequent_from
    monkeypatch.setattr(at, "_frequent_from", lambda w: original(w, head))
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    rows = QUERIES["op9_attention_scores"](spark, small_dir).collect()
    check_base(rows, docs)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    check_base(at.score_texts(docs, FILE).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert at.score_texts(no_documents(spark), FILE).count() == 0
    held = docs.where("doc_id is null")
    assert {(r["train_tokens"], r["base_score"]) for r in at.score_texts(held, FILE).collect()} == {(0, 0.0)}


def small_model(seed=1, n=500, steps=60):
    random = np.random.default_rng(seed)
    counts = np.append(random.integers(0, 50, n), 20).astype(float)
    texts = [np.cumsum(random.integers(0, 3, random.integers(0, 200))) % n for _ in range(60)]
    samples = [np.append(i, t[-1]) for x in texts for i, t in zip(*at.windows_of(x, n))]
    return at.train_attention(counts, samples, steps=steps), texts


def naive(model, ids):
    """One subword at a time, each from its own window."""
    t, end, total = model.tables, model.end, 0.0
    x, y = np.append(end + 1, ids), np.append(ids, end)
    rel = {i + at.CONTEXT - s: t["bias"][i, s] for i in range(at.STEP) for s in range(at.SPAN) if s <= i + at.CONTEXT}
    for pos, target in enumerate(y):
        first = max(0, pos // at.STEP * at.STEP - at.CONTEXT)
        types = model.type_of[x[first:pos + 1]]
        q = t["Q"][types[-1]].astype(float)
        s = t["K"][types].astype(float) @ q + np.array([rel[pos - first - i] for i in range(len(types))])
        a = np.exp(s - s.max())
        z = (a / a.sum()) @ t["V"][types] + t["R"][types[-1]]
        level = z @ t["U"] + t["b"]
        level = level - level.max()
        total += (level[model.class_of[target]] - np.log(np.exp(level).sum())) / math.log(10) + model.within[target]
    return total


def test_batched_windows_equal_one_at_a_time():
    model, texts = small_model()
    texts = [np.empty(0, np.int64), *texts[:12], np.arange(31) % 500, np.arange(32) % 500, np.arange(33) % 500]
    got = at.attention_scores(model, texts)
    assert np.allclose(got, [naive(model, t) for t in texts], atol=2e-3)
    # Later subwords and other texts don't matter.
    assert np.allclose(got[3], at.attention_scores(model, [texts[3]])[0], atol=1e-3)


def test_probabilities_add_up():
    model, texts = small_model()
    context = texts[2][:40]
    ends = np.arange(model.end + 1)
    before = naive(model, context) - naive_end(model, context)
    chances = [10 ** (naive(model, np.append(context, e)) - naive_end(model, np.append(context, e)) - before) for e in ends[:-1]]
    assert abs(sum(chances) + 10 ** naive_end(model, context) - 1) < 1e-6


def naive_end(model, ids):
    """The share of a score that the end has."""
    longer = model.end  # the end itself
    full = naive(model, ids)
    t = at.Attention(model.type_of, model.class_of, np.where(np.arange(len(model.within)) == longer, model.within - 1000, model.within), model.tables)
    shifted = naive(t, ids)
    assert abs(full - shifted - 1000) < 1e-6
    x = np.append(model.end + 1, ids)
    pos = len(ids)
    first = max(0, pos // at.STEP * at.STEP - at.CONTEXT)
    tb = model.tables
    types = model.type_of[x[first:pos + 1]]
    rel = {i + at.CONTEXT - s: tb["bias"][i, s] for i in range(at.STEP) for s in range(at.SPAN) if s <= i + at.CONTEXT}
    s = tb["K"][types].astype(float) @ tb["Q"][types[-1]].astype(float) + np.array([rel[pos - first - i] for i in range(len(types))])
    a = np.exp(s - s.max())
    level = ((a / a.sum()) @ tb["V"][types] + tb["R"][types[-1]]) @ tb["U"] + tb["b"]
    level = level - level.max()
    return (level[model.class_of[longer]] - np.log(np.exp(level).sum())) / math.log(10) + model.within[longer]


def test_gradients():
    random = np.random.default_rng(2)
    shapes = {"E": (at.TYPES + 3, at.WIDTH), "q": (at.WIDTH,) * 2, "k": (at.WIDTH,) * 2, "v": (at.WIDTH,) * 2,
              "r": (at.WIDTH,) * 2, "U": (at.WIDTH, at.CLASSES), "b": (at.CLASSES,), "rel": (at.SPAN,)}
    p = {n: random.normal(0, 0.3, s) for n, s in shapes.items()}
    x, y = random.integers(0, 9, (3, at.SPAN)), random.integers(0, 9, (3, at.STEP))
    x[0, :at.CONTEXT], y[1, 20:] = at.TYPES + 2, at.TYPES + 2
    classes = random.integers(0, at.CLASSES, at.TYPES + 3)
    back, hidden = at._mask()

    def loss():
        e = p["E"][x]
        own = e[:, at.CONTEXT:]
        s = own @ p["q"] @ (e @ p["k"]).transpose(0, 2, 1) / math.sqrt(at.WIDTH) + p["rel"][back] + hidden.astype(float)
        s += np.where(x == at.TYPES + 2, -1e9, 0)[:, None, :]
        z = own @ p["r"] + at._softmax(s) @ (e @ p["v"])
        chance = at._softmax(z @ p["U"] + p["b"])
        i, j = np.indices(y.shape)
        real = y != at.TYPES + 2
        return -np.log(chance[i, j, classes[y]])[real].mean()

    g = at._gradients(p, x, y, classes, back, hidden)
    for name, a in p.items():
        spots = [(2, 3)] if a.ndim == 2 else [(3,)]
        for spot in spots:
            old, h = a[spot], 1e-5
            a[spot] = old + h
            up = loss()
            a[spot] = old - h
            down = loss()
            a[spot] = old
            assert abs((up - down) / (2 * h) - g[name][spot]) < 1e-6, name


def test_training_beats_counts_alone():
    _, texts = small_model()
    plain, _ = small_model(steps=0)
    trained, _ = small_model(steps=250)
    assert at.attention_scores(trained, texts).sum() > 0.9 * at.attention_scores(plain, texts).sum()


def test_pairs_are_counted_over_all_training_tokens(spark, monkeypatch):
    monkeypatch.setattr(at, "PAIRS", 50)
    random, end = np.random.default_rng(4), 300
    texts = [random.integers(0, end, random.integers(0, 40)).astype("<u4") for _ in range(90)]
    rows = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "ids binary").repartition(5)
    type_of, column_of = random.integers(0, at.TYPES + 3, end + 3), random.integers(0, 7, end + 3)
    for back in (True, False):
        want = np.zeros((at.TYPES + 3, 7))
        for t in texts:
            x = [end + 1, *t.tolist(), end]
            for a, b in zip(x, x[1:]):
                a, b = (b, a) if back else (a, b)
                want[type_of[a], column_of[b]] += 1
        assert (at.pair_counts(rows, end, type_of, column_of, 7, back) == want).all()


def test_context_outside_the_sample_counts(spark, monkeypatch):
    # No window is sampled, so all that is known of order was counted over the whole corpus.
    monkeypatch.setattr(at, "SAMPLE_TEXTS", 0)
    words, other = "red green blue black white".split(), "one two three four five".split()
    line, mixed = " ".join(f"{a} {b}" for a, b in zip(words, other)), " ".join(words[::-1] + other[::-1])
    docs = spark.createDataFrame([(i, line if i % 2 else line[::-1]) for i in range(400)] + [
        (i, text) for i, text in zip((i for i in range(1000, 2000) if is_held(i)), (line, mixed))], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in at.score_texts(docs, FILE).where("doc_id >= 1000").collect()}
    a, b = (rows[d] for d in sorted(rows))
    assert abs(a["base_score"] - b["base_score"]) < 1e-6 and a["score"] > b["score"] + 5


def test_every_window_is_learned_from(spark, monkeypatch):
    # Each window has a type of its own, whose parameters only that window can move.
    monkeypatch.setattr(at, "SAMPLE_TEXTS", 10)
    monkeypatch.setattr(at, "HELD", 20)
    random, texts, end = np.random.default_rng(3), 100, 500
    rows = [(i, bytearray(np.repeat(np.arange(5 * i, 5 * i + 5), at.STEP)[:-1].astype("<u4").tobytes())) for i in range(texts)]
    tokens = spark.createDataFrame(rows, "node long, ids binary").repartition(3)
    assert at.window_count(tokens) == end
    start = {n: random.normal(0, 0.3, shape) for n, shape in at.SHAPES.items()}
    type_of = np.append(np.arange(end), [at.TYPES, at.TYPES + 1, at.TYPES + 2])
    classes = np.arange(at.TYPES + 3) % at.CLASSES
    learned = at.learn_windows(tokens, end, start, type_of, classes, None)
    assert (np.abs(learned["E"][:end] - start["E"][:end]).max(axis=1) > 1e-4).all()
    assert (np.abs(learned["E"][end:at.TYPES] - start["E"][end:at.TYPES]) < 1e-6).all()
    assert at.learn_windows(tokens.where("false"), end, start, type_of, classes, None) is start
