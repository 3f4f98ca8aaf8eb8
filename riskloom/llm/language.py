"""Language identification by a string kernel.

The kernel of two texts counts the byte n-grams (n = 1 to 3, a blended spectrum)
that are present in both, over the root of the numbers in each. N-grams are hashed
to ``DIMENSIONS`` bits, so presence is a row of bits and a batch of kernels is one
matrix product. Kernels with ``LANDMARKS`` training texts give Nyström features,
and one ridge regression per language on them (1 for its own texts, -1 for
others) scores a text; the highest score wins.

A text that is null or has no letter is ``und`` with score 0, and so is every text
if nothing could be learned. Languages of equal score go by name. Null languages
are not learned from; rows that repeat are judged once each; other columns are not
looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import chosen, held_out, once, row_key, whole_text

BITS = 14
DIMENSIONS = 1 << BITS
LANDMARKS = 192
RIDGE = 0.05
# The model is fitted on about this many texts, if there are more, evenly by language.
SAMPLE = 4_000
HOLD_OUT = 5
CHUNK = 128
UNKNOWN = "und"

_MIX = np.uint32(2654435761)


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text's n-grams."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    shift = np.uint32(32 - BITS)
    for row, text in zip(out, texts):
        one = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        two = (one[:-1] << np.uint32(8)) | one[1:]
        three = (two[:-1] << np.uint32(8)) | one[2:]
        # The length keeps n-grams of different length apart.
        for n, grams in ((1, one), (2, two), (3, three)):
            row[((grams + np.uint32(n << 24)) * _MIX) >> shift] = 1
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def kernels(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    sizes = np.sqrt(np.maximum(x.sum(1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(1), 1))[None]
    return (x @ landmarks.T) / sizes


@dataclass(frozen=True)
class Languages:
    names: list[str]
    landmarks: np.ndarray  # one row of bits each
    weights: np.ndarray  # landmark kernels to scores

    def scores(self, texts: list[str], landmarks: np.ndarray) -> np.ndarray:
        parts = [kernels(presence(texts[i:i + CHUNK]), landmarks) @ self.weights for i in range(0, len(texts), CHUNK)]
        return np.concatenate(parts)

    def judge(self, texts: list[str], landmarks: np.ndarray) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if self.names and has_letter(t)]
        if known:
            s = self.scores([texts[i] for i in known], landmarks)
            best = s.argmax(1)
            for i, b, top in zip(known, best.tolist(), s.max(1).tolist()):
                names[i], scores[i] = self.names[b], min(max((top + 1) / 2, 0.0), 1.0)
        return names, scores


def fit_languages(x: np.ndarray, language: list[str], landmarks: int = LANDMARKS, seed: int = 3) -> Languages:
    """One-versus-rest kernel ridge regression over Nyström features."""
    names = sorted(set(language))
    if not names:
        return Languages([], np.zeros((0, DIMENSIONS // 8), np.uint8), np.zeros((0, 0), np.float32))
    random = np.random.default_rng(seed)
    owner = np.array([names.index(v) for v in language])
    # Landmarks in turn from every language.
    turns = np.concatenate([np.arange((owner == k).sum()) for k in range(len(names))])
    rows = np.concatenate([random.permutation(np.flatnonzero(owner == k)) for k in range(len(names))])
    chosen = rows[np.argsort(turns, kind="stable")[:landmarks]]
    z = x[chosen]
    values, vectors = np.linalg.eigh(kernels(z, z).astype(np.float64))
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernels(x, z).astype(np.float64) @ root
    target = np.where(owner[:, None] == np.arange(len(names)), 1.0, -1.0)
    # Every language weighs the same.
    weight = (1 / np.bincount(owner))[owner][:, None] * len(owner) / len(names)
    square = features.T @ (weight * features) + RIDGE * np.eye(features.shape[1])
    solved = np.linalg.solve(square, features.T @ (weight * target))
    return Languages(names, np.packbits(z.astype(bool), axis=1), (root @ solved).astype(np.float32))


def training_sample(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """lang and packed n-gram bits of a sample, the same on every run.

    Equal rows (of id, language and text) count as one. About ``size`` rows, taken by a
    hash of all three, are collected, however many documents or copies an id has.
    """
    known = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(HOLD_OUT))
    known = known.withColumn("key", row_key("doc_id", "lang", "text"))
    # A list of languages is short; beyond the size of the sample the rest are not learned.
    counts = (
        known.select("lang", "key").distinct().groupBy("lang").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "lang").limit(size).collect())
    if not counts:
        return known.select("lang", F.lit(b"").alias("bits")).limit(0)
    each = size / len(counts)
    rate = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, each / r["n"]))])

    @F.arrow_udf("binary")
    def bits(texts: pa.Array) -> pa.Array:
        parts, rows = texts.to_pylist(), []
        for i in range(0, len(parts), CHUNK):
            rows += [r.tobytes() for r in np.packbits(presence(parts[i:i + CHUNK]).astype(bool), axis=1)]
        return pa.array(rows, pa.binary())

    taken = known.where(chosen(F.col("key"), F.element_at(rate, F.col("lang")))).select("key", "lang", "text")
    return once(taken, "key").select("lang", bits("text").alias("bits"))


def _unpack(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


def train(docs: DataFrame, size: int = SAMPLE) -> Languages:
    rows = sorted((r["lang"], bytes(r["bits"])) for r in training_sample(docs, size).collect())
    packed = np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(len(rows), DIMENSIONS // 8)
    return fit_languages(_unpack(packed), [lang for lang, _ in rows])


def judge(model: Languages, text: Column) -> Column:
    """Struct of lang_pred and score of a text column (no nulls)."""

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        names, scores = model.judge(texts.to_pylist(), _unpack(model.landmarks))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                          ["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = train(docs, size)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out(HOLD_OUT).alias("held_out"),
        judge(model, whole_text()).alias("j"),
    ).select("doc_id", "held_out", "j.*")
