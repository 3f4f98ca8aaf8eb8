"""Secret scans: patterns, and novelty under a primed zstandard dictionary.

The patterns find assignments, access keys and hex strings. The method looks at
all long strings that follow a sensitive word closely in the same line, and measures how
many bytes each adds when it is compressed after a dictionary of identifiers and the text
around it. What repeats something known adds little; what is new costs its letters.

So that new names, paths and words are cheap and random strings dear, the compressor's
entropy coding has to be in play: a short block stores its letters as they are, and then
everything new is equally dear. The block is therefore led by letters in the proportions
of names (``LETTERS``, shuffled, so that nothing but their frequency is learned), which
set the code lengths: common letters take four or five bits, rare ones, digits and signs
eight or more. A name, a path or a url stays well below, random letters and digits of any
alphabet above ``NOVELTY`` bytes a character. Case is folded, as capitals are as common in
constants as they are in keys. The mean over several shuffles evens out the rounding to
whole bytes.

The identifiers are those that stand near sensitive words in most distinct texts of the
whole corpus. The strings to be measured vouch neither for themselves nor, in their own
text, for the dictionary.

Offsets are code points, ends exclusive. A null or empty text has no spans; rows
that repeat are scanned once each; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import unused, whole_text

KINDS = ("assign", "access", "hex", "novel")
MASK = "[secret]"

# Bytes of the identifier dictionary; with the text around a candidate (in code
# points, on either side) it primes the compressor.
DICTIONARY = 16_384
AROUND = 512
# A candidate is novel if it adds at least this many bytes a character.
NOVELTY = 0.65
# --- fixed values: letters and signs of names, by how often they come -----------------
LETTERS = {
    "e": 120, "t": 90, "a": 80, "o": 75, "i": 73, "n": 70, "s": 63, "r": 60, "h": 55, "l": 40, "d": 40, "c": 32,
    "u": 28, "m": 26, "f": 23, "p": 21, "g": 20, "w": 20, "y": 18, "b": 15, "v": 10, "k": 8, "x": 3, "j": 2, "q": 2, "z": 1,
    "0": 6, "1": 6, "2": 6, "3": 6, "4": 6, "5": 6, "6": 6, "7": 6, "8": 6, "9": 6,
    " ": 20, "-": 30, "_": 30, "/": 30, ".": 30, "=": 2, "+": 1,
}
# --- end of fixed values ---------------------------------------------------------------
# Letters that lead a block, and how many shuffles of them are averaged over.
LEAD, SHUFFLES = 20_000, 5
# Letters between two marks.
BETWEEN, MARK = 200, "\n" * 12

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SENSITIVE = re.compile(
    r"passw|passphrase|secret|token|api_?key|access_?key|private_?key|credential|bearer|signature|auth",
    re.IGNORECASE | re.ASCII,
)
# A candidate starts at most so many characters after a sensitive word.
REACH, LEAST = 40, 16
_HINTS = ("passw", "passphrase", "secret", "token", "key", "credential", "bearer", "signature", "auth")
_LONG = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % LEAST, re.ASCII)
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,39}", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, by start, then kind as listed."""
    low = text.lower()
    spans = []
    if any(k in low for k in ("passw", "secret", "token", "key")):
        spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    # Runs of these characters are maximal, so asking for the length finds the same.
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """All long strings that start within reach of a sensitive word in its line.

    Full stops at either end are the sentence's. Where the word is part of a string,
    what follows its equals sign is one more, up to the next such place.
    """
    low = text.lower()
    if not any(k in low for k in _HINTS):
        return []
    words = [m.end() for m in _SENSITIVE.finditer(text)]
    found, at = set(), 0
    for run in _LONG.finditer(text) if words else ():
        a, b = run.span()
        at = bisect_right(words, a, at)
        parts = []
        if at and a - words[at - 1] <= REACH and text.find("\n", words[at - 1], a) < 0:
            parts.append((a, b))
        signs = {text.find("=", w, min(b, w + REACH)) + 1 for w in words[at:bisect_right(words, b, at)]}
        starts = sorted(signs - {0})
        parts += zip(starts, [*starts[1:], b])
        for start, stop in parts:
            while start < stop and text[start] in ".=":
                start += 1
            while start < stop and text[stop - 1] == ".":
                stop -= 1
            if stop - start >= LEAST:
                found.add((start, stop))
    return sorted(found)


def _bare(start: int, end: int, base: list[tuple[int, int, str]]) -> bool:
    """Whether a long part of start to end lies outside the patterns' spans."""
    at = start
    for a, b, _ in base:
        if b > at and a < end:
            if a - at >= LEAST:
                return True
            at = b
    return end - at >= LEAST


def without(text: str, start: int, end: int, spans: list[tuple[int, int]]) -> str:
    """text[start:end] with a blank for each of the sorted spans."""
    parts, at = [], start
    for a, b in spans:
        if b > at and a < end:
            parts += [text[at:max(at, a)], " "]
            at = b
    return "".join([*parts, text[at:end]])


@lru_cache(1)
def _leads() -> list[bytes]:
    """Shuffles of letters in the proportions of names.

    The compressor looks for repetitions in ever larger steps while it finds none, and
    would run past those behind the letters; a mark that repeats brings it back.
    """
    total = sum(LETTERS.values())
    pool = [c for c, n in LETTERS.items() for _ in range(max(1, round(LEAD * n / total)))]
    out = []
    for seed in range(SHUFFLES):
        random.Random(seed).shuffle(pool)
        text = "".join(pool)
        out.append("".join(text[i:i + BETWEEN] + MARK for i in range(0, len(text), BETWEEN)).encode())
    return out


@lru_cache(1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)


def added_bytes(text: str, start: int, end: int, dictionary: bytes, others: list[tuple[int, int]] = ()) -> float:
    """Compressed bytes that text[start:end] adds after the dictionary and its surroundings.

    ``others`` are the text's candidates in order; where one repeats the string it is left out.
    """
    own, first, last = text[start:end], max(0, start - AROUND), end + AROUND
    close = others[max(0, bisect_left(others, (first, 0)) - 2):bisect_left(others, (last, 0))]
    same = [(a, b) for a, b in close if a != start and (own in text[a:b] or text[a:b] in own)]
    # The text after the string comes first, so that the one before leads up to it.
    around = (without(text, end, last, same) + "\n" + without(text, first, start, same)).encode("utf-8", "replace")
    known = (dictionary + b"\n" + around).lower()
    press, folded = _compressor(), own.encode().lower()
    return sum(len(press.compress(lead + known + folded)) - len(press.compress(lead + known)) for lead in _leads()) / SHUFFLES


def scan(text: str, dictionary: bytes) -> tuple[list, list]:
    """Spans of the patterns, and all spans."""
    base, found = base_spans(text), candidates(text)
    novel = [
        (a, b, "novel") for a, b in found
        if _bare(a, b, base) and added_bytes(text, a, b, dictionary, found) >= NOVELTY * (b - a)
    ]
    return base, sorted(base + novel, key=lambda s: (s[0], KINDS.index(s[2])))


def show(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced; overlapping spans are one."""
    parts, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            parts += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def near_words(text: str) -> tuple[set[str], set[str]]:
    """Identifiers before the candidates of a text, and those inside candidates.

    A candidate is no identifier of its text, wherever in the text it stands.
    """
    found = candidates(text)
    if not found:
        return set(), set()
    strings = {text[a:b] for a, b in found}
    hidden = sorted({*found, *(m.span() for m in _LONG.finditer(text) if m[0] in strings)})
    inside = {w for t in strings for w in _IDENTIFIER.findall(t) if len(w) >= 8}
    near: set[str] = set()
    at = 0
    for a, _ in found:
        # What the last look has read is not read again.
        start = max(0, a - AROUND, at)
        close = hidden[max(0, bisect_left(hidden, (start, 0)) - 1):bisect_left(hidden, (a, 0))]
        near.update(_IDENTIFIER.findall(without(text, start, a, close)))
        at = a
    return near - inside, inside


def identifiers(docs: DataFrame, size: int = DICTIONARY) -> bytes:
    """The identifiers near sensitive words, those of most distinct texts last (nearest for the compressor).

    Counts are over all documents; only those that fit the dictionary are collected.
    Copies of a text don't add to a word's rank, and they alone don't bring in a word
    that is part of a candidate anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: Counter = Counter()
            measured: set[tuple[str, int]] = set()
            for text in batch["text"].to_pylist():
                near, inside = near_words(text)
                if near or inside:
                    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                    rows.update((w, h) for w in near)
                    measured.update((w, h) for w in inside)
            keys = [*rows, *measured]
            yield pa.RecordBatch.from_pydict({
                "word": pa.array([w for w, _ in keys], pa.string()), "digest": pa.array([h for _, h in keys], pa.int64()),
                "n": pa.array([*rows.values(), *([0] * len(measured))], pa.int64()),
                "inside": pa.array([0] * len(rows) + [1] * len(measured), pa.int64()),
            })

    by_text = docs.mapInArrow(run, "word string, digest bigint, n bigint, inside bigint").groupBy("word", "digest").agg(
        F.sum("n").alias("n"), F.max("inside").alias("inside"))
    counted = by_text.groupBy("word").agg(
        F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("texts"), F.sum("n").alias("n"), F.max("inside").alias("inside"))
    several = (F.col("texts") > 1) | ((F.col("n") > 1) & (F.col("inside") == 0))
    top = counted.where(several).orderBy(F.desc("texts"), "word").limit(size // 5).collect()
    words: list[str] = []
    for r in top:
        if sum(map(len, words)) + len(words) + len(r["word"]) >= size:
            break
        words.append(r["word"])
    return " ".join(reversed(words)).encode()


def scan_column(dictionary: bytes, text: Column) -> Column:
    """A struct of counts, digests, all spans and the masked text (null where nothing is found)."""

    @F.arrow_udf("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, masked string")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            base, spans = scan(t, dictionary)
            kinds = [k for _, _, k in base]
            rows.append({
                "n_assign": kinds.count("assign"), "n_access": kinds.count("access"), "n_hex": kinds.count("hex"),
                "base_sha256": hashlib.sha256(show(base).encode()).hexdigest(),
                "spans": show(spans), "masked": mask(t, spans) if spans else None,
            })
        kind = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                ("base_sha256", pa.string()), ("spans", pa.string()), ("masked", pa.string())]
        return pa.array(rows, pa.struct(kind))

    return run(text)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts, spans and the masked text of every document."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    found = scan_column(identifiers(texts.select("text")), F.col("text"))
    return texts.select("doc_id", found.alias("f")).select("doc_id", "f.*")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every found span masked and ``n_chars`` in step; clean ones as they are."""
    found = scan_column(identifiers(docs.select(whole_text().alias("text"))), whole_text())
    name = unused(docs, "masked")
    marked = docs.withColumn(name, found["masked"])
    changed = {"text": F.coalesce(F.col(name), F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col(name).isNotNull(), F.length(name).cast(kind)).otherwise(F.col("n_chars"))
    return marked.withColumns(changed).select(*docs.columns)
