"""Quality rules as weak supervision, with DataFrame functions only.

Each rule looks at one figure of a text and votes good (1), bad (-1) or abstains
(0). How often a rule votes good on good texts, and bad on bad ones, is estimated
by expectation-maximisation over all documents. Every kind of fault is seen by
several rules, none of which has to be right: the estimate starts from rules that are
mostly right, with little weight, and the data say which of them are. A document stays
if the posterior probability that it is good reaches ``BAR`` and the two hard limits
hold, so a bad vote of a rule that is often wrong is outvoted, and a few votes that
hardly ever come on good documents are enough to reject one.

A vote never counts for the opposite of what it says: a rule that the estimate finds
to be no better than chance counts nothing.

Documents with the same votes count as one, so the estimate works on a table of
vote patterns (at most three to the number of rules) and each step brings one row
of sums to the driver.

A null or empty text has no words and fails the word limit. Rows that repeat are
judged once each. An empty table gives an empty result. Other columns are kept
out of the way, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored, unused, whole_text

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
# What a line of prose ends with.
ENDS = ".!?:;\"'”’»)…。！？"
MIN_WORDS = 50
BAR = 0.5
STEPS = 20

# Figure, the side on which a vote is bad, and the limits of a bad and a good
# vote; between the limits a rule abstains.
RULES = {
    "n_words": ("below", 50, 80),
    "long_words": ("above", 6.8, 6.2),
    "short_words": ("below", 4.2, 4.45),
    "symbols": ("above", 0.25, 0.05),
    "symbol_words": ("above", 0.2, 0.05),
    "bare_symbols": ("above", 0.15, 0.03),
    "line_ends": ("below", 0.9, 0.97),
    "shouting": ("above", 0.4, 0.05),
    "capitals": ("above", 0.3, 0.1),
    "repeated_lines": ("above", 0.3, 0.1),
    "repeated_words": ("above", 0.4, 0.2),
    "distinct_words": ("below", 0.4, 0.55),
}
# What is believed before the data speak: the share of good documents, how often a
# rule that votes is right on good and on bad ones, and how many documents (as a
# share of all) that belief weighs. A rule knows one fault among many, so on bad
# documents it is as often right as not.
PRIOR_GOOD, RIGHT_ON_GOOD, RIGHT_ON_BAD, PRIOR_WEIGHT = 0.85, 0.9, 0.5, 0.005


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def with_figures(docs: DataFrame, name: str) -> DataFrame:
    """The documents with a struct column ``name`` of all figures of their texts.

    Each step is a projection whose columns the next refers to more than once,
    which keeps the optimizer from working them out again inside a loop.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    t, w, g, p = (f"{name}_{x}" for x in ("text", "words", "grams", "places"))
    df = docs.select(*own, whole_text().alias(t))
    df = df.select(
        *own, t,
        F.array_remove(F.split(t, r"[\x09-\x0D\x20]+"), "").alias(w),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]")).alias(f"{name}_lines"),
        F.translate(t, SPACE, "").alias(f"{name}_dense"),
    )
    # A 3-word window as a 64-bit hash.
    grams = F.transform(
        F.slice(F.col(w), 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )
    df = df.select(*own, t, w, f"{name}_lines", f"{name}_dense", grams.alias(g))
    # Only texts with a repeated window need its places. Sorted by (44 bits of
    # the hash, place), repeated windows are neighbours.
    packed = F.sort_array(F.transform(F.col(g), lambda h, i: F.shiftleft(h, 20).bitwiseOR(i.cast("bigint"))))
    repeats = F.size(F.array_distinct(g)) < F.size(g)
    df = df.select(
        *own, t, w, f"{name}_lines", f"{name}_dense", g,
        F.when(repeats & (F.size(g) < 1 << 20), packed).alias(p),
        repeats.alias(f"{name}_repeats"),
    )

    def place(x):
        return x.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")

    def same(x, other):
        # Equal 44 bits, then the whole hash.
        return F.coalesce(
            (F.shiftright(x, 20) == F.shiftright(other, 20)) & (F.get(g, place(x)) == F.get(g, place(other))),
            F.lit(False),
        )

    # Neighbours that agree in 44 bits but not in the whole hash would hide a
    # repetition behind them; such texts, and very long ones, compare whole hashes.
    mixed = F.exists(
        F.transform(F.col(p), lambda x, i: F.coalesce(
            (F.shiftright(x, 20) == F.shiftright(F.get(p, i + 1), 20))
            & (F.get(g, place(x)) != F.get(g, place(F.get(p, i + 1)))), F.lit(False))),
        lambda x: x,
    )
    quick = F.transform(
        F.filter(F.col(p), lambda x, i: same(x, F.get(p, i - 1)) | same(x, F.get(p, i + 1))), place)
    df = df.select(
        *own, t, w, f"{name}_lines", f"{name}_dense", g, f"{name}_repeats",
        F.when(~mixed, F.sort_array(quick)).alias(p),
    )
    pairs = F.array_sort(F.transform(F.col(g), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    slow = f"{name}_slow"
    df = df.select(
        *own, t, w, f"{name}_lines", f"{name}_dense", p, f"{name}_repeats",
        F.when(F.col(f"{name}_repeats") & F.col(p).isNull(), pairs).alias(slow),
    )
    by_hash = F.sort_array(F.transform(
        F.filter(F.col(slow), lambda x, i: F.coalesce(
            (x["h"] == F.get(slow, i - 1)["h"]) | (x["h"] == F.get(slow, i + 1)["h"]),
            x["h"] == F.get(slow, i - 1)["h"], x["h"] == F.get(slow, i + 1)["h"], F.lit(False))),
        lambda x: x["i"]))
    df = df.select(
        *own, t, w, f"{name}_lines", f"{name}_dense",
        F.coalesce(F.col(p), by_hash, F.array().cast("array<int>")).alias(p),
    )
    # A repeated window covers three words, fewer where the next one starts.
    covered = F.aggregate(
        F.transform(F.col(p), lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
        F.lit(0), lambda a, x: a + x,
    )
    dense, lines = F.col(f"{name}_dense"), F.col(f"{name}_lines")
    symbols = _count_of(dense, SYMBOLS)

    def symbol_words(is_one):
        # Most texts have no symbol, and their words are not looked at.
        return F.when(symbols > 0, F.size(F.filter(w, is_one))).otherwise(0).cast("bigint")

    return df.select(
        *own,
        F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(dense).cast("bigint").alias("word_chars"),
            symbols.cast("bigint").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            covered.cast("bigint").alias("n_repeat_words"),
            F.size(lines).cast("bigint").alias("n_lines"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
            symbol_words(lambda x: F.translate(x, SYMBOLS, "") != x).alias("n_symbol_words"),
            symbol_words(lambda x: F.translate(x, SYMBOLS, "") == "").alias("n_bare_symbols"),
            F.size(F.filter(lines, lambda x: F.right(F.rtrim(x, F.lit(SPACE)), F.lit(1)).isin(*ENDS))).cast("bigint").alias("n_ended"),
            _count_of(dense, "!").cast("bigint").alias("n_shouts"),
            _count_of(dense, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("bigint").alias("n_capitals"),
        ).alias(name),
    )


def rule_figures(f: Column) -> dict[str, Column]:
    words, chars = f["n_words"], f["word_chars"]
    return {
        "n_words": words,
        "long_words": _ratio(chars, words),
        "short_words": _ratio(chars, words),
        "symbols": _ratio(f["n_symbols"], words),
        "symbol_words": _ratio(f["n_symbol_words"], words),
        "bare_symbols": _ratio(f["n_bare_symbols"], words),
        "line_ends": _ratio(f["n_ended"], f["n_lines"]),
        "shouting": _ratio(f["n_shouts"], words),
        "capitals": _ratio(f["n_capitals"], chars),
        "repeated_lines": _ratio(f["n_dup_lines"], f["n_lines"]),
        "repeated_words": _ratio(f["n_repeat_words"], words),
        # Long texts use a word again and again; short ones don't yet.
        "distinct_words": _ratio(f["n_distinct"], F.least(words, F.lit(1000))),
    }


def votes(f: Column) -> dict[str, Column]:
    out = {}
    for rule, figure in rule_figures(f).items():
        side, bad, good = RULES[rule]
        is_bad, is_good = (figure > bad, figure <= good) if side == "above" else (figure < bad, figure >= good)
        out[rule] = F.when(is_bad, -1).when(is_good, 1).otherwise(0)
    return out


@dataclass(frozen=True)
class Accuracies:
    """The share of good documents, and each rule's rate of right votes on either kind."""

    good: float
    on_good: dict[str, float]
    on_bad: dict[str, float]

    def weights(self, rule: str) -> tuple[float, float]:
        """What a good and a bad vote of a rule add to the log-odds of good."""
        a, b = self.on_good[rule], self.on_bad[rule]
        return max(math.log(a / (1 - b)), 0.0), min(math.log((1 - a) / b), 0.0)

    def posterior(self, vote: dict[str, Column]) -> Column:
        terms = [F.lit(math.log(self.good / (1 - self.good)))]
        for rule, v in vote.items():
            for_good, for_bad = self.weights(rule)
            terms.append(F.when(v > 0, for_good).when(v < 0, for_bad).otherwise(0.0))
        return 1 / (1 + F.exp(-reduce(lambda x, y: x + y, terms)))


def prior(names: list[str]) -> Accuracies:
    """What is believed before the data speak."""
    return Accuracies(PRIOR_GOOD, dict.fromkeys(names, RIGHT_ON_GOOD), dict.fromkeys(names, RIGHT_ON_BAD))


def estimate(patterns: DataFrame, steps: int = STEPS) -> Accuracies:
    """EM over a table of vote patterns (a column per rule and ``n``)."""
    names = [c for c in patterns.columns if c != "n"]
    now = prior(names)
    for _ in range(steps):
        p = now.posterior({r: F.col(r) for r in names})
        weighed = patterns.select(*names, "n", (F.col("n") * p).alias("g"))
        bad = F.col("n") - F.col("g")
        sums = [F.sum("n").alias("n"), F.sum("g").alias("g")]
        for r in names:
            for key, part, when in (("gr", F.col("g"), F.col(r) > 0), ("gv", F.col("g"), F.col(r) != 0),
                                    ("br", bad, F.col(r) < 0), ("bv", bad, F.col(r) != 0)):
                sums.append(F.sum(F.when(when, part).otherwise(0.0)).alias(f"{key}_{r}"))
        s = weighed.agg(*sums).first()
        if not s["n"]:
            return now
        w = PRIOR_WEIGHT * s["n"]

        # The belief counts as so many votes, so no rate is 0 or 1.
        new = Accuracies(
            (s["g"] + w * PRIOR_GOOD) / (s["n"] + w),
            {r: (s[f"gr_{r}"] + w * RIGHT_ON_GOOD) / (s[f"gv_{r}"] + w) for r in names},
            {r: (s[f"br_{r}"] + w * RIGHT_ON_BAD) / (s[f"bv_{r}"] + w) for r in names},
        )
        moved = max(abs(new.on_good[r] - now.on_good[r]) + abs(new.on_bad[r] - now.on_bad[r]) for r in names)
        now = new
        if moved < 1e-4:
            break
    return now


def _judged(figures: DataFrame, name: str) -> DataFrame:
    """The rows with the posterior and the verdict beside their figures in column ``name``."""
    rows = stored(figures, "rule-figures")
    f = F.col(name)
    vote = votes(f)
    patterns = stored(
        rows.select(*[v.alias(r) for r, v in vote.items()]).groupBy(*vote).agg(F.count("*").alias("n")),
        "rule-patterns",
    ).coalesce(1)
    posterior = estimate(patterns).posterior(vote)
    failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
    return rows.withColumn(name, f.withField("posterior", posterior).withField("base_failed", failed)) \
        .withColumn(name, F.col(name).withField("kept", ~F.col(f"{name}.base_failed") & (F.col(f"{name}.posterior") >= BAR)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the figures, base_failed, posterior and kept of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    f = _judged(with_figures(rows, "f").select("doc_id", "f"), "f")
    return f.select(
        "doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words",
        "f.base_failed", "f.kept", "f.posterior",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is to keep them, columns unchanged."""
    name = unused(docs, "figures")
    return _judged(with_figures(docs, name), name).where(F.col(f"{name}.kept")).select(*docs.columns)
