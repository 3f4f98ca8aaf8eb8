"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

Each text becomes a row of counts and shares (``features``). A document labelled
good is preferred to one labelled bad; the model is a linear utility whose
difference predicts the preference by a logistic loss. The bar is a quantile of
the training utilities: the share of bad documents among the labels. A slope
turns the distance to the bar into a score in which the bar is ``CUT``.

All labelled rows are learned from. Newton's method needs sums over rows and pairs only;
Spark adds them up (``SpreadRows``), and what arrives here has the size of the model.

A null or empty text has zero features and a score like any other. Labels that
are neither 0 nor 1 are left out; a document labelled twice has the mean, rounded
up. Rows that repeat are scored once each. Without labels of both kinds nothing
can be ranked and every score is 0.5. Other columns are not looked at.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import chosen, held_out, look_up, once, row_key, stored, whole_text
from riskloom.operators.joins import many_to_one
from riskloom.operators.ranges import in_ranges

CUT = 0.3
# Few rows are paired several times, up to about so many pairs.
PAIRS = 60_000
HOLD_OUT = 5
# Digits of what is fitted and of utilities at the bar: sums in another order differ far behind them.
DIGITS, WEIGHT_DIGITS = 9, 6
# Parts of a range of utilities, and rows of a part that are few.
PARTS, FEW_ROWS = 4096, 10_000

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
N_FEATURES = 12 + 256


def features(text: str) -> np.ndarray:
    """Counts and shares of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES, np.float32)
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float32)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, w, k = len(data), max(len(words), 1), max(len(lines), 1)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    out[:12] = (
        np.log1p(n), np.log1p(len(words)), n / w, len(set(words)) / w,
        sum(map(operator.eq, words, words[1:])) / w, len(set(lines)) / k, np.log1p(n / k),
        counts[_SYMBOLS].sum() / w, upper / max(upper + lower, 1), counts[48:58].sum() / n,
        counts[33] / w, counts[[44, 46]].sum() / w,
    )
    out[12:] = np.sqrt(counts / n)
    return out


def features_of(texts: list[str]) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.zeros((0, N_FEATURES), np.float32)


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bar: float
    slope: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(x), 0.5)
        z = self.slope * (self.utility(x) - self.bar) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


# Sums over pairs of loss, slope and curvature at some weights.
PairSums = Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]


def _order(x: np.ndarray) -> np.ndarray:
    """A number for each row that depends on its features only; rows are paired in its order."""
    return np.fromiter((xxhash.xxh3_64_intdigest(r.tobytes()) for r in x), np.uint64, len(x)).view(np.int64)


def _rounds(n_up: int, n_down: int, pairs: int) -> int:
    """How often each row of the larger class is paired; every row is in some pair."""
    larger = max(n_up, n_down)
    return -(-max(min(pairs, n_up * n_down), larger) // larger)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return ((x - mean) / scale).clip(-8, 8)


def _pair_sums(d: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over rows of log(1 + exp(-d w)), its slope and its curvature."""
    u = np.clip(d @ w, -500, 500)
    pull = 1 / (1 + np.exp(u))
    return np.logaddexp(0, -u).sum(), -(pull @ d), (d * (pull * (1 - pull))[:, None]).T @ d


class LocalRows:
    """Rows in memory."""

    def __init__(self, x: np.ndarray, good: np.ndarray, weight: np.ndarray) -> None:
        self.x, self.good, self.weight = x, good, weight
        self.n_up, self.n_down = int(good.sum()), int((~good).sum())

    def moments(self) -> np.ndarray:
        x = self.x.astype(np.float64)
        return np.stack([x.sum(0), (x * x).sum(0)])

    def pair_sums(self, mean: np.ndarray, scale: np.ndarray, rounds: int) -> PairSums:
        order = np.argsort(_order(self.x), kind="stable")
        up, down = order[self.good[order]], order[~self.good[order]]
        larger, smaller = (up, down) if len(up) >= len(down) else (down, up)
        place = (np.arange(len(larger))[:, None] + np.arange(rounds)).ravel() % len(smaller)
        z = _standard(self.x, mean, scale)
        d = (z[np.repeat(larger, rounds)] - z[smaller[place]]) * (1 if larger is up else -1)
        return lambda w: _pair_sums(d, w)

    def utilities(self, model: Ranking) -> LocalRows:
        self.u = model.utility(self.x)
        return self

    def bar(self) -> float:
        values, which = np.unique(np.round(self.u, DIGITS), return_inverse=True)
        share = self.weight[~self.good].sum() / self.weight.sum()
        return _between(values, np.bincount(which, self.weight), (share - 1e-9) * self.weight.sum())

    def spread(self, bar: float) -> float:
        return float((self.u - bar).std())

    def slope_sums(self, bar: float, a: float) -> tuple[float, float]:
        x, y = self.u - bar, self.good.astype(float)
        p = 1 / (1 + np.exp(-np.clip(a * x + np.log(CUT / (1 - CUT)), -50, 50)))
        return (self.weight * (p - y) * x).sum(), (self.weight * p * (1 - p) * x * x).sum()


class SpreadRows:
    """Rows of a stored table key, good, weight, x: every sum is a pass over it.

    Rows are numbered by class in the order of their features' numbers, so the pairs are
    those of ``LocalRows``.
    """

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        counts = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
        self.n_up, self.n_down = counts.get(True, 0), counts.get(False, 0)

    def moments(self) -> np.ndarray:
        def of(batch):
            x = _matrix(batch["x"]).astype(np.float64)
            return np.concatenate([x.sum(0), (x * x).sum(0)])

        return _added(self.rows.select("x"), 2 * N_FEATURES, of).reshape(2, N_FEATURES)

    def _numbered(self) -> DataFrame:
        """Rows with ``place``, their number in their class from 0."""
        ranged = in_ranges(self.rows.select("key", "good", "x", _order_udf()("x").alias("h")), "good", "h", "key")
        counts = ranged.groupBy("good", "_range").count()
        # A row for each range and class.
        before = Window.partitionBy("good").orderBy("_range")
        starts = counts.select("good", "_range", (F.sum("count").over(before) - F.col("count")).alias("start"))
        inside = Window.partitionBy("_range", "good").orderBy("h", "key")
        return ranged.withColumn("place", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["good", "_range"]).select(
            "good", "x", (F.col("place") + F.col("start")).alias("place"))

    def pair_sums(self, mean: np.ndarray, scale: np.ndarray, rounds: int) -> PairSums:
        numbered, most_good = self._numbered(), self.n_up >= self.n_down
        turns = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))
        larger = numbered.where(F.col("good") == most_good).select(F.col("x").alias("a"), "place", turns.alias("turn")).select(
            "a", ((F.col("place") + F.col("turn")) % min(self.n_up, self.n_down)).alias("place"))
        smaller = numbered.where(F.col("good") != most_good).select(F.col("x").alias("b"), "place")
        pairs = stored(many_to_one(larger, smaller, ["place"], "inner").select("a", "b"), "preference-pairs")
        n, sign = N_FEATURES, 1 if most_good else -1

        def sums(w):
            def of(batch):
                d = sign * (_standard(_matrix(batch["a"]), mean, scale) - _standard(_matrix(batch["b"]), mean, scale))
                loss, slope, curve = _pair_sums(d, w)
                return np.concatenate([[loss], slope, curve.ravel()])

            out = _added(pairs, 1 + n + n * n, of)
            return out[0], out[1:n + 1], out[n + 1:].reshape(n, n)

        return sums

    def utilities(self, model: Ranking) -> SpreadRows:
        @F.arrow_udf("double")
        def utility(x: pa.Array) -> pa.Array:
            return pa.array(model.utility(_matrix(x)), pa.float64())

        self.u = stored(self.rows.select("good", "weight", utility("x").alias("u")), "utilities")
        return self

    def bar(self) -> float:
        """The bar, looked for in ever smaller parts of the utilities."""
        rows = self.u.select(F.round("u", DIGITS).alias("u"), "weight")
        total = self.u.agg(F.sum("weight").alias("all"), F.sum(F.when(~F.col("good"), F.col("weight"))).alias("bad"),
                           F.min(F.round("u", DIGITS)).alias("low"), F.max(F.round("u", DIGITS)).alias("high")).first()
        wanted = (total["bad"] / total["all"] - 1e-9) * total["all"]
        low, high, below, inside = total["low"], total["high"], 0.0, self.n_up + self.n_down
        while inside > FEW_ROWS and high > low:
            part = F.least(F.floor((F.col("u") - low) / ((high - low) / PARTS)), F.lit(PARTS - 1))
            parts = rows.where(F.col("u").between(low, high)).groupBy(part.alias("part")).agg(
                F.sum("weight").alias("weight"), F.count("*").alias("n"), F.min("u").alias("low"), F.max("u").alias("high")).collect()
            for r in sorted(parts, key=lambda r: r["part"]):
                low, high, inside = r["low"], r["high"], r["n"]
                if below + r["weight"] >= wanted:
                    break
                below += r["weight"]
        values = rows.where(F.col("u").between(low, high)).groupBy("u").agg(F.sum("weight").alias("weight")).orderBy("u").collect()
        # The neighbours on both sides, in case the bar lies next to them.
        around = rows.agg(F.max(F.when(F.col("u") < low, F.col("u"))).alias("before"), F.min(F.when(F.col("u") > high, F.col("u"))).alias("after")).first()
        found = [(around["before"], below), *[(r["u"], r["weight"]) for r in values], (around["after"], np.inf)]
        found = [(u, w) for u, w in found if u is not None]
        return _between(np.array([u for u, _ in found]), np.array([w for _, w in found]), wanted)

    def spread(self, bar: float) -> float:
        return self.u.agg(F.stddev_pop(F.col("u") - bar).alias("s")).first()["s"]

    def slope_sums(self, bar: float, a: float) -> tuple[float, float]:
        x = F.col("u") - F.lit(bar)
        z = F.least(F.greatest(F.lit(a) * x + F.lit(float(np.log(CUT / (1 - CUT)))), F.lit(-50.0)), F.lit(50.0))
        p, y = 1 / (1 + F.exp(-z)), F.col("good").cast("double")
        r = self.u.agg(F.sum(F.col("weight") * (p - y) * x).alias("g"), F.sum(F.col("weight") * p * (1 - p) * x * x).alias("h")).first()
        return r["g"], r["h"]


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def _added(rows: DataFrame, size: int, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``of`` over all batches; a task hands on ``size`` numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(batch)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": used, "v": total[used]})

    summed = rows.mapInArrow(run, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[summed["cell"].to_numpy()] = summed["v"].to_numpy()
    return out


def _between(values: np.ndarray, weights: np.ndarray, wanted: float) -> float:
    """The middle between the first value up to which ``wanted`` is reached and the next one."""
    k = max(0, min(int(np.searchsorted(np.cumsum(weights), wanted)), len(values) - 2))
    return float((values[k] + values[min(k + 1, len(values) - 1)]) / 2)


def _newton(sums: PairSums, n: int, penalty: float, rounds: int = 50) -> np.ndarray:
    """The weights of least mean loss over ``n`` pairs; a step that goes too far is halved."""
    w, move, least = np.zeros(N_FEATURES), None, np.inf
    for _ in range(rounds):
        loss, slope, curve = sums(w)
        loss = loss / n + penalty / 2 * (w @ w)
        if move is not None and loss > least * (1 + 1e-12):
            move = move / 2
        else:
            held, least = w, loss
            move = -np.linalg.solve(curve / n + penalty * np.eye(len(w)), slope / n + penalty * w)
        w = held + move
        if np.abs(move).max() < 1e-10:
            break
    return w


def fit_ranking(x: np.ndarray, good: np.ndarray, weight: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3) -> Ranking:
    """``fit`` on rows in memory.

    ``weight`` says how many labelled documents a row stands for.
    """
    return fit(LocalRows(x, good, weight), pairs, penalty)


def fit(rows: LocalRows | SpreadRows, pairs: int = PAIRS, penalty: float = 1e-3) -> Ranking:
    """Learn a utility from pairs of a good and a bad row, then the bar and the slope."""
    n = rows.n_up + rows.n_down
    if not rows.n_up or not rows.n_down:
        return Ranking(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.0)
    total, squares = rows.moments()
    mean = total / n
    scale = np.round(np.sqrt(np.maximum(squares / n - mean * mean, 0)) + 1e-3, DIGITS)
    mean = np.round(mean, DIGITS)
    turns = _rounds(rows.n_up, rows.n_down, pairs)
    w = np.round(_newton(rows.pair_sums(mean, scale, turns), turns * max(rows.n_up, rows.n_down), penalty), WEIGHT_DIGITS)
    ranked = rows.utilities(Ranking(mean, scale, w, 0.0, 0.0))
    bar = ranked.bar()
    return Ranking(mean, scale, w, bar, _slope(ranked, bar, n))


def _slope(rows: LocalRows | SpreadRows, bar: float, n: int) -> float:
    """The slope of a logistic curve through ``CUT`` at the bar, by Newton's steps."""
    start = a = 1 / (rows.spread(bar) + 1e-9)
    for _ in range(20):
        slope, curve = rows.slope_sums(bar, a)
        before = a
        a = float(np.clip(a - (slope / n + 1e-3 * (a - start)) / (curve / n + 1e-3), 0.1 * start, 4 * start))
        if abs(a - before) < 1e-12 * start:
            break
    return round(float(a), DIGITS)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int | None = None) -> DataFrame:
    """Features of all labelled documents, or of about ``per_class`` of a class: columns key, good, weight, x.

    Equal rows (of id and text) count as one that weighs as many. A sample takes rows by
    a hash of both, so it is the same on every run, however many documents or copies an id has.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(HOLD_OUT))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).alias("good"))
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).select(
        "doc_id", "text", row_key("doc_id", "text").alias("key"))
    distinct = texts.where(F.col("doc_id").isNotNull() & ~held_out(HOLD_OUT)).groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    labelled = stored(many_to_one(distinct, known, ["doc_id"], "inner").select("key", "good", "n"), "labelled-rows")
    if per_class is None:
        taken = stored(labelled.select("key", "good", F.col("n").cast("double").alias("weight")), "labelled-keys")
        return _featured(look_up(texts, taken, ["key"]))
    counts = {r["good"]: r["n"] for r in labelled.groupBy("good").agg(F.count("*").alias("n")).collect()}
    rate = {g: min(1.0, per_class / n) for g, n in counts.items()}
    wanted = F.when(F.col("good"), rate.get(True, 0.0)).otherwise(rate.get(False, 0.0))
    taken = labelled.where(chosen(F.col("key"), wanted)).select(
        "key", "good", (F.col("n") / wanted).alias("weight"))
    return _featured(texts.join(F.broadcast(taken), "key"))


def _featured(texts: DataFrame) -> DataFrame:
    rows = once(texts.select("key", "good", "weight", "text"), "key")
    return rows.select("key", "good", "weight", _features_udf()("text").alias("x"))


def _features_udf():
    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        x = features_of(texts.to_pylist())
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))

    return run


def _order_udf():
    @F.arrow_udf("bigint")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(_order(_matrix(x)), pa.int64())

    return run


def train(docs: DataFrame, labels: DataFrame, per_class: int | None = None) -> Ranking:
    return fit(SpreadRows(stored(labelled_sample(docs, labels, per_class), "labelled-features")))


def score(model: Ranking, text: Column) -> Column:
    """The score of a text column (no nulls)."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features_of(texts.to_pylist())), pa.float64())

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, per_class: int | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, per_class)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(HOLD_OUT).alias("held_out"), score(model, whole_text()).alias("score"),
    ).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
