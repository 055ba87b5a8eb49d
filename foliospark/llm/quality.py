"""Quality classifier: a naive Bayes support vector machine over n-gram indicators.

Each text becomes the set of its hashed n-grams (present or not). The log-count ratio of an n-gram between good and bad
training rows scales its indicator; a linear model of hinge loss is fitted on the scaled indicators, at unit length, by
dual coordinate descent. A logistic curve, fitted on margins of rows that their own model hasn't seen and weighted by
the shares of both labels, turns margins into scores.

N-grams are of two kinds: one and two lower-case tokens; and one to four shapes of tokens (capitals, capitalised, lower case,
digits, the sign itself), where a word that repeats the word before it has a shape of its own. Tokens are words and single
signs; whole texts are read, some ``STEP`` tokens at a time.

Fitting uses a bounded sample: at most ``per_class`` labelled rows of each label, those of smallest hash, of at most ``longest``
characters. Up to 1,000 rows a label, Spark ranks within each task first, so no more than that leave it (a larger ``per_class`` ranks all
rows of a label in one task). Their n-gram sets are made by tasks, so two times ``per_class`` packed sets reach the driver. The label
shares are counted over all training rows.

Defined results: a null text is empty and gets the score of a text without n-grams; without rows of both labels the score is the share of
good ones, (good + 1) / (all + 2); a doc_id whose labels contradict each other isn't learned from, one labelled again counts
once; labels without a document and null labels or ids are left out; equal texts get equal scores; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.language_id import held_out
from foliospark.llm.suffix_dedup import mixed

BUCKETS, STEP, REMEMBERED = 1 << 18, 50_000, 100_000
LOWER, CAPITALISED, UPPER, OTHER, DIGITS, AGAIN, SIGN = range(7)
_TOKEN = re.compile(r"\w+|[^\w\s]")
_SEEDS = mixed(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def shape(token: str) -> int:
    if not (token[0].isalnum() or token[0] == "_"):
        return SIGN + ord(token)
    if token[0].isdigit():
        return DIGITS
    if token.islower():
        return LOWER
    if token.isupper():
        return UPPER if len(token) > 1 else CAPITALISED
    return CAPITALISED if token.istitle() else OTHER


class Lexicon(dict):
    """Numbers of tokens, with the hash of the lower-case token and the shape of each; forgets all when it has grown large."""

    def __init__(self):
        super().__init__()
        self.hashes, self.shapes = np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=np.uint64)

    def __missing__(self, token: str) -> int:
        k = len(self)
        if k == len(self.hashes):
            self.hashes, self.shapes = np.r_[self.hashes, np.zeros_like(self.hashes)], np.r_[self.shapes, np.zeros_like(self.shapes)]
        raw = token.lower().encode("utf-8", "surrogatepass")
        self.hashes[k], self.shapes[k] = zlib.crc32(raw) + (len(raw) << 32), shape(token)
        self[token] = k
        return k


def _grams(codes: np.ndarray, most: int, seed: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of 1 to ``most`` codes."""
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, most + 1):
        if len(codes) < n:
            return
        rolled = mixed(rolled[: len(codes) - n + 1] * _SEEDS[seed] + codes[n - 1 :] + np.uint64(n))
        yield (rolled >> np.uint64(40)).astype(np.int64) % BUCKETS


def indicators(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """The ordered distinct buckets of a text's n-grams."""
    tokens, found, before = _TOKEN.finditer(text or ""), np.zeros(0, dtype=np.int64), None
    tail = np.zeros((2, 0), dtype=np.uint64)  # the last three tokens of the step before, so no n-gram is lost between steps
    while True:
        words = [m[0] for m in islice(tokens, STEP)]
        if not words:
            return found
        if len(lexicon) > REMEMBERED:
            lexicon.clear()
        at = np.fromiter((lexicon[w] for w in words), dtype=np.int64, count=len(words))
        hashes, shapes = lexicon.hashes[at], lexicon.shapes[at]
        word = np.flatnonzero(shapes < SIGN)
        if len(word):
            last = np.r_[hashes[word[0]] ^ np.uint64(1) if before is None else before, hashes[word[:-1]]]
            shapes[word[hashes[word] == last]] = AGAIN
            before = hashes[word[-1]]
        hashes, shapes = np.r_[tail[0], hashes], np.r_[tail[1], shapes]
        parts = [*_grams(hashes[max(0, tail.shape[1] - 1) :], 2, 0), *_grams(shapes, 4, 1)]
        found = np.union1d(found, np.concatenate(parts))
        tail = np.stack([hashes[-3:], shapes[-3:]])


def count_ratios(sets: list[np.ndarray], good: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of each bucket's share among good rows to that among bad rows."""
    sides = []
    for side in (True, False):
        rows = [s for s, g in zip(sets, good.tolist(), strict=True) if g is side]
        count = np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]), minlength=BUCKETS) + smoothing
        sides.append(np.log(count / count.sum()))
    return sides[0] - sides[1]


def descend(sets: list[np.ndarray], ratios: np.ndarray, good: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of least hinge loss, by dual coordinate descent in random order; each dual variable stays between 0 and ``cost``."""
    weights, bias, sign = np.zeros(BUCKETS), 0.0, np.where(good, 1.0, -1.0)
    rows = [unit(ratios[s]) for s in sets]
    diagonal = np.array([r @ r + 1.0 for r in rows])
    dual, order = np.zeros(len(sets)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(sets)).tolist():
            slope = sign[i] * (weights[sets[i]] @ rows[i] + bias) - 1.0
            new = min(cost, max(0.0, dual[i] - slope / diagonal[i]))
            step = (new - dual[i]) * sign[i]
            if step:
                weights[sets[i]] += step * rows[i]
                bias += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def unit(x: np.ndarray) -> np.ndarray:
    length = float(np.sqrt(x @ x))
    return x / length if length else x


@dataclass
class QualityModel:
    """``weights`` are of unscaled indicators; a margin is their sum over the length of the scaled indicators, plus the bias."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt(self.squares[found].sum()))
        return self.bias + (float(self.weights[found].sum()) / length if length else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -500.0, 500.0))))


def _fitted(sets: list[np.ndarray], good: np.ndarray) -> QualityModel:
    ratios = count_ratios(sets, good)
    weights, bias = descend(sets, ratios, good)
    return QualityModel((weights * ratios).astype(np.float32), (ratios * ratios).astype(np.float32), bias, 1.0, 0.0)


def logistic(margins: np.ndarray, good: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve of greatest likelihood, by Newton's method with a small penalty on the slope."""
    x, at = np.stack([margins, np.ones(len(margins))], axis=1), np.zeros(2)
    penalty = np.array([1e-2, 1e-6])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ at, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, x.T @ (weight * (good - p)) - penalty * at)
        at = at + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit(sets: list[np.ndarray], good: np.ndarray, share: float, folds: int = 3) -> QualityModel:
    """Fits the model; ``share`` of good rows among all training rows weighs the curve of the scores."""
    fold, margins = np.zeros(len(sets), dtype=np.int64), np.zeros(len(sets))
    for side in (good, ~good):
        fold[side] = np.arange(int(side.sum())) % folds
    for k in range(folds):
        rest = np.flatnonzero(fold != k)
        model = _fitted([sets[i] for i in rest], good[rest])
        for i in np.flatnonzero(fold == k):
            margins[i] = model.margin(sets[i])
    whole = _fitted(sets, good)
    weight = np.where(good, share / max(1, good.sum()), (1 - share) / max(1, (~good).sum())) * len(sets)
    whole.slope, whole.shift = logistic(margins, good.astype(float), weight)
    return whole


def training_sets(docs: DataFrame, labels: DataFrame, per_class: int = 1000, longest: int = 20_000) -> tuple[list[np.ndarray], np.ndarray, float]:
    """The n-gram sets and labels of the bounded sample, and (good + 1) / (all + 2) over all training rows."""
    told = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    told = told.where("quality = most").where(~held_out()).select("doc_id", (F.col("quality") == 1).alias("good"))
    lengths = docs.select("doc_id", F.length("text").alias("n")).where(F.coalesce("n", F.lit(0)) <= longest)
    mark = F.xxhash64(F.lit("fit"), F.col("doc_id"))
    ranked = told.join(lengths.select("doc_id"), "doc_id", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("good").orderBy(mark, "doc_id")))
    picked = ranked.where(F.col("k") <= per_class).select("doc_id", "good")
    counts = {r["good"]: r["n"] for r in told.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "good": batch["good"], "found": [indicators(t, lexicon).astype(np.int32).tobytes() for t in batch["text"]]})

    texts = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= longest).join(F.broadcast(picked), "doc_id")
    rows = texts.mapInPandas(packed, "doc_id long, good boolean, found binary").groupBy("doc_id", "good").agg(F.min("found").alias("found")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    share = (counts.get(True, 0) + 1) / (sum(counts.values()) + 2)
    return [np.frombuffer(r["found"], dtype=np.int32).astype(np.int64) for r in rows], np.array([r["good"] for r in rows], dtype=bool), share


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = 1000) -> QualityModel:
    sets, good, share = training_sets(docs, labels, per_class)
    if good.all() or not good.any():
        nothing = np.zeros(BUCKETS, dtype=np.float32)
        return QualityModel(nothing, nothing, 0.0, 0.0, float(np.log(share / (1 - share))))
    return fit(sets, good, share)


def quality_score(model: QualityModel):
    """A function of a text column: the score. One pass, no shuffle."""

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon()
        for batch in batches:
            yield pd.Series([model.score(indicators(t, lexicon)) for t in batch], dtype="float64")

    return F.pandas_udf(scored, "double")


def score_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, after fitting on labelled rows that aren't held out."""
    found = docs.select("doc_id", quality_score(fit_on(docs, labels))("text").alias("score"))
    predicted: Column = (F.col("score") >= least).cast("int")
    return found.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))
