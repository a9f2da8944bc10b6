"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.shared import Memo, held_out, stored

ROWS = 100_000  # labelled rows to learn from, at most (chosen by a hash of their ids)
FEATURES = 65_536  # of a model, at most: the most significant
PRIOR = 0.05  # weight of the Dirichlet prior, as a share of all counts
DISCOVERIES = 0.05  # share of chance features among those kept, at most as expected
DRIFT = 0.5  # cost of a token that says nothing, so that chance segments stay short
PREFIXES = (4, 5)  # letters of the beginnings that stand for words not met before; two more must follow
THRESHOLD = 0.3

_word = re.compile(r"\w+")


def features(token: str) -> list[int]:
    """Numbers of the words in a token and of their beginnings."""
    found = []
    for word in _word.findall(token):
        found.append(_number(word))
        found += [_number(f"{word[:n]}^") for n in PREFIXES if len(word) >= n + 2]
    return found


def _number(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) - 2**63


# --- learning -------------------------------------------------------------------------
def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS) -> DataFrame:
    """label, text and calibrates (one in four, by a hash) of labelled rows that are not held out.

    Each distinct text comes once, and there are at most about `rows`.
    The chosen ids have a bounded number, so the join sends them to the texts.
    """
    known = labels.where(f"{label} is not null and doc_id is not null").select("doc_id", F.col(label).cast("int").alias("label"))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, rows / max(known.count(), 1))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    met = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # Copies would count many times: one of each text is enough.
    one = met.groupBy(F.xxhash64("text").alias("key")).agg(F.max("label").alias("label"), F.first("text").alias("text"))
    return one.select("label", "text", (F.pmod("key", F.lit(4)) == 0).alias("calibrates"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts labelled 0 and 1 with each feature, added up for each batch. A text that repeats a word counts once."""
    numbers = Memo(features, 100_000)
    for batch in batches:
        counts: dict[int, list[int]] = {}
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for feature in {f for token in set(text.lower().split()) for f in numbers[token]}:
                counts.setdefault(feature, [0, 0])[label] += 1
        if counts:
            zero, one = zip(*counts.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64()), pa.array(zero, pa.int64()), pa.array(one, pa.int64())], ["feature", "zero", "one"])


class Model(NamedTuple):
    """Log-odds by feature; the rate and size of chance segments; by class the share of texts with
    any excess and its mean among these."""

    odds: dict[int, float]
    rate: float
    size: float
    clean: tuple[float, float]
    toxic: tuple[float, float]
    prior: float


def log_odds(rows: DataFrame) -> dict[int, float]:
    """Log-odds of features in toxic against clean rows, under a Dirichlet prior of the whole's shares.

    Kept are those that are significant among all that were tested, the most significant
    first. The level follows their number, see `level`.
    """
    counts = rows.mapInArrow(_count, "feature long, zero long, one long").groupBy("feature").agg(
        F.sum("zero").alias("zero"), F.sum("one").alias("one")
    )
    counts = stored(counts, "toxic-features")
    n0, n1 = counts.agg(F.sum("zero"), F.sum("one")).first()
    if not n0 or not n1:
        return {}
    met = rows.groupBy("label").agg(F.count(F.lit(1))).collect()
    texts0, texts1 = (next((n for label, n in met if label == k), 0) for k in (0, 1))
    tables = counts.groupBy("zero", "one").agg(F.count(F.lit(1))).collect()  # few: most features are rare
    zero, one, times = np.array(tables, np.int64).T
    p = chance_of(zero, one, texts0, texts1)
    kept = p <= level(p, times)
    passed = rows.sparkSession.createDataFrame([(int(a), int(b), float(x)) for a, b, x in zip(zero[kept], one[kept], p[kept], strict=True)], "zero long, one long, p double")
    prior, all_prior = PRIOR * (F.col("zero") + F.col("one")), PRIOR * (n0 + n1)
    with_prior, without = F.col("one") + prior, F.col("zero") + prior
    odds = F.log(with_prior / (n1 + all_prior - with_prior)) - F.log(without / (n0 + all_prior - without))
    best = counts.join(F.broadcast(passed), ["zero", "one"]).orderBy("p", "feature").limit(FEATURES)
    return {r.feature: r.odds for r in best.select("feature", odds.alias("odds")).collect()}


def chance_of(zero: np.ndarray, one: np.ndarray, texts0: int, texts1: int) -> np.ndarray:
    """Chance that so many texts, dealt at random, have as uneven a share of toxic ones: twice the
    smaller tail of the hypergeometric law (Fisher's test)."""
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, texts0 + texts1 + 1)))])

    def choose(n, k):
        return logs[n] - logs[k] - logs[n - k]

    out = np.ones(len(zero))
    for i, (a, b) in enumerate(zip(zero.tolist(), one.tolist(), strict=True)):
        n = a + b
        k = np.arange(max(0, n - texts0), min(n, texts1) + 1)
        law = np.exp(choose(texts1, k) + choose(texts0, n - k) - choose(texts0 + texts1, n))
        out[i] = min(1.0, 2 * min(law[k >= b].sum(), law[k <= b].sum()))
    return out


def level(p: np.ndarray, times: np.ndarray, share: float = DISCOVERIES) -> float:
    """The largest chance to keep, by Benjamini and Hochberg: among all features that were tested,
    as many as chance would bring at this level are at most a `share` of those kept."""
    order = np.argsort(p, kind="stable")
    found = np.cumsum(times[order])
    good = p[order] <= share * found / times.sum()
    return float(p[order][good][-1]) if good.any() else 0.0


# --- segments -------------------------------------------------------------------------
@dataclass
class Scorer:
    """Scores of tokens, remembered while there is room."""

    odds: dict[int, float]

    def __post_init__(self):
        self.known = Memo(self._score, 120_000)

    def _score(self, token: str) -> float:
        """Of a token's known features the strongest for toxicity; the drift where it has none."""
        found = [self.odds[f] for f in features(token) if f in self.odds]
        return max(found) - DRIFT if found else -DRIFT

    def scores(self, text: str) -> np.ndarray:
        tokens = text.lower().split()
        return np.fromiter(map(self.known.__getitem__, tokens), np.float64, len(tokens))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring segments, in order, in linear time.

    A run of tokens above 0 opens a segment. It takes in earlier ones back to the
    nearest whose sum before it is smaller, if the sum up to it has grown since then.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum at end
    back: list[int] = []  # nearest earlier segment whose sum before is smaller
    for at in np.flatnonzero(scores > 0).tolist():
        first, last, before, end = at, at, float(sums[at]), float(sums[at + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = back[j]
            if j < 0 or found[j][3] >= end:
                found.append((first, last, before, end))
                back.append(j)
                break
            first, before = found[j][0], found[j][2]
            del found[j:], back[j:]
    return [(a, b, end - before) for a, b, before, end in found]


def chance(values: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Rate and size of the extreme-value law of chance segments, from how often each token score occurs.

    The rate solves sum p e^(rate s) = 1. The size is the usual rough one, drift over rate.
    """
    share = counts / counts.sum()
    low, high = 1e-6, 1.0
    if not (values > 0).any() or (share * values).sum() >= 0:
        return 1.0, 0.1
    while (share * np.exp(high * values)).sum() < 1 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(np.minimum(middle * values, 500))).sum() < 1 else (low, middle)
    return high, max(min(-(share * values).sum() * high, 1.0), 1e-3)


def excess(found: list[tuple[int, int, float]], tokens: int, rate: float, size: float) -> float:
    """By how much the significant segments exceed what chance gives in so many tokens, in all; 0 without any."""
    limit = max(math.log(max(size * tokens, 1e-9)), 0.0)
    return sum(max(rate * s - limit, 0.0) for *_, s in found)


def _histogram(odds: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(odds)
        for batch in batches:
            all_scores = [scorer.scores(t) for t in batch.column("text").to_pylist()]
            values, counts = np.unique(np.round(np.concatenate(all_scores), 2), return_counts=True) if all_scores else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), pa.array(counts, pa.int64())], ["value", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Learns from labelled rows that are not held out; without any, every text scores low.

    The laws of both classes come from texts that the log-odds were not learned from.
    """
    known = stored(sample(docs, labels, rows=rows), "toxic-sample")
    odds = log_odds(known.where("not calibrates").select("label", "text"))
    clean = known.where("label = 0").select("text").mapInArrow(_histogram(odds), "value double, n long")
    bins = clean.groupBy("value").agg(F.sum("n").alias("n")).collect()  # bounded: scores to two places
    rate, size = chance(np.array([b.value for b in bins]), np.array([b.n for b in bins])) if bins else (1.0, 0.1)

    @F.pandas_udf("double")
    def statistic(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(odds)
        for column in columns:
            scores = map(scorer.scores, column)
            yield pd.Series([excess(segments(s), len(s), rate, size) for s in scores], dtype="float64")

    moments = known.where("calibrates").select("label", statistic("text").alias("x")).groupBy("label").agg(F.count_if(F.col("x") > 0), F.sum("x"), F.count(F.lit(1)))
    by_class = {label: (over, total, n) for label, over, total, n in moments.collect()}
    if set(by_class) != {0, 1}:
        return Model({}, rate, size, (0.5, 1.0), (0.5, 1.0), 0.01)
    laws = {label: _tail(*counts) for label, counts in by_class.items()}
    return Model(odds, rate, size, laws[0], laws[1], by_class[1][2] / (by_class[0][2] + by_class[1][2]))


def _tail(over: int, total: float, n: int) -> tuple[float, float]:
    """Share of texts with any excess, smoothed, and mean excess: beyond a limit, extreme values of
    light-tailed scores are exponential."""
    return (over + 0.5) / (n + 1), max(total / over if over else 0.0, 0.5)


def posterior(x: float, model: Model) -> float:
    """Chance that a text of this excess or more is toxic; of one without excess, that it is all the same."""
    (q0, m0), (q1, m1) = model.clean, model.toxic
    if x <= 0:
        toxic, clean = math.log(1 - q1), math.log(1 - q0)
    else:
        m0 = min(m0, m1)  # more excess never speaks against toxicity
        toxic, clean = math.log(q1) - x / m1, math.log(q0) - x / m0
    odds = toxic - clean + math.log(model.prior / (1 - model.prior))
    return 1 / (1 + math.exp(-max(min(odds, 500), -500)))


# --- scoring --------------------------------------------------------------------------
SCORED = "score double, passages array<struct<first:int,last:int,score:double>>"


def scored(model: Model, text: Column) -> Column:
    """score, and the significant passages as first and last word and segment score, of a text."""

    @F.pandas_udf(SCORED)
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.odds)

        def of(t: str) -> tuple:
            s = scorer.scores(t)
            found = segments(s)
            limit = max(math.log(max(model.size * len(s), 1e-9)), 0.0)
            told = [{"first": a, "last": b, "score": v} for a, b, v in found if model.rate * v > limit]
            return posterior(excess(found, len(s), model.rate, model.size), model), told

        for column in columns:
            yield pd.DataFrame([of(t) for t in column], columns=["score", "passages"])

    return run(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= threshold) and passages of every row.

    A null text counts as empty and scores low. Labels are only learned from: null ones
    and those of unknown ids are passed over, of several for one id the largest counts.
    """
    model = fit(docs, labels)
    made = docs.select("doc_id", held_out().alias("held_out"), scored(model, F.col("text")).alias("made"))
    made = made.select("doc_id", "held_out", "made.*")
    return made.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
