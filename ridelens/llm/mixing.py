"""Mixing documents to target weights of domains that are known only by chance."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ridelens.llm.shared import stored

ROWS = 8_000  # labelled rows for the classifier, at most (chosen by a hash of their ids)
DOMAINS = 64  # at most: the most frequent; others are not aimed at
LETTERS = 64
STEPS, TOLERANCE, STAY = 60, 1e-4, 1e-4  # of the fit: most steps, distance to the optimum, pull towards rate 1
HIGHEST = math.inf  # rate: none by default, as a cap keeps domains from their targets
SMALLEST = 1e-6  # share of a domain: errors of smaller ones are relative to this
TEMPERATURE = 0.7  # default targets are the expected shares to this power


def features(text: str) -> np.ndarray:
    """Shares of letters (by code, modulo LETTERS) and of kinds of characters, and variety of words."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(len(codes), 1)
    letters = np.bincount(codes % LETTERS, minlength=LETTERS) / n
    upper = ((codes >= 65) & (codes <= 90)).sum() / n
    beyond = (codes > 127).sum() / n
    marks = np.array([(codes == ord(c)).sum() for c in "!|#$%&*.,\n "]) / n
    words = text.split()
    variety = len(set(words)) / max(len(words), 1)
    return np.concatenate([letters, marks, [upper, beyond, variety, np.log1p(len(words)) / 10, n / max(len(words), 1) / 10]])


class Classifier(NamedTuple):
    names: list[str]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return softmax(np.column_stack([(x - self.mean) / self.spread, np.ones(len(x))]) @ self.weights)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@F.pandas_udf(ArrayType(DoubleType()))
def _features(column: pd.Series) -> pd.Series:
    return column.map(features)


def domain(lang: str = "lang", quality: str = "quality") -> Column:
    """The domain of a labelled row: its language and its quality class."""
    return F.concat_ws("-", F.coalesce(F.col(lang), F.lit("und")), F.concat(F.lit("q"), F.col(quality).cast("string")))


def fit_classifier(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Classifier:
    """Softmax regression of the domain on text features, from a bounded sample of labelled rows.

    The sample is chosen before its texts are read, and comes to the driver as features.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, rows / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    met = docs.where("text is not null").select("doc_id", "text", "lang").join(F.broadcast(known), "doc_id")
    got = met.select(domain().alias("domain"), _features("text").alias("x")).limit(2 * rows).collect()
    if not got:
        return Classifier(["all"], np.zeros(1), np.ones(1), np.zeros((2, 1)))
    names = pd.Series([r.domain for r in got]).value_counts().index[:DOMAINS].sort_values().tolist()
    got = [r for r in got if r.domain in set(names)]
    x = np.array([r.x for r in got])
    y = np.array([names.index(r.domain) for r in got])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    design = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    target = np.eye(len(names))[y]
    weights, speed = np.zeros((design.shape[1], len(names))), np.zeros((design.shape[1], len(names)))
    for _ in range(300):
        slope = design.T @ (softmax(design @ (weights + 0.9 * speed)) - target) / len(x) + 1e-4 * weights
        speed = 0.9 * speed - 0.5 * slope
        weights = weights + speed
    return Classifier(names, mean, spread, weights)


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_tokens (words) and p, the chance of each domain, of every row; an empty text has no tokens."""

    @F.pandas_udf("n_tokens long, p array<double>")
    def run(column: pd.Series) -> pd.DataFrame:
        if not len(column):
            return pd.DataFrame({"n_tokens": [], "p": []})
        x = np.array([features(t) for t in column]) if len(model.names) > 1 else np.zeros((len(column), 1))
        return pd.DataFrame({"n_tokens": column.map(lambda t: len(t.split())), "p": list(model.posteriors(x))})

    made = docs.select("doc_id", run(F.coalesce("text", F.lit(""))).alias("made"))
    return made.select("doc_id", "made.*")


def rate_of(lift: list[float], highest: float = HIGHEST, p: str = "p") -> Column:
    """A document's rate: 1 and its domains' lifts, put back to 0 or more (and to `highest` or less)."""
    if not lift:
        return F.lit(1.0)
    moved = F.aggregate(F.zip_with(F.col(p), F.array(*map(F.lit, lift)), lambda a, b: a * b), F.lit(1.0), lambda a, b: a + b)
    rate = F.greatest(moved, F.lit(0.0))
    return F.least(rate, F.lit(float(highest))) if math.isfinite(highest) else rate


def expected(members: DataFrame, k: int, rate: Column) -> np.ndarray:
    """Tokens expected in each domain at these rates."""
    sums = [F.coalesce(F.sum(F.col("n_tokens") * F.col("p")[i] * F.col("rate")), F.lit(0.0)) for i in range(k)]
    return np.array(members.withColumn("rate", rate).agg(*sums).first(), float)


def _sums(lift: np.ndarray, highest: float):
    """Tokens by domain at a lift's rates, how they change with the lift, and the integral of the rates; summed over the task."""
    k = len(lift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k + k * k + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
            p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            moved = 1.0 + p @ lift
            rate = np.clip(moved, 0.0, highest)
            free = p * (n * ((moved > 0) & (moved < highest)))[:, None]
            sums[:k] += (n * rate) @ p
            sums[k:-1] += (free.T @ p).ravel()
            sums[-1] += n @ (rate * moved - rate * rate / 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["i", "x"])

    return run


def _measured(members: DataFrame, lift: np.ndarray, highest: float, total: float) -> tuple[np.ndarray, np.ndarray, float]:
    k = len(lift)
    found = members.select("n_tokens", "p").mapInArrow(_sums(lift, highest), "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    sums = np.zeros(k + k * k + 1)
    for row in found.collect():
        sums[row.i] = row.x
    sums /= total
    return sums[:k], sums[k:-1].reshape(k, k), float(sums[-1])


def fit_rates(members: DataFrame, targets: np.ndarray, highest: float = HIGHEST) -> tuple[Column, list[float]]:
    """The rates as an expression of p, and the shares of tokens they are expected to give, relative to all tokens there are.

    Minimises half the squared distance of expected domain totals to the targets, each
    relative to the domain's own size, so that small domains count, and STAY times half
    that of the rates to 1, over rates of 0 or more. At the optimum a rate is the
    projection of 1 + p . lift, with one lift for each domain, so that rates need no
    table. Lifts are found by Newton steps on the dual, halved until it falls; each sums
    totals over all documents. It ends where no domain's total is further from the
    optimality condition than TOLERANCE of its size; a warning tells if STEPS ran out.
    """
    k = len(targets)
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return rate_of([]), [0.0] * k
    lift, tried, best, direction, size = np.zeros(k), np.zeros(k), None, np.zeros(k), 1.0
    own = None
    for _ in range(STEPS):
        shares, curve, integral = _measured(members, tried, highest, total)
        own = np.maximum(shares, SMALLEST) if own is None else own
        dual = integral - targets @ tried + STAY / 2 * own @ tried**2
        slope = shares - targets + STAY * own * tried
        if best is not None and dual > best[0] + 1e-4 * size * (best[2] @ direction) + 1e-12:
            size /= 2
            tried = lift + size * direction
            continue
        lift, best, size = tried, (dual, shares, slope), 1.0
        if (np.abs(slope) / own).max() < TOLERANCE:
            break
        direction = -np.linalg.solve(curve + np.diag(STAY * own), slope)
        tried = lift + direction
    else:
        logging.getLogger(__name__).warning("mixing: %d steps ended before the optimum: slope %s of shares %s", STEPS, best[2].tolist(), own.tolist())
    return rate_of(lift.tolist(), highest), best[1].tolist()


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, highest: float = HIGHEST) -> DataFrame:
    """doc_id, n_tokens, domains, targets, shares, p, rate and copies of every row.

    targets: weight of each domain, scaled to 1; by default the expected shares to the
    power TEMPERATURE, which lifts small domains. Rates are fitted so that tokens expected
    in each domain have these shares of the whole, as nearly as rates of 0 or more can.
    shares are those expected at the rates, beside the targets, in the order of domains.
    `highest` caps the rates where it is given; domains may then miss their targets.
    copies is the rate rounded up with the chance of its fraction, by a hash of the id:
    copies in all are as many as rates say, and the same each time. A null text counts
    as empty: it has no tokens, and its rate follows from its domains. Repeated rows get
    equal copies; a null id has the hash of null. Unlabelled tables make one domain.
    """
    model = fit_classifier(docs, labels)
    members = stored(memberships(docs, model), "memberships")
    if targets is None:
        wanted = expected(members, len(model.names), F.lit(1.0)) ** TEMPERATURE
    else:
        wanted = np.array([targets.get(n, 0.0) for n in model.names])
    wanted = wanted / wanted.sum() if wanted.sum() else np.full(len(wanted), 1 / len(wanted))
    rate, shares = fit_rates(members, wanted, highest)
    names, aims, given = (F.array(*map(F.lit, of)) for of in (model.names, wanted.tolist(), shares))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 32)) / float(1 << 32)
    rated = members.withColumn("rate", rate)
    return rated.select(
        "doc_id",
        "n_tokens",
        names.alias("domains"),
        aims.alias("targets"),
        given.alias("shares"),
        "p",
        "rate",
        F.floor(F.col("rate") + chance).cast("int").alias("copies"),
    )
