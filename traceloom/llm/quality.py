"""Operator 5: a quality score by Bradley-Terry pairwise ranking.

Preference pairs are of labelled rows outside the held-out part: a text of label 1
is preferred to one of label 0.  A document's strength is linear in features of
its whole text, and the weights are fitted by logistic loss on the pairs' feature
differences.  The cut is the quantile of strengths that leaves the share of label
1 above it; scores are the logistic of the strength, scaled and shifted so that
the cut lies at ``threshold``.

Every labelled row is learnt from, one row a key.  One narrow pass makes each
text's features, for learning and scoring alike.  Labelled rows are dealt to cells
of about ``cell`` rows of the commoner label; rows of the rarer one go to as many
cells as are without, so each cell pairs all its rows of both labels.  Newton steps
add up the cells' gradients and curvature on the executors; means, deviations and
the cut are of all labelled rows.  Only sums reach the driver.

Null text counts as empty; empty texts get the score of their (zero) features.
Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import held_out, known_labels, sigmoid
from .shared import discard, has, ship, staged, text_of, tidy

#: Classes of bytes: upper, lower, digits, white space, word bytes of other scripts, and signs by kind.
SIGNS = (b".", b",", b"!?", b"|", b"#$%&*", b"\"'()-;:")


def _classes() -> np.ndarray:
    c = np.full(256, 5 + len(SIGNS), np.int64)
    c[65:91], c[97:123], c[48:58], c[[9, 10, 11, 12, 13, 32]], c[128:] = 0, 1, 2, 3, 4
    for i, s in enumerate(SIGNS):
        c[list(s)] = 5 + i
    return c


CLASSES = _classes()
N_FEATURES = 2 * (6 + len(SIGNS)) + 10


def features(text: str) -> np.ndarray:
    """Shares and means that don't grow with length, each also as a square root."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(b):
        return np.zeros(N_FEATURES, np.float32)
    share = np.bincount(CLASSES, np.bincount(b, minlength=256), 6 + len(SIGNS)) / len(b)
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x]
    m = max(len(lines), 1)
    other = np.array([
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        np.log1p(n) / 8,
        len(b) / n / 10,
        len(set(lines)) / m,
        min(n / m, 200) / 50,
        (len(set(words)) / n) ** 0.5,
        (sum(map(eq, words, words[1:])) / n) ** 0.5,
        min(len(b) / n, 40) ** 2 / 400,
        1.0 / n**0.5,
    ])
    return np.concatenate([share, np.sqrt(share), other]).astype(np.float32)


class BradleyTerry:
    def __init__(self) -> None:
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.w, self.a, self.b = np.zeros(N_FEATURES), 1.0, 0.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * self.strength(x) + self.b)

    def slopes(self, good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Pairs, loss, gradient and curvature, end to end, over all pairs of rows of label 1 and 0."""
        g, b = (np.clip((x - self.mean) / self.scale, -8, 8) for x in (good, bad))
        margin = (g @ w)[:, None] - (b @ w)[None]
        p = sigmoid(-margin)
        v = p * (1 - p)
        cross = g.T @ v @ b
        curve = (g.T * v.sum(1)) @ g + (b.T * v.sum(0)) @ b - cross - cross.T
        return np.concatenate([[p.size, np.logaddexp(0, -margin).sum()], p.sum(0) @ b - p.sum(1) @ g, curve.ravel()])

    def fit(self, x: np.ndarray, y: np.ndarray, rate: float, threshold: float, pairs: int = 40_000, rounds: int = 400, l2: float = 1e-3, seed: int = 5) -> BradleyTerry:
        """Fit rows at hand on drawn pairs; ``rate`` is the share of label 1, which they needn't have."""
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        w, m1, m2 = np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        for step in range(1, rounds + 1):
            g = -(d.T @ (1 - sigmoid(d @ w))) / pairs + l2 * w
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            w -= 0.03 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        self.w = w
        s = self.strength(x)
        # the labels' shares in the sample are even; weights give them those of the whole
        weight = np.where(y == 1, rate / len(good), (1 - rate) / len(bad))
        order = np.argsort(s)
        cut = s[order][np.searchsorted(np.cumsum(weight[order]), 1 - rate)]
        self.a = float(1 / (s.std() + 1e-9)) * 2
        self.b = float(np.log(threshold / (1 - threshold)) - self.a * cut)
        return self


def featured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, held_out, t, x) of every row: features of its text and a hash to choose by."""

    @F.pandas_udf("array<float>")
    @tidy
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([features(t) for t in part])

    t = text_of(f"`{text}`")
    return docs.select(F.col(f"`{key}`").alias("k"), held_out(key).alias("held_out"), F.xxhash64(t).alias("t"), made(t).alias("x"))


def added(cells: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(good, bad)`` over all cells."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for good, bad in zip(b.column("good"), b.column("bad")):
                one = of(*(x.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_FEATURES) for x in (good, bad)))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    rows = cells.select("good", "bad").mapInArrow(tidy(summed), "s array<double>").select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return np.array([r["s"] for r in rows])


def dealt(rows: DataFrame, n_good: int, n_bad: int, cell: int) -> DataFrame:
    """(good, bad): the rows (k, y, x) in cells that hold both labels; each row of the commoner label is in one."""
    common, most, least = (1, n_good, n_bad) if n_good >= n_bad else (0, n_bad, n_good)
    cells = -(-most // cell)
    own = max(1, min(cells, least // 32))  # cells that rows of the rarer label fill by themselves; the others get copies
    at = lambda n: F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    one = rows.where(F.col("y") == common).select("y", "x", at(cells).alias("cell"))
    other = rows.where(F.col("y") != common).select("y", "x", F.explode(F.sequence(at(own), F.lit(cells - 1), F.lit(own))).alias("cell"))
    held = lambda label: F.flatten(F.collect_list(F.when(F.col("y") == label, F.col("x")))).alias("good" if label else "bad")
    return one.unionByName(other).groupBy("cell").agg(held(1), held(0))


def ranked(values: DataFrame, k: int, bins: int = 4096) -> float:
    """The ``k``-th smallest (from 0) of the column s, by counts of ever narrower ranges."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    inside, below = values, 0
    for _ in range(12):
        width = (high - low) / bins
        if not width > 1e-14 * max(abs(low), abs(high), 1e-300):
            break
        at = F.least(F.floor((F.col("s") - low) / width), F.lit(bins - 1)).cast("int")
        for r in inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("at").collect():
            if below + r["n"] > k:
                break
            below += r["n"]
        low, high = r["low"], r["high"]
        inside = values.where(F.col("s").between(low, high))
        if r["n"] == 1:
            break
    return low


def train(made: DataFrame, labels: DataFrame, threshold: float, key: str = "doc_id", label: str = "quality", cell: int = 256, rounds: int = 25, l2: float = 1e-3) -> BradleyTerry:
    """Fit on all labelled rows of ``made``, as ``featured`` gives them."""
    model = BradleyTerry()
    # of the rows of a key that with the least text hash
    rows = staged(made.select("k", "t", "x").join(known_labels(labels, label, key), "k").groupBy("k", "y").agg(F.min_by("x", "t").alias("x")), "learning")
    n_good, n_bad = rows.agg(F.count(F.when(F.col("y") == 1, 1)), F.count(F.when(F.col("y") == 0, 1))).first()
    if not n_good or not n_bad:
        discard(rows)
        return model
    n, sums = n_good + n_bad, lambda e: np.array([r["s"] for r in rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(e.alias("s")).orderBy("i").collect()])
    value = F.col("v").cast("double")
    model.mean, model.scale = sums(F.avg(value)), sums(F.stddev_pop(value)) + 1e-3

    cells = staged(dealt(rows, n_good, n_bad, cell), "cells")
    penalty = lambda w: l2 / 2 * w @ w
    w, step, best = np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.inf
    for _ in range(rounds):
        s = added(cells, lambda good, bad, v=w + step: model.slopes(good, bad, v))
        loss = s[1] / s[0] + penalty(w + step)
        if loss > best:  # too far
            step = step / 2
            continue
        w, done, best = w + step, best - loss < 1e-9, loss
        if done:
            break
        slope, curve = s[2 : 2 + N_FEATURES] / s[0] + l2 * w, s[2 + N_FEATURES :].reshape(N_FEATURES, -1) / s[0]
        step = -np.linalg.solve(curve + l2 * np.eye(N_FEATURES), slope)
    model.w = w

    @F.pandas_udf("double")
    def strong(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.strength(_matrix(part)))

    strengths = staged(rows.select(strong("x").alias("s")), "strengths")
    model.a = 2 / (strengths.agg(F.stddev_pop("s")).first()[0] + 1e-9)
    model.b = float(np.log(threshold / (1 - threshold)) - model.a * ranked(strengths, n - n_good))
    discard(rows, cells, strengths)
    return model


def _matrix(part: pd.Series) -> np.ndarray:
    return np.array(part.tolist(), np.float64).reshape(len(part), N_FEATURES)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, held_out, score, predicted) of every row of ``docs``."""
    has(docs, key, text)
    has(labels, key, label)
    ship(docs.sparkSession)
    made = staged(featured(docs, key, text), "features")
    model = train(made, labels, threshold, key, label)

    @F.pandas_udf("double")
    @tidy
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.score(_matrix(part)))

    return made.select(F.col("k").alias(key), "held_out", scored("x").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
