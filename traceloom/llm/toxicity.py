"""Operator 6: character n-gram linear classifier with naive Bayes ratios.

Features say which character n-grams (``SIZES`` characters, A-Z lowered, white
space as a space, hashed to ``BITS`` bits) a text holds.  Each is scaled by its
naive Bayes log-count ratio between the labels, and a linear model is fitted to
the scaled features by logistic loss.

The ratios and the model come from at most ``sample`` labelled rows outside the
held-out part, one row a key.  Executors count in how many texts of each label
an n-gram stands; the ``features`` most telling ones stay.  Of each sample row
only the telling n-grams that it holds reach the driver: at most ``sample`` times
``features`` numbers, whatever the texts' length.  Every whole text is scored, in
one narrow pass.

Null and empty texts hold no n-grams and get the model's score for nothing.
Without labels of both kinds no n-gram tells anything, and every score is the
same small number (0.000123).  Repeated rows are scored each;
of rows that share a labelled key one is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import held_out, learning_rows, sigmoid
from .shared import discard, has, ship, staged, text_of, tidy

BITS = 20
SIZES = (4, 6, 8)
#: Characters of a text that are worked on at a time.
PART = 1 << 20
#: n-grams with a smaller ratio, or one within so many standard errors of none, are left out; small samples have larger errors.
TELLING, ERRORS = 1.0, 3.0
MIX = np.uint32(0x9E3779B1)
STEP = np.uint32(0x01000193)


def _parts(text: str) -> Iterator[np.ndarray]:
    """The hashes of a text's n-grams, at every character, part by part; spaces stand around it."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c >= 65) & (c <= 90), c + np.uint32(32), c)
    c[(c >= 9) & (c <= 13)] = 32
    for a in range(0, len(c), PART):
        b = c[a : a + PART + SIZES[-1] - 1]
        h, done = b * STEP + np.uint32(7), 1
        for n in SIZES:
            while done < n and len(h) > 1:
                h = (h[:-1] * STEP) ^ (b[done:] * MIX)
                done += 1
            if done == n:
                yield (h * MIX) >> np.uint32(32 - BITS)


def grams(text: str, among: np.ndarray | None = None) -> np.ndarray:
    """The distinct hashed n-grams of a text, or those of them marked in ``among``."""
    if among is None:
        seen = np.zeros(1 << BITS, bool)
        for h in _parts(text):
            seen[h] = True
        return np.flatnonzero(seen).astype(np.int32)
    found = [h[among[h]] for h in _parts(text)]
    return np.unique(np.concatenate(found)).astype(np.int32) if found else np.empty(0, np.int32)


class NaiveBayesLinear:
    def __init__(self) -> None:
        self.w, self.b = np.zeros(1 << BITS, np.float32), -9.0
        self.used = np.zeros(1 << BITS, bool)

    def fit(self, ids: np.ndarray, ratio: np.ndarray, x: list[np.ndarray], y: np.ndarray, rate: float, rounds: int = 150, l2: float = 1e-4) -> NaiveBayesLinear:
        """``x`` holds each row's places in ``ids``; ``rate``: the share of label 1 among all rows, which the sample needn't have."""
        if len(set(y.tolist())) < 2:
            return self
        n = len(ids)
        flat, of = np.concatenate(x), np.repeat(np.arange(len(x)), [len(i) for i in x])
        r = ratio[flat]
        w, b = np.zeros(n), 0.0
        m1, m2, c1, c2 = np.zeros(n), np.zeros(n), 0.0, 0.0
        for step in range(1, rounds + 1):  # gradient steps of bounded size (Adam)
            err = (sigmoid(np.bincount(of, r * w[flat], len(x)) + b) - y) / len(x)
            g, gb = np.bincount(flat, r * err[of], n) + l2 * w, err.sum()
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            c1, c2 = 0.9 * c1 + 0.1 * gb, 0.99 * c2 + 0.01 * gb * gb
            u, v = 1 - 0.9**step, 1 - 0.99**step
            w -= 0.02 * (m1 / u) / (np.sqrt(m2 / v) + 1e-8)
            b -= 0.02 * (c1 / u) / (np.sqrt(c2 / v) + 1e-8)
        self.w[ids] = (w * ratio).astype(np.float32)
        self.used = self.w != 0
        prior = y.mean()
        self.b = float(b + np.log(rate / (1 - rate)) - np.log(prior / (1 - prior)))
        return self

    def score(self, text: str) -> float:
        return float(sigmoid(np.float64(self.w[grams(text, self.used)].sum(dtype=np.float64) + self.b)))


def telling(rows: DataFrame, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, ratios): the most telling n-grams of the rows (x, y); counts are taken on the executors."""
    n1, n0 = rows.agg(F.count(F.when(F.col("y") == 1, 1)), F.count(F.when(F.col("y") == 0, 1))).first()
    if not n1 or not n0:
        return np.empty(0, np.int64), np.empty(0)
    counts = rows.select(F.explode("x").alias("g"), "y").groupBy("g").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    ratio = F.log(((F.col("p") + 1) / (n1 + 2)) / ((F.col("n") - F.col("p") + 1) / (n0 + 2)))
    error = F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("n") - F.col("p") + 1))
    told = counts.select("g", ratio.alias("r"), (F.abs(ratio) / error).alias("z")).where((F.abs("r") > TELLING) & (F.col("z") > ERRORS))
    best = told.orderBy(F.desc("z"), "g").limit(features).toPandas()
    return best["g"].to_numpy(np.int64), best["r"].to_numpy(float)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 4000, features: int = 4096, key: str = "doc_id", text: str = "text") -> NaiveBayesLinear:
    """Fit on at most ``sample`` labelled rows."""

    @F.pandas_udf("array<int>")
    @tidy
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([grams(t) for t in part])

    rows = staged(learning_rows(docs, labels, label, sample, key, text).select(made("text").alias("x"), "y"), "sample")
    ids, ratio = telling(rows, features)
    if not len(ids):
        discard(rows)
        return NaiveBayesLinear()
    place = np.full(1 << BITS, -1, np.int32)
    place[ids] = np.arange(len(ids))

    @F.pandas_udf("array<int>")
    def kept(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([p[p >= 0] for p in (place[np.asarray(x, np.int64)] for x in part)])

    found = rows.select(kept("x").alias("x"), "y").toPandas()
    discard(rows)
    y = F.col(f"`{label}`").cast("int")
    rate = labels.where(~held_out(key) & y.isin(0, 1)).agg(F.avg(y.cast("double"))).first()[0]
    x = [np.asarray(v, np.int64) for v in found["x"]]
    return NaiveBayesLinear().fit(ids, ratio, x, found["y"].to_numpy(np.int64), min(max(rate or 0.0, 1e-3), 0.999))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 4000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) of every row of ``docs``."""
    has(docs, key, text)
    has(labels, key, label)
    ship(docs.sparkSession)
    score = scorer(train(docs, labels, label, sample, key=key, text=text))
    return docs.select(F.col(f"`{key}`"), held_out(key).alias("held_out"), score(text_of(f"`{text}`")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scorer(model: NaiveBayesLinear):
    """The model as a column function."""

    @F.pandas_udf("double")
    @tidy
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([model.score(t) for t in part], dtype="float64")

    return scored
