"""Text features and small linear models shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str = "doc_id") -> Column:
    """True where crc32 of the key as text leaves 2 on division by 4: never learnt from."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known_labels(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """(k, y): the labelled keys outside the held-out part, but those whose labels are null or of two minds."""
    y = F.col(f"`{label}`").cast("int")
    known = labels.where(F.col(f"`{key}`").isNotNull() & y.isin(0, 1)).groupBy(F.col(f"`{key}`").alias("k")).agg(F.min(y).alias("y"), F.max(y).alias("top")).where("y = top").select("k", "y")
    return known.where(~held_out("k"))


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y): at most ``sample`` labelled rows outside the held-out part.

    Keys are chosen by a hash, half of each label where there are enough, and of
    the rows of a key that with the least text hash.  Labels that are null or of two minds about a key are left out.
    """
    known = known_labels(labels, label, key)
    order = F.xxhash64(F.col("k"), F.lit(17))
    some = known.where("y = 1").orderBy(order).limit(sample // 2).union(known.where("y = 0").orderBy(order).limit(sample // 2))
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(some), "k")  # bounded: at most ``sample`` keys
    # rows of a key are first reduced where they are read
    return met.groupBy("k", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
