"""Groups of near-duplicate texts, for keeping near copies on one side of a split.

Texts are sets of word shingles; two are near if their sets' Jaccard similarity
reaches the threshold.  MinHash signatures are cut into bands; sets that share a
band are compared exactly, and groups are what is linked, over any number of
steps.  With 32 bands of 4 a pair at 0.8 is missed once in some 10^7.

Equal texts are one set from the start, so that a text which half the rows share
costs what one row does.  Sets of one band come together in chunks: a pair of
chunks is a task's work, is compared as a product of matrices, and gives links
that span what it finds connected, so a band of any size is split and gives no
more links than rows.  Bands that hold the same sets are compared once.

Rows whose text is null or has no words are groups of their own.  Shingles are
told apart by 64-bit hashes, sets by 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, ship, staged
from .graph import components


def shingles(text: Column, words: int) -> Column:
    """The distinct hashes of a text's word shingles, sorted; a shorter text is one shingle, one without words none."""
    split = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), 0)

    def hashed(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, words), " ")))
        return F.when(F.size(w) > 0, F.array_sort(F.array_distinct(each))).otherwise(F.array().cast("array<bigint>"))

    # inside a function over one array of words, so that a text is split once
    return F.get(F.transform(F.array(split), hashed), F.lit(0))


def signatures(sets: pa.ListArray, bands: int, depth: int, seed: int) -> np.ndarray:
    """(set, band): a hash of each band's minima."""
    rng = np.random.default_rng(seed)
    flat = sets.flatten().to_numpy().astype(np.int64).view(np.uint64)
    first = np.r_[0, np.cumsum(sets.value_lengths().to_numpy())[:-1]]
    out = np.zeros((len(sets), bands), np.uint64)
    for band in range(bands):
        total = np.full(len(sets), band + 1, np.uint64)
        for _ in range(depth):
            a, b = rng.integers(0, 2**63, 2, dtype=np.uint64)
            x = flat * (a * np.uint64(2) + np.uint64(1)) + b
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            total = (total ^ np.minimum.reduceat(x ^ (x >> np.uint64(32)), first)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, band] = total
    return out


def near_pairs(sets: list[np.ndarray], similarity: float, block: int = 4096) -> np.ndarray:
    """(set, set): whether two sets are near, by counting what they share, some elements at a time."""
    size = np.array([len(s) for s in sets])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2^24 are exact
    for low in range(0, int(element[-1]) + 1, block):
        a, b = np.searchsorted(element, [low, low + block])
        held = np.zeros((len(sets), block), np.float32)
        held[owner[a:b], element[a:b] - low] = 1
        shared += held @ held.T
    shared = shared.astype(np.float64)
    return shared / (size[:, None] + size[None] - shared) >= similarity - 1e-12


def spanning(near: np.ndarray, names: list[str]) -> list[tuple[str, str]]:
    """Links that connect what ``near`` connects: from each unseen row outwards."""
    out, seen = [], np.zeros(len(names), bool)
    for i in range(len(names)):
        if seen[i]:
            continue
        seen[i], front = True, [i]
        while front:
            at = front.pop()
            fresh = np.flatnonzero(near[at] & ~seen)
            seen[fresh] = True
            front += fresh.tolist()
            out += [(names[i], names[j]) for j in fresh]
    return out


def near_groups(rows: DataFrame, key: str, text: str, similarity: float = 0.8, words: int = 5, bands: int = 32, depth: int = 4, chunk: int = 512, seed: int = 11) -> DataFrame:
    """(key, group): ``group`` is the smallest key of the row's group; keys are unique and not null."""
    spark = rows.sparkSession
    ship(spark)
    each = rows.select(F.col(f"`{key}`").alias("key"), shingles(F.col(f"`{text}`"), words).alias("set"))
    named = staged(each.withColumn("node", F.when(F.size("set") > 0, F.md5(F.array_join(F.col("set").cast("array<string>"), ",").cast("binary")))), "sets")
    sets = staged(named.where("node is not null").groupBy("node").agg(F.first("set").alias("set")), "distinct")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = signatures(b.column(1), bands, depth, seed)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), bands))), pa.array(found.ravel().view(np.int64))], names=["node", "band"])

    band_of = staged(sets.select("node", "set").mapInArrow(banded, "node string, band long"), "bands")
    member = F.xxhash64("node")
    held = band_of.groupBy("band").agg(F.count("*").alias("n"), F.sum(member.cast("decimal(38,0)")).alias("h"), F.min("node").alias("least"), F.max("node").alias("most")).where("n > 1")
    # bands of the same sets are one
    once = staged(held.groupBy("n", "h", "least", "most").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "once")
    dealt = band_of.join(once, "band").withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")

    def compared(cell: pa.Table) -> pa.Table:
        names, found = cell["node"].to_pylist(), []
        if len(names) > 1:
            near = near_pairs([np.asarray(s.values) for s in cell["set"]], similarity)
            own = cell["own"].to_numpy()
            if cell["i"][0].as_py() != cell["j"][0].as_py():  # each chunk by itself is another cell's
                near &= own[:, None] != own[None]
            found = spanning(near, names)
        a, b = zip(*found) if found else ((), ())
        return pa.table([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    links = cells.join(sets, "node").groupBy("band", "i", "j").applyInArrow(compared, "a string, b string")
    of = components(staged(links, "links"))
    whole = named.select("key", "node").join(of, "node", "left")
    grouped = whole.select("key", F.coalesce("component", "node").alias("g"))
    least = staged(grouped.where("g is not null").groupBy("g").agg(F.min("key").alias("group")), "groups")
    out = staged(grouped.join(least, "g", "left").select(F.col("key").alias(key), F.coalesce("group", "key").alias("group")), "near")
    discard(named, sets, band_of, once, of, least)
    return out
