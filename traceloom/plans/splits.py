"""Dividing traces into splits: by hash, field, time or strata, with near copies kept together.

Ranks are global without a window over everything: rows are dealt by ranges of
their order, ranked within a range, and moved up by the counts of the ranges
ahead.  Shares are exact: of n rows (of a stratum) a split has its share of n,
rounded where it ends.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import discard, staged
from .governance import split_by_hash
from .near import near_groups

STRATEGIES = ("by_field", "by_time", "hash_of_field", "stratified_by_field", "random")
SHARES = {"train": 0.7, "dev": 0.15, "test": 0.15}


@dataclass(frozen=True)
class Splits:
    """``field`` is a column; for by_time what orders the traces, the newest being the last split's.

    by_field and hash_of_field keep rows of one value together; stratified_by_field
    gives each value's rows the exact shares; random is by the trace's id.
    """

    strategy: str = "hash_of_field"
    field: str | None = None
    shares: dict[str, float] = dataclasses.field(default_factory=lambda: dict(SHARES), hash=False)
    seed: int = 42
    #: near copies of this text column go to one split; None leaves them
    guard: str | None = None
    similarity: float = 0.8

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy {self.strategy!r} is none of {', '.join(STRATEGIES)}")
        if self.field is None and self.strategy != "random":
            raise ValueError(f"{self.strategy} needs a field")
        if abs(sum(self.shares.values()) - 1) > 1e-6 or any(s < 0 for s in self.shares.values()):
            raise ValueError("shares must add up to 1")
        if "test" not in self.shares:
            raise ValueError("shares must name test: a sealed part isn't optional")


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0) in ``order`` and ``total``, within each value of ``by``; nulls in ``by`` are a value.

    ``order`` should end with a unique column; of rows that are alike in all of
    it any may come first.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"__o{n}" for n in range(len(order))]
    keyed = rows.withColumns(dict(zip(names, order))).repartitionByRange(*by, *names)
    # written, so that no later scan can draw the ranges otherwise
    keyed = staged(keyed.withColumn("__range", F.spark_partition_id()), "ranges")
    group = F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.struct(F.lit(1).alias("one"))
    keyed = keyed.withColumn("__by", F.to_json(group, {"ignoreNullFields": "false"}))
    counts = keyed.groupBy("__by", "__range").agg(F.count("*").alias("n"))  # a row a range and value
    ahead = W.partitionBy("__by").orderBy("__range")
    counts = counts.select("__by", "__range", (F.sum("n").over(ahead) - F.col("n")).alias("__before"), F.sum("n").over(W.partitionBy("__by")).alias("total"))
    inside = F.row_number().over(W.partitionBy("__by", "__range").orderBy(*names))
    out = keyed.withColumn("__in", inside).join(counts, ["__by", "__range"])
    return out.withColumn("rank", F.col("__before") + F.col("__in") - 1).drop("__by", "__range", "__in", "__before", *names)


def by_rank(shares: dict[str, float]) -> Column:
    """The split of a row with ``rank`` of ``total``."""
    out, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        fits = F.col("rank") < F.floor(F.col("total") * upto + 0.5)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise(list(shares)[-1])


def assign(traces: DataFrame, splits: Splits, key: str = "trace_id") -> DataFrame:
    """(key, split) of every trace; with a guard, a group of near copies has the split of its smallest key."""
    shuffled = F.md5(F.concat_ws("|", F.lit(str(splits.seed)), F.col(f"`{key}`").cast("string")))
    if splits.strategy == "by_time":
        rows = ranked(traces.select(F.col(f"`{key}`").alias("key"), F.col(f"`{splits.field}`").alias("at")), [], ["at", "key"]).select("key", by_rank(splits.shares).alias("split"))
    elif splits.strategy == "stratified_by_field":
        rows = ranked(traces.select(F.col(f"`{key}`").alias("key"), F.col(f"`{splits.field}`").alias("stratum"), shuffled.alias("at")), ["stratum"], ["at", "key"]).select("key", by_rank(splits.shares).alias("split"))
    else:
        of = F.col(f"`{key if splits.strategy == 'random' else splits.field}`")
        rows = traces.select(F.col(f"`{key}`").alias("key"), split_by_hash(of.cast("string"), splits.shares, splits.seed).alias("split"))
    if splits.guard is not None:
        rows = staged(rows, "splits")
        group = near_groups(traces, key, splits.guard, splits.similarity).withColumnRenamed(key, "key")
        first = rows.select(F.col("key").alias("group"), "split")
        rows = staged(group.join(first, "group").select("key", "split"), "guarded")
        discard(group)
    return rows.withColumnRenamed("key", key)


def leaks(groups: DataFrame, assigned: DataFrame, key: str = "trace_id") -> DataFrame:
    """(group, splits): groups of near copies that stand in more than one split; empty under a guard."""
    return groups.join(assigned, key).groupBy("group").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)
