"""Helpers shared by the operators; shipping the package and cutting lineage are the session's."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _remove, discard, renamed, shared_path, ship, staged  # noqa: F401


def tidy(made: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``made``, with freed memory given back when a task's rows end.

    Workers live on between tasks; else each keeps the most that any task needed.
    """

    @wraps(made)
    def run(batches):
        yield from made(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only where the C library has it
            trim(0)

    return run


def has(df: DataFrame, *names: str) -> None:
    """Fail early and clearly if ``df`` lacks a column."""
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}; there are {', '.join(df.columns)}")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def text_of(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def over_cells(rows: DataFrame, cells: int | Column, name: str, step: int = 4096) -> DataFrame:
    """Each row once for each cell, 0 to ``cells`` - 1, as long; numbers are made in two steps, so that no long array is."""
    last = (F.lit(cells) if isinstance(cells, int) else cells).cast("long") - 1
    zero, by = F.lit(0).cast("long"), F.lit(step).cast("long")
    rows = rows.withColumn("__last", last).withColumn("__from", F.explode(F.sequence(zero, F.col("__last"), by)))
    each = F.sequence(F.col("__from"), F.least(F.col("__from") + (step - 1), F.col("__last")))
    return rows.withColumn(name, F.explode(each)).drop("__from", "__last")
