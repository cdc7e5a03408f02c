"""Checks over a stream of traces.

The checks are projections of a row, so the same plans run on a stream; a trace
that arrives again is dropped by its id.  Traces carry when their file arrived;
ids are remembered for a span after that and then forgotten, so state has a
bound: the traces of one span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import Check
from ..plans.suite import run_suite
from ..schema import TRACE
from ..session import shared_path


def read_traces(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of trace files (Parquet in the trace schema), with ``arrived``, the time their file was written; oldest files first."""
    reader = spark.readStream.schema(TRACE)
    rows = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)
    return rows.withColumn("arrived", F.col("_metadata.file_modification_time"))


def once(traces: DataFrame, within: str | None) -> DataFrame:
    """Each trace once.

    With ``arrived`` and a span (say ``7 days``) an id is remembered that long;
    traces that arrive again later count again.  Files come in order of arrival,
    so no trace is ever late.  Without either, ids are remembered for ever.
    """
    if within is None or "arrived" not in traces.columns:
        return traces.dropDuplicates(["trace_id"])
    return traces.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["trace_id"])


def start(traces: DataFrame, checks: Sequence[Check], out: str, checkpoint: str, available_now: bool = False, within: str | None = "7 days"):
    """Append the results of each new trace below ``out``.

    Each batch is written to a folder of its own number, over what a failed try
    of the same batch left, so that every batch counts once; ``within`` as of ``once``.
    """

    def each(batch: DataFrame, number: int) -> None:
        run_suite(batch.drop("arrived"), checks).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = once(traces, within).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()


def replayed(traces: DataFrame, checks: Sequence[Check], files: int = 4) -> DataFrame:
    """Write ``traces`` as files, stream them through the checks, and read the results."""
    spark = traces.sparkSession
    path, out = shared_path(spark, "stream-in"), shared_path(spark, "stream-out")
    traces.repartition(files).write.parquet(path)
    query = start(read_traces(spark, path, 2), checks, out, shared_path(spark, "stream-state"), available_now=True)
    query.awaitTermination()
    return spark.read.parquet(out)
