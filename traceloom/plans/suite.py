"""Running a suite of checks, and what it adds up to."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import version_of
from ..operators.base import Check, Narrow, results, row


def suite_hash(name: str, checks: Sequence[Check]) -> str:
    return version_of([name, [[c.id, c.version_hash()] for c in checks]])


def ids_of(check: Check) -> list[str]:
    """The evaluator ids of a check's rows: its own, or those of its questions."""
    return check.ids() if hasattr(check, "ids") else [check.id]


PLANNED = (AnalysisException, ArithmeticError, LookupError, TypeError, ValueError)


def failed_to_plan(e: Exception) -> Column:
    return F.lit(f"{type(e).__name__}: {(str(e).splitlines() or [''])[0]}")


def evaluated(check: Check, traces: DataFrame) -> DataFrame:
    """The check's rows; if it can't be planned over these traces, an errored row for each.

    A job that fails (lost storage, no memory) still fails the run: that says
    nothing about the traces.
    """
    try:
        return check.apply(traces)
    except PLANNED as e:
        return results(traces, check, error=failed_to_plan(e))


def narrow_rows(traces: DataFrame, checks: Sequence[Narrow]) -> DataFrame:
    """The rows of checks that are projections: one pass over the traces, one array of results a trace."""
    rows, found = traces, []
    for n, check in enumerate(checks):
        try:
            more, columns = check.columns(rows, str(n))
            one = F.struct(*row(check, **columns))
            more.select(one)  # analysed here, so that what can't be planned costs this check alone
            rows = more
        except PLANNED as e:
            one = F.struct(*row(check, error=failed_to_plan(e)))
        found.append(one)
    return rows.select(F.inline(F.array(*found)))


def run_suite(traces: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One result row per trace and check; a check that fails costs its own rows only.

    All checks that are projections share one pass; each of the others, which
    ask a judge, is a plan of its own.
    """
    ids = [x for c in checks for x in ids_of(c)]
    if len(set(ids)) < len(ids):
        raise ValueError("two checks share an id")
    if not checks:
        raise ValueError("a suite needs a check")
    narrow = [c for c in checks if isinstance(c, Narrow)]
    parts = [narrow_rows(traces, narrow)] if narrow else []
    return reduce(DataFrame.unionByName, parts + [evaluated(c, traces) for c in checks if not isinstance(c, Narrow)])


def outcomes(results: DataFrame) -> DataFrame:
    """``results`` with its outcome: errors first, then unusable answers, then verdicts."""
    return results.withColumn(
        "outcome",
        F.when(F.col("error").isNotNull(), "errored").when(F.col("invalid_output"), "invalid").when(F.col("passed"), "passed").when(~F.col("passed"), "failed").otherwise("not_applicable"),
    )


def summarize(results: DataFrame, checks: Sequence[Check] | None = None) -> DataFrame:
    """Counts per check; ``pass_rate`` is over decided rows only, null when there are none.

    Unusable answers count as errored too.  Checks without rows are listed.
    """
    n = lambda *o: F.count(F.when(F.col("outcome").isin(*o), 1))
    out = outcomes(results).groupBy("evaluator_id").agg(
        n("passed").alias("passed"), n("failed").alias("failed"), n("not_applicable").alias("not_applicable"),
        n("errored", "invalid").alias("errored"), n("invalid").alias("invalid_output"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
    )
    if checks is not None:
        names = results.sparkSession.createDataFrame([(x,) for c in checks for x in ids_of(c)], "evaluator_id string")
        out = F.broadcast(names).join(out, "evaluator_id", "left").fillna(0)
    return out.withColumn("pass_rate", F.try_divide(F.col("passed").cast("double"), F.col("passed") + F.col("failed")))


def failures(results: DataFrame, evaluator_id: str | None = None) -> DataFrame:
    bad = results.where("passed = false and error is null and not invalid_output")
    return bad if evaluator_id is None else bad.where(F.col("evaluator_id") == evaluator_id)


def run_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), F.count(F.when(F.col("cache_hit"), 1)).alias("cache_hits"),
    )
