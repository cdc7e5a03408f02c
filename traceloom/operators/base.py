"""What every check gives: one row of the result schema per trace."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RESULT


class Check(Protocol):
    id: str

    def version_hash(self) -> str: ...

    def apply(self, traces: DataFrame) -> DataFrame: ...


class Narrow:
    """A check that is a projection of a trace: a suite runs all of these in one pass.

    ``columns`` gives (rows with what helper columns it needs, named with ``tag``,
    the result's columns).
    """

    def columns(self, traces: DataFrame, tag: str) -> tuple[DataFrame, dict[str, Column]]:
        raise NotImplementedError

    def apply(self, traces: DataFrame) -> DataFrame:
        rows, columns = self.columns(traces, "")
        return results(rows, self, **columns)


def helper(tag: str, name: str) -> str:
    """A helper column's name; no trace has it."""
    return f"__{tag}_{name}"


def outcome(passed: Column, reason_na: Column | None = None) -> dict[str, Column]:
    """score, passed and the explanation of what isn't applicable."""
    out = {"passed": passed, "score": F.when(passed, 1.0).when(~passed, 0.0)}
    if reason_na is not None:
        out["explanation"] = F.when(reason_na.isNotNull(), F.concat(F.lit("not applicable: "), reason_na))
    return out


def row(check: Check, **columns: Column) -> list[Column]:
    """The columns of one result row, in the result schema."""
    known = {"trace_id": F.col("trace_id"), "evaluator_id": F.lit(check.id), "evaluator_version": F.lit(check.version_hash()), "cache_hit": F.lit(False), "invalid_output": F.lit(False)} | columns
    return [known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in RESULT.items()]


def results(traces: DataFrame, check: Check, **columns: Column) -> DataFrame:
    """One row per trace, in the result schema; a narrow projection."""
    return traces.select(*row(check, **columns))
