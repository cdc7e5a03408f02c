"""Further checks: regular expressions, numeric tolerance, sets, JSON Schema, functions.

All but the last are projections of built-in functions.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import version_of
from ..functions.paths import resolve, split_path
from ..session import ship
from .base import Narrow, helper, outcome
from .json_schema import problems


def _both(actual: str, expected: str) -> tuple:
    got, want = resolve(actual), resolve(expected)
    return got, want, F.when(got.missing, f"no value at {actual}").when(want.missing, f"no value at {expected}")


@dataclass(frozen=True)
class Regex(Narrow):
    id: str
    actual: str
    pattern: str

    def version_hash(self) -> str:
        return version_of(["regex", self.id, self.actual, self.pattern])

    def columns(self, traces: DataFrame, tag: str) -> tuple[DataFrame, dict[str, Column]]:
        got = resolve(self.actual)
        why = F.when(got.missing, f"no value at {self.actual}")
        return traces, outcome(F.when(why.isNull(), F.coalesce(got.text, F.lit("")).rlike(self.pattern)), why) | {"normalized_prediction": got.json}


@dataclass(frozen=True)
class NumericTolerance(Narrow):
    """Within an absolute or a relative tolerance; a value that is no number fails."""

    id: str
    actual: str
    expected: str
    absolute: float = 0.0
    relative: float = 0.0

    def version_hash(self) -> str:
        return version_of(["numeric_tolerance", self.id, self.actual, self.expected, self.absolute, self.relative])

    def columns(self, traces: DataFrame, tag: str) -> tuple[DataFrame, dict[str, Column]]:
        got, want, why = _both(self.actual, self.expected)
        a, b = got.text.try_cast("double"), want.text.try_cast("double")
        near = F.coalesce(F.abs(a - b) <= F.greatest(F.lit(self.absolute), F.lit(self.relative) * F.abs(b)), F.lit(False))
        return traces, outcome(F.when(why.isNull(), near), why) | {"normalized_prediction": got.json, "ground_truth": want.json}


def _set(json: Column) -> Column:
    return F.array_distinct(F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>")))


@dataclass(frozen=True)
class SetComparison(Narrow):
    """Precision, recall and F1 of two lists as sets; the score is F1, it passes from ``least`` up."""

    id: str
    actual: str
    expected: str
    least: float = 1.0

    def version_hash(self) -> str:
        return version_of(["set_comparison", self.id, self.actual, self.expected, self.least])

    def columns(self, traces: DataFrame, tag: str) -> tuple[DataFrame, dict[str, Column]]:
        got, want, why = _both(self.actual, self.expected)
        a, b = _set(got.json), _set(want.json)
        both = F.size(F.array_intersect(a, b)).cast("double")
        precision = F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(both / F.size(a))
        recall = F.when(F.size(b) == 0, (F.size(a) == 0).cast("double")).otherwise(both / F.size(b))
        f1 = F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(2 * both / (F.size(a) + F.size(b)))
        cols = outcome(F.when(why.isNull(), f1 >= self.least), why)
        cols["score"] = F.when(why.isNull(), f1)
        raw = F.when(why.isNull(), F.to_json(F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))))
        return traces, cols | {"raw_output": raw, "normalized_prediction": F.to_json(F.array_sort(a)), "ground_truth": F.to_json(F.array_sort(b))}


@dataclass(frozen=True)
class JsonSchema(Narrow):
    """A value against a JSON Schema (see json_schema); without one, its kind and required keys."""

    id: str
    actual: str
    kind: str = "object"
    required: tuple[str, ...] = ()
    schema: dict | None = field(default=None, hash=False)

    def __post_init__(self):
        problems(self.whole(), F.lit(None).cast("variant"))  # a schema that can't be compiled is refused here

    def whole(self) -> dict:
        return self.schema if self.schema is not None else {"type": self.kind, "required": list(self.required)}

    def version_hash(self) -> str:
        return version_of(["json_schema", self.id, self.actual, self.whole()])

    def columns(self, traces: DataFrame, tag: str) -> tuple[DataFrame, dict[str, Column]]:
        got = resolve(self.actual)
        why = F.when(got.missing, f"no value at {self.actual}")
        v, found = helper(tag, "value"), helper(tag, "problems")
        rows = traces.withColumn(v, F.try_parse_json(F.coalesce(got.json, F.lit("null")))).withColumn(found, F.when(why.isNull(), problems(self.whole(), F.col(v))))
        cols = outcome(F.when(why.isNull(), F.size(found) == 0), why)
        cols["explanation"] = F.coalesce(cols["explanation"], F.nullif(F.array_join(found, "; "), F.lit("")))
        return rows, cols | {"raw_output": F.when(F.size(found) > 0, F.to_json(F.struct(F.col(found).alias("problems")))), "normalized_prediction": got.json}


@dataclass(frozen=True)
class PythonCheck(Narrow):
    """A function of values of the trace, called in Arrow batches.

    ``inputs`` names the function's arguments and their paths; a missing value is
    None.  It returns a boolean, a number (the score, which passes from ``least``
    up), None (not applicable), or one of these with an explanation.  What it
    raises becomes that row's error and costs no other row anything.
    """

    id: str
    function: Callable
    inputs: dict[str, str] = field(hash=False)
    version: str = "1"
    least: float = 1.0

    def __post_init__(self):
        for p in self.inputs.values():
            split_path(p)

    def version_hash(self) -> str:
        return version_of(["python", self.id, self.version, self.inputs, self.least])

    def columns(self, traces: DataFrame, tag: str) -> tuple[DataFrame, dict[str, Column]]:
        function, least, names = self.function, self.least, list(self.inputs)

        def one(values: dict) -> tuple:
            try:
                got = function(**{n: None if values[n] is None else json.loads(values[n]) for n in names})
                said = None
                if isinstance(got, tuple):
                    got, said = got
                if got is None:
                    return None, None, said, None
                score = float(got)
                return bool(got) if isinstance(got, bool) else score >= least, score, said, None
            except Exception as e:
                return None, None, None, f"{type(e).__name__}: {e}"

        @F.pandas_udf("passed boolean, score double, said string, error string")
        def called(rows: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame([one(r) for r in rows.to_dict("records")], columns=["passed", "score", "said", "error"])
            return out.astype({"passed": "boolean", "score": "Float64"})

        ship(traces.sparkSession)
        at = helper(tag, "called")
        rows = traces.withColumn(at, called(F.struct(*[(lambda f: F.when(f.present, f.json))(resolve(p)).alias(n) for n, p in self.inputs.items()])))
        m = F.col(at)
        why = F.when(m["passed"].isNull() & m["error"].isNull(), F.concat(F.lit("not applicable: "), F.coalesce(m["said"], F.lit("the function gave nothing"))))
        return rows, {"passed": m["passed"], "score": m["score"], "explanation": F.coalesce(why, m["said"]), "error": m["error"]}
