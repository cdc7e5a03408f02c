"""exact_match and json_match."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import MatchOptions, json_match, version_of
from ..functions.paths import resolve, split_path
from ..functions.text import normalize
from ..session import ship
from .base import Narrow, helper, outcome


@dataclass(frozen=True)
class ExactMatch(Narrow):
    id: str
    actual: str
    expected: str | None = None
    lower: bool = False
    strip: bool = True
    collapse_whitespace: bool = False

    def version_hash(self) -> str:
        return version_of(["exact_match", self.id, self.actual, self.expected, self.lower, self.strip, self.collapse_whitespace])

    def columns(self, traces: DataFrame, tag: str) -> tuple[DataFrame, dict[str, Column]]:
        norm = lambda c: normalize(c, self.lower, self.strip, self.collapse_whitespace)
        got = resolve(self.actual)
        left = norm(got.text)
        if self.expected is None:
            return traces, outcome(F.lit(None).cast("boolean"), F.when(got.missing, f"no value at {self.actual}").otherwise("no expected path"))
        want = resolve(self.expected)
        right = norm(want.text)
        why = F.when(got.missing, f"no value at {self.actual}").when(want.missing, f"no value at {self.expected}")
        verdict = F.when(why.isNull(), left == right)
        cols = outcome(verdict, why)
        cols["explanation"] = F.coalesce(cols["explanation"], F.when(~verdict, F.concat(F.lit("expected '"), right, F.lit("', got '"), left, F.lit("'"))))
        quoted = lambda c: F.to_json(c.cast("variant"))
        cols["normalized_prediction"] = F.when(got.present, quoted(left))
        cols["ground_truth"] = F.when(got.present & want.present, quoted(right))
        return traces, cols


@dataclass(frozen=True)
class JsonMatch(Narrow):
    id: str
    actual: str
    expected: str | None = None
    options: MatchOptions = MatchOptions()

    def __post_init__(self):
        for p in self.options.ignore_paths:
            split_path(p)

    def version_hash(self) -> str:
        return version_of(["json_match", self.id, self.actual, self.expected, self.options.payload()])

    def columns(self, traces: DataFrame, tag: str) -> tuple[DataFrame, dict[str, Column]]:
        got = resolve(self.actual)
        if self.expected is None:
            return traces, outcome(F.lit(None).cast("boolean"), F.when(got.missing, f"no value at {self.actual}").otherwise("no expected path"))
        want = resolve(self.expected)
        why = F.when(got.missing, f"no value at {self.actual}").when(want.missing, f"no value at {self.expected}")
        ship(traces.sparkSession)
        applies = got.present & want.present
        at = helper(tag, "match")
        rows = traces.withColumn(at, json_match(F.when(applies, F.coalesce(got.json, F.lit("null"))), F.when(applies, F.coalesce(want.json, F.lit("null"))), self.options))
        m = F.col(at)
        cols = outcome(m["passed"], why)
        cols["explanation"] = F.coalesce(cols["explanation"], m["reason"])
        cols["error"] = m["error"]
        cols["normalized_prediction"] = F.coalesce(m["prediction"], F.when(got.present, got.json))
        cols["ground_truth"] = m["truth"]
        return rows, cols
