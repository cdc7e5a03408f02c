"""The facade: traces, checks and a judge; then results, report and dataset."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import load_registry
from .functions.canon import canonical
from .operators.base import Check
from .operators.judge import JudgeConfig, Provider, mock
from .operators.judged import LlmQuestion, Rubric, RubricQuestion, TextMatchesTools, ToolSelection
from .operators.tool_calls import ToolCallOutcome, ToolRegistryCheck
from .plans import feedback, report, suite
from .registry import Registry
from .session import staged
from .sources.jsonl import mapped, read_jsonl, to_traces


def load_traces(spark: SparkSession, source: str | DataFrame | Iterable[dict], mapping: dict[str, str] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(traces, errors) of a JSONL path, dicts, or a DataFrame in the trace schema."""
    if isinstance(source, DataFrame):
        return (source if limit is None else source.limit(limit)), spark.createDataFrame([], "source_id string, message string")
    if isinstance(source, str):
        rows, bad = read_jsonl(spark, source, limit)
    else:
        items = [(f"item:{i}", canonical(x)) for i, x in enumerate(source)]
        rows = spark.createDataFrame(items[:limit], "source_id string, data string")
        bad = spark.createDataFrame([], "source_id string, message string")
    traces, wrong = to_traces(mapped(rows, mapping))
    return traces, bad.unionByName(wrong)


@dataclass(frozen=True)
class Report:
    """A run's results, written once, and what they add up to."""

    results: DataFrame
    checks: Sequence[Check]

    def summary(self) -> DataFrame:
        return suite.summarize(self.results, self.checks)

    def failures(self, evaluator_id: str | None = None) -> DataFrame:
        return suite.failures(self.results, evaluator_id)

    def totals(self) -> DataFrame:
        return suite.run_totals(self.results)

    def kinds(self) -> dict[str, str]:
        of = {ToolSelection: "selection", ToolRegistryCheck: "registry", ToolCallOutcome: "outcome", TextMatchesTools: "consistency"}
        return {of[type(c)]: c.id for c in self.checks if type(c) in of}

    def markdown(self) -> str:
        return report.markdown(self.results, self.kinds())


@dataclass(frozen=True)
class Wanted:
    """A check that is yet to get the registry, the judge and the provider of the run it is for."""

    kind: type
    options: dict
    judge: str = "default"

    def made(self, registry: Registry | None, judges: dict[str, JudgeConfig], provider: Provider) -> Check:
        takes, options = {f.name for f in fields(self.kind)}, dict(self.options)
        if "registry" in takes and "registry" not in options:
            if registry is None and self.kind is not TextMatchesTools:
                raise ValueError(f"{options['id']} needs a tool registry: give tools")
            options["registry"] = registry
        if "judge" in takes:
            if self.judge not in judges:
                raise ValueError(f"{options['id']}: {self.judge!r} is no judge; there are {', '.join(judges) or 'none'}")
            options |= {"judge": judges[self.judge], "provider": provider}
        return self.kind(**options)


def registry_check(id: str = "tool_registry_check", **options) -> Wanted:
    """Is the call allowed?  No judge."""
    return Wanted(ToolRegistryCheck, {"id": id, **options})


def tool_call_outcome(id: str = "tool_call_outcome", **options) -> Wanted:
    """Did the call succeed, by what was recorded?  No judge."""
    return Wanted(ToolCallOutcome, {"id": id, **options})


def tool_selection(policy: str | None = None, *, id: str = "tool_selection", judge: str = "default", **options) -> Wanted:
    """Which tool should have been called?  The judge never sees the call."""
    return Wanted(ToolSelection, {"id": id, "policy": policy, **options}, judge)


def text_matches_tools(*, id: str = "text_matches_tools", judge: str = "default", **options) -> Wanted:
    """Does the reply say what the calls did?"""
    return Wanted(TextMatchesTools, {"id": id, **options}, judge)


def llm_question(question: str, *, id: str, inputs: dict[str, str], judge: str = "default", **options) -> Wanted:
    """Any other question."""
    return Wanted(LlmQuestion, {"id": id, "template": question, "inputs": inputs, **options}, judge)


def rubric(questions: Sequence[RubricQuestion], *, id: str, inputs: dict[str, str], judge: str = "default", **options) -> Wanted:
    """Several questions in one call."""
    return Wanted(Rubric, {"id": id, "questions": tuple(questions), "inputs": inputs, **options}, judge)


def judges_of(judge: str | JudgeConfig | dict[str, JudgeConfig] | None) -> dict[str, JudgeConfig]:
    """Judges by name, of ``provider:model``, a configuration, or several by name."""
    if judge is None:
        return {}
    if isinstance(judge, dict):
        return dict(judge)
    if isinstance(judge, str):
        provider, colon, model = judge.partition(":")
        if not colon or not model:
            raise ValueError(f"judge {judge!r} is not of the form provider:model")
        judge = JudgeConfig(provider, model)
    return {"default": judge}


def registry_of(tools: Registry | dict | str | Path | None) -> Registry | None:
    """A registry, or one of a dict or of a file's path."""
    if isinstance(tools, (str, Path)):
        return load_registry(str(tools))
    return Registry.of(tools) if isinstance(tools, dict) else tools


class Loom:
    """Evaluate traces, report, and compile failures into preference pairs."""

    def __init__(self, spark: SparkSession, traces, tools: Registry | dict | str | Path | None = None, checks: Sequence[Check | Wanted] | None = None, judge: str | JudgeConfig | dict[str, JudgeConfig] | None = None, mapping: dict[str, str] | None = None, provider: Provider = mock, policy: str | None = None):
        self.spark = spark
        self.registry = registry_of(tools)
        judges = judges_of(judge)
        self.traces, self.errors = load_traces(spark, traces, mapping)
        self.checks = [c.made(self.registry, judges, provider) if isinstance(c, Wanted) else c for c in checks] if checks is not None else default_checks(self.registry, next(iter(judges.values()), None), provider, policy)
        if not self.checks:
            raise ValueError("there is no check to run: give tools, a judge, or checks")

    def judge(self, limit: int | None = None) -> Report:
        traces = self.traces if limit is None else self.traces.limit(limit)
        if len(self.checks) > 1:  # parse the source once for all checks
            traces = staged(traces, "traces")
        return Report(staged(suite.run_suite(traces, self.checks), "results"), self.checks)

    def dataset(self, done: Report, sealed: DataFrame | None = None) -> feedback.Dataset:
        ids = [c.id for c in self.checks if isinstance(c, ToolSelection) and not c.holdout]
        return feedback.build_dpo(done.results.where(F.col("evaluator_id").isin(ids)), self.traces, self.registry, sealed)

    def finetune(self, *_args, **_kwargs):
        raise NotImplementedError("training is outside this library: write the dataset and train with a tool made for it")


def default_checks(registry: Registry | None, judge: JudgeConfig | None, provider: Provider = mock, policy: str | None = None) -> list[Check]:
    out: list[Check] = [ToolCallOutcome("tool_call_outcome")]
    if registry is not None:
        out.append(ToolRegistryCheck("tool_registry_check", registry))
    if judge is not None:
        if registry is not None:
            out.append(ToolSelection("tool_selection", registry, judge, policy=policy, provider=provider))
        out.append(TextMatchesTools("text_matches_tools", judge, registry, provider=provider))
    return out
