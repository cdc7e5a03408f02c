"""Configuration files: strict keys, all problems at once, hints for near misses, line numbers."""

from __future__ import annotations

import difflib
import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from .functions.canon import MatchOptions
from .functions.paths import split_path
from .operators.extensions import JsonSchema, NumericTolerance, Regex, SetComparison
from .operators.judge import JudgeConfig
from .operators.judged import LlmQuestion, Rubric, RubricQuestion, TextMatchesTools, ToolSelection
from .operators.matching import ExactMatch, JsonMatch
from .operators.tool_calls import ToolCallOutcome, ToolRegistryCheck
from .plans.governance import PATTERNS
from .plans.splits import Splits
from .registry import Registry

CHECKS = {
    "exact_match": ExactMatch, "json_match": JsonMatch, "tool_registry_check": ToolRegistryCheck, "tool_call_outcome": ToolCallOutcome, "llm_question": LlmQuestion,
    "tool_selection": ToolSelection, "text_matches_tools": TextMatchesTools, "regex": Regex, "numeric_tolerance": NumericTolerance, "set_comparison": SetComparison, "json_schema": JsonSchema, "rubric": Rubric,
}
#: Keys of a suite file that are named otherwise here.
KEYS = {"question": "template", "system_prompt": "system"}
MATCHER_OPTIONS = {"map": "labels", "tolerance": "tolerance", "choices": "choices", "answer_key": "answer_key"}
NOT_CONFIGURED = {"provider", "cache", "registry", "judge"}
#: Keys of a project's splits, and what they are called here; field and guard are paths into traces.
SPLIT_KEYS = {"strategy": "strategy", "field": "field", "ratios": "shares", "seed": "seed", "guard": "guard", "similarity": "similarity"}
SOURCES = {"jsonl": ("path",), "parquet": ("path",), "csv": ("path",), "jdbc": ("url", "query")}


class ConfigError(ValueError):
    """Everything that is wrong with a file."""

    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Project:
    name: str
    source: dict
    mapping: dict[str, str]
    splits: Splits | None = None
    #: redaction rules for the texts of traces, applied when they are read
    redaction: tuple[str, ...] = ()
    #: name (say, base) to {provider, model}
    models: dict = field(default_factory=dict)
    #: of base and judge, those whose providers must differ
    distinct: tuple[str, ...] = ()


def integrity_problems(project: Project, judges: dict[str, JudgeConfig]) -> list[str]:
    """What is wrong between a project's file and the judges', which neither shows alone: a judge of the base model's family favours it."""
    base = project.models.get("base") or {}
    if not {"base", "judge"} <= set(project.distinct) or not base.get("provider"):
        return []
    return [f"integrity.require_distinct_providers: judge {name!r} has the base model's provider, {j.provider}" for name, j in sorted(judges.items()) if j.provider == base["provider"]]


def hint(word: str, known) -> str:
    near = difflib.get_close_matches(word, list(known), 1)
    return f"; did you mean {near[0]!r}?" if near else ""


def load(path: str) -> tuple[dict, dict[str, int]]:
    """(data, line of each dotted key) of a YAML or JSON file."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text), {}
    import yaml

    lines: dict[str, int] = {}

    def walk(node, at: str) -> None:
        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                name = f"{at}.{k.value}" if at else str(k.value)
                lines[name] = k.start_mark.line + 1
                walk(v, name)
        elif isinstance(node, yaml.SequenceNode):
            for i, v in enumerate(node.value):
                walk(v, f"{at}[{i}]")

    walk(yaml.compose(text, yaml.SafeLoader), "")
    return yaml.safe_load(text) or {}, lines


def _unknown(data: dict, known, at: str, lines: dict[str, int]) -> list[str]:
    out = []
    for k in data:
        if k not in known:
            name = f"{at}.{k}" if at else k
            out.append(f"{f'line {lines[name]}: ' if name in lines else ''}{name}: unknown key{hint(k, known)}")
    return out


def load_project(path: str) -> Project:
    data, lines = load(path)
    problems = _unknown(data, ("name", "description", "source", "mapping", "models", "integrity", "splits", "redaction"), "", lines)
    if not data.get("name"):
        problems.append("name: is required")
    source = data.get("source") or {}
    if source.get("type") not in SOURCES:
        problems.append(f"source.type: {source.get('type')!r} is none of {', '.join(SOURCES)}{hint(str(source.get('type')), SOURCES)}")
    else:
        problems += [f"source.{k}: is required for {source['type']}" for k in SOURCES[source["type"]] if not source.get(k)]
        if source["type"] == "jdbc" and source.get("query") and source["query"].split(None, 1)[0].lower() not in ("select", "with"):
            problems.append("source.query: only SELECT or WITH")
    for target in data.get("mapping") or {}:
        try:
            split_path(target)
        except ValueError as e:
            problems.append(f"mapping: {e}")
    given, splits = data.get("splits"), None
    if given is not None:
        problems += (bad := _unknown(given, SPLIT_KEYS, "splits", lines))
        try:
            splits = None if bad else Splits(**{SPLIT_KEYS[k]: v for k, v in given.items()})
            for f in (splits.field, splits.guard) if splits else ():
                if f is not None:
                    split_path(f)
        except (TypeError, ValueError) as e:
            problems.append(f"splits: {e}")
    rules = tuple(data.get("redaction") or ())
    problems += [f"redaction: {r!r} is no rule{hint(str(r), PATTERNS)}" for r in rules if r not in PATTERNS]
    integrity = data.get("integrity") or {}
    problems += _unknown(integrity, ("require_distinct_providers",), "integrity", lines)
    if problems:
        raise ConfigError(problems)
    return Project(data["name"], source, data.get("mapping") or {}, splits, rules, data.get("models") or {}, tuple(integrity.get("require_distinct_providers") or ()))


def load_registry(path: str) -> Registry:
    data, _ = load(path)
    try:
        return Registry.of(data)
    except (TypeError, ValueError) as e:
        raise ConfigError([str(e)]) from e


def build_suite(data: dict, registry: Registry | None = None, judges: dict[str, JudgeConfig] | None = None, lines: dict[str, int] | None = None, **extra) -> list:
    """The checks of a suite; ``extra`` (provider, cache) goes to those that ask a judge.

    ``holdout`` keeps a judged check's rows out of datasets; other checks never
    enter them.  ``weight`` is checked and has no effect.
    """
    problems, checks, lines = [], [], lines or {}
    problems += _unknown(data, ("name", "suite", "description", "evaluators"), "", lines)
    for i, spec in enumerate(data.get("evaluators") or []):
        at, spec = f"evaluators[{i}]", dict(spec)
        kind = CHECKS.get(name := spec.pop("type", None))
        if kind is None:
            problems.append(f"{at}.type: {name!r} is no check{hint(str(name), CHECKS)}")
            continue
        takes = {f.name for f in fields(kind)}
        given = spec.pop("judge", "default")
        weight = spec.pop("weight", 1.0)
        if isinstance(weight, bool) or not isinstance(weight, (int, float)) or weight < 0:
            problems.append(f"{at}.weight: must be a number from 0")
        if "holdout" in spec and not isinstance(spec["holdout"], bool):
            problems.append(f"{at}.holdout: must be true or false")
        if "holdout" not in takes:
            spec.pop("holdout", None)
        spec = {n if (n := KEYS.get(k)) in takes else k: v for k, v in spec.items()}
        # options of checks that take them by name
        for group, names in (("options", {n: n for n in takes - NOT_CONFIGURED - {"id", "actual", "expected", "options"}}), ("matcher_options", MATCHER_OPTIONS)):
            if group in spec and group not in takes and (group == "options" or kind is LlmQuestion):
                options = spec.pop(group) or {}
                problems += _unknown(options, names, f"{at}.{group}", lines)
                spec |= {names[k]: v for k, v in options.items() if k in names}
        if bad := _unknown(spec, takes - NOT_CONFIGURED, at, lines):
            problems += bad
            continue
        if kind is ToolSelection and isinstance(spec.get("inputs"), dict):
            spec["inputs"] = list(spec["inputs"].values())
        args = {k: tuple(v) if isinstance(v, list) else v for k, v in spec.items()}
        if "options" in args:
            args["options"] = MatchOptions(**{k: tuple(v) if isinstance(v, list) else v for k, v in args["options"].items()})
        if "registry" in takes and (registry is not None or kind is not TextMatchesTools):
            if registry is None:
                problems.append(f"{at}: needs a tool registry")
                continue
            args["registry"] = registry
        if "judge" in takes:
            if given not in (judges or {}):
                problems.append(f"{at}.judge: {given!r} is no configured judge{hint(str(given), judges or {})}")
                continue
            args |= {"judge": judges[given]} | {k: v for k, v in extra.items() if k in takes}
        try:
            if kind is Rubric:
                args["questions"] = tuple(RubricQuestion(**{k: tuple(v) if isinstance(v, list) else v for k, v in q.items()}) for q in args.get("questions", ()))
            checks.append(kind(**args))
        except (TypeError, ValueError) as e:
            problems.append(f"{at}: {e}")
    ids = [c.id for c in checks]
    problems += [f"evaluators: the id {x!r} is used twice" for x in sorted({x for x in ids if ids.count(x) > 1})]
    if not checks and not problems:
        problems.append("evaluators: a suite needs a check")
    if problems:
        raise ConfigError(problems)
    return checks
