"""The checks that ask a judge: llm_question, rubric, tool_selection, text_matches_tools."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import canonical, version_of
from ..functions.lookup import Lookup
from ..functions.paths import calls_at, may_hold_calls, member, resolve, split_path
from ..functions.text import as_bool, render
from ..registry import NONE, Registry
from .base import results, row
from .judge import JudgeConfig, Provider, ask, mock
from .tool_calls import tools_of

MATCHERS = ("boolean", "exact_label", "label_map", "numeric_tolerance", "set_overlap")


def prompt_of(system: str | None, user: Column) -> Column:
    head = F.lit(f'{{"system":{json.dumps(system)},"messages":[{{"role":"user","content":')
    return F.concat(head, F.to_json(user.cast("variant")), F.lit("}]}"))


def judged(traces: DataFrame, check, prompt: Column, schema: Column, schema_key: object) -> DataFrame:
    rows, fresh = ask(traces.withColumn("prompt", prompt), schema, F.lit(check.judge.version_hash(check.system, schema_key, {})), check.judge, check.provider, check.cache)
    object.__setattr__(check, "fresh", fresh)
    return rows


def field_json(name: str) -> Column:
    """A field of the parsed answer as JSON text; null if absent or null."""
    v = member(F.try_parse_json("parsed"), name)
    return F.when(~F.is_variant_null(v), F.to_json(v))


def field_text(name: str) -> Column:
    v = member(F.try_parse_json("parsed"), name)
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def replied() -> Column:
    """The parsed answer; of a reply that stayed unusable its text, as a JSON string."""
    return F.coalesce(F.col("parsed"), F.to_json(F.col("raw").cast("variant")))


def answered(rows: DataFrame, check, why: Column, usable: Column, **columns: Column) -> DataFrame:
    """Result rows: not applicable, errored, unusable and decided kept apart."""
    asked = why.isNull()
    invalid = asked & F.col("error").isNull() & ~F.coalesce(usable, F.lit(False))
    decided = asked & F.col("error").isNull() & ~invalid
    passed = F.when(decided, columns.pop("passed"))
    says = F.when(why.isNotNull(), F.concat(F.lit("not applicable: "), why)).when(decided, columns.pop("explanation"))
    only = {n: F.when(decided, c) for n, c in columns.items()}
    bill = {n: F.when(asked, F.col(n)) for n in ("cache_hit", "latency_ms", "cost_usd", "tokens_in", "tokens_out", "judge_config_hash")}
    bill["cache_hit"] = F.coalesce(bill["cache_hit"], F.lit(False))
    return results(rows, check, passed=passed, score=F.when(passed, 1.0).when(~passed, 0.0), explanation=says, invalid_output=invalid, error=F.when(asked, F.col("error")), raw_output=F.when(asked, replied()), **bill, **only)


@dataclass(frozen=True)
class LlmQuestion:
    id: str
    template: str
    inputs: dict[str, str]
    judge: JudgeConfig
    matcher: str = "boolean"
    labels: dict[str, str] = field(default_factory=dict)
    choices: tuple[str, ...] = ()
    ground_truth: str | None = None
    tolerance: float = 0.0
    system: str | None = None
    #: where the answer stands in the reply
    answer_key: str = "answer"
    #: instead of the matcher's own schema
    response_schema: dict | None = None
    holdout: bool = False
    provider: Provider = mock
    cache: DataFrame | None = field(default=None, compare=False)

    def __post_init__(self):
        if self.matcher not in MATCHERS:
            raise ValueError(f"matcher {self.matcher!r} is none of {', '.join(MATCHERS)}")
        for p in self.inputs.values():
            split_path(p)
        if self.response_schema is not None and self.answer_key not in self.response_schema.get("properties", {}):
            raise ValueError(f"response_schema has no property {self.answer_key!r}")

    def version_hash(self) -> str:
        return version_of(["llm_question", self.id, self.template, self.inputs, self.matcher, self.labels, list(self.choices), self.ground_truth, self.tolerance, self.system, self.judge.identity(), *([self.answer_key, self.response_schema] if self.response_schema or self.answer_key != "answer" else [])])

    def schema(self) -> dict:
        if self.response_schema is not None:
            return self.response_schema
        answer = {"boolean": {"type": "boolean"}, "numeric_tolerance": {"type": "number"}, "set_overlap": {"type": "array", "items": {"enum": list(self.choices)} if self.choices else {}}}.get(self.matcher, {"type": "string", "enum": list(self.choices)} if self.choices else {"type": "string"})
        return {"type": "object", "properties": {self.answer_key: answer, "reason": {"type": "string"}}, "required": [self.answer_key]}

    def prediction(self) -> Column:
        """The answer as JSON text, by the matcher; null if unusable."""
        text, raw = field_text(self.answer_key), field_json(self.answer_key)
        quoted = lambda c: F.to_json(c.cast("variant"))
        if self.matcher == "boolean":
            return F.when(as_bool(raw), "true").when(~as_bool(raw), "false")
        if self.matcher == "numeric_tolerance":
            return F.regexp_replace(raw, '^"|"$', "").try_cast("double").cast("string")
        if self.matcher == "set_overlap":
            return F.to_json(F.array_sort(F.from_json(raw, "array<string>")))
        plain = F.coalesce(text, F.regexp_replace(raw, '^"|"$', ""))
        if self.matcher == "label_map":
            mapped = plain
            for k, v in self.labels.items():
                mapped = F.when(plain == k, v).otherwise(mapped)
            plain = mapped
        return quoted(plain)

    def truth(self) -> Column | None:
        if self.ground_truth is None:
            return None
        t = resolve(self.ground_truth)
        if self.matcher == "numeric_tolerance":
            return F.when(t.present, F.coalesce(t.text.try_cast("double").cast("string"), t.json))
        if self.matcher == "set_overlap":
            return F.when(t.present, F.coalesce(F.to_json(F.array_sort(F.from_json(t.json, "array<string>"))), t.json))
        return F.when(t.present, t.json)

    def apply(self, traces: DataFrame) -> DataFrame:
        values = {n: (lambda f: F.coalesce(f.text, f.json))(resolve(p)) for n, p in self.inputs.items()}
        schema = self.schema()
        rows = judged(traces, self, prompt_of(self.system, render(self.template, values)), F.lit(canonical(schema)), [self.template, schema])
        predicted, truth = self.prediction(), self.truth()
        usable = predicted.isNotNull()
        reason = F.coalesce(field_text("reason"), F.lit(""))
        if truth is None:
            truth = F.lit(None).cast("string")
        same = predicted == truth
        if self.matcher == "numeric_tolerance":
            same = F.abs(predicted.cast("double") - truth.try_cast("double")) <= self.tolerance
        says = F.when(truth.isNull(), F.concat(reason, F.lit(" [measured but not calibrated: no ground truth]"))).otherwise(reason)
        return answered(rows, self, F.lit(None).cast("string"), usable, passed=F.coalesce(same, F.when(truth.isNotNull(), False)), explanation=says, normalized_prediction=predicted, ground_truth=truth)


@dataclass(frozen=True)
class RubricQuestion:
    """One question of a rubric.  It passes by its truth; without one a boolean passes if true, and a number from ``least`` up."""

    name: str
    text: str
    kind: str = "boolean"
    choices: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    ground_truth: str | None = None
    least: float | None = None

    KINDS = ("boolean", "integer", "number", "enum", "string")

    def __post_init__(self):
        if self.kind not in self.KINDS:
            raise ValueError(f"question {self.name!r}: kind {self.kind!r} is none of {', '.join(self.KINDS)}")
        if (self.kind == "enum") != bool(self.choices):
            raise ValueError(f"question {self.name!r}: choices belong to kind enum, and to no other")
        if not self.name or "." in self.name or not self.text.strip():
            raise ValueError("a question needs a text, and a name without dots")
        if self.ground_truth is not None:
            split_path(self.ground_truth)

    def numeric(self) -> bool:
        return self.kind in ("integer", "number")

    def schema(self) -> dict:
        if self.kind == "enum":
            return {"type": "string", "enum": list(self.choices)}
        bounds = {k: v for k, v in (("minimum", self.low), ("maximum", self.high)) if v is not None and self.numeric()}
        return {"type": self.kind, **bounds}

    def prediction(self) -> Column:
        """The answer as JSON text; null where it isn't of the question's kind or beyond its bounds."""
        text, raw = field_text(self.name), field_json(self.name)
        if self.kind == "boolean":
            return F.when(as_bool(raw), "true").when(~as_bool(raw), "false")
        if self.kind == "enum":
            return F.when(text.isin(list(self.choices)), F.to_json(text.cast("variant")))
        if self.kind == "string":
            return F.to_json(text.cast("variant"))
        n = F.regexp_replace(raw, '^"|"$', "").try_cast("double")
        fits = n.isNotNull() & ~F.isnan(n)
        for bound, holds in ((self.low, n >= (self.low or 0)), (self.high, n <= (self.high or 0))):
            fits = fits & holds if bound is not None else fits
        if self.kind == "integer":
            return F.when(fits & (n == F.floor(n)), F.floor(n).cast("string"))
        return F.when(fits, n.cast("string"))


@dataclass(frozen=True)
class Rubric:
    """Several questions in one call: a result row a question, named ``id.question``; the first carries the call's bill."""

    id: str
    questions: tuple[RubricQuestion, ...]
    inputs: dict[str, str]
    judge: JudgeConfig
    template: str | None = None
    system: str | None = "Answer every question about what follows."
    holdout: bool = False
    provider: Provider = mock
    cache: DataFrame | None = field(default=None, compare=False)

    def __post_init__(self):
        names = [q.name for q in self.questions]
        if not names or len(set(names)) < len(names):
            raise ValueError("a rubric needs questions of different names")
        for p in self.inputs.values():
            split_path(p)

    def ids(self) -> list[str]:
        return [f"{self.id}.{q.name}" for q in self.questions]

    def version_hash(self) -> str:
        asked = [[q.name, q.text, q.kind, list(q.choices), q.low, q.high, q.ground_truth, q.least] for q in self.questions]
        return version_of(["rubric", self.id, asked, self.inputs, self.template, self.system, self.judge.identity()])

    def schema(self) -> dict:
        return {"type": "object", "properties": {q.name: q.schema() for q in self.questions} | {"reason": {"type": "string"}}, "required": [q.name for q in self.questions]}

    def apply(self, traces: DataFrame) -> DataFrame:
        values = {n: (lambda f: F.coalesce(f.text, f.json))(resolve(p)) for n, p in self.inputs.items()}
        asked = "\n".join(f"{q.name}: {q.text}" for q in self.questions)
        shown = self.template if self.template is not None else "\n".join(f"{n}: {{{{ {n} }}}}" for n in self.inputs)
        user = F.concat(render(shown, values), F.lit(f"\n\nQuestions:\n{asked}"))
        rows = judged(traces, self, prompt_of(self.system, user), F.lit(canonical(self.schema())), [asked, self.schema()])
        # answers and truths are columns of their own, so that each is worked out once
        truths = {f"_t{n}": (lambda t: F.when(t.present, F.struct(t.json.alias("json"), t.text.alias("text"))))(resolve(q.ground_truth)) for n, q in enumerate(self.questions) if q.ground_truth is not None}
        rows = rows.withColumns({f"_a{n}": q.prediction() for n, q in enumerate(self.questions)} | truths | {"_reason": F.coalesce(field_text("reason"), F.lit(""))})
        failed = F.col("error").isNotNull()
        found = []
        for n, q in enumerate(self.questions):
            answer = F.col(f"_a{n}")
            invalid = ~failed & answer.isNull()
            truth = F.lit(None).cast("string")
            passed = answer == "true" if q.kind == "boolean" else answer.cast("double") >= q.least if q.numeric() and q.least is not None else F.lit(None).cast("boolean")
            if q.ground_truth is not None:
                t = F.col(f"_t{n}")
                truth = t["json"]
                same = answer.try_cast("double") == t["text"].try_cast("double") if q.numeric() else answer == truth
                passed = F.when(t.isNotNull(), F.coalesce(same, F.lit(False)))
            decided = F.when(~failed & ~invalid, passed)
            says = F.when(~failed & ~invalid, F.concat(F.col("_reason"), F.when(passed.isNull(), F.lit(" [measured but not calibrated: no ground truth]")).otherwise("")))
            # the call is billed once, whatever it answers
            bill = {c: F.col(c) if n == 0 else F.lit(z).cast(k) for c, k, z in (("latency_ms", "long", 0), ("cost_usd", "double", 0.0), ("tokens_in", "long", 0), ("tokens_out", "long", 0))}
            columns = {"evaluator_id": F.lit(f"{self.id}.{q.name}"), "passed": decided, "score": F.when(decided, 1.0).when(~decided, 0.0), "explanation": says, "invalid_output": invalid, "error": F.col("error"), "raw_output": replied(), "normalized_prediction": F.when(~failed, answer), "ground_truth": truth, "cache_hit": F.col("cache_hit"), "judge_config_hash": F.col("judge_config_hash")}
            found.append(F.struct(*row(self, **columns, **bill)))
        return rows.select(F.inline(F.array(*found)))


def called(calls: Column) -> Column:
    return F.filter(F.transform(F.coalesce(calls, F.array().cast(_CALLS)), lambda c: c["name"]), lambda n: n.isNotNull())


_CALLS = "array<struct<name:string,arguments:string,call_id:string,node:string,result:string,error:string>>"


def call_text(c: Column) -> Column:
    """``name(key=value, ...)`` with keys in order and values as JSON, numbers as they were stored."""
    parsed = F.try_variant_get(F.try_parse_json(c["arguments"]), "$", "map<string,variant>")
    stored = F.from_json(c["arguments"], "map<string,string>")
    entries = F.array_sort(F.map_keys(parsed))

    def one(k: Column) -> Column:
        v = F.try_element_at(parsed, k)
        plain = F.when(v.isNull() | F.is_variant_null(v), F.lit("null")).when(F.schema_of_variant(v) == "STRING", F.to_json(v)).otherwise(F.coalesce(F.try_element_at(stored, k), F.to_json(v)))
        return F.concat(k, F.lit("="), plain)

    return F.concat(F.coalesce(c["name"], F.lit("?")), F.lit("("), F.coalesce(F.array_join(F.transform(entries, one), ", "), F.lit("")), F.lit(")"))


@dataclass(frozen=True)
class ToolSelection:
    id: str
    registry: Registry
    judge: JudgeConfig
    #: what the user asked; with the catalogue and the policy the whole prompt
    request: str = "input.user_request"
    #: further paths that the judge is shown
    inputs: tuple[str, ...] = ()
    policy: str | None = None
    actual: str = "output.tool_calls"
    node_path: str | None = None
    samples: int = 1
    system: str | None = "Choose the tool that the agent should call next."
    holdout: bool = False
    provider: Provider = mock
    cache: DataFrame | None = field(default=None, compare=False)

    def __post_init__(self):
        if self.samples != 1:
            raise ValueError("only one sample is taken")
        may_hold_calls(self.actual)
        hidden = [["output", "text"], ["output", "tool_calls"], split_path(self.actual)]
        for p in self.shown():
            if any(split_path(p)[: len(h)] == h for h in hidden):
                raise ValueError(f"{p!r} would show the judge what the agent did")

    def shown(self) -> list[str]:
        return list(dict.fromkeys([self.request, *self.inputs]))

    def questions(self) -> list:
        return [self.registry.hash(), self.shown(), *([self.policy] if self.policy else [])]

    def version_hash(self) -> str:
        return version_of(["tool_selection", self.id, *self.questions(), self.node_path, self.system, self.judge.identity(), *([self.actual] if self.actual != "output.tool_calls" else [])])

    def schema(self, node: str | None) -> dict:
        names = self.registry.choices(node)
        return {"type": "object", "properties": {"best": {"type": "string", "enum": names}, "arguments": {"type": "object"}, "acceptable": {"type": "array", "items": {"enum": names}}, "reason": {"type": "string"}}, "required": ["best", "acceptable"]}

    def told(self, node: str | None) -> dict:
        """What depends on the node alone: the catalogue, the reply's schema and the choices."""
        place = f"Tools at node {node}" if node is not None else "Tools"
        return {"catalogue": f"{place}:\n{self.registry.catalogue(node)}", "schema": canonical(self.schema(node)), "choices": self.registry.choices(node)}

    def apply(self, traces: DataFrame) -> DataFrame:
        calls, unread = calls_at(self.actual)
        first = F.try_element_at(F.filter(calls, lambda c: c["node"].isNotNull()), F.lit(1))["node"]
        node = F.coalesce(resolve(self.node_path).text, first) if self.node_path else first
        nodes, anywhere = Lookup({n: self.told(n) for n in self.registry.nodes}, "catalogue:string,schema:string,choices:array<string>"), self.told(None)
        every = F.struct(F.lit(anywhere["catalogue"]).alias("catalogue"), F.lit(anywhere["schema"]).alias("schema"), F.from_json(F.lit(canonical(anywhere["choices"])), "array<string>").alias("choices"))
        of = nodes.find(F.col("_node"))
        told = F.when(F.col("_node").isNull(), every).when(of.isNotNull(), F.struct(*[of[f].alias(f) for f in ("catalogue", "schema", "choices")]))
        rows = traces.withColumn("_node", node).withColumn("_told", told)
        elsewhere = self.actual != "output.tool_calls"  # there, no calls recorded is an answer: none
        rows = rows.withColumn("_why", F.when(F.col("_told").isNull(), F.concat(F.lit("unknown node '"), F.col("_node"), F.lit("'"))).otherwise(F.when(unread.startswith("no value") | unread.startswith("no array"), unread) if elsewhere else F.lit(None).cast("string")))
        said = F.concat_ws("\n", *[F.concat(F.lit(f"{p}: "), F.coalesce(resolve(p).text, F.lit("None"))) for p in self.shown()])
        rules = f"\n\nPolicy:\n{self.policy}" if self.policy else ""
        user = F.concat(said, F.lit(f"{rules}\n\n"), F.col("_told.catalogue"))
        prompt = F.when(F.col("_why").isNull(), prompt_of(self.system, user))
        rows = judged(rows, self, prompt, F.coalesce(F.col("_told.schema"), F.lit("{}")), self.questions())
        best = field_text("best")
        acceptable = F.array_union(F.coalesce(F.from_json(field_json("acceptable"), "array<string>"), F.array().cast("array<string>")), F.array(best))
        names = F.array_distinct(called(calls))
        observed = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(NONE)))
        passed = F.size(F.array_except(observed, acceptable)) == 0
        return answered(rows, self, F.col("_why"), best.isNotNull() & F.array_contains("_told.choices", best), passed=passed, explanation=F.coalesce(field_text("reason"), F.lit("")), normalized_prediction=F.to_json(observed), ground_truth=F.to_json(best.cast("variant")))


@dataclass(frozen=True)
class TextMatchesTools:
    id: str
    judge: JudgeConfig
    registry: Registry | None = None
    text: str = "output.text"
    actual: str = "output.tool_calls"
    #: tell the judge what the registry says of the tools called
    describe_tools: bool = True
    holdout: bool = False
    system: str | None = "Does the reply agree with the calls that were made?"
    provider: Provider = mock
    cache: DataFrame | None = field(default=None, compare=False)

    SCHEMA = {"type": "object", "properties": {"consistent": {"type": "boolean"}, "contradiction": {"type": "string"}, "reason": {"type": "string"}}, "required": ["consistent"]}

    def version_hash(self) -> str:
        told = self.registry.hash() if self.registry is not None and self.describe_tools else None
        return version_of(["text_matches_tools", self.id, told, self.text, self.system, self.judge.identity(), *([self.actual] if self.actual != "output.tool_calls" else [])])

    def __post_init__(self):
        may_hold_calls(self.actual)
        split_path(self.text)

    def described(self, calls: Column) -> Column:
        """The registry's descriptions of the tools called, in order of name; empty without any."""
        if self.registry is None or not self.describe_tools:
            return F.lit("")
        tools = tools_of(self.registry)
        found = F.transform(F.array_sort(F.array_distinct(called(calls))), lambda n: F.struct(n.alias("n"), tools.find(n)["description"].alias("d")))
        said = F.array_join(F.transform(F.filter(found, lambda x: x["d"].isNotNull()), lambda x: F.concat(x["n"], F.lit(": "), x["d"])), "\n")
        return F.when(said == "", "").otherwise(F.concat(F.lit("\n\nTools:\n"), said))

    def apply(self, traces: DataFrame) -> DataFrame:
        recorded, unread = calls_at(self.actual)
        calls, text = F.coalesce(recorded, F.array().cast(_CALLS)), resolve(self.text).text
        why = F.when(F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")) == "", "no reply")
        if self.actual != "output.tool_calls":
            why = why.when(unread.startswith("no value") | unread.startswith("no array"), unread)
        told = F.when(F.size(calls) == 0, "No tool was called.").otherwise(F.array_join(F.transform(calls, call_text), "\n"))
        rows = traces.withColumn("_why", why)
        prompt = F.when(F.col("_why").isNull(), prompt_of(self.system, F.concat(F.lit("Reply:\n"), text, F.lit("\n\nCalls:\n"), told, self.described(calls))))
        rows = judged(rows, self, prompt, F.lit(canonical(self.SCHEMA)), "consistency")
        ok = F.when(field_json("consistent") == "true", True).when(field_json("consistent") == "false", False)
        reason = F.coalesce(field_text("reason"), F.lit(""))
        says = F.when(ok, reason).otherwise(F.concat(F.lit("reply says '"), F.coalesce(field_text("contradiction"), F.lit("")), F.lit("' - "), reason))
        return answered(rows, self, F.col("_why"), ok.isNotNull(), passed=ok, explanation=says, normalized_prediction=F.to_json(called(recorded)))
