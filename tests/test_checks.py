import json
from dataclasses import replace

import pytest

from traceloom.functions.canon import MatchOptions
from traceloom.operators.extensions import JsonSchema, NumericTolerance, Regex, SetComparison
from traceloom.operators.judge import JudgeConfig, ProviderError, Reply, ask_one, parse_reply
from traceloom.operators.judged import LlmQuestion, TextMatchesTools, ToolSelection
from traceloom.operators.matching import ExactMatch, JsonMatch
from traceloom.operators.tool_calls import ToolCallOutcome, ToolRegistryCheck
from traceloom.registry import Registry

from .helpers import trace, traces

TOOLS = Registry.of({
    "tools": {
        "find": {"description": "Find an order.", "side_effecting": False, "arguments": {"id": {"type": "string", "required": True}}},
        "refund": {"description": "Refund.", "side_effecting": True, "arguments": {"id": {"type": "string", "required": True}, "amount": {"type": "number", "required": True}, "why": {"type": "string", "enum": ["late", "broken"]}, "count": {"type": "integer"}}},
        "note": {"description": "Note.", "allow_extra_arguments": True},
    },
    "nodes": {"desk": {"tools": ["find", "note"]}, "back": {"tools": ["find", "refund"]}},
})
JUDGE = JudgeConfig("mock", "m")


def by_id(df):
    return {r["trace_id"]: r for r in df.collect()}


def test_exact_match(spark):
    rows = traces(spark, [trace("same", truth={"t": " Hello "}, text="hello"), trace("null", truth={"t": "x"}), trace("none", text="x"), trace("nulls", truth={"t": None})])
    got = by_id(ExactMatch("e", "output.text", "ground_truth.t", lower=True).apply(rows))
    assert (got["same"]["passed"], got["same"]["score"]) == (True, 1.0)
    assert got["null"]["passed"] is False and got["null"]["explanation"] == "expected 'x', got ''"  # an unset text is null, not missing
    assert got["none"]["passed"] is None and got["none"]["explanation"].startswith("not applicable") and json.loads(got["none"]["normalized_prediction"]) == "x"
    assert got["nulls"]["passed"] is True


def test_json_match(spark):
    call = {"name": "find", "arguments": {"id": "1"}}
    rows = traces(spark, [trace("same", [call], {"c": [call]}), trace("differs", [call], {"c": [{"name": "find", "arguments": {"id": "2"}}]}), trace("absent", [call]), trace("null", [call], {"c": None}), trace("empty", [], {"c": []})])
    got = by_id(JsonMatch("j", "output.tool_calls", "ground_truth.c").apply(rows))
    assert {k: r["passed"] for k, r in got.items()} == {"same": True, "differs": False, "absent": None, "null": False, "empty": True}
    assert "id" in got["differs"]["explanation"]
    with pytest.raises(ValueError):
        JsonMatch("j", "output.text", options=MatchOptions(ignore_paths=("a..b",)))


CASES = {
    "clean": ([("find", {"id": "1"})], []),
    "unregistered": ([("other", {})], ["unregistered_tool"]),
    "node": ([("find", {"id": "1"}, "nowhere")], ["unknown_node"]),
    "scope": ([("refund", {"id": "1", "amount": 1}, "desk")], ["not_permitted_at_node"]),
    "missing": ([("find", {})], ["invalid_arguments"]),
    "null": ([("find", {"id": None})], ["invalid_arguments"]),
    "optional_null": ([("refund", {"id": "1", "amount": 1, "why": None})], []),
    "type": ([("find", {"id": 5})], ["invalid_arguments"]),
    "bool_number": ([("refund", {"id": "1", "amount": True})], ["invalid_arguments"]),
    "float_number": ([("refund", {"id": "1", "amount": 1.5})], []),
    "float_integer": ([("refund", {"id": "1", "amount": 1, "count": 5.0})], ["invalid_arguments"]),
    "integer": ([("refund", {"id": "1", "amount": 1, "count": 5})], []),
    "enum": ([("refund", {"id": "1", "amount": 1, "why": "other"})], ["invalid_arguments"]),
    "undeclared": ([("find", {"id": "1", "x": 1})], ["invalid_arguments"]),
    "extra_allowed": ([("note", {"x": 1})], []),
    "repeat_harmless": ([("find", {"id": "1"}), ("find", {"id": "1"})], []),
    "repeat_effect": ([("refund", {"id": "1", "amount": 1})] * 2, ["duplicate_side_effecting"]),
    "repeat_other": ([("refund", {"id": "1", "amount": 1}), ("refund", {"id": "2", "amount": 1})], []),
    "repeat_unknown": ([("note", {}), ("note", {}), ("note", {})], ["duplicate_undeclared"] * 2),
    "several": ([("other", {}), ("find", {"x": 1}, "nowhere")], ["unregistered_tool", "unknown_node", "invalid_arguments", "invalid_arguments"]),
    "unnamed": ([(None, {})], ["unnamed_call"]),
}


def test_registry_check(spark):
    calls = {k: [{"name": c[0], "arguments": c[1]} | ({"node": c[2]} if len(c) > 2 else {}) for c in cs] for k, (cs, _) in CASES.items()}
    rows = traces(spark, [trace(k, c) for k, c in calls.items()] + [trace("none"), trace("default", [{"name": "refund", "arguments": {"id": "1", "amount": 1}}], metadata={"node": "desk"})])
    got = by_id(ToolRegistryCheck("r", TOOLS, node_path="metadata.node").apply(rows))
    for k, (_, codes) in CASES.items():
        found = [v["code"] for v in json.loads(got[k]["raw_output"] or '{"violations":[]}')["violations"]]
        assert found == codes, k
        assert got[k]["passed"] is all(c == "duplicate_undeclared" for c in codes), k
    assert got["none"]["passed"] is None and got["none"]["explanation"] == "not applicable: no tool calls"
    assert got["default"]["passed"] is False
    assert got["repeat_unknown"]["explanation"] == "note repeats call 0; note repeats call 0"
    with pytest.raises(ValueError):
        ToolRegistryCheck("r", TOOLS, expected="ground_truth.x")


def test_registry_refuses():
    for bad in ({"tools": {}}, {"tools": {"none": {"description": "x"}}}, {"tools": {"a": {"description": "x"}}, "nodes": {"n": {"tools": ["b"]}}}, {"tools": {"a": {"description": ""}}}, {"tools": {"a": {"description": "x", "arguments": {"y": {"type": "date"}}}}}, {"tool": {}}):
        with pytest.raises(ValueError):
            Registry.of(bad)
    assert "refund(id: string, amount: number, why?: \"late\"|\"broken\", count?: integer)" in TOOLS.catalogue("back")
    assert TOOLS.choices("desk") == ["find", "note", "none"]


def test_outcome(spark):
    c = lambda **k: {"name": "find", **k}
    rows = traces(spark, [
        trace("text", [c(error="boom")]), trace("null", [c(error=None)]), trace("absent", [c()]), trace("empty", [c(error="")]), trace("blank", [c(error=" \n ")]), trace("mixed", [c(), c(error="x" * 200)]), trace("none"),
        trace("failed", [c(result={"status": "failed"})]), trace("ok", [c(result={"status": "ok"})]),
    ])
    got = by_id(ToolCallOutcome("o").apply(rows))
    assert {k: got[k]["passed"] for k in got} == {"text": False, "null": None, "absent": None, "empty": True, "blank": True, "mixed": False, "none": None, "failed": None, "ok": None}
    raw = json.loads(got["mixed"]["raw_output"])
    assert raw["recorded"] == 1 and raw["failures"][0]["call"] == 1 and len(raw["failures"][0]["error"]) == 120
    got = by_id(ToolCallOutcome("o", error_field="result.status", failure_values=("failed",)).apply(rows))
    assert (got["failed"]["passed"], got["ok"]["passed"], got["text"]["passed"]) == (False, True, None)


def says(reply):
    def provider(prompt, schema, config):
        return Reply(json.dumps(reply) if not isinstance(reply, str) else reply, 10, 5, 0.5)

    return provider


def test_selection(spark):
    rows = traces(spark, [trace("agrees", [{"name": "find"}]), trace("not", [{"name": "refund"}, {"name": "find"}]), trace("quiet"), trace("lost", [{"name": "find", "node": "nowhere"}])])
    got = by_id(ToolSelection("s", TOOLS, JUDGE, provider=says({"best": "find", "acceptable": [], "reason": "why"})).apply(rows))
    assert {k: r["passed"] for k, r in got.items()} == {"agrees": True, "not": False, "quiet": False, "lost": None}
    assert got["not"]["normalized_prediction"] == '["refund","find"]' and got["quiet"]["normalized_prediction"] == '["none"]' and got["not"]["ground_truth"] == '"find"'
    assert got["lost"]["cost_usd"] is None and got["lost"]["cache_hit"] is False
    for reply in ({"best": 5}, {"best": "made up", "acceptable": []}, "no json"):
        got = by_id(ToolSelection("s", TOOLS, JUDGE, provider=says(reply)).apply(rows))
        assert got["agrees"]["invalid_output"] is True and got["agrees"]["passed"] is None and got["agrees"]["error"] is None
    for more in ({"inputs": ("output.text",)}, {"inputs": ("output.tool_calls[0].name",)}, {"samples": 3}):
        with pytest.raises(ValueError):
            ToolSelection("s", TOOLS, JUDGE, **more)


def test_consistency(spark):
    rows = traces(spark, [trace("reply", [{"name": "find", "arguments": {"id": "1"}}], text="done"), trace("calls_none", text="done"), trace("silent", [{"name": "find"}]), trace("blank", text="  ")])
    got = by_id(TextMatchesTools("c", JUDGE, provider=says({"consistent": False, "contradiction": "done", "reason": "nothing ran"})).apply(rows))
    assert {k: r["passed"] for k, r in got.items()} == {"reply": False, "calls_none": False, "silent": None, "blank": None}
    assert got["reply"]["explanation"] == "reply says 'done' - nothing ran"
    got = by_id(TextMatchesTools("c", JUDGE, provider=says({"consistent": "yes"})).apply(rows))
    assert got["reply"]["invalid_output"] is True


@pytest.mark.parametrize("matcher,reply,truth,passed", [
    ("boolean", True, True, True), ("boolean", "no", False, True), ("boolean", "PASS", True, True), ("boolean", 1, True, True), ("boolean", "perhaps", True, None),
    ("exact_label", "a", "a", True), ("exact_label", "a", "b", False), ("exact_label", "a", None, False), ("numeric_tolerance", 2, 2.0, True), ("numeric_tolerance", 2, 2.1, False), ("set_overlap", ["b", "a"], ["a", "b"], True),
])
def test_questions(spark, matcher, reply, truth, passed):
    rows = traces(spark, [trace("t", truth={"x": truth}), trace("no truth")])
    got = by_id(LlmQuestion("q", "{{ r }}", {"r": "input.user_request"}, JUDGE, matcher=matcher, ground_truth="ground_truth.x", provider=says({"answer": reply, "reason": "so"})).apply(rows))
    assert got["t"]["passed"] is passed and got["t"]["invalid_output"] is (passed is None)
    if passed is not None:
        assert got["no truth"]["passed"] is None and "not calibrated" in got["no truth"]["explanation"]


def test_question_options(spark):
    with pytest.raises(ValueError):
        LlmQuestion("q", "x", {}, JUDGE, matcher="other")
    rows = traces(spark, [trace("t", truth={"x": 2.05})])
    q = LlmQuestion("q", "x", {}, JUDGE, matcher="numeric_tolerance", tolerance=0.1, ground_truth="ground_truth.x", provider=says({"answer": 2}))
    assert by_id(q.apply(rows))["t"]["passed"] is True
    q = LlmQuestion("q", "x", {}, JUDGE, matcher="label_map", labels={"yes": "ok"}, ground_truth="ground_truth.x", provider=says({"answer": "yes"}))
    assert by_id(q.apply(rows))["t"]["normalized_prediction"] == '"ok"'


@pytest.mark.parametrize("text,want", [('{"a":1}', {"a": 1}), ('```json\n{"a":1}\n```', {"a": 1}), ('```\n{"a":1}```', {"a": 1}), ('Sure: {"a":1} there.', {"a": 1}), ("[1]", None), ('[{"a":1}]', None), ('"x"', None), ("5", None), ("", None)])
def test_replies(text, want):
    assert parse_reply(text) == want


def test_retry_and_repair(monkeypatch):
    monkeypatch.setattr("time.sleep", lambda s: None)
    calls = []

    def flaky(prompt, schema, config):
        calls.append(prompt)
        if len(calls) < 3:
            raise ProviderError("busy", 429)
        return Reply("no json" if len(calls) == 3 else '{"a":1}', 10, 5, 1.0)

    config = JudgeConfig("mock", "m")
    assert ask_one(flaky, {"messages": []}, {}, config)[0] == '{"a":1}' and len(calls) == 4
    assert ask_one(lambda *a: Reply("never", 10, 5, 1.0), {"messages": []}, {}, config)[3] == 2.0  # both calls are billed
    assert ask_one(lambda *a: Reply("never", None, 5, None), {"messages": []}, {}, config)[3] is None  # unknown stays unknown

    def refused(*a):
        calls.append(1)
        raise ProviderError("bad key", 401)

    n = len(calls)
    assert ask_one(refused, {"messages": []}, {}, config)[1] == "ProviderError: bad key" and len(calls) == n + 1


def test_judge_identity():
    a, b = JudgeConfig("mock", "m"), JudgeConfig("mock", "m", base_url="http://x", timeout_s=5, max_retries=0)
    assert a.version_hash(None, "q", {}) == b.version_hash(None, "q", {}) != JudgeConfig("mock", "m", temperature=0.5).version_hash(None, "q", {})
    with pytest.raises(ValueError):
        JudgeConfig("other", "m")


def test_cache(spark):
    rows = traces(spark, [trace("a", request="one"), trace("b", request="one"), trace("c", request="two")])
    q = LlmQuestion("q", "{{ r }}", {"r": "input.user_request"}, JUDGE)
    first = by_id(q.apply(rows))
    assert [first[k]["cache_hit"] for k in "abc"] == [False, True, False] and [first[k]["cost_usd"] for k in "abc"] == [0.001, 0.0, 0.001]
    again = by_id(LlmQuestion("q", "{{ r }}", {"r": "input.user_request"}, JUDGE, cache=q.fresh).apply(rows))
    assert all(r["cache_hit"] and r["cost_usd"] == 0.0 for r in again.values())
    other = by_id(LlmQuestion("q", "Now: {{ r }}", {"r": "input.user_request"}, JUDGE, cache=q.fresh).apply(rows))
    assert not other["a"]["cache_hit"]
    bad = by_id(LlmQuestion("q", "{{ r }}", {"r": "input.user_request"}, JUDGE, provider=says("never")).apply(rows))
    assert not bad["b"]["cache_hit"] and bad["b"]["invalid_output"]


def test_extensions(spark):
    rows = traces(spark, [trace("t", truth={"n": 10, "s": ["a", "b"], "o": {"x": 1}, "got": 10.4, "mine": ["b", "c"]}, text="abc123"), trace("none")])
    r = lambda c: by_id(c.apply(rows))
    assert r(Regex("x", "output.text", r"\d{3}$"))["t"]["passed"] is True
    near = r(NumericTolerance("x", "ground_truth.got", "ground_truth.n", relative=0.05))
    assert near["t"]["passed"] is True and near["none"]["passed"] is None
    sets = r(SetComparison("x", "ground_truth.mine", "ground_truth.s", least=0.5))
    assert sets["t"]["passed"] is True and sets["t"]["score"] == 0.5 and sets["none"]["passed"] is None
    assert r(JsonSchema("x", "ground_truth.o", required=("x",)))["t"]["passed"] is True
    assert r(JsonSchema("x", "ground_truth.o", required=("y",)))["t"]["passed"] is False


def test_options_of_judged_checks(spark):
    def spy(prompt, schema, config):
        return Reply(json.dumps({"best": "find", "acceptable": [], "consistent": "legal" in json.dumps(prompt), "verdict": "Irreversible" in json.dumps(prompt)}))

    rows = traces(spark, [trace("a", [{"name": "find"}], text="done"), trace("b", text="done")])
    tools = Registry.of({"tools": {"find": {"description": "Irreversible legal search."}, "refund": {"description": "Pays."}}})
    got = by_id(TextMatchesTools("c", JUDGE, tools, provider=spy).apply(rows))
    assert {k: r["passed"] for k, r in got.items()} == {"a": True, "b": False}  # only the tools called are described
    got = by_id(TextMatchesTools("c", JUDGE, tools, describe_tools=False, provider=spy).apply(rows))
    assert {k: r["passed"] for k, r in got.items()} == {"a": False, "b": False}
    schema = {"type": "object", "properties": {"verdict": {"type": "boolean"}}, "required": ["verdict"]}
    q = LlmQuestion("q", "Irreversible? {{ r }}", {"r": "input.user_request"}, JUDGE, answer_key="verdict", response_schema=schema, provider=spy)
    assert q.schema() == schema and by_id(q.apply(rows))["a"]["normalized_prediction"] == "true"
    with pytest.raises(ValueError):
        LlmQuestion("q", "x", {}, JUDGE, response_schema=schema)
    plain, ruled = ToolSelection("s", tools, JUDGE), ToolSelection("s", tools, JUDGE, policy="Refund within 30 days.")
    assert plain.version_hash() != ruled.version_hash()
    with pytest.raises(ValueError):
        ToolSelection("s", tools, JUDGE, request="output.text")
    with pytest.raises(ValueError):
        TextMatchesTools("c", JUDGE, actual="output.artifacts")

    def wants_policy(prompt, schema, config):
        return Reply(json.dumps({"best": "find" if "within 30 days" in json.dumps(prompt) else "refund", "acceptable": []}))

    for check, passed in ((plain, False), (ruled, True)):
        assert by_id(replace(check, provider=wants_policy).apply(rows))["a"]["passed"] is passed
