"""Artifacts, logs of the store, the report's counts, rubrics, calls at other paths, and the state of streams."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from traceloom import api, config
from traceloom.api import Loom
from traceloom.cli import main
from traceloom.operators.judge import JudgeConfig, Reply
from traceloom.operators.judged import Rubric, RubricQuestion, TextMatchesTools, ToolSelection, call_text
from traceloom.operators.tool_calls import ToolCallOutcome, ToolRegistryCheck
from traceloom.plans import report, suite
from traceloom.registry import Registry
from traceloom.sources.artifacts import Artifacts
from traceloom.sources.store import Store
from traceloom.streaming import evaluate

from .helpers import trace, traces

TOOLS = {"tools": {"look": {"description": "Looks.", "arguments": {"id": {"type": "string"}}}, "pay": {"description": "Pays.", "side_effecting": True}}, "nodes": {"desk": {"tools": ["look"]}}}
JUDGE = JudgeConfig("mock", "m")


def test_artifacts_by_content(spark, tmp_path):
    store = Artifacts(spark, f"file://{tmp_path}/a")
    assert not (tmp_path / "a").exists()
    data = bytes(range(256)) * 9000
    (tmp_path / "f").write_bytes(data)
    one = store.put_bytes(data)
    assert store.put_file(tmp_path / "f") == one and store.put_bytes(b"") != one
    files = [f for _, _, names in os.walk(tmp_path / "a") for f in names if not f.startswith(".")]
    assert len(files) == 2 and store.get_bytes(one) == data and store.exists(one)
    assert [(r["uri"], bytes(r["content"]) == data, r["whole"]) for r in store.fetch([one]).collect()] == [(one, True, True)] and store.fetch([]).count() == 0
    path = tmp_path / "a" / one[6:8] / one[8:10] / one[6:]
    for crc in path.parent.glob(".*.crc"):
        crc.unlink()
    path.write_bytes(data[:-1])
    with pytest.raises(ValueError):
        store.get_bytes(one)
    assert not store.fetch([one]).first()["whole"]
    with pytest.raises(FileNotFoundError):
        store.get_bytes("cas://" + "0" * 64)
    for bad in ("cas://12", "file:///x", "cas://" + "A" * 64):
        with pytest.raises(ValueError):
            store.get_bytes(bad)


def test_logs_of_projects_judges_and_runs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.latest_run() is None and store.projects() is None
    store.upsert_project("p", {"a": 1})
    store.upsert_project("p", {"a": 2})
    assert [(r["name"], r["config"]) for r in store.projects().collect()] == [("p", '{"a":2}')]
    assert store.register_judge("h", JUDGE.identity(), None, {}) and not store.register_judge("h", JUDGE.identity(), "else", {}) and store.judges().count() == 1
    done = suite.run_suite(traces(spark, [trace("a", [{"name": "look"}])]), [ToolCallOutcome("o")])
    store.record("r1", done, "p", split="train")
    store.record("r2", done, "q")
    assert store.latest_run() == "r2" and store.latest_run("p") == "r1" and store.runs("p").first()["rows"] == 1


def test_report_counts_and_leaves_nothing_out(spark):
    says = lambda prompt, schema, c: Reply(json.dumps({"consistent": False, "contradiction": "paid", "reason": "no"}), 1, 1, 0.1)
    rows = traces(spark, [trace(f"t{i:02d}", [{"name": "look", "error": f"e{i}"}], text=f"I paid {i}") for i in range(60)] + [trace("quiet", [{"name": "look"}, {"name": "pay"}])])
    checks = [TextMatchesTools("c", JUDGE, provider=says), ToolCallOutcome("o"), ToolRegistryCheck("r", Registry.of(TOOLS))]
    done = suite.run_suite(rows, checks).cache()
    kinds = {"outcome": "o", "consistency": "c", "registry": "r", "selection": "absent"}
    text = report.markdown(done, kinds, "run-1")
    assert text.count("| t59 |") == 2 and "| t59 | look | reply says 'paid' - no |" in text and "Run `run-1` · 61 traces" in text
    assert "_consistent 0 · no reply 1 · invalid answers 0 · errored 0_" in text and "_succeeded 0 · no outcome recorded 1 · errored 0_" in text
    assert "Tool selection" not in text and "Nothing found. 61 trace(s) checked against the registry." in text
    assert "50 more rows are not shown." in report.markdown(done, {"consistency": "c"}, top=10)
    with pytest.raises(ValueError):
        report.markdown(done, {"nope": "c"})


def test_rubric_bills_once(spark):
    def says(prompt, schema, c):
        n = int(prompt["messages"][0]["content"].split("\n")[0].split()[-1])
        return Reply("oops" if n == 3 else json.dumps({"kind": n != 1, "stars": n, "tone": "calm" if n else "loud", "reason": "so"}), 7, 3, 0.5)

    questions = (RubricQuestion("kind", "Kind?"), RubricQuestion("stars", "Stars?", "integer", low=0, high=1, ground_truth="ground_truth.s"), RubricQuestion("tone", "Tone?", "enum", ("calm", "rude")))
    rows = traces(spark, [trace(f"t{i}", request=str(i), truth={"s": 1.0} if i < 3 else None) for i in range(5)])
    check = Rubric("r", questions, {"q": "input.user_request"}, JUDGE, provider=says)
    got = {(r["trace_id"], r["evaluator_id"]): r for r in suite.run_suite(rows, [check]).collect()}
    assert len(got) == 15 and sum(r["cost_usd"] for r in got.values()) == 0.5 * 4 + 2 * 0.5  # one repair
    assert [got[f"t{i}", "r.kind"]["passed"] for i in range(5)] == [True, False, True, None, True]
    assert [got[f"t{i}", "r.stars"]["passed"] for i in range(5)] == [False, True, None, None, None] and [got[f"t{i}", "r.stars"]["invalid_output"] for i in range(5)] == [False, False, True, True, True]
    assert got["t0", "r.tone"]["invalid_output"] and got["t1", "r.tone"]["normalized_prediction"] == '"calm"' and got["t1", "r.tone"]["passed"] is None
    assert got["t3", "r.kind"]["raw_output"] == '"oops"'  # kept for inspection
    names = [r["evaluator_id"] for r in suite.summarize(suite.run_suite(rows, [check]), [check]).orderBy("evaluator_id").collect()]
    assert names == ["r.kind", "r.stars", "r.tone"]
    for bad in ({"kind": "enum"}, {"kind": "text"}, {"choices": ("a",)}, {"name": "a.b"}):
        with pytest.raises(ValueError):
            RubricQuestion(**{"name": "x", "text": "?"} | bad)


def test_calls_at_other_paths(spark):
    calls = [{"name": "look", "arguments": {"id": "1", "n": 45.0}}, {"name": "gone", "error": "no"}]
    rows = traces(spark, [trace("a", metadata={"calls": calls}), trace("b", metadata={"calls": "text"}), trace("c"), trace("d", metadata={"calls": []})])
    got = {r["trace_id"]: r for r in ToolRegistryCheck("r", Registry.of(TOOLS), actual="metadata.calls").apply(rows).collect()}
    assert [v["code"] for v in json.loads(got["a"]["raw_output"])["violations"]] == ["invalid_arguments", "unregistered_tool"]
    assert [got[k]["explanation"] for k in "bcd"] == ["not applicable: no array of calls at metadata.calls", "not applicable: no value at metadata.calls", "not applicable: no tool calls"]
    got = {r["trace_id"]: r["passed"] for r in ToolCallOutcome("o", actual="metadata.calls").apply(rows).collect()}
    assert got == {"a": False, "b": None, "c": None, "d": None}
    done = ToolSelection("s", Registry.of(TOOLS), JUDGE, actual="metadata.calls").apply(rows).collect()
    assert {r["trace_id"]: r["passed"] for r in done} == {"a": False, "b": None, "c": None, "d": False}
    with pytest.raises(ValueError):
        ToolSelection("s", Registry.of(TOOLS), JUDGE, actual="metadata.calls", inputs=("metadata.calls[0].name",))
    said = traces(spark, [trace("a", [{"name": "f", "arguments": {"b": "x\"y", "a": 45.0, "c": None, "d": [1.50]}}, {"name": "g"}])]).select(F.transform("output.tool_calls", call_text)).first()[0]
    assert said == ['f(a=45.0, b="x\\"y", c=null, d=[1.5])', "g()"]


def test_facade_takes_names_paths_and_factories(spark, tmp_path):
    (tmp_path / "tools.json").write_text(json.dumps(TOOLS))
    checks = [api.registry_check(), api.tool_call_outcome(error_field="result.e"), api.tool_selection("Be kind."), api.text_matches_tools(), api.llm_question("{{ q }}?", id="q", inputs={"q": "input.user_request"}), api.rubric([RubricQuestion("a", "?")], id="u", inputs={"q": "input.user_request"})]
    loom = Loom(spark, [trace("a", [{"name": "look"}], text="x")], str(tmp_path / "tools.json"), checks, judge="mock:m")
    assert loom.judge().summary().count() == 6 and loom.checks[2].policy == "Be kind."
    for bad in ({"judge": "mock"}, {"judge": "none:m"}, {"judge": {"other": JUDGE}}, {"tools": None}):
        with pytest.raises(ValueError):
            Loom(spark, [trace("a")], **({"tools": TOOLS, "judge": JUDGE, "checks": [api.tool_selection()]} | bad))


def test_ingest_applies_splits_and_redaction(spark, tmp_path, capsys):
    rows = [trace(f"t{i}", [{"name": "look"}], request=f"mail me at a{i}@b.org, number {i} of many words here" if i % 2 else "the same request of every second trace here", metadata={"at": f"2024-01-{i + 1:02d}"}) for i in range(20)]
    (tmp_path / "x.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    project = f"name: p\nsource: {{type: jsonl, path: {tmp_path}/x.jsonl}}\nsplits: {{strategy: by_time, field: metadata.at, guard: input.user_request}}\nredaction: [email]\nmodels: {{base: {{provider: mock, model: x}}}}\n"
    (tmp_path / "p.yaml").write_text(project)
    (tmp_path / "q.yaml").write_text(project + "integrity: {require_distinct_providers: [base, judge]}\n")
    (tmp_path / "suite.yaml").write_text("name: s\njudges:\n  default: {provider: mock, model: x}\nevaluators:\n  - {type: tool_call_outcome, id: tool_call_outcome}\n  - {type: rubric, id: u, inputs: {q: input.user_request}, questions: [{name: a, text: 'Good?'}]}\n")
    cli = lambda *a: main(["--store", f"file://{tmp_path}/store", *a], spark)
    assert cli("report") == 1
    assert cli("ingest", f"{tmp_path}/p.yaml", "--dry-run") == 0 and "t0: the same request" in capsys.readouterr().out
    assert cli("ingest", f"{tmp_path}/p.yaml") == 0
    store = Store(spark, f"file://{tmp_path}/store")
    kept = store.read_snapshot("p", store.latest("p"), verify=True)
    by = {r["trace_id"]: (r["split"], r["input"]["user_request"]) for r in kept.collect()}
    assert len(by) == 20 and len({by[f"t{i}"][0] for i in range(0, 20, 2)}) == 1 and by["t19"][0] == "test" and by["t1"][1].startswith("mail me at [email], number 1")
    assert cli("evaluate", f"{tmp_path}/q.yaml", f"{tmp_path}/suite.yaml") == 1 and "base model's provider" in capsys.readouterr().err
    assert cli("evaluate", f"{tmp_path}/p.yaml", f"{tmp_path}/suite.yaml") == 0
    assert store.judges().count() == 1 and store.runs("p").first()["fingerprint"] == store.latest("p")
    capsys.readouterr()
    assert cli("report") == 0 and "## Failed calls" in capsys.readouterr().out
    assert cli("report", "nope") == 1
    (tmp_path / "bad.yaml").write_text("name: p\nsource: {type: jsonl, path: x}\nsplits: {strategy: by_tim, feld: a}\nredaction: [emial]\nintegrity: {more: 1}\n")
    with pytest.raises(config.ConfigError) as e:
        config.load_project(str(tmp_path / "bad.yaml"))
    assert len(e.value.problems) == 3


def test_state_of_streams_has_a_bound(spark, tmp_path):
    golden = traces(spark, [trace(f"t{i}", [{"name": "look", "error": "e"}]) for i in range(40)]).drop("row_hash")
    (tmp_path / "in").mkdir()
    now = time.time()
    for day in range(8):  # five new traces a day, and two of the day before once more
        golden.where(f"cast(substring(trace_id, 2) as int) between {5 * day - 2} and {5 * day + 4}").coalesce(1).write.parquet(f"{tmp_path}/d{day}")
        part = next((tmp_path / f"d{day}").glob("part-*.parquet"))
        to = tmp_path / "in" / f"day{day}.parquet"
        part.rename(to)
        os.utime(to, (now - 86_400 * (8 - day),) * 2)
    stream = evaluate.read_traces(spark, f"{tmp_path}/in", 1)
    query = evaluate.start(stream, [ToolCallOutcome("o")], f"{tmp_path}/out", f"{tmp_path}/state", available_now=True, within="36 hours")
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 20 and held[-1] <= 15 and len(held) >= 8  # of 40 traces
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40
