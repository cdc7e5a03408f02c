import json

import pytest
from pyspark.sql import functions as F

from traceloom import config
from traceloom.api import Loom, load_traces
from traceloom.cli import main
from traceloom.functions.canon import MatchOptions
from traceloom.operators.base import results
from traceloom.operators.judge import JudgeConfig
from traceloom.operators.judged import LlmQuestion, TextMatchesTools, ToolSelection
from traceloom.operators.matching import ExactMatch, JsonMatch
from traceloom.operators.tool_calls import ToolCallOutcome, ToolRegistryCheck
from traceloom.plans import feedback, governance, report, suite
from traceloom.registry import Registry
from traceloom.sources.jsonl import mapped, read_jsonl, to_traces, unmapped_fields
from traceloom.sources.store import Store
from traceloom.streaming import evaluate

from .helpers import trace, traces

JUDGE = JudgeConfig("mock", "m")
TOOLS = {"tools": {"cancel": {"description": "Cancel."}, "look": {"description": "Look.", "arguments": {"id": {"type": "string", "required": True}}}}}


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"trace_id":"a"}\n\n// a remark\nbroken {\n[1]\n  {"trace_id":"b"}\n')
    rows, bad = read_jsonl(spark, str(path))
    assert [r["source_id"] for r in rows.orderBy("source_id").collect()] == ["line:1", "line:6"]
    assert sorted(r["message"] for r in bad.collect()) == ["line 4: invalid JSON", "line 5: expected an object, found array<decimal(1,0)>"] or len(bad.collect()) == 2
    assert read_jsonl(spark, str(path), 1)[0].count() == 1 and read_jsonl(spark, str(path), 0)[0].count() == 0


def test_jsonl_lines_over_many_blocks(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    path.write_text("".join(f'{{"trace_id":"{i}","input":{{"user_request":"{"x" * 200}"}}}}\n' for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows, _ = read_jsonl(spark, str(path))
        got = rows.select("source_id", F.get_json_object("data", "$.trace_id").alias("t")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r["source_id"] == f"line:{int(r['t']) + 1}" for r in got) and len(got) == 5000


def raw(spark, rows):
    return spark.createDataFrame([(f"line:{i}", json.dumps(r)) for i, r in enumerate(rows, 1)], "source_id string, data string")


def test_mapping_and_validation(spark):
    rows = raw(spark, [{"id": "1", "said": "hi", "calls": [{"name": "x", "arguments": {"a": 1}}], "lang": "en"}, {"id": "2", "said": None}, {"said": "no id"}])
    mapping = {"trace_id": "id", "output.text": "said", "output.tool_calls": "calls", "ground_truth.reply": "want"}
    good, bad = to_traces(mapped(rows, mapping))
    got = {r["trace_id"]: r for r in good.collect()}
    assert got["1"]["output"]["tool_calls"][0]["arguments"] == '{"a":1}' and got["1"]["source_id"] == "line:1" and got["2"]["output"]["text"] is None
    assert [r["message"] for r in bad.collect()] == ["line:3: trace_id: must not be empty"]
    assert [r["field"] for r in unmapped_fields(rows, mapping).collect()] == ["lang"]
    with pytest.raises(TypeError):
        mapped(rows, {"x.y": "a", "x.y.z": "b"})
    both, _ = to_traces(mapped(rows, {"trace_id": "id", "output.text": "id"}))  # a column may fill two fields
    assert both.first()["output"]["text"] == "1"
    odd = [{"trace_id": "a", "extra": 1}, {"trace_id": ""}, {"trace_id": "c", "input": {"messages": [{"role": "boss", "content": "x"}]}}, {"trace_id": "d", "output": {"artifacts": [{"type": "image", "uri": "data:x"}]}}, {"trace_id": "e", "output": {"artifacts": [{"type": "image", "uri": " "}]}}, {"trace_id": "f", "output": {}}]
    good, bad = to_traces(raw(spark, odd))
    assert [r["trace_id"] for r in good.collect()] == ["f"] and bad.count() == 5


def test_changed_payload_fails_a_verified_read(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    print_, _ = s.write_snapshot("p", traces(spark, [trace("a"), trace("b")]), {"type": "jsonl", "path": "/x"})
    body = f"{tmp_path}/store/snapshots/project=p/fingerprint={print_}"
    changed = spark.read.parquet(body).withColumn("ground_truth", F.lit('{"x":9}'))
    changed.write.partitionBy("split").parquet(f"{tmp_path}/changed")
    import shutil

    shutil.rmtree(body)
    shutil.move(f"{tmp_path}/changed", body)
    with pytest.raises(ValueError):
        s.read_snapshot("p", print_, verify=True)
    assert s.read_snapshot("p", print_).count() == 2


def test_content_hash(spark):
    a, b, c = trace("a", truth={"x": 1, "y": 2}), trace("a", truth={"y": 2, "x": 1}), trace("a", truth={"x": 1, "y": 3})
    hashes = [to_traces(raw(spark, [t]))[0].first()["content_hash"] for t in (a, b, c)]
    assert hashes[0] == hashes[1] != hashes[2]


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    t = traces(spark, [trace("a"), trace("b", truth={"x": 1})])
    assert s.latest("p") is None
    first, new = s.write_snapshot("p", t, {"type": "jsonl", "path": "/x"})
    assert new and s.write_snapshot("p", t.orderBy(F.desc("trace_id")), {"type": "jsonl", "path": "/x"}) == (first, False)
    assert s.write_snapshot("other", t, {"type": "jsonl", "path": "/x"}) == (first, True)
    assert s.latest("p") == first and s.read_snapshot("p", first, "train", verify=True).count() == 2
    assert [tuple(r) for r in s.split_counts("p", first).collect()] == [("train", 2)]
    with pytest.raises(ValueError, match="duplicate"):
        s.write_snapshot("p", t.union(t), {"type": "jsonl"})
    with pytest.raises(ValueError, match="split"):
        s.write_snapshot("q", t, {"type": "jsonl"}, F.lit("nonsense"))
    res = ToolCallOutcome("o").apply(t)
    assert s.record("r1", res).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        s.record("r1", res)
    assert s.cache() is None
    rows = spark.createDataFrame([("k", "{}")], "cache_key string, parsed string")
    s.add_to_cache(rows)
    s.add_to_cache(rows)
    assert s.cache().count() == 1


def test_snapshot_tampering_is_found(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    print_, _ = s.write_snapshot("p", traces(spark, [trace("a"), trace("b")]), {"type": "x"})
    traces(spark, [trace("c")]).write.mode("append").parquet(f"file://{tmp_path}/store/snapshots/project=p/fingerprint={print_}/split=train")
    with pytest.raises(ValueError, match="doesn't hold"):
        s.read_snapshot("p", print_, verify=True)


def result_rows(spark, rows):
    base = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, trace_id string, e string, passed boolean, invalid boolean, error string, cost double")

    class Any:
        id = "x"

        def version_hash(self):
            return "v"

    return results(base, Any(), evaluator_id=F.col("e"), passed=F.col("passed"), invalid_output=F.col("invalid"), error=F.col("error"), cost_usd=F.col("cost"))


def test_summary(spark):
    rows = result_rows(spark, [("a", "q", True, False, None, 0.5), ("b", "q", False, False, None, None), ("c", "q", None, False, None, 0.25), ("d", "q", None, False, "x", None), ("e", "q", None, True, None, None), ("a", "n", None, False, None, None)])
    got = {r["evaluator_id"]: r for r in suite.summarize(rows, [ToolCallOutcome("q"), ToolCallOutcome("n"), ToolCallOutcome("never")]).collect()}
    q = got["q"]
    assert (q["passed"], q["failed"], q["not_applicable"], q["errored"], q["invalid_output"], q["pass_rate"], q["cost_usd"]) == (1, 1, 1, 2, 1, 0.5, 0.75)
    assert got["n"]["pass_rate"] is None and got["never"]["passed"] == 0
    assert suite.failures(rows).count() == 1 and suite.run_totals(rows).first()["cost_usd"] == 0.75
    for bad in ([], [ToolCallOutcome("a"), ToolCallOutcome("a")]):
        with pytest.raises(ValueError):
            suite.run_suite(rows, bad)
    assert report.coverage(rows.where("evaluator_id = 'q'")).first().asDict() == {"passed": 1, "failed": 1, "skipped": 2, "invalid": 1, "errored": 1}


def golden(spark):
    """Fourteen traces of the shape that the acceptance counts are about."""
    look = lambda i: {"name": "look", "arguments": {"id": i}}
    rows = []
    for i in range(14):
        calls = [] if i < 4 else [look(str(i))] if i != 13 else [{"name": "cancel", "arguments": {}}]
        if i == 4:
            calls[0]["error"] = "boom"
        if i == 5:
            calls[0]["error"] = ""
        truth = {}
        if i >= 2 and i < 12:
            truth["calls"] = [look(str(i))] if i in (4, 5, 6, 7) else [] if i in (2,) else [look("other")]
        if i < 12:
            truth["ok"] = i < 5
        rows.append(trace(f"t{i:02}", calls, truth, text="reply", request=f"ask {i}"))
    return traces(spark, rows)


def test_suite_counts(spark):
    reg = Registry.of(TOOLS)
    checks = [
        ToolRegistryCheck("registry", reg), JsonMatch("calls", "output.tool_calls", "ground_truth.calls", MatchOptions(ignore_paths=("error",))), ToolCallOutcome("outcome"), ExactMatch("name", "output.tool_calls[0].name", "ground_truth.calls[0].name"),
        ToolSelection("selection", reg, JUDGE), TextMatchesTools("text", JUDGE, reg), LlmQuestion("policy", "{{ r }}", {"r": "input.user_request"}, JUDGE, ground_truth="ground_truth.ok"), LlmQuestion("free", "{{ r }}?", {"r": "input.user_request"}, JUDGE),
    ]
    got = {r["evaluator_id"]: (r["passed"], r["failed"], r["not_applicable"]) for r in suite.summarize(suite.run_suite(golden(spark), checks), checks).collect()}
    assert got == {"registry": (10, 0, 4), "calls": (5, 5, 4), "outcome": (1, 1, 12), "name": (8, 0, 6), "selection": (1, 13, 0), "text": (14, 0, 0), "policy": (5, 7, 2), "free": (0, 0, 14)}


def test_report_and_markdown(spark):
    loom = Loom(spark, golden(spark), TOOLS, judge=JUDGE)
    done = loom.judge()
    text = done.markdown()
    assert text == done.markdown() and "## Tool selection" in text and "## Contradictions" in text and "Nothing found." in text
    top = report.selection(done.results.where("evaluator_id = 'tool_selection'")).collect()
    assert [(r["called"], r["judge_says"], r["n"], r["example"]) for r in top] == [("look", "cancel", 9, "t04"), ("none", "cancel", 4, "t00")]
    assert report.failures(done.results).first()["error"] == "boom"
    assert report.cell("a|b\nc") == "a\\|b c" and done.summary().count() == 4
    assert report.trace_count(done.results).first()["traces"] == 14
    with pytest.raises(NotImplementedError):
        loom.finetune()


def test_feedback(spark):
    loom = Loom(spark, golden(spark), TOOLS, judge=JUDGE)
    done = loom.judge()
    sealed = spark.createDataFrame([("t00",), ("t05",)], "trace_id string")
    made = loom.dataset(done, sealed)
    assert {r["drop_reason"]: r["n"] for r in made.dropped.collect()} == {"in_sealed_test_split": 2, "passed": 1}
    row = made.rows.where("trace_id = 't04'").first()
    assert row["prompt"] == '[{"role":"user","content":"ask 4"}]' and row["chosen"] == '[{"arguments":{},"name":"cancel"}]' and row["rejected"] == '[{"arguments":{"id":"4"},"name":"look"}]'
    m = made.manifest()
    assert m["rows"] == 11 and m["dropped_total"] == 3 and m == loom.dataset(done, sealed).manifest()


def test_drop_reasons_in_order(spark):
    reg = Registry.of(TOOLS)
    t = traces(spark, [trace(k) for k in "abcdefghijk"])
    raw_of = {"g": {}, "h": {"best": "made_up"}, "i": {"best": "look", "arguments": {}}, "j": {"best": "none"}, "k": {"best": "look", "arguments": {"id": "1"}}}
    rows = [(k, False if k in "ghijk" else True if k == "f" else None, k == "d", "boom" if k == "c" else None, json.dumps(raw_of.get(k)) if k in raw_of else None, "held" if k == "b" else "s") for k in "abcdefghijk"]
    base = spark.createDataFrame(rows, "trace_id string, passed boolean, invalid_output boolean, error string, raw_output string, evaluator_id string").withColumn("judge_config_hash", F.lit("h")).withColumn("evaluator_version", F.lit("v"))
    sealed = t.where("trace_id = 'a'")
    got = {r["trace_id"]: r["drop_reason"] for r in feedback.classify(base, t, reg, sealed, ("held",)).collect()}
    assert got == {"a": "in_sealed_test_split", "b": "holdout_evaluator", "c": "evaluator_errored", "d": "judge_answered_unusably", "e": "not_applicable", "f": "passed", "g": "no_judge_proposal_recorded", "h": "proposal_not_in_registry", "i": "proposal_failed_argument_check", "j": None, "k": None}
    bare = {r["trace_id"]: r["drop_reason"] for r in feedback.classify(base, t, None).collect()}
    assert bare["k"] == "no_registry_to_validate_proposal" and bare["j"] is None
    chosen = {r["trace_id"]: r["chosen"] for r in feedback.build_dpo(base, t, reg).rows.collect()}
    assert chosen["j"] == "[]"


def test_load_traces(spark, tmp_path):
    good, bad = load_traces(spark, [{"trace_id": "a"}, {"trace_id": ""}])
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(ValueError):
        Loom(spark, [{"trace_id": "a"}], checks=[])


def test_streaming(spark, tmp_path):
    t = golden(spark)
    t.write.parquet(f"{tmp_path}/in/1")
    t.limit(3).write.parquet(f"{tmp_path}/in/2")  # again: dropped
    stream = evaluate.read_traces(spark, f"{tmp_path}/in/*", 1)
    evaluate.start(stream, [ToolCallOutcome("o")], f"{tmp_path}/out", f"{tmp_path}/state", available_now=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 14


def test_config(tmp_path):
    (tmp_path / "project.yaml").write_text("name: p\nsorce:\n  type: jsonl\nmapping:\n  b..c: a\n")
    with pytest.raises(config.ConfigError) as e:
        config.load_project(str(tmp_path / "project.yaml"))
    assert "line 2: sorce: unknown key; did you mean 'source'?" in e.value.problems and len(e.value.problems) == 3
    with pytest.raises(config.ConfigError) as e:
        config.build_suite({"evaluators": [{"type": "exact_mach", "id": "a"}, {"type": "tool_registry_check", "id": "b"}, {"type": "llm_question", "id": "c", "judge": "j"}, {"type": "regex", "id": "d", "actual": "output.text", "patern": "x"}]})
    assert len(e.value.problems) == 4
    checks = config.build_suite({"evaluators": [{"type": "json_match", "id": "a", "actual": "output.tool_calls", "expected": "ground_truth.c", "options": {"ignore_paths": ["node"]}}, {"type": "text_matches_tools", "id": "b", "judge": "m"}]}, None, {"m": JUDGE})
    assert [c.id for c in checks] == ["a", "b"] and checks[0].options.ignore_paths == ("node",)


def test_command_line(spark, tmp_path, capsys):
    rows = [trace(f"t{i}", [{"name": "look", "arguments": {"id": "1"}}] if i else [], request="r") for i in range(3)]
    (tmp_path / "x.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "project.yaml").write_text(f"name: p\nsource:\n  type: jsonl\n  path: {tmp_path}/x.jsonl\n")
    (tmp_path / "tools.json").write_text(json.dumps(TOOLS))
    (tmp_path / "suite.yaml").write_text("name: s\njudges:\n  m: {provider: mock, model: x}\nevaluators:\n  - {type: tool_registry_check, id: reg}\n  - {type: tool_selection, id: sel, judge: m}\n")
    cli = lambda *a: main(["--store", f"file://{tmp_path}/store", *a], spark)
    assert cli("validate", f"{tmp_path}/project.yaml") == 0
    assert cli("evaluate", f"{tmp_path}/project.yaml", f"{tmp_path}/suite.yaml", "--tools", f"{tmp_path}/tools.json") == 1
    assert cli("snapshot", "p") == 2
    assert cli("ingest", f"{tmp_path}/project.yaml") == 0 and cli("snapshot", "p") == 0
    capsys.readouterr()
    assert cli("evaluate", f"{tmp_path}/project.yaml", f"{tmp_path}/suite.yaml", "--tools", f"{tmp_path}/tools.json") == 0
    run = capsys.readouterr().out.split("\n")[0]
    assert cli("report", run, "--evaluator", "selection=sel", "--evaluator", "registry=reg") == 0
    assert "| look | cancel | 2 | t1 |" in capsys.readouterr().out
    assert cli("feedback", run, "--project", "p", "--evaluator", "sel", "--tools", f"{tmp_path}/tools.json", "--out", f"{tmp_path}/pairs") == 0
    assert spark.read.text(f"{tmp_path}/pairs").count() == 3


def test_governance(spark):
    base = spark.range(10000).select(F.col("id").cast("string").alias("k"))
    n = {r["s"]: r["n"] for r in base.groupBy(governance.split_by_hash(F.col("k"), {"train": 0.8, "test": 0.2}).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert abs(n["test"] - 2000) < 200
    one = spark.createDataFrame([("mail a.b@c.org from 10.0.0.1",)], "t string")
    assert one.select(governance.redact(F.col("t"), ["email", "ipv4"])).first()[0] == "mail [email] from [ipv4]"
    rows = spark.createDataFrame([("q", p, t, None, False) for p, t in [("true", "true")] * 4 + [("true", "false")] + [("false", "false")] * 4 + [("false", "true")]], "evaluator_id string, normalized_prediction string, ground_truth string, error string, invalid_output boolean")
    m = governance.judge_metrics(rows).first()
    assert (m["n"], m["accuracy"], m["precision"], m["recall"]) == (10, 0.8, 0.8, 0.8) and abs(m["kappa"] - 0.6) < 1e-9
    run = lambda ps: spark.createDataFrame([(str(i), "q", p, False) for i, p in enumerate(ps)], "trace_id string, evaluator_id string, passed boolean, invalid_output boolean")
    g = governance.compare_runs(run([True, True, False, None]), run([True, False, True, True])).first()
    assert (g["decided"], g["regressed"], g["improved"], g["passes"]) == (3, 1, 1, True)


def test_suite_keys():
    reg = Registry.of({"tools": {"find": {"description": "Finds."}}})
    judges = {"default": JudgeConfig("mock", "m")}
    suite = {
        "suite": "s", "description": "what it is for",
        "evaluators": [
            {"id": "a", "type": "exact_match", "actual": "output.text", "options": {"lower": True}, "weight": 2},
            {"id": "b", "type": "tool_call_outcome", "actual": "output.tool_calls", "options": {"error_field": "result.status", "failure_values": ["failed"]}, "holdout": True},
            {"id": "c", "type": "tool_selection", "judge": "default", "request": "input.user_request", "inputs": {"lang": "metadata.language"}, "policy": "p", "system_prompt": "s", "holdout": True},
            {"id": "d", "type": "text_matches_tools", "text": "output.text", "describe_tools": False},
            {"id": "e", "type": "llm_question", "question": "{{ r }}?", "inputs": {"r": "output.text"}, "matcher": "label_map", "matcher_options": {"map": {"yes": "ok"}, "answer_key": "said"}},
        ],
    }
    a, b, c, d, e = config.build_suite(suite, reg, judges)
    assert a.lower and b.failure_values == ("failed",) and c.holdout and c.inputs == ("metadata.language",) and c.policy == "p" and c.system == "s"
    assert not d.describe_tools and e.template == "{{ r }}?" and e.labels == {"yes": "ok"} and e.answer_key == "said"
    bad = {"evaluators": [{"id": "a", "type": "exact_match", "actual": "output.text", "options": {"lowr": True}, "weight": -1}]}
    with pytest.raises(config.ConfigError) as failed:
        config.build_suite(bad)
    assert any("weight" in p for p in failed.value.problems) and any("lowr" in p and "lower" in p for p in failed.value.problems)


def test_a_failing_check_costs_its_own_rows(spark):
    rows = traces(spark, [trace("a", text="x"), trace("b", text="y")])
    bad = LlmQuestion("bad", "{{ nothing }}", {}, JudgeConfig("mock", "m"))
    done = suite.run_suite(rows, [ExactMatch("ok", "output.text", "output.text"), bad])
    got = {(r["evaluator_id"], r["trace_id"]): r for r in done.collect()}
    assert len(got) == 4 and got["ok", "a"]["passed"] is True and got["ok", "a"]["error"] is None
    assert got["bad", "b"]["passed"] is None and got["bad", "b"]["error"].startswith("ValueError: ") and "nothing" in got["bad", "b"]["error"]
    counts = {r["evaluator_id"]: (r["passed"], r["errored"]) for r in suite.summarize(done).collect()}
    assert counts == {"ok": (2, 0), "bad": (0, 2)}
