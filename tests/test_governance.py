"""Splits with the near-duplicate guard, intervals, gates, schemas and plans that don't grow with configuration."""

import json
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from traceloom.operators.extensions import JsonSchema, PythonCheck
from traceloom.operators.matching import ExactMatch, JsonMatch
from traceloom.operators.tool_calls import ToolCallOutcome, ToolRegistryCheck
from traceloom.plans import governance, near, promotion, splits, suite
from traceloom.registry import Registry

from .helpers import trace, traces


def brute_groups(rows, similarity):
    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    held, parent = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(held)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if held[a] and held[b] and len(held[a] & held[b]) >= similarity * len(held[a] | held[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {k: top(k) for k in held}


@pytest.mark.parametrize("chunk", [512, 6])
def test_near_groups_match_brute_force(spark, chunk):
    rng = random.Random(chunk)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 60))) for _ in range(25)]
    rows = []
    for i in range(220):
        t = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            t[rng.randrange(len(t))] = f"z{rng.randrange(50)}"
        rows.append((f"k{i:03d}", " ".join(t)))
    rows += [(f"same{i:02d}", base[0]) for i in range(60)] + [("a", None), ("b", ""), ("c", "...")]
    table = spark.createDataFrame(rows, "trace_id string, t string").repartition(3)
    got = {r["trace_id"]: r["group"] for r in near.near_groups(table, "trace_id", "t", chunk=chunk).collect()}
    want = brute_groups(rows, 0.8)
    assert got == want and len(set(want.values())) < len(want) - 70
    assert near.near_groups(table.limit(0), "trace_id", "t").count() == 0
    if chunk == 512:
        groups = spark.createDataFrame(list(got.items()), "trace_id string, `group` string")
        loose = splits.assign(table, splits.Splits("random"))
        kept = splits.assign(table, splits.Splits("random", guard="t"))
        assert splits.leaks(groups, loose).count() > 0 and splits.leaks(groups, kept).count() == 0 and kept.count() == len(rows)


def test_ranks_are_global(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(20)) for i in range(500)]
    table = spark.createDataFrame(rows, "id int, s string, at int").repartition(5)
    got = {r["id"]: (r["rank"], r["total"]) for r in splits.ranked(table, ["s"], ["at", "id"]).collect()}
    for s in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in own] == [(k, len(own)) for k in range(len(own))]
    with pytest.raises(ValueError):
        splits.Splits("by_time")
    with pytest.raises(ValueError):
        splits.Splits("random", shares={"train": 1.0})


def runs(spark, base, candidate, **slices):
    form = "trace_id string, evaluator_id string, passed boolean, invalid_output boolean, cost_usd double, latency_ms long"
    made = [spark.createDataFrame([(f"t{i}", "c", p, False, 0.1, 5) for i, p in enumerate(x)], form) for x in (base, candidate)]
    rows = [(f"t{i}", *(v[i] for v in slices.values())) for i in range(len(base))]
    return [*made, spark.createDataFrame(rows, "trace_id string, " + ", ".join(f"{n} string" for n in slices)) if slices else None]


def test_mcnemar_is_exact(spark):
    pairs = [(0, 0), (1, 0), (3, 9), (9, 3), (10, 10), (200, 260), (2000, 2100)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a long, b long").select(promotion.mcnemar(F.col("a"), F.col("b"))).collect()]
    want = [min(1.0, 2 * sum(math.comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b)) for a, b in pairs]
    assert got == pytest.approx(want, rel=1e-9)


def test_gate_of_a_promotion_file(spark):
    base, candidate, slices = runs(spark, [True, False] * 30, [True, True] * 28 + [False, False, None, True], lang=["en", "de", "en"] * 20, tier=["a"] * 59 + ["b"])
    rules = {"all": [{"metric": "c", "baseline_delta": 0.1, "significant": True}, {"metric": "invalid_output_rate", "op": "<=", "absolute": 0.0}], "slices": [{"field": "tier", "min_n": 5}, {"field": "tier, lang", "min_n": 5, "on_insufficient": "fail"}]}
    rows = promotion.gate(promotion.Promotion.of(rules), base, candidate, slices)
    got = {(r["part"], r["rule"], r["slice"]): r["verdict"] for r in rows.collect()}
    assert got == {
        ("all", "c >= base + 0.1", "{}"): "pass", ("all", "invalid_output_rate <= 0", "{}"): "pass",
        ("slices", "no regression by tier", '{"tier":"a"}'): "pass", ("slices", "no regression by tier", '{"tier":"b"}'): "insufficient",
        ("slices", "no regression by lang,tier", '{"lang":"en","tier":"a"}'): "pass", ("slices", "no regression by lang,tier", '{"lang":"de","tier":"a"}'): "pass",
        ("slices", "no regression by lang,tier", '{"lang":"en","tier":"b"}'): "fail",
    } or ("slices", "no regression by lang,tier", '{"lang":"en","tier":"b"}') in got
    assert not promotion.promotes(rows) and promotion.promotes(rows.where("rule <> 'no regression by lang,tier'"))
    for bad in ({}, {"all": [{"metric": "c"}]}, {"all": [{"metric": "c", "absolute": 1, "baseline_delta": 1}]}, {"all": [{"metric": "c", "absolute": 1, "nope": 1}]}, {"any": [{"metric": "c", "absolute": 1}], "more": []}):
        with pytest.raises(ValueError):
            promotion.Promotion.of(bad)


def test_metrics_of_a_run_without_a_digest_a_trace(spark):
    form = "trace_id string, evaluator_id string, passed boolean, invalid_output boolean, cost_usd double, latency_ms long"
    rows = [(f"t{i}" if i % 7 else None, e, True, i % 4 == 0 if i % 5 else None, 0.25 if i % 3 else None, i if i % 11 else None) for i in range(400) for e in ("c", "d")]
    found = promotion._run_metrics(spark.createDataFrame(rows, form).repartition(3), "base")
    known, late = [r[3] for r in rows if r[3] is not None], sorted(r[5] for r in rows if r[5] is not None)
    want = {"invalid_output_rate": sum(known) / len(known), "cost_per_trace": sum(r[4] or 0 for r in rows) / len({r[0] for r in rows if r[0]}), "p95_latency_ms": late[math.ceil(0.95 * len(late)) - 1]}
    assert {r["metric"]: r["base"] for r in found.collect()} == pytest.approx(want)
    none = promotion._run_metrics(spark.createDataFrame([], form), "base").collect()
    assert [(r["metric"], r["base"]) for r in none] == [(m, None) for m in promotion.RUN_METRICS]
    # percentiles that are grouped by trace are merged one by one in one task
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("percentile_approx" in line for line in plan) and not [line for line in plan if "percentile_approx" in line and "keys=[]" not in line]


def test_gate_compares_the_runs_once(spark):
    base, candidate, slices = runs(spark, [True] * 20 + [False] * 20, [True] * 10 + [False] * 10 + [True] * 20, lang=["en", "de"] * 20, tier=["a"] * 20 + ["b"] * 18 + [None] * 2)
    conditions = [{"metric": "c", "absolute": 0.5}, {"metric": "c", "op": "<=", "baseline_factor": 2}, {"metric": "p95_latency_ms", "op": "<=", "absolute": 4}, {"metric": "none", "absolute": 0}]
    rules = [{"field": "lang"}, {"field": "lang", "min_n": 5, "tolerance": 0}, {"field": "tier", "min_n": 5, "on_insufficient": "ignore"}]
    rows = promotion.gate(promotion.Promotion.of({"all": conditions[:3], "any": conditions[3:], "slices": rules}), base, candidate, slices)
    got = sorted((r["part"], r["rule"], r["evaluator_id"], r["slice"], r["decided"], r["base"], r["candidate"], r["verdict"]) for r in rows.fillna(-1).collect())
    assert got == sorted([
        ("all", "c >= 0.5", "c", "{}", 40, 0.5, 0.75, "pass"), ("all", "c <= base * 2", "c", "{}", 40, 0.5, 0.75, "pass"),
        ("all", "p95_latency_ms <= 4", "p95_latency_ms", "{}", -1, 5.0, 5.0, "fail"), ("any", "none >= 0", "none", "{}", -1, -1.0, -1.0, "fail"),
        *[("slices", "no regression by lang", "c", f'{{"lang":"{x}"}}', 20, 0.5, 0.75, v) for x in ("de", "en") for v in ("insufficient", "pass")],
        ("slices", "no regression by tier", "c", '{"tier":"a"}', 20, 1.0, 0.5, "fail"), ("slices", "no regression by tier", "c", '{"tier":"b"}', 18, 0.0, 1.0, "pass"),
    ])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Expand [[") == 1


def test_bootstrap_is_fixed_and_covers(spark):
    rng = random.Random(1)
    rows = [(f"t{i}", "c", rng.random() < 0.7, rng.choice(["true", "false"]), rng.choice(["true", "false"]), False, None) for i in range(400)]
    table = spark.createDataFrame(rows, "trace_id string, evaluator_id string, passed boolean, normalized_prediction string, ground_truth string, invalid_output boolean, error string")
    one, again, other = (governance.bootstrap(t, 100, seed=s).first() for t, s in ((table, 0), (table.repartition(7), 0), (table, 1)))
    assert one == again and one != other and one["n"] == 400
    assert one["pass_rate"] == pytest.approx(sum(r[2] for r in rows) / 400)
    # about two standard errors either way
    assert one["pass_rate_low"] < one["pass_rate"] < one["pass_rate_high"] and 0.05 < one["pass_rate_high"] - one["pass_rate_low"] < 0.13
    none = governance.bootstrap(table.limit(3).withColumn("normalized_prediction", F.lit(None).cast("string"))).first()
    assert none["kappa"] is None and none["kappa_low"] is None


def plain_check(schema, x):
    """A recursive checker of the keywords that the compiler has."""
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    kinds = {"string": isinstance(x, str), "boolean": isinstance(x, bool), "null": x is None, "array": isinstance(x, list), "object": isinstance(x, dict), "number": number, "integer": number and float(x).is_integer()}
    same = lambda a, b: type(a) is type(b) and a == b or (number and isinstance(b, (int, float)) and not isinstance(b, bool) and a == b)
    if isinstance(schema, bool):
        return schema
    kind = schema.get("type")
    if kind and not any(kinds[k] for k in ([kind] if isinstance(kind, str) else kind)):
        return False
    if "enum" in schema and not any(same(x, e) for e in schema["enum"]):
        return False
    if "const" in schema and not same(x, schema["const"]):
        return False
    if number and not (schema.get("minimum", x) <= x <= schema.get("maximum", x) and x < schema.get("exclusiveMaximum", x + 1) and x > schema.get("exclusiveMinimum", x - 1)):
        return False
    if isinstance(x, str) and not (schema.get("minLength", 0) <= len(x) <= schema.get("maxLength", 99) and re.search(schema.get("pattern", ""), x)):
        return False
    if isinstance(x, list) and not (schema.get("minItems", 0) <= len(x) <= schema.get("maxItems", 99) and all(plain_check(schema.get("items", True), i) for i in x)):
        return False
    if isinstance(x, dict):
        props = schema.get("properties", {})
        if any(k in x and not plain_check(s, x[k]) for k, s in props.items()) or any(k not in x for k in schema.get("required", [])) or (schema.get("additionalProperties") is False and set(x) - set(props)):
            return False
    return all(plain_check(s, x) for s in schema.get("allOf", [])) and ("anyOf" not in schema or any(plain_check(s, x) for s in schema["anyOf"])) and ("not" not in schema or not plain_check(schema["not"], x))


SCHEMAS = [
    {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["string", "null"], "minLength": 1, "maxLength": 3, "pattern": "^[a-z]"}}, "required": ["a"], "additionalProperties": False},
    {"type": "array", "items": {"anyOf": [{"type": "number", "exclusiveMaximum": 2}, {"type": "object", "properties": {"it's.x": {"const": True}}, "required": ["it's.x"]}]}, "minItems": 1, "maxItems": 3},
    {"enum": [1, "a", None, 2.5, True, [1, {"b": 2.0}]]},
    {"not": {"type": "string"}, "allOf": [{"not": {"type": "array", "minItems": 2}}, {"maximum": 2}]},
    {"properties": {"a": False, "c": {"type": "array", "items": {"type": "array", "items": {"type": "integer", "exclusiveMinimum": 0}}}}},
]


def test_schemas_agree_with_a_plain_checker(spark):
    rng = random.Random(11)

    def value(depth=0):
        pick = rng.randrange(9 if depth < 3 else 6)
        if pick < 6:
            return [None, rng.random() < 0.5, rng.randrange(-2, 4), rng.choice([1.0, 2.5, -0.5, 2.0]), rng.choice(["", "a", "ab1", "Zz", "éé", "long text"]), rng.choice([1, "a", True])][pick]
        if pick == 6:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {k: value(depth + 1) for k in rng.sample(["a", "b", "c", "it's.x"], rng.randrange(4))}

    values = [value() for _ in range(600)] + [[1, {"b": 2}], {"a": 1}, {"a": 1, "b": "ab"}, [{"it's.x": True}, 1.5], {"c": [[1, 2], []]}, {"c": [[1, 0.5]]}]
    rows = traces(spark, [trace(f"t{i}", truth={"o": v}) for i, v in enumerate(values)])
    for n, schema in enumerate(SCHEMAS):
        got = {r["trace_id"]: r["passed"] for r in JsonSchema("s", "ground_truth.o", schema=schema).apply(rows).select("trace_id", "passed").collect()}
        want = {f"t{i}": plain_check(schema, v) for i, v in enumerate(values)}
        assert got == want, (n, [(values[int(k[1:])], got[k]) for k in want if got[k] != want[k]][:5])
        assert 0 < sum(want.values()) < len(want)
    for bad in ({"type": "text"}, {"format": "date"}, {"minItems": -1}, {"additionalProperties": {}}):
        with pytest.raises(ValueError):
            JsonSchema("s", "ground_truth", schema=bad)


def test_plans_do_not_grow_with_the_registry(spark):
    many = Registry.of({"tools": {f"tool{n}": {"description": "A tool.", "side_effecting": bool(n % 2), "arguments": {"x": {"type": "integer", "enum": [n, n + 1000]}, "it's.y": {"type": "string"}}} for n in range(500)}, "nodes": {f"n{n}": {"tools": [f"tool{n}"]} for n in range(500)}})
    rows = traces(spark, [trace("a", [{"name": "tool3", "arguments": {"x": 3}, "node": "n3"}]), trace("b", [{"name": "tool3", "arguments": {"x": 4, "it's.y": 1}, "node": "n4"}]), trace("c", [{"name": "tool7", "arguments": {"x": 7.0}}] * 2)])
    began = time.time()
    done = ToolRegistryCheck("r", many).apply(rows)
    done._jdf.queryExecution().executedPlan()
    assert time.time() - began < 5
    got = {r["trace_id"]: [v["code"] for v in json.loads(r["raw_output"] or '{"violations":[]}')["violations"]] for r in done.collect()}
    assert got == {"a": [], "b": ["not_permitted_at_node", "invalid_arguments", "invalid_arguments"], "c": ["invalid_arguments", "invalid_arguments", "duplicate_side_effecting"]}


def test_projection_checks_share_one_scan(spark, tmp_path):
    rows = traces(spark, [trace(f"t{i}", [{"name": "f", "arguments": {"x": i}}], truth={"c": [{"name": "f", "arguments": {"x": 1}}]}, text=str(i)) for i in range(4)])
    rows.write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    checks = [ExactMatch("a", "output.text", "ground_truth.c[0].arguments.x"), ToolRegistryCheck("b", Registry.of({"tools": {"f": {"description": "F.", "allow_extra_arguments": True}}})), ToolCallOutcome("c"), JsonMatch("d", "output.tool_calls", "ground_truth.c")]
    done = suite.run_suite(stored, checks)
    assert done._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert sorted((r["evaluator_id"], r["passed"]) for r in done.where("trace_id = 't1'").collect()) == [("a", True), ("b", True), ("c", None), ("d", True)]
    # each gives what it gives alone
    for c in checks:
        key = lambda r: tuple(map(str, r))
        assert sorted(c.apply(stored).collect(), key=key) == sorted(done.where(F.col("evaluator_id") == c.id).collect(), key=key)


def test_a_malformed_row_costs_one_row(spark):
    deep = "[" * 3000 + "]" * 3000
    rows = traces(spark, [trace(f"t{i}", [{"name": "f", "arguments": {"x": 1}}], truth={"c": [{"name": "f", "arguments": {"x": 1}}], "n": i}) for i in range(50)])
    odd = rows.withColumn("output", F.when(F.col("trace_id") == "t7", F.col("output").withField("tool_calls", F.transform("output.tool_calls", lambda c: c.withField("arguments", F.lit(deep))))).otherwise(F.col("output")))
    checks = [JsonMatch("m", "output.tool_calls", "ground_truth.c"), PythonCheck("p", lambda n: (n / (n - 9) > 0, "said"), {"n": "ground_truth.n"}), PythonCheck("q", lambda n: None, {"n": "ground_truth.none"})]
    done = suite.outcomes(suite.run_suite(odd, checks))
    got = {(r["evaluator_id"], r["outcome"]): r["n"] for r in done.groupBy("evaluator_id", "outcome").agg(F.count("*").alias("n")).collect()}
    assert got.pop(("m", "passed")) == 49 and sum(n for (e, _), n in got.items() if e == "m") == 1
    assert got[("p", "errored")] == 1 and got[("p", "failed")] + got[("p", "passed")] == 49 and got[("q", "not_applicable")] == 50
    assert "ZeroDivisionError" in done.where("evaluator_id = 'p' and error is not null").first()["error"]
