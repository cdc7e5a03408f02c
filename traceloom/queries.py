"""Registered queries of the evaluation engine over derived traces, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived as d
from .functions.canon import MatchOptions, canonical_json, content_hash
from .functions.paths import resolve
from .operators.judge import JudgeConfig
from .operators.judged import LlmQuestion, Rubric, RubricQuestion, TextMatchesTools, ToolSelection
from .operators.extensions import JsonSchema, PythonCheck
from .operators.matching import ExactMatch, JsonMatch
from .operators.tool_calls import ToolCallOutcome, ToolRegistryCheck
from .plans import feedback, governance, near, promotion, report, splits, suite
from .session import shared_path
from .sources import store
from .streaming import evaluate

JUDGE = JudgeConfig("mock", "mock-1")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WITH = "WITH" + d.CALLS_SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def verdicts(results: DataFrame, *more: str) -> DataFrame:
    return results.select("trace_id", "passed", "score", *more)


# paths


@query(f"""{WITH} SELECT trace_id, regexp_matches(arguments, '"k"') AS there, arguments LIKE '%null%' AS is_null,
CASE WHEN regexp_matches(arguments, '"k"') THEN regexp_extract(arguments, '"k":([^,}}]*)', 1) END AS json FROM calls WHERE pos = 0""")
def path_extract(spark, sf):
    f = resolve("output.tool_calls[0].arguments.k")
    return d.traces(spark, sf).select("trace_id", f.present.alias("there"), (f.present & f.is_null).alias("is_null"), f.json.alias("json"))


@query(f"{WITH} SELECT trace_id, arg_max(name, pos) AS name, count(*) > 2 AS has_third FROM calls GROUP BY trace_id")
def path_negative_index(spark, sf):
    return d.traces(spark, sf).select("trace_id", resolve("output.tool_calls[-1].name").text.alias("name"), resolve("output.tool_calls.2").present.alias("has_third"))


@query(f"""{WITH}, t AS (SELECT DISTINCT trace_id, user_id FROM calls)
SELECT CASE WHEN user_id % 5 = 0 THEN 'missing' WHEN user_id % 5 = 1 THEN 'null' ELSE 'value' END AS state, count(*) AS n FROM t GROUP BY 1""")
def path_missing_vs_null(spark, sf):
    f = resolve("ground_truth.tool_calls")
    state = F.when(f.missing, "missing").when(f.is_null, "null").otherwise("value")
    return d.traces(spark, sf).select(state.alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT trace_id, true AS there, true AS is_null FROM calls GROUP BY trace_id")
def path_typed_field(spark, sf):
    """output.text is unset in these traces: there, and null."""
    f = resolve("output.text")
    return d.traces(spark, sf).select("trace_id", f.present.alias("there"), f.is_null.alias("is_null"))


# deterministic checks


@query(f"""{WITH} SELECT trace_id, CASE WHEN user_id % 5 > 0 THEN true END AS passed, CASE WHEN user_id % 5 > 0 THEN 1::DOUBLE END AS score FROM calls WHERE pos = 0""")
def exact_match_norm(spark, sf):
    return verdicts(ExactMatch("first", "output.tool_calls[0].name", "ground_truth.first", lower=True).apply(d.traces(spark, sf)))


@query(f"""{WITH} SELECT trace_id, CASE WHEN user_id % 5 > 0 THEN false END AS passed, CASE WHEN user_id % 5 > 0 THEN 0::DOUBLE END AS score,
CASE WHEN user_id % 5 = 0 THEN 'not applicable: no value at ground_truth.first' ELSE 'expected ''' || upper(name) || ''', got ''' || name || '''' END AS explanation FROM calls WHERE pos = 0""")
def exact_match_case(spark, sf):
    return verdicts(ExactMatch("first", "output.tool_calls[0].name", "ground_truth.first").apply(d.traces(spark, sf)), "explanation")


@query(f"{WITH} SELECT trace_id, CAST(NULL AS BOOLEAN) AS passed, CAST(NULL AS DOUBLE) AS score, 'not applicable: no expected path' AS explanation FROM calls WHERE pos = 0")
def exact_match_na(spark, sf):
    return verdicts(ExactMatch("first", "output.tool_calls[0].name").apply(d.traces(spark, sf)), "explanation")


def _match_sql(got: str, want: str, ordered: bool) -> str:
    """Verdicts from both sides' calls as texts: names with reduced arguments."""
    reduce = "CASE WHEN {a} IN ('{{}}', '{{\"k\":null}}') THEN '' ELSE {a} END"
    a = "name || ' ' || " + reduce.format(a=got)
    b = "name || ' ' || " + reduce.format(a=want)
    order_a, order_b = ("pos", "event_id") if ordered else (a, b)
    return f"""{WITH}, n AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS c, row_number() OVER (PARTITION BY trace_id ORDER BY event_id) AS r,
      CASE WHEN user_id % 2 = 1 THEN regexp_replace(arguments, '"k":(-?[0-9]+)', '"k":"\\1"') ELSE arguments END AS wanted,
      regexp_replace(arguments, '"k":(-?[0-9]+)', '"k":"\\1"') AS as_text FROM calls),
    s AS (SELECT trace_id, any_value(user_id) AS u, list({a} ORDER BY {order_a}) AS got,
      coalesce(list({b} ORDER BY {order_b}) FILTER (user_id % 5 <> 4 OR r < c), []) AS want FROM n GROUP BY trace_id)
    SELECT trace_id, CASE WHEN u % 5 = 0 THEN NULL WHEN u % 5 = 1 THEN false ELSE got = want END AS passed, CASE WHEN u % 5 = 0 THEN NULL WHEN u % 5 = 1 THEN 0::DOUBLE WHEN got = want THEN 1::DOUBLE ELSE 0::DOUBLE END AS score FROM s"""


IGNORED = ("node", "error", "result")


def _json_match(spark, sf, **options) -> DataFrame:
    return verdicts(JsonMatch("calls", "output.tool_calls", "ground_truth.tool_calls", MatchOptions(**options)).apply(d.traces(spark, sf)))


@query(_match_sql("arguments", "wanted", True))
def json_match_strict(spark, sf):
    return _json_match(spark, sf, ignore_paths=IGNORED)


@query(_match_sql("arguments", "wanted", False))
def json_match_ignore_order(spark, sf):
    return _json_match(spark, sf, ignore_paths=IGNORED, ignore_order=True)


@query(_match_sql("as_text", "regexp_replace(wanted, '\"k\":(-?[0-9]+)', '\"k\":\"\\1\"')", False))
def json_match_coerce(spark, sf):
    return _json_match(spark, sf, ignore_paths=IGNORED, ignore_order=True, coerce_types=True)


@query(_match_sql("arguments", "wanted", True))
def json_match_extra(spark, sf):
    """Fields that only the recorded calls have are extra, and allowed."""
    return _json_match(spark, sf, allow_extra_arguments=True)


_VIOLATIONS = f"""{WITH}, p AS (SELECT *, name || '|' || arguments AS print FROM calls), f AS (SELECT *, min(pos) OVER (PARTITION BY trace_id, print) AS first FROM p),
v AS (
  SELECT trace_id, pos, name, 'unregistered_tool' AS code FROM f WHERE name = 'error'
  UNION ALL SELECT trace_id, pos, name, 'unknown_node' FROM f WHERE name <> 'error' AND node = 'nowhere'
  UNION ALL SELECT trace_id, pos, name, 'not_permitted_at_node' FROM f WHERE name = 'purchase' AND node = 'triage'
  UNION ALL SELECT trace_id, pos, name, 'invalid_arguments' FROM f WHERE name IN ('view', 'purchase') AND arguments IN ('{{}}', '{{"k":null}}')
  UNION ALL SELECT trace_id, pos, name, 'invalid_arguments' FROM f WHERE name <> 'error' AND arguments = '{{"k":"x"}}'
  UNION ALL SELECT trace_id, pos, name, 'invalid_arguments' FROM f WHERE name IN ('click', 'view', 'purchase') AND arguments LIKE '%extra%'
  UNION ALL SELECT trace_id, pos, name, 'invalid_arguments' FROM f WHERE name = 'purchase' AND regexp_matches(arguments, '"k":4')
  UNION ALL SELECT trace_id, pos, name, CASE name WHEN 'purchase' THEN 'duplicate_side_effecting' ELSE 'duplicate_undeclared' END FROM f WHERE name IN ('purchase', 'view') AND first < pos)"""


def _registry(traces: DataFrame) -> DataFrame:
    return ToolRegistryCheck("registry", d.REGISTRY).apply(traces)


@query(f"{_VIOLATIONS}, t AS (SELECT trace_id, count(*) FILTER (code <> 'duplicate_undeclared') AS bad, count(*) AS n FROM v GROUP BY trace_id) SELECT DISTINCT c.trace_id, coalesce(bad, 0) = 0 AS passed, CASE WHEN coalesce(bad, 0) = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS score, coalesce(n, 0) AS violations FROM calls c LEFT JOIN t USING (trace_id)")
def registry_verdicts(spark, sf):
    found = F.from_json("raw_output", "violations array<struct<code:string>>")["violations"]
    return _registry(d.traces(spark, sf)).select("trace_id", "passed", "score", F.coalesce(F.size(found), F.lit(0)).cast("long").alias("violations"))


@query(f"{_VIOLATIONS} SELECT trace_id, CAST(pos AS BIGINT) AS call, name AS tool, code, count(*) AS n FROM v GROUP BY ALL")
def registry_violations(spark, sf):
    item = F.explode(F.from_json("raw_output", "violations array<struct<code:string,call:int,tool:string,message:string>>")["violations"])
    return _registry(d.traces(spark, sf)).select("trace_id", item.alias("v")).groupBy("trace_id", F.col("v.call").cast("long").alias("call"), "v.tool", "v.code").agg(F.count("*").alias("n"))


@query(f"{_VIOLATIONS} SELECT code, count(*) AS n, string_agg(DISTINCT name, ', ' ORDER BY name) AS tools, min(trace_id) AS example FROM v GROUP BY code")
def report_violations(spark, sf):
    return report.violations(_registry(d.traces(spark, sf)))


@query(f"""{WITH} SELECT trace_id, CASE WHEN count(error) > 0 THEN count(*) FILTER (error <> '') = 0 END AS passed,
CASE WHEN count(error) = 0 THEN NULL WHEN count(*) FILTER (error <> '') = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS score FROM calls GROUP BY trace_id""")
def outcome_verdicts(spark, sf):
    return verdicts(ToolCallOutcome("outcome").apply(d.traces(spark, sf)))


@query(f"""{WITH} SELECT trace_id, CASE WHEN count(status) > 0 THEN count(*) FILTER (status = 'failed') = 0 END AS passed,
CASE WHEN count(status) = 0 THEN NULL WHEN count(*) FILTER (status = 'failed') = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS score FROM calls GROUP BY trace_id""")
def outcome_failure_values(spark, sf):
    return verdicts(ToolCallOutcome("status", error_field="result.status", failure_values=("failed", "error")).apply(d.traces(spark, sf)))


@query(f"{WITH} SELECT name AS tool, error, count(*) AS n, min(trace_id) AS example FROM calls WHERE error <> '' GROUP BY name, error")
def report_failures(spark, sf):
    return report.failures(ToolCallOutcome("outcome").apply(d.traces(spark, sf)))


def _event_traces(spark, sf, calls: Callable[..., list], truth=None) -> DataFrame:
    """A trace per event, with calls (name, arguments) made of its id."""
    i = F.col("event_id")
    one = lambda name, args: F.struct(F.lit(name).alias("name"), args.alias("arguments"), *[F.lit(None).cast("string").alias(n) for n in ("call_id", "node", "result", "error")])
    output = F.struct(F.lit(None).cast("string").alias("text"), F.array(*[one(n, a) for n, a in calls(i)]).alias("tool_calls"), F.lit(None).cast("array<struct<type:string,uri:string,duration_ms:bigint,mime:string>>").alias("artifacts"))
    return spark.read.parquet(f"{sf}/events.parquet").select(i.cast("string").alias("trace_id"), output.alias("output"), (truth(i) if truth else F.lit(None).cast("string")).alias("ground_truth"))


_BY_EVENT = "SELECT CAST(event_id AS VARCHAR) AS trace_id, {p} AS passed, CASE WHEN {p} THEN 1::DOUBLE ELSE 0::DOUBLE END AS score FROM events"


@query(_BY_EVENT.format(p="event_id % 3 <> 0"))
def json_match_number_text(spark, sf):
    """Under coerce_types 45.0 is the text 45.0, not 45, which a third of the truths say."""
    t = _event_traces(spark, sf, lambda i: [("f", F.concat(F.lit('{"x":'), i, F.lit(".0}")))], lambda i: F.concat(F.lit('{"calls":[{"name":"f","arguments":{"x":"'), i, F.when(i % 3 == 0, "").otherwise(".0"), F.lit('"}}]}')))
    return verdicts(JsonMatch("calls", "output.tool_calls", "ground_truth.calls", MatchOptions(coerce_types=True)).apply(t))


@query(_BY_EVENT.format(p="event_id % 3 <> 0"))
def json_match_kept_nulls(spark, sf):
    """Nulls inside arguments count where they aren't taken as missing; a third of the truths lack theirs."""
    t = _event_traces(spark, sf, lambda i: [("f", F.lit('{"x":null,"y":1}'))], lambda i: F.concat(F.lit('{"calls":[{"name":"f","arguments":{'), F.when(i % 3 == 0, "").otherwise('"x":null,'), F.lit('"y":1}}]}')))
    return verdicts(JsonMatch("calls", "output.tool_calls", "ground_truth.calls", MatchOptions(treat_null_as_missing=False)).apply(t))


def _small_registry():
    from .registry import Registry

    return Registry.of({"tools": {"pay": {"description": "Pay.", "side_effecting": True, "allow_extra_arguments": True, "arguments": {"c.d": {"type": "number", "required": True}}}}, "nodes": {}})


@query(_BY_EVENT.format(p="event_id % 3 = 1"))
def registry_argument_names(spark, sf):
    """An argument named c.d isn't d inside c, and a list is no arguments."""
    t = _event_traces(spark, sf, lambda i: [("pay", F.when(i % 3 == 0, '{"c":{"d":1}}').when(i % 3 == 1, '{"c.d":1}').otherwise("[1]"))])
    return verdicts(ToolRegistryCheck("registry", _small_registry()).apply(t))


@query(_BY_EVENT.format(p="event_id % 2 = 1"))
def registry_number_text(spark, sf):
    """5 and 5.0 are different calls; the same call twice is a duplicate, in whatever order its keys are."""
    t = _event_traces(spark, sf, lambda i: [("pay", F.lit('{"c.d":5,"e":1}')), ("pay", F.when(i % 2 == 1, '{"c.d":5.0,"e":1}').otherwise('{"e":1,"c.d":5}'))])
    return verdicts(ToolRegistryCheck("registry", _small_registry()).apply(t))


@query(_BY_EVENT.format(p="event_id % 3 <> 0"))
def json_match_truth_number_text(spark, sf):
    """45.0 in the truth is 45.0 in the call, and not 45, also under coerce_types."""
    t = _event_traces(spark, sf, lambda i: [("f", F.concat(F.lit('{"x":'), i, F.lit(".0,\"y\":[1,2.50]}")))], lambda i: F.concat(F.lit('{"calls":[{"name":"f","arguments":{"y":[1,2.5],"x":'), i, F.when(i % 3 == 0, "").otherwise(".0"), F.lit("}}]}")))
    return verdicts(JsonMatch("calls", "output.tool_calls", "ground_truth.calls", MatchOptions(coerce_types=True)).apply(t))


@query(_BY_EVENT.format(p="event_id % 3 <> 0"))
def registry_swapped_numbers(spark, sf):
    """{a:5, b:5.0} and {a:5.0, b:5} are different calls, whatever order their keys have."""
    other = lambda i: F.when(i % 3 == 0, '{"b":5.0,"c.d":5}').when(i % 3 == 1, '{"b":5,"c.d":5.0}').otherwise('{"c.d":5,"b":"5.0"}')
    t = _event_traces(spark, sf, lambda i: [("pay", F.lit('{"c.d":5,"b":5.0}')), ("pay", other(i))])
    return verdicts(ToolRegistryCheck("registry", _small_registry()).apply(t))


def _many_tools():
    from .registry import Registry

    argument = lambda n: {"rate": {"type": "number", "required": True, "enum": [n, 0.5]}, "label": {"type": "string"}}
    return Registry.of({"tools": {f"tool_{n}": {"description": f"Tool {n}.", "side_effecting": False, "arguments": argument(float(n))} for n in range(500)}, "nodes": {f"node_{n}": {"tools": [f"tool_{n}", f"tool_{(n + 1) % 500}"]} for n in range(500)}})


@query("""SELECT CAST(event_id AS VARCHAR) AS trace_id, CASE WHEN event_id % 600 >= 500 THEN 'unregistered_tool' WHEN event_id % 5 = 1 THEN 'not_permitted_at_node' WHEN event_id % 5 = 2 THEN 'unknown_node' WHEN event_id % 5 = 3 THEN 'invalid_arguments' END AS code FROM events""")
def registry_of_500_tools(spark, sf):
    """Enums of numbers hold whole ones as numbers: tool 7 takes 7 and 7.0, or 0.5."""
    i, n = F.col("event_id"), F.col("event_id") % 600
    rate = F.when(i % 5 == 3, F.concat((n + 1).cast("string"), F.lit(".5"))).when(i % 2 == 0, n.cast("string")).when(i % 3 == 0, "0.50").otherwise(F.concat(n.cast("string"), F.lit(".0")))
    node = F.when(i % 5 == 1, F.concat(F.lit("node_"), (n + 2) % 500)).when(i % 5 == 2, "nowhere").otherwise(F.concat(F.lit("node_"), (n + i % 2 * 499) % 500))
    call = F.struct(F.concat(F.lit("tool_"), n).alias("name"), F.concat(F.lit('{"rate":'), rate, F.lit("}")).alias("arguments"), F.lit(None).cast("string").alias("call_id"), node.alias("node"), F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("error"))
    output = F.struct(F.lit(None).cast("string").alias("text"), F.array(call).alias("tool_calls"))
    traces = spark.read.parquet(f"{sf}/events.parquet").select(i.cast("string").alias("trace_id"), output.alias("output"))
    found = F.from_json("raw_output", "violations array<struct<code:string>>")["violations"]
    return ToolRegistryCheck("registry", _many_tools()).apply(traces).select("trace_id", F.array_join(F.transform(found, lambda x: x["code"]), ",").alias("code"))


@query("SELECT CAST(event_id AS VARCHAR) AS trace_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN value > 40 THEN true ELSE false END AS passed, event_id % 7 = 0 AS errored FROM events")
def errors_cost_their_rows(spark, sf):
    """A function that raises for some traces makes errored rows of these alone."""

    def cheap(value, nth):
        if nth % 7 == 0:
            raise KeyError("no price")
        return value > 40

    e = spark.read.parquet(f"{sf}/events.parquet")
    truth = F.concat(F.lit('{"value":'), F.col("value").cast("string"), F.lit(',"nth":'), F.col("event_id"), F.lit("}"))
    traces = e.select(F.col("event_id").cast("string").alias("trace_id"), truth.alias("ground_truth"))
    done = suite.run_suite(traces, [PythonCheck("price", cheap, {"value": "ground_truth.value", "nth": "ground_truth.nth"})])
    return done.select("trace_id", "passed", F.col("error").isNotNull().alias("errored"))


_PROPS_SCHEMA = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 80}, "list": {"type": "array", "items": {"type": ["integer", "null"], "exclusiveMaximum": 3}, "maxItems": 3}, "kind": {"enum": ["click", "view", 1.0]}}, "required": ["k"], "additionalProperties": False}


@query("""WITH e AS (SELECT event_id, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS k, event_type FROM events)
SELECT CAST(event_id AS VARCHAR) AS trace_id, event_id % 11 <> 0 AND k BETWEEN 10 AND 80 AND event_id % 5 <> 4 AND event_id % 13 <> 0 AND (event_type IN ('click', 'view') OR event_id % 3 = 0) AS passed FROM e""")
def json_schema_verdicts(spark, sf):
    """Bounds, items, enums and undeclared keys of a schema over free-form values."""
    i = F.col("event_id")
    k = F.regexp_extract("props", r"(-?[0-9]+)", 1)
    body = F.concat(
        F.lit("{"), F.when(i % 11 == 0, "").otherwise(F.concat(F.lit('"k":'), k, F.when(i % 2 == 0, ".0").otherwise(""), F.lit(","))), F.lit('"list":[1,null'), F.when(i % 5 == 4, ",3").otherwise(",-2"), F.lit('],"kind":'),
        F.when(i % 3 == 0, "1").otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))), F.when(i % 13 == 0, ',"more":{}').otherwise(""), F.lit("}"),
    )
    traces = spark.read.parquet(f"{sf}/events.parquet").select(i.cast("string").alias("trace_id"), F.concat(F.lit('{"o":'), body, F.lit("}")).alias("ground_truth"))
    return JsonSchema("shape", "ground_truth.o", schema=_PROPS_SCHEMA).apply(traces).select("trace_id", "passed")


# judged checks, with the mock judge


def _selection(**more) -> ToolSelection:
    return ToolSelection("selection", d.REGISTRY, JUDGE, **more)


_SELECTED = f"""{WITH}, s AS (SELECT trace_id, any_value(node) AS node, string_agg(DISTINCT name, ', ') AS names, count(*) FILTER (name <> 'click') = 0 AS passed FROM calls GROUP BY trace_id)"""


@query(f"{_SELECTED} SELECT trace_id, CASE WHEN node IS DISTINCT FROM 'nowhere' THEN passed END AS passed, CASE WHEN node = 'nowhere' THEN NULL WHEN passed THEN 1::DOUBLE ELSE 0::DOUBLE END AS score, CASE WHEN node IS DISTINCT FROM 'nowhere' THEN '\"click\"' END AS ground_truth FROM s")
def selection_mock(spark, sf):
    return verdicts(_selection().apply(d.traces(spark, sf)), "ground_truth")


_ORDERED = f"""{WITH}, u AS (SELECT trace_id, node, name, min(pos) AS pos FROM calls GROUP BY ALL),
s AS (SELECT trace_id, any_value(node) AS node, string_agg(name, ',' ORDER BY pos) AS called FROM u GROUP BY trace_id)"""


@query(f"{_ORDERED} SELECT called, 'click' AS judge_says, count(*) AS n, min(trace_id) AS example FROM s WHERE node IS DISTINCT FROM 'nowhere' AND called <> 'click' GROUP BY called")
def report_selection(spark, sf):
    return report.selection(_selection().apply(d.traces(spark, sf)))


_CHATS = "WITH" + d.CHATS_SQL


@query(f"{_CHATS} SELECT trace_id, CASE WHEN coalesce(trim(reply), '') <> '' THEN true END AS passed, CASE WHEN coalesce(trim(reply), '') <> '' THEN 1::DOUBLE END AS score FROM chats")
def consistency_mock(spark, sf):
    return verdicts(TextMatchesTools("consistent", JUDGE).apply(d.chats(spark, sf)))


def _question(**more) -> LlmQuestion:
    return LlmQuestion("question", "Is this polite? {{ request }}", {"request": "input.user_request"}, JUDGE, **more)


@query(f"{_CHATS} SELECT trace_id, toxic = 0 AS passed, CASE WHEN toxic = 0 THEN 1::DOUBLE WHEN toxic = 1 THEN 0::DOUBLE END AS score, 'true' AS normalized_prediction FROM chats")
def question_boolean(spark, sf):
    return verdicts(_question(ground_truth="ground_truth.clean").apply(d.chats(spark, sf)), "normalized_prediction")


@query(f"{_CHATS} SELECT trace_id, CASE WHEN toxic IS NOT NULL THEN false END AS passed, CASE WHEN toxic IS NOT NULL THEN 0::DOUBLE END AS score, '\"true\"' AS normalized_prediction FROM chats")
def question_label_map(spark, sf):
    """The first choice, mapped to a text, is no boolean."""
    return verdicts(_question(matcher="label_map", choices=("yes", "no"), labels={"yes": "true"}, ground_truth="ground_truth.clean").apply(d.chats(spark, sf)), "normalized_prediction")


@query(f"{_CHATS} SELECT trace_id, quality = 0 AS passed, CASE WHEN quality = 0 THEN 1::DOUBLE WHEN quality = 1 THEN 0::DOUBLE END AS score FROM chats")
def question_numeric(spark, sf):
    return verdicts(_question(matcher="numeric_tolerance", ground_truth="ground_truth.quality").apply(d.chats(spark, sf)))


@query(f"{_CHATS} SELECT trace_id, CAST(NULL AS BOOLEAN) AS passed, CAST(NULL AS DOUBLE) AS score, 'mock answer [measured but not calibrated: no ground truth]' AS explanation FROM chats")
def question_uncalibrated(spark, sf):
    return verdicts(_question().apply(d.chats(spark, sf)), "explanation")


@query(f"{_CHATS}, p AS (SELECT user_request FROM chats) SELECT count(*) AS prompts, count(DISTINCT coalesce(user_request, 'None')) AS asked, 0.001::DOUBLE * count(DISTINCT coalesce(user_request, 'None')) AS cost_usd, count(*) AS hits_on_second_run FROM p")
def judge_cache(spark, sf):
    """A prompt is asked once; on a second run all are known."""
    traces = d.chats(spark, sf)
    one = _question()
    first = one.apply(traces)
    second = _question(cache=one.fresh).apply(traces)
    a = first.agg(F.count("*").alias("prompts"), F.count(F.when(~F.col("cache_hit"), 1)).alias("asked"), F.sum("cost_usd").alias("cost_usd"))
    return a.crossJoin(second.agg(F.count(F.when(F.col("cache_hit") & (F.col("cost_usd") == 0), 1)).alias("hits_on_second_run")))


# suite and summary


CHECKS = lambda: [
    ExactMatch("exact", "output.tool_calls[0].name", "ground_truth.first", lower=True),
    ToolRegistryCheck("registry", d.REGISTRY),
    ToolCallOutcome("outcome"),
    _selection(),
]

_SUITE = f"""{_VIOLATIONS}, x AS (
  SELECT trace_id, 'exact' AS evaluator_id, CASE WHEN user_id % 5 > 0 THEN true END AS passed FROM calls WHERE pos = 0
  UNION ALL SELECT trace_id, 'registry', count(code) FILTER (code <> 'duplicate_undeclared') = 0 FROM (SELECT DISTINCT trace_id FROM calls) LEFT JOIN v USING (trace_id) GROUP BY trace_id
  UNION ALL SELECT trace_id, 'outcome', CASE WHEN count(error) > 0 THEN count(*) FILTER (error <> '') = 0 END FROM calls GROUP BY trace_id
  UNION ALL SELECT trace_id, 'selection', CASE WHEN any_value(node) IS DISTINCT FROM 'nowhere' THEN count(*) FILTER (name <> 'click') = 0 END FROM calls GROUP BY trace_id)"""


@query(f"""{_SUITE} SELECT evaluator_id, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (passed IS NULL) AS not_applicable,
0 AS errored, 0 AS invalid_output, count(*) FILTER (passed) / nullif(count(*) FILTER (passed IS NOT NULL), 0) AS pass_rate FROM x GROUP BY evaluator_id""")
def summary_by_check(spark, sf):
    checks = CHECKS()
    return suite.summarize(suite.run_suite(d.traces(spark, sf), checks), checks).drop("cost_usd")


@query(f"{_SUITE} SELECT evaluator_id, passed, count(*) AS n FROM x GROUP BY evaluator_id, passed")
def tally(spark, sf):
    return suite.run_suite(d.traces(spark, sf), CHECKS()).groupBy("evaluator_id", "passed").agg(F.count("*").alias("n"))


@query(f"{_SUITE} SELECT trace_id, evaluator_id FROM x WHERE NOT passed")
def failed_rows(spark, sf):
    return suite.failures(suite.run_suite(d.traces(spark, sf), CHECKS())).select("trace_id", "evaluator_id")


@query(f"{_CHATS}, q AS (SELECT DISTINCT coalesce(user_request, 'None') AS r FROM chats) SELECT (SELECT count(*) FROM chats) AS rows, 0.001::DOUBLE * count(*) AS cost_usd, 100 * count(*) AS tokens_in, 20 * count(*) AS tokens_out, (SELECT count(*) FROM chats) - count(*) AS cache_hits FROM q")
def run_totals(spark, sf):
    return suite.run_totals(_question().apply(d.chats(spark, sf)))


@query(f"{WITH} SELECT count(DISTINCT trace_id) AS traces FROM calls")
def report_trace_count(spark, sf):
    t = d.traces(spark, sf)
    return report.trace_count(_registry(t), ToolCallOutcome("outcome").apply(t))


@query(f"{_SUITE} SELECT evaluator_id, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (passed IS NULL) AS skipped, 0 AS invalid, 0 AS errored FROM x WHERE evaluator_id = 'selection' GROUP BY 1")
def report_coverage(spark, sf):
    return report.coverage(_selection().apply(d.traces(spark, sf))).withColumn("evaluator_id", F.lit("selection"))


def _contradicting(prompt: dict, schema: dict, config) -> "Reply":
    """A judge that finds every third reply inconsistent, by its length."""
    import json

    from .operators.judge import Reply

    reply = prompt["messages"][0]["content"].rpartition("\n\nCalls:\n")[0].removeprefix("Reply:\n")
    return Reply(json.dumps({"consistent": len(reply) % 3 > 0, "contradiction": "it trails off", "reason": "too round"}), 1, 1, 0.001)


@query(f"""{_CHATS} SELECT trace_id, 'none' AS called, 'reply says ''it trails off'' - too round' AS explanation FROM chats WHERE regexp_replace(coalesce(reply, ''), '\\s', '', 'g') <> '' AND length(reply) % 3 = 0""")
def report_contradictions(spark, sf):
    """Replies against their calls, by a judge that contradicts some."""
    return report.contradictions(TextMatchesTools("consistent", JUDGE, provider=_contradicting).apply(d.chats(spark, sf)))


_RUBRIC = (RubricQuestion("clean", "Is it clean?", ground_truth="ground_truth.clean"), RubricQuestion("quality", "How good is it?", "integer", low=0, high=1, ground_truth="ground_truth.quality"), RubricQuestion("tone", "Which tone?", "enum", ("calm", "rude")), RubricQuestion("kind", "Is it kind?"))


@query(f"""{_CHATS}, q(name, n) AS (VALUES ('clean', 0), ('quality', 1), ('tone', 2), ('kind', 3)), x AS (SELECT trace_id, 'rubric.' || name AS evaluator_id, n, CASE name WHEN 'clean' THEN toxic = 0 WHEN 'quality' THEN quality = 0 WHEN 'kind' THEN true END AS passed, CASE name WHEN 'quality' THEN '0' WHEN 'tone' THEN '"calm"' ELSE 'true' END AS answer,
row_number() OVER (PARTITION BY coalesce(user_request, 'None'), n ORDER BY trace_id) AS k FROM chats, q)
SELECT evaluator_id, passed, answer, count(*) AS rows, count(*) FILTER (n = 0 AND k = 1) AS billed FROM x GROUP BY 1, 2, 3""")
def rubric_rows(spark, sf):
    """Four questions in one call: four rows a trace, and one bill a prompt."""
    done = Rubric("rubric", _RUBRIC, {"request": "input.user_request"}, JUDGE).apply(d.chats(spark, sf))
    return done.groupBy("evaluator_id", "passed", F.col("normalized_prediction").alias("answer")).agg(F.count("*").alias("rows"), F.count(F.when(F.col("cost_usd") > 0, 1)).alias("billed"))


# feedback




_FED = f"""{_SELECTED}, w AS (SELECT *, user_in(trace_id) % 10 = 0 AS sealed FROM s)""".replace("user_in(trace_id)", "CAST(split_part(trace_id, '-', 2) AS BIGINT)")


def _classified(spark, sf) -> DataFrame:
    t = d.traces(spark, sf)
    sealed = t.where(F.split("trace_id", "-")[1].cast("long") % 10 == 0)
    return feedback.classify(_selection().apply(t), t, d.REGISTRY, sealed)


@query(f"{_FED} SELECT CASE WHEN sealed THEN 'in_sealed_test_split' WHEN node = 'nowhere' THEN 'not_applicable' ELSE 'passed' END AS drop_reason, count(*) AS n FROM w WHERE sealed OR node = 'nowhere' OR passed GROUP BY 1")
def feedback_drops(spark, sf):
    return feedback.drops(_classified(spark, sf))


@query(f"""{_FED} SELECT trace_id, '[{{"role":"user","content":"user ' || split_part(trace_id, '-', 2) || '"}}]' AS prompt, '[{{"arguments":{{}},"name":"click"}}]' AS chosen FROM w WHERE NOT sealed AND node IS DISTINCT FROM 'nowhere' AND NOT passed""")
def feedback_rows(spark, sf):
    return feedback.dataset_rows(_classified(spark, sf)).select("trace_id", "prompt", "chosen")


@query(f"{_FED} SELECT count(*) FILTER (NOT sealed AND node IS DISTINCT FROM 'nowhere' AND NOT passed) AS rows FROM w")
def feedback_without_sealed(spark, sf):
    return _classified(spark, sf).where("drop_reason is null").agg(F.count("*").alias("rows"))


@query(f"{_FED} SELECT 'proposal_failed_argument_check' AS drop_reason, count(*) AS n FROM w WHERE NOT passed AND node IS DISTINCT FROM 'nowhere' UNION ALL SELECT CASE WHEN node = 'nowhere' THEN 'not_applicable' ELSE 'passed' END, count(*) FROM w WHERE node = 'nowhere' OR passed GROUP BY 1")
def feedback_argument_check(spark, sf):
    """Against a registry whose first tool needs an argument, the mock's empty proposal fails."""
    from dataclasses import replace

    from .registry import Argument

    t = d.traces(spark, sf)
    strict = replace(d.REGISTRY, tools={**d.REGISTRY.tools, "click": replace(d.REGISTRY.tools["click"], arguments={"k": Argument("integer", True)})})
    return feedback.drops(feedback.classify(_selection().apply(t), t, strict))


# sources and storage


@query(f"{WITH}, t AS (SELECT DISTINCT trace_id, user_id FROM calls) SELECT CASE WHEN user_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM t GROUP BY 1")
def split_counts(spark, sf):
    split = F.when(F.split("trace_id", "-")[1].cast("long") % 10 == 0, "test").otherwise("train")
    kept = store.Store(spark, shared_path(spark, "store"))
    print_, _ = kept.write_snapshot("p", d.traces(spark, sf), {"type": "events"}, split)
    return kept.split_counts("p", print_)


@query("SELECT CAST(conv_id AS VARCHAR) AS trace_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_trace_ids(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").cast("string").alias("trace_id"))
    return store.duplicate_ids(rows)


@query("SELECT count(*) AS rows, count(DISTINCT regexp_extract(props, '(-?[0-9]+)', 1)) AS distinct_contents FROM events")
def content_hash_dedupe(spark, sf):
    h = content_hash(canonical_json("props"))
    return spark.read.parquet(f"{sf}/events.parquet").agg(F.count("*").alias("rows"), F.countDistinct(h).alias("distinct_contents"))


@query("SELECT DISTINCT sha256('{\"k\":' || regexp_extract(props, '(-?[0-9]+)', 1) || '}') AS content_hash FROM events")
def content_hashes(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(content_hash(canonical_json("props")).alias("content_hash")).distinct()


@query("SELECT 'props' AS field UNION ALL SELECT 'value'")
def unmapped_fields(spark, sf):
    from .sources.jsonl import unmapped_fields as unmapped

    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props")).alias("data"))
    return unmapped(rows, {"trace_id": "event_id", "metadata.user": "user_id", "output.text": "event_type"})


@query(f"{_CHATS} SELECT trace_id, n_messages AS messages, user_request FROM chats")
def messages_prompt(spark, sf):
    return d.chats(spark, sf).select("trace_id", F.size("input.messages").cast("long").alias("messages"), F.col("input.user_request").alias("user_request"))


@query("SELECT CAST(event_id AS VARCHAR) AS trace_id, event_type AS text FROM events")
def mapped_traces(spark, sf):
    from .sources.jsonl import mapped, to_traces

    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("string").alias("source_id"), F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "event_type")).alias("data"))
    traces, _ = to_traces(mapped(rows, {"trace_id": "event_id", "output.text": "event_type"}))
    return traces.select("trace_id", F.col("output.text").alias("text"))


@query("""SELECT CAST(event_id AS VARCHAR) AS source_id, CASE event_id % 5 WHEN 1 THEN 'output.tool_calls: must be of kind array, found string' WHEN 2 THEN 'input: must be of kind object, found string'
WHEN 3 THEN 'input: unknown field: bogus' WHEN 4 THEN 'output.tool_calls: unknown field: tool' END AS problem FROM events""")
def ingest_problems(spark, sf):
    """Values of the wrong kind and unknown keys are reported with their row; the others become traces."""
    from .sources.jsonl import to_traces

    i = F.col("event_id")
    body = F.when(i % 5 == 1, '"output":{"tool_calls":"oops"}').when(i % 5 == 2, '"input":"str"').when(i % 5 == 3, '"input":{"bogus":1}').when(i % 5 == 4, '"output":{"tool_calls":[{"name":"f","tool":"g"}]}').otherwise('"output":{"tool_calls":[{"name":"f"}]}')
    rows = spark.read.parquet(f"{sf}/events.parquet").select(i.cast("string").alias("source_id"), F.concat(F.lit('{"trace_id":"'), i, F.lit('",'), body, F.lit("}")).alias("data"))
    traces, errors = to_traces(rows)
    why = F.expr("substring(message, length(source_id) + 3)")
    return traces.select(F.col("source_id"), F.lit(None).cast("string").alias("problem")).unionByName(errors.select("source_id", why.alias("problem")))


@query("SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def latest_of_each(spark, sf):
    """The latest row of each group: an aggregate, not a sort."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return store.last_of_each(c, "conv_id", "turn").select("conv_id", "role", "text")


# splits, intervals and gates


_SAID = """said AS (SELECT trace_id, list_distinct(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s
  FROM (SELECT trace_id, regexp_extract_all(lower(coalesce(user_request, '')), '[^\\s\\p{P}\\p{S}]+') AS w FROM chats) WHERE len(w) > 0)"""

_NEAR = f"""WITH RECURSIVE{d.CHATS_SQL}, {_SAID},
each_ AS (SELECT trace_id, len(s) AS n, unnest(s) AS x FROM said),
links AS (SELECT a.trace_id AS a, b.trace_id AS b FROM each_ a JOIN each_ b ON a.x = b.x AND a.trace_id <> b.trace_id GROUP BY a.trace_id, b.trace_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT trace_id, least(trace_id, coalesce(min(b), trace_id)) AS "group" FROM chats LEFT JOIN reach ON a = trace_id GROUP BY trace_id)"""


def _requests(spark, sf) -> DataFrame:
    return d.chats(spark, sf).select("trace_id", F.col("input.user_request").alias("request"))


@query(f"""{_NEAR} SELECT trace_id, "group" FROM groups""")
def near_duplicate_requests(spark, sf):
    """Requests that share four fifths of their five-word shingles, over any number of steps."""
    return near.near_groups(_requests(spark, sf), "trace_id", "request")


@query(f"""{_NEAR}, r AS (SELECT trace_id, row_number() OVER (ORDER BY md5('42|' || trace_id), trace_id) - 1 AS k, count(*) OVER () AS n FROM chats),
s AS (SELECT trace_id, CASE WHEN k < floor(n * 0.7 + 0.5) THEN 'train' WHEN k < floor(n * 0.85 + 0.5) THEN 'dev' ELSE 'test' END AS split FROM r)
SELECT g.trace_id, s.split FROM groups g JOIN s ON s.trace_id = g."group" """)
def guarded_split(spark, sf):
    """Exact shares, then near copies to the split of their group's first trace."""
    rows = _requests(spark, sf).withColumn("one", F.lit(1))
    return splits.assign(rows, splits.Splits("stratified_by_field", "one", guard="request"))


@query("""WITH r AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, count(*) OVER () AS n FROM events)
SELECT CAST(event_id AS VARCHAR) AS trace_id, CASE WHEN k < floor(n * 0.7 + 0.5) THEN 'train' WHEN k < floor(n * 0.85 + 0.5) THEN 'dev' ELSE 'test' END AS split FROM r""")
def split_by_time(spark, sf):
    """The newest 15 per cent are the test split."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    return splits.assign(e, splits.Splits("by_time", "ts"), key="event_id").select(F.col("event_id").cast("string").alias("trace_id"), "split")


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, CASE WHEN k < floor(n * 0.5 + 0.5) THEN 'train' ELSE 'test' END AS split, count(*) AS rows, min(event_id) AS first FROM r GROUP BY 1, 2""")
def split_by_strata(spark, sf):
    """Half of each kind of event, exactly."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    assigned = splits.assign(e, splits.Splits("stratified_by_field", "event_type", {"train": 0.5, "test": 0.5}), key="event_id")
    return e.join(assigned, "event_id").groupBy("event_type", "split").agg(F.count("*").alias("rows"), F.min("event_id").alias("first"))


def _runs(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two runs of two checks over events, and the events' slices."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    i = F.col("event_id")
    null = lambda t: F.lit(None).cast(t)

    def run(shift: int) -> DataFrame:
        high = (F.col("value") > 40 - shift) & (i % 29 != shift % 29)
        check = lambda name, passed: F.struct(F.lit(name).alias("evaluator_id"), passed.alias("passed"), F.when(passed, "true").otherwise("false").alias("normalized_prediction"))
        both = F.array(check("high", F.when(i % 17 != 0, high)), check("even", i % 2 == 0))
        return e.select(i.cast("string").alias("trace_id"), "value", F.inline(both)).select(
            "trace_id", "evaluator_id", "passed", "normalized_prediction", F.when(F.col("value") > 45, "true").otherwise("false").alias("ground_truth"), (F.col("trace_id").cast("bigint") % 50 == shift).alias("invalid_output"),
            null("string").alias("error"), (F.lit(0.001) * (1 + shift)).alias("cost_usd"), (F.col("trace_id").cast("bigint") % 100).alias("latency_ms"),
        )

    return run(0), run(3), e.select(i.cast("string").alias("trace_id"), "event_type", (F.col("user_id") % 3).alias("tier"))


_RUNS = """WITH e AS (SELECT CAST(event_id AS VARCHAR) AS trace_id, event_id AS i, value, event_type, user_id % 3 AS tier FROM events),
pairs AS (SELECT trace_id, event_type, tier, 'high' AS evaluator_id, CASE WHEN i % 17 <> 0 THEN value > 40 AND i % 29 <> 0 END AS b, CASE WHEN i % 17 <> 0 THEN value > 37 AND i % 29 <> 3 END AS c FROM e
  UNION ALL SELECT trace_id, event_type, tier, 'even', i % 2 = 0, i % 2 = 0 FROM e)"""


@query(f"""{_RUNS}, g AS (SELECT evaluator_id, event_type, tier, grouping(event_type) AS g1, grouping(tier) AS g2, count(*) FILTER (b IS NOT NULL AND c IS NOT NULL) AS decided,
    avg(CASE WHEN c IS NOT NULL THEN b::INT END) AS base_rate, avg(CASE WHEN b IS NOT NULL THEN c::INT END) AS candidate_rate, count(*) FILTER (b AND NOT c) AS regressed, count(*) FILTER (NOT b AND c) AS improved
    FROM pairs GROUP BY GROUPING SETS ((evaluator_id), (evaluator_id, event_type), (evaluator_id, tier), (evaluator_id, event_type, tier)))
SELECT evaluator_id, concat_ws(',', CASE WHEN g1 = 0 THEN 'event_type' END, CASE WHEN g2 = 0 THEN 'tier' END) AS fields,
'{{' || concat_ws(',', CASE WHEN g1 = 0 THEN '"event_type":"' || event_type || '"' END, CASE WHEN g2 = 0 THEN '"tier":"' || tier || '"' END) || '}}' AS slice, decided, round(base_rate, 9) AS base_rate, round(candidate_rate, 9) AS candidate_rate, regressed, improved,
round(least(1.0, 2 * list_sum(list_transform(range(least(regressed, improved) + 1), lambda k: exp(lgamma(regressed + improved + 1) - lgamma(k + 1) - lgamma(regressed + improved - k + 1) - (regressed + improved) * ln(2))))), 9) AS p_value FROM g""")
def run_comparison(spark, sf):
    """Two runs over all traces, by each of two slice columns, and by both, with the exact paired test."""
    base, candidate, slices = _runs(spark, sf)
    rounded = lambda c: F.round(c, 9).alias(c)
    found = promotion.compare(base, candidate, slices, [(), ("event_type",), ("tier",), ("event_type", "tier")])
    return found.select("evaluator_id", "fields", "slice", "decided", rounded("base_rate"), rounded("candidate_rate"), "regressed", "improved", rounded("p_value"))


_GATE = {"all": [{"metric": "high", "baseline_delta": 0.01}, {"metric": "even", "absolute": 0.5, "op": "<="}, {"metric": "cost_per_trace", "op": "<=", "baseline_factor": 5}], "any": [{"metric": "high", "baseline_delta": 0.0, "significant": True}, {"metric": "nothing", "absolute": 0.0}], "slices": [{"field": "event_type", "min_n": 10, "tolerance": 0.0}]}


@query(f"""{_RUNS}, w AS (SELECT evaluator_id, count(*) FILTER (b IS NOT NULL AND c IS NOT NULL) AS decided, avg(CASE WHEN c IS NOT NULL THEN b::INT END) AS base, avg(CASE WHEN b IS NOT NULL THEN c::INT END) AS candidate, count(*) FILTER (b AND NOT c) AS r, count(*) FILTER (NOT b AND c) AS m FROM pairs GROUP BY 1),
p AS (SELECT *, least(1.0, 2 * list_sum(list_transform(range(least(r, m) + 1), lambda k: exp(lgamma(r + m + 1) - lgamma(k + 1) - lgamma(r + m - k + 1) - (r + m) * ln(2))))) AS p FROM w),
s AS (SELECT evaluator_id, event_type, count(*) FILTER (b IS NOT NULL AND c IS NOT NULL) AS decided, avg(CASE WHEN c IS NOT NULL THEN b::INT END) AS base, avg(CASE WHEN b IS NOT NULL THEN c::INT END) AS candidate FROM pairs GROUP BY 1, 2)
SELECT 'all' AS part, 'high >= base + 0.01' AS rule, evaluator_id, '{{}}' AS slice, CASE WHEN candidate >= base + 0.01 - 1e-12 THEN 'pass' ELSE 'fail' END AS verdict FROM p WHERE evaluator_id = 'high'
UNION ALL SELECT 'all', 'even <= 0.5', evaluator_id, '{{}}', CASE WHEN candidate <= 0.5 + 1e-12 THEN 'pass' ELSE 'fail' END FROM p WHERE evaluator_id = 'even'
UNION ALL SELECT 'all', 'cost_per_trace <= base * 5', 'cost_per_trace', '{{}}', 'pass'
UNION ALL SELECT 'any', 'high >= base + 0', evaluator_id, '{{}}', CASE WHEN candidate >= base - 1e-12 AND p < 0.05 AND m > r THEN 'pass' ELSE 'fail' END FROM p WHERE evaluator_id = 'high'
UNION ALL SELECT 'any', 'nothing >= 0', 'nothing', '{{}}', 'fail'
UNION ALL SELECT 'slices', 'no regression by event_type', evaluator_id, '{{"event_type":"' || event_type || '"}}', CASE WHEN decided < 10 THEN 'insufficient' WHEN candidate >= base - 1e-12 THEN 'pass' ELSE 'fail' END FROM s""")
def promotion_gate(spark, sf):
    """Conditions on checks and on whole runs, and a rule for slices, as a promotion file has them."""
    base, candidate, slices = _runs(spark, sf)
    return promotion.gate(promotion.Promotion.of(_GATE), base, candidate, slices).select("part", "rule", "evaluator_id", "slice", "verdict")


_WEIGHT = " + ".join(f"(u >= {b})::INT" for b in governance.POISSON)


@query(f"""WITH x AS (SELECT CAST(event_id AS VARCHAR) AS trace_id, event_id AS i, value > 45 AS truth, event_id % 17 <> 0 AS has, value > 40 AND event_id % 29 <> 0 AS high FROM events WHERE event_id % 50 <> 0),
cells AS (SELECT trace_id, 'high' AS evaluator_id, coalesce(CASE WHEN has THEN high END, false)::INT AS yes, has::INT AS decided, coalesce(CASE WHEN has THEN high END, false) AS says, truth FROM x UNION ALL SELECT trace_id, 'even', (i % 2 = 0)::INT, 1, i % 2 = 0, truth FROM x),
u AS (SELECT *, ('0x' || substr(md5('0|' || trace_id || '|' || (r // 4)), 1 + 8 * (r % 4), 8))::BIGINT AS u FROM (SELECT *, unnest(range(40)) AS r FROM cells)),
w AS (SELECT evaluator_id, r, {_WEIGHT} AS w, yes, decided, says, truth FROM u UNION ALL SELECT evaluator_id, -1, 1, yes, decided, says, truth FROM cells),
g AS (SELECT evaluator_id, r, sum(w * yes)::DOUBLE AS yes, sum(w * decided)::DOUBLE AS decided, sum(w * (says AND truth)::INT)::DOUBLE AS tp, sum(w * (says AND NOT truth)::INT)::DOUBLE AS fp, sum(w * (NOT says AND truth)::INT)::DOUBLE AS fn, sum(w * (NOT says AND NOT truth)::INT)::DOUBLE AS tn FROM w GROUP BY 1, 2),
k AS (SELECT *, yes / decided AS rate, (tp + tn) / (tp + fp + fn + tn) AS agreed, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS chance FROM g),
m AS (SELECT evaluator_id, r, decided, rate, (agreed - chance) / (1 - chance) AS kappa FROM k),
l AS (SELECT evaluator_id, max(CASE WHEN r < 0 THEN decided END)::BIGINT AS n, max(CASE WHEN r < 0 THEN rate END) AS pass_rate, max(CASE WHEN r < 0 THEN kappa END) AS kappa, list_sort(list(rate) FILTER (r >= 0)) AS rates, list_sort(list(kappa) FILTER (r >= 0)) AS kappas FROM m GROUP BY 1)
SELECT evaluator_id, n, pass_rate, rates[1 + 0] AS pass_rate_low, rates[1 + 39] AS pass_rate_high, kappa, kappas[1 + 0] AS kappa_low, kappas[1 + 39] AS kappa_high FROM l""")
def judge_intervals(spark, sf):
    """Pass rate and kappa with bounds over 40 resamples."""
    return governance.bootstrap(_runs(spark, sf)[0], resamples=40)


# streaming


@query(f"{_VIOLATIONS}, t AS (SELECT trace_id, count(*) FILTER (code <> 'duplicate_undeclared') AS bad FROM v GROUP BY trace_id) SELECT DISTINCT c.trace_id, coalesce(bad, 0) = 0 AS passed FROM calls c LEFT JOIN t USING (trace_id)")
def streaming_registry(spark, sf):
    """The registry check over a stream of trace files, each trace once."""
    return evaluate.replayed(d.traces(spark, sf), [ToolRegistryCheck("registry", d.REGISTRY)]).select("trace_id", "passed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
