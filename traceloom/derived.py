"""Traces derived from the driver's tables, since those hold no tool calls.

A user's events of a day are a trace; each event is a call.  The same relations
are given as DuckDB text, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import Registry
from .schema import CALL, INPUT, MESSAGE, OUTPUT

REGISTRY = Registry.of({
    "tools": {
        "click": {"description": "Click an element.", "side_effecting": False, "arguments": {"k": {"type": "integer"}}},
        "view": {"description": "View a page.", "side_effecting": None, "arguments": {"k": {"type": "integer", "required": True}}},
        "purchase": {"description": "Buy an item.", "side_effecting": True, "arguments": {"k": {"type": "integer", "required": True, "enum": [0, 1, 2, 3]}}},
        "signup": {"description": "Sign a user up.", "side_effecting": False, "allow_extra_arguments": True, "arguments": {"k": {"type": "number"}}},
    },
    "nodes": {"triage": {"tools": ["click", "view", "signup"]}, "checkout": {"tools": ["click", "view", "purchase", "signup"]}},
})


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, user_id, event_id, ts, name, arguments, node, error, result)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = (F.regexp_extract("props", r"(-?[0-9]+)", 1).cast("long") % 5).cast("string")
    i = F.col("event_id")
    arguments = (
        F.when(i % 7 == 0, "{}").when(i % 11 == 0, '{"k":"x"}').when(i % 13 == 0, F.concat(F.lit('{"k":'), k, F.lit(',"extra":true}')))
        .when(i % 17 == 0, '{"k":null}').otherwise(F.concat(F.lit('{"k":'), k, F.lit("}")))
    )
    node = F.when(F.col("user_id") % 4 == 1, "triage").when(F.col("user_id") % 4 == 2, "checkout").when(F.col("user_id") % 4 == 3, "nowhere")
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), i.cast("string"))).when(F.col("value") > 50, "")
    result = F.when(i % 3 == 0, '{"status":"failed"}').when(i % 3 == 1, '{"status":"ok"}')
    trace = F.concat_ws("-", F.lit("t"), F.col("user_id"), F.date_format("ts", "yyyyMMdd"))
    return e.select(trace.alias("trace_id"), "user_id", "event_id", "ts", F.col("event_type").alias("name"), arguments.alias("arguments"), node.alias("node"), error.alias("error"), result.alias("result"))


#: The same calls for DuckDB, with each call's position in its trace.
CALLS_SQL = """
c0 AS (SELECT 't-' || user_id || '-' || strftime(ts, '%Y%m%d') AS trace_id, user_id, event_id, ts, event_type AS name,
    CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) % 5 AS k, value FROM events),
calls AS (SELECT trace_id, user_id, event_id, ts, name, k,
    CASE WHEN event_id % 7 = 0 THEN '{}' WHEN event_id % 11 = 0 THEN '{"k":"x"}' WHEN event_id % 13 = 0 THEN '{"k":' || k || ',"extra":true}'
      WHEN event_id % 17 = 0 THEN '{"k":null}' ELSE '{"k":' || k || '}' END AS arguments,
    CASE user_id % 4 WHEN 1 THEN 'triage' WHEN 2 THEN 'checkout' WHEN 3 THEN 'nowhere' END AS node,
    CASE WHEN name = 'error' THEN 'failed ' || event_id WHEN value > 50 THEN '' END AS error,
    CASE event_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'ok' END AS status,
    row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) - 1 AS pos FROM c0)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces in the trace schema; one shuffle brings a trace's calls together.

    Ground truth: absent for users divisible by 5, stored null calls for those
    that leave 1, else the calls by event_id, k as text for odd users, without
    the last call for users that leave 4; and the first call's name, in capitals
    and blanks.
    """
    c = calls(spark, sf_dir)
    call = F.struct("name", "arguments", F.lit(None).cast("string").alias("call_id"), "node", "result", "error")
    g = c.groupBy("trace_id", "user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", call.alias("call")))).alias("x"))
    by_id = F.array_sort(F.transform("x", lambda y: F.struct(y["event_id"].alias("event_id"), y["call"].alias("call"))))
    short = F.when(F.col("user_id") % 5 == 4, F.slice(by_id, 1, F.greatest(F.size(by_id) - 1, F.lit(0)))).otherwise(by_id)

    def wanted(y):
        args = y["call"]["arguments"]
        args = F.when(F.col("user_id") % 2 == 1, F.regexp_replace(args, r'"k":(-?[0-9]+)', r'"k":"$1"')).otherwise(args)
        return F.concat(F.lit('{"name":"'), y["call"]["name"], F.lit('","arguments":'), args, F.lit("}"))

    listed = F.concat(F.lit("["), F.array_join(F.transform(short, wanted), ","), F.lit("]"))
    first = F.concat(F.lit('"first":" '), F.upper(F.col("x")[0]["call"]["name"]), F.lit(' "'))
    truth = F.when(F.col("user_id") % 5 == 1, F.concat(F.lit("{"), first, F.lit(',"tool_calls":null}'))).when(F.col("user_id") % 5 > 1, F.concat(F.lit("{"), first, F.lit(',"tool_calls":'), listed, F.lit("}")))
    tool_calls = F.transform("x", lambda y: y["call"]).cast(f"array<{CALL}>")
    given = F.struct(F.lit(None).cast(f"array<{MESSAGE}>").alias("messages"), F.concat(F.lit("user "), F.col("user_id")).alias("user_request"), F.lit(None).cast("string").alias("system_prompt"), F.lit(None).cast("string").alias("tools_available"))
    output = F.struct(F.lit(None).cast("string").alias("text"), tool_calls.alias("tool_calls"), F.lit(None).cast("array<struct<type:string,uri:string,duration_ms:bigint,mime:string>>").alias("artifacts"))
    return g.select("trace_id", given.cast(INPUT).alias("input"), output.cast(OUTPUT).alias("output"), truth.alias("ground_truth"), F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("content_hash"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces from conversations: messages, the last assistant turn as reply; labels as ground truth."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    of = lambda role: F.transform(F.filter("m", lambda x: x["role"] == role), lambda x: x["text"])
    j = g.join(labels.withColumnRenamed("doc_id", "conv_id"), "conv_id", "left")
    truth = F.when(F.col("toxic").isNotNull(), F.concat(F.lit('{"clean":'), F.when(F.col("toxic") == 0, "true").otherwise("false"), F.lit(',"quality":'), F.col("quality").cast("string"), F.lit("}")))
    given = F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"), F.get(of("user"), F.lit(0)).alias("user_request"), F.get(of("system"), F.lit(0)).alias("system_prompt"), F.lit(None).cast("string").alias("tools_available"))
    output = F.struct(F.try_element_at(of("assistant"), F.lit(-1)).alias("text"), F.array().cast(f"array<{CALL}>").alias("tool_calls"), F.lit(None).cast("array<struct<type:string,uri:string,duration_ms:bigint,mime:string>>").alias("artifacts"))
    return j.select(F.concat(F.lit("c-"), F.col("conv_id")).alias("trace_id"), given.cast(INPUT).alias("input"), output.cast(OUTPUT).alias("output"), truth.alias("ground_truth"), F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("content_hash"))


CHATS_SQL = """
chats AS (SELECT 'c-' || c.conv_id AS trace_id, c.conv_id, arg_min(text, turn) FILTER (role = 'user') AS user_request, arg_max(text, turn) FILTER (role = 'assistant') AS reply,
    count(*) AS n_messages, any_value(l.toxic) AS toxic, any_value(l.quality) AS quality FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id GROUP BY c.conv_id)"""
