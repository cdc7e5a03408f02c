"""Schemas of traces, results and registry tables.

The outside is fixed, the inside is open: free-form values (arguments, results,
ground truth, metadata) are kept as JSON text, which is the source of truth, and
read as VARIANT on demand.
"""

from __future__ import annotations

CALL = "struct<name:string,arguments:string,call_id:string,node:string,result:string,error:string>"
ARTIFACT = "struct<type:string,uri:string,duration_ms:bigint,mime:string>"
MESSAGE = "struct<role:string,content:string>"
INPUT = f"struct<messages:array<{MESSAGE}>,user_request:string,system_prompt:string,tools_available:string>"
OUTPUT = f"struct<text:string,tool_calls:array<{CALL}>,artifacts:array<{ARTIFACT}>>"
TRACE = f"trace_id string, input {INPUT}, output {OUTPUT}, ground_truth string, metadata string, source_id string, content_hash string"

#: Fields that hold JSON text.
JSON_FIELDS = {"arguments", "result", "tools_available", "ground_truth", "metadata"}
ROLES = ("system", "user", "assistant", "tool")
ARTIFACT_TYPES = ("audio", "image", "file")

RESULT = {
    "trace_id": "string",
    "evaluator_id": "string",
    "evaluator_version": "string",
    "score": "double",
    "passed": "boolean",
    "normalized_prediction": "string",
    "ground_truth": "string",
    "explanation": "string",
    "raw_output": "string",
    "judge_config_hash": "string",
    "cache_hit": "boolean",
    "invalid_output": "boolean",
    "error": "string",
    "latency_ms": "bigint",
    "cost_usd": "double",
    "tokens_in": "bigint",
    "tokens_out": "bigint",
}
