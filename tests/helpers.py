"""Builders of small traces."""

import json

from traceloom.sources.jsonl import to_traces


def trace(trace_id, calls=None, truth=None, text=None, request=None, metadata=None, **more):
    out = {"trace_id": trace_id, "output": {"text": text, "tool_calls": calls or []}, "input": {"user_request": request} | more.pop("input", {})}
    if truth is not None:
        out["ground_truth"] = truth
    if metadata is not None:
        out["metadata"] = metadata
    return out | more


def traces(spark, rows):
    data = spark.createDataFrame([(f"item:{i}", json.dumps(r)) for i, r in enumerate(rows)], "source_id string, data string")
    good, bad = to_traces(data)
    assert bad.count() == 0, bad.collect()
    return good.cache()
