"""Failures into preference pairs, with a histogram of all that was left out and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canon import canonical_json, version_of
from ..operators.tool_calls import argument_problems
from ..registry import NONE, Registry
from ..session import ship

PROVENANCE = {"target_source": "judge_tool_selection", "signal_provenance": "judge", "judge_health": "unmeasured"}


def classify(results: DataFrame, traces: DataFrame, registry: Registry | None, sealed: DataFrame | None = None, holdout_ids: tuple[str, ...] = ()) -> DataFrame:
    """Selection results with their traces and ``drop_reason``, the first that holds; null: a row."""
    pairs = results.join(traces.select("trace_id", "input", "output"), "trace_id")
    if sealed is not None:
        pairs = pairs.join(sealed.select("trace_id").distinct().withColumn("sealed", F.lit(True)), "trace_id", "left")
    else:
        pairs = pairs.withColumn("sealed", F.lit(False))
    v = F.try_parse_json("raw_output")
    best = F.try_variant_get(v, "$.best", "string")
    arguments = F.coalesce(F.to_json(F.try_variant_get(v, "$.arguments", "variant")), F.lit("{}"))
    pairs = pairs.withColumn("best", best).withColumn("arguments", F.when(F.col("best").isNotNull(), arguments))
    call = F.col("best") != NONE
    reason = (
        F.when(F.coalesce("sealed", F.lit(False)), "in_sealed_test_split")
        .when(F.col("evaluator_id").isin(list(holdout_ids)), "holdout_evaluator")
        .when(F.col("error").isNotNull(), "evaluator_errored")
        .when(F.col("invalid_output"), "judge_answered_unusably")
        .when(F.col("passed").isNull(), "not_applicable")
        .when(F.col("passed"), "passed")
        .when(F.col("best").isNull(), "no_judge_proposal_recorded")
    )
    if registry is None:
        reason = reason.when(call, "no_registry_to_validate_proposal")
    else:
        reason = reason.when(call & ~F.col("best").isin(list(registry.tools)), "proposal_not_in_registry")
        reason = reason.when(call & (F.size(argument_problems(registry, F.col("best"), F.col("arguments"))) > 0), "proposal_failed_argument_check")
    return pairs.withColumn("drop_reason", reason)


def dataset_rows(classified: DataFrame) -> DataFrame:
    """(trace_id, prompt, chosen, rejected, provenance…) as JSON text."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    told = F.array_compact(F.array(F.when(F.col("input.system_prompt").isNotNull(), message("system", F.col("input.system_prompt"))), message("user", F.coalesce("input.user_request", F.lit("")))))
    prompt = F.when(F.size("input.messages") > 0, F.to_json("input.messages")).otherwise(F.to_json(told))
    chosen = F.when(F.col("best") == NONE, "[]").otherwise(F.concat(F.lit('[{"arguments":'), F.col("arguments"), F.lit(',"name":'), F.to_json(F.col("best").cast("variant")), F.lit("}]")))
    calls = F.coalesce(F.col("output.tool_calls"), F.array().cast("array<struct<name:string,arguments:string,call_id:string,node:string,result:string,error:string>>"))
    rejected = F.to_json(F.transform(calls, lambda c: F.struct(F.try_parse_json(F.coalesce(c["arguments"], F.lit("{}"))).alias("arguments"), c["name"].alias("name"))))
    return classified.where("drop_reason is null").select("trace_id", prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"), *[F.lit(v).alias(k) for k, v in PROVENANCE.items()], F.col("judge_config_hash").alias("judge_version"), "evaluator_version")


def drops(classified: DataFrame) -> DataFrame:
    """(drop_reason, n), the most frequent first."""
    return classified.where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "drop_reason")


@dataclass
class Dataset:
    rows: DataFrame
    dropped: DataFrame

    def manifest(self) -> dict:
        """Row count, an order-free fingerprint and the drop histogram."""
        part = lambda k: F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\u0001", "trace_id", "prompt", "chosen", "rejected"), 256), 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string")
        row = self.rows.agg(F.count("*").alias("n"), *[part(k).alias(f"s{k}") for k in range(4)]).first()
        dropped = {r["drop_reason"]: r["n"] for r in self.dropped.collect()}
        return {"rows": row["n"], "fingerprint": version_of([row[f"s{k}"] for k in range(4)]), "dropped": dict(sorted(dropped.items())), "dropped_total": sum(dropped.values())}

    def write_jsonl(self, path: str) -> None:
        ship(self.rows.sparkSession)
        self.rows.select(canonical_json(F.to_json(F.struct(*self.rows.columns))).alias("value")).write.text(path)


def build_dpo(results: DataFrame, traces: DataFrame, registry: Registry | None, sealed: DataFrame | None = None, holdout_ids: tuple[str, ...] = ()) -> Dataset:
    classified = classify(results, traces, registry, sealed, holdout_ids)
    return Dataset(dataset_rows(classified), drops(classified))
