"""Splits, redaction, judge metrics and promotion gates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What redaction rules may name, with their patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "phone": r"\+?\d[\d ().-]{7,}\d",
    "number": r"\b\d{12,19}\b",
}


def split_by_hash(key: Column, shares: dict[str, float], seed: int = 0) -> Column:
    """A split for each row by a hash of its key: stable, and equal keys stay together."""
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must add up to 1")
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    out, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(list(shares)[-1])


def redact(text: Column, rules: Sequence[str], salt: str | None = None) -> Column:
    """Patterns replaced by their name; with a salt, whole values by their hash."""
    if unknown := [r for r in rules if r not in PATTERNS]:
        raise ValueError(f"unknown redaction rules: {', '.join(unknown)}")
    if salt is not None:
        return F.sha2(F.concat(F.lit(salt), text), 256)
    for r in rules:
        text = F.regexp_replace(text, PATTERNS[r], f"[{r}]")
    return text


def redact_traces(traces: DataFrame, rules: Sequence[str], salt: str | None = None) -> DataFrame:
    """``traces`` with the rules applied to what people and the model wrote: request, prompt, messages and reply."""
    if not rules and salt is None:
        return traces
    clean = lambda c: redact(c, rules, salt)
    given, said = F.col("input"), F.col("output")
    messages = F.transform(given["messages"], lambda m: m.withField("content", clean(m["content"])))
    given = given.withField("user_request", clean(given["user_request"])).withField("system_prompt", clean(given["system_prompt"])).withField("messages", messages)
    return traces.withColumns({"input": given, "output": said.withField("text", clean(said["text"]))})


def redaction_counts(traces: DataFrame, rules: Sequence[str]) -> DataFrame:
    """(rule, n): how many texts each rule finds something in; a rule with none may be mistaken."""
    texts = F.array_compact(F.concat(F.array("input.user_request", "input.system_prompt", "output.text"), F.coalesce(F.transform("input.messages", lambda m: m["content"]), F.array().cast("array<string>"))))
    found = traces.agg(*[F.sum(F.size(F.filter(texts, lambda t, r=r: t.rlike(PATTERNS[r])))).alias(r) for r in rules])
    return found.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(r), F.lit(0)).alias("n")) for r in rules])))


def judge_metrics(results: DataFrame) -> DataFrame:
    """(evaluator_id, n, tp, fp, fn, tn, accuracy, precision, recall, f1, kappa) of boolean answers against truth."""
    p, t = F.col("normalized_prediction") == "true", F.col("ground_truth") == "true"
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    decided = results.where("normalized_prediction in ('true', 'false') and ground_truth in ('true', 'false') and error is null and not invalid_output")
    g = decided.groupBy("evaluator_id").agg(F.count("*").alias("n"), n(p & t).alias("tp"), n(p & ~t).alias("fp"), n(~p & t).alias("fn"), n(~p & ~t).alias("tn"))
    g = g.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("n")).withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    g = g.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    chance = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn"))) / (F.col("n") * F.col("n"))
    return g.withColumn("kappa", F.try_divide(F.col("accuracy") - chance, 1 - chance))


#: Poisson(1) as bounds of a 32-bit number: a weight is how many of these a row's number reaches.
POISSON = tuple(math.floor(2**32 * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(9))


def bootstrap(results: DataFrame, resamples: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(evaluator_id, n, pass_rate, pass_rate_low, pass_rate_high, kappa, kappa_low, kappa_high).

    A Poisson bootstrap: in each resample a row counts as often as a hash of its
    trace, the resample and the seed says, so results are the same wherever rows
    lie and whatever order they have.  All resamples are one aggregate, which is
    partial ahead of the shuffle: a task sends a row a check and resample.
    ``n`` are the decided rows; kappa is over boolean answers with boolean truth.
    Bounds are order statistics of the resamples in which the measure exists.
    """
    if resamples < 2 or not 0 < level < 1:
        raise ValueError("a bootstrap needs two resamples and a level between 0 and 1")
    p, t = F.col("normalized_prediction"), F.col("ground_truth")
    usable = F.col("error").isNull() & ~F.coalesce(F.col("invalid_output"), F.lit(False))
    judged = usable & p.isin("true", "false") & t.isin("true", "false")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    rows = results.select(
        "trace_id", "evaluator_id", one(usable & F.col("passed")).alias("yes"), one(usable & F.col("passed").isNotNull()).alias("decided"),
        *[one(judged & (p == a) & (t == b)).alias(n) for n, a, b in (("tp", "true", "true"), ("fp", "true", "false"), ("fn", "false", "true"), ("tn", "false", "false"))],
    ).where("decided + tp + fp + fn + tn > 0")
    # resample -1 is the rows as they are; one hash serves four resamples
    each = rows.withColumn("r", F.explode(F.sequence(F.lit(-1), F.lit(resamples - 1))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "trace_id", F.floor(F.col("r") / 4).cast("string")))
    number = F.conv(F.substr(digest, F.lit(1) + 8 * F.pmod("r", F.lit(4)), F.lit(8)), 16, 10).cast("bigint")
    weight = sum(((number >= bound).cast("bigint") for bound in POISSON[1:]), (number >= POISSON[0]).cast("bigint"))
    each = each.withColumn("w", F.when(F.col("r") < 0, F.lit(1)).otherwise(weight))
    g = each.groupBy("evaluator_id", "r").agg(*[F.sum(F.col("w") * F.col(c)).cast("double").alias(c) for c in ("yes", "decided", "tp", "fp", "fn", "tn")])
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    agreed = F.try_divide(F.col("tp") + F.col("tn"), total)
    chance = F.try_divide((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn")), total * total)
    g = g.select("evaluator_id", "r", "decided", F.try_divide("yes", "decided").alias("pass_rate"), F.try_divide(agreed - chance, 1 - chance).alias("kappa"))
    whole = F.col("r") < 0
    out = g.groupBy("evaluator_id").agg(
        F.max(F.when(whole, F.col("decided"))).cast("bigint").alias("n"),
        *[f for m in ("pass_rate", "kappa") for f in (F.max(F.when(whole, F.col(m))).alias(m), F.array_sort(F.collect_list(F.when(~whole, F.col(m)))).alias(f"{m}_all"))],
    )
    bounds = []
    for m in ("pass_rate", "kappa"):
        last, values = F.size(f"{m}_all") - 1, F.col(f"{m}_all")
        bounds += [m, F.get(values, F.floor(last * ((1 - level) / 2)).cast("int")).alias(f"{m}_low"), F.get(values, F.ceil(last * ((1 + level) / 2)).cast("int")).alias(f"{m}_high")]
    return out.select("evaluator_id", "n", *bounds)


def latency(results: DataFrame) -> DataFrame:
    return results.groupBy("evaluator_id").agg(F.percentile_approx("latency_ms", F.array(F.lit(0.5), F.lit(0.95))).alias("q")).select("evaluator_id", F.col("q")[0].alias("p50_ms"), F.col("q")[1].alias("p95_ms"))


@dataclass(frozen=True)
class Gate:
    """What a candidate run must hold against a base run."""

    max_drop: float = 0.0
    max_invalid_rate: float = 0.02
    min_decided: int = 1


def compare_runs(base: DataFrame, candidate: DataFrame, slices: DataFrame | None = None, gate: Gate = Gate()) -> DataFrame:
    """(evaluator_id, slice, base_rate, candidate_rate, regressed, improved, decided, invalid_rate, passes).

    Runs are joined on trace and check.  ``slices`` has (trace_id, slice).
    """
    a = base.select("trace_id", "evaluator_id", F.col("passed").alias("b"))
    c = candidate.select("trace_id", "evaluator_id", F.col("passed").alias("c"), "invalid_output")
    j = a.join(c, ["trace_id", "evaluator_id"])
    j = j.withColumn("slice", F.lit("all")) if slices is None else j.join(slices.select("trace_id", "slice"), "trace_id")
    both = F.col("b").isNotNull() & F.col("c").isNotNull()
    n = lambda x: F.count(F.when(x, 1))
    g = j.groupBy("evaluator_id", "slice").agg(
        n(both).alias("decided"), n(both & F.col("b") & ~F.col("c")).alias("regressed"), n(both & ~F.col("b") & F.col("c")).alias("improved"),
        F.avg(F.when(both, F.col("b").cast("double"))).alias("base_rate"), F.avg(F.when(both, F.col("c").cast("double"))).alias("candidate_rate"), F.avg(F.col("invalid_output").cast("double")).alias("invalid_rate"),
    )
    ok = (F.col("decided") >= gate.min_decided) & (F.col("candidate_rate") >= F.col("base_rate") - gate.max_drop) & (F.col("invalid_rate") <= gate.max_invalid_rate)
    return g.withColumn("passes", F.coalesce(ok, F.lit(False)))
