"""Promotion gates: a candidate run against a base run, over all traces and in every slice.

Runs are joined once on trace and check; one aggregate with grouping sets gives
the rates of all traces, of each slice column and of their combinations.  The
test of a difference is McNemar's, exact: of the traces on which the two runs
differ, how unlikely is it that so many went one way.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a condition may name besides a check: metrics of the whole run.
RUN_METRICS = ("invalid_output_rate", "cost_per_trace", "p95_latency_ms")


@dataclass(frozen=True)
class Condition:
    """One requirement; exactly one of the three targets is given."""

    metric: str
    op: str = ">="
    #: the candidate's value against the base's plus this
    baseline_delta: float | None = None
    #: against this
    absolute: float | None = None
    #: against the base's times this
    baseline_factor: float | None = None
    #: the difference to the base must also be significant
    significant: bool = False

    def __post_init__(self):
        if not self.metric:
            raise ValueError("a condition needs a metric")
        if self.op not in (">=", "<="):
            raise ValueError(f"op {self.op!r} is neither >= nor <=")
        if sum(t is not None for t in (self.baseline_delta, self.absolute, self.baseline_factor)) != 1:
            raise ValueError(f"the condition on {self.metric} needs one target: baseline_delta, absolute or baseline_factor")
        if self.significant and self.metric in RUN_METRICS:
            raise ValueError(f"{self.metric} is no check, so its difference can't be tested")

    def said(self) -> str:
        return next(f"{self.metric} {self.op} {n} {v:g}" for n, v in (("base +", self.baseline_delta), ("", self.absolute), ("base *", self.baseline_factor)) if v is not None).replace("  ", " ")


@dataclass(frozen=True)
class SliceRule:
    """No slice of a column (or columns, joined by commas) may lose more than ``tolerance``; those under ``min_n`` decided traces never pass in silence."""

    field: str
    no_regression: bool = True
    min_n: int = 25
    tolerance: float = 0.02
    on_insufficient: str = "warn"

    def __post_init__(self):
        if not self.field or self.min_n < 1 or self.tolerance < 0:
            raise ValueError("a slice rule needs a field, min_n above 0 and a tolerance of 0 or more")
        if self.on_insufficient not in ("warn", "ignore", "fail"):
            raise ValueError(f"on_insufficient {self.on_insufficient!r} is none of warn, ignore, fail")

    def fields(self) -> tuple[str, ...]:
        return tuple(f.strip() for f in self.field.split(","))


@dataclass(frozen=True)
class Promotion:
    all: tuple[Condition, ...] = ()
    any: tuple[Condition, ...] = ()
    slices: tuple[SliceRule, ...] = ()

    def __post_init__(self):
        if not self.all and not self.any:
            raise ValueError("a gate without conditions would promote anything")

    @classmethod
    def of(cls, data: dict) -> Promotion:
        """From a plain dict, as a promotion file has it; unknown keys are refused."""
        kinds = {"all": Condition, "any": Condition, "slices": SliceRule}
        if unknown := set(data) - set(kinds):
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
        for name, kind in kinds.items():
            for item in data.get(name) or ():
                if unknown := set(item) - {f.name for f in dataclasses.fields(kind)}:
                    raise ValueError(f"unknown keys under {name}: {', '.join(sorted(unknown))}")
        return cls(**{name: tuple(kind(**item) for item in data.get(name) or ()) for name, kind in kinds.items()})


def mcnemar(one: Column, other: Column) -> Column:
    """The two-sided exact p-value of ``one`` against ``other`` discordant pairs: twice the smaller tail of n fair coins, 1 at most."""
    n, least = (one + other).cast("double"), F.least(one, other).cast("int")
    zero = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("p"))

    def step(a: Column, i: Column) -> Column:
        log = F.when(i == 0, F.lit(0.0)).otherwise(a["log"] + F.ln((n - i + 1) / i))
        return F.struct(log.alias("log"), (a["p"] + F.exp(log - n * math.log(2))).alias("p"))

    return F.least(F.lit(1.0), 2 * F.aggregate(F.sequence(F.lit(0), least), zero, step, lambda a: a["p"]))


def compare(base: DataFrame, candidate: DataFrame, slices: DataFrame | None = None, sets: Sequence[Sequence[str]] = ((),)) -> DataFrame:
    """(evaluator_id, fields, slice, decided, base_rate, candidate_rate, regressed, improved, p_value).

    ``slices`` has a row a trace with the slice columns; ``sets`` lists the
    combinations of them, the empty one being all traces.  ``fields`` names the
    combination, ``slice`` its values as JSON.  Rates are over traces that both
    runs decided.
    """
    names = sorted({f for s in sets for f in s})
    a = base.select("trace_id", "evaluator_id", F.col("passed").alias("b"))
    c = candidate.select("trace_id", "evaluator_id", F.col("passed").alias("c"))
    joined = a.join(c, ["trace_id", "evaluator_id"])
    if names:
        joined = joined.join(slices.select("trace_id", *[F.col(f"`{f}`").cast("string").alias(f"s{n}") for n, f in enumerate(names)]), "trace_id", "left")
    keys = [f"s{n}" for n in range(len(names))]
    both = F.col("b").isNotNull() & F.col("c").isNotNull()
    count = lambda x: F.count(F.when(x, 1))
    rate = lambda x: F.avg(F.when(both, F.col(x).cast("double")))
    wanted = [["evaluator_id", *[f"s{names.index(f)}" for f in s]] for s in sets]
    grouped = joined.groupingSets([[F.col(k) for k in s] for s in wanted], "evaluator_id", *keys).agg(
        F.grouping_id().alias("g"), count(both).alias("decided"), rate("b").alias("base_rate"), rate("c").alias("candidate_rate"),
        count(both & F.col("b") & ~F.col("c")).alias("regressed"), count(both & ~F.col("b") & F.col("c")).alias("improved"),
    )
    bit = lambda n: F.col("g").bitwiseAND(F.lit(1 << (len(keys) - 1 - n))) == 0
    used = F.array_compact(F.array(*[F.when(bit(n), F.lit(f)) for n, f in enumerate(names)])) if names else F.array().cast("array<string>")
    values = F.array_compact(F.array(*[F.when(bit(n), F.concat(F.to_json(F.lit(f).cast("variant")), F.lit(":"), F.coalesce(F.to_json(F.col(f"s{n}").cast("variant")), F.lit("null")))) for n, f in enumerate(names)])) if names else used
    return grouped.select(
        "evaluator_id", F.array_join(used, ",").alias("fields"), F.concat(F.lit("{"), F.array_join(values, ","), F.lit("}")).alias("slice"),
        "decided", "base_rate", "candidate_rate", "regressed", "improved", mcnemar(F.col("regressed"), F.col("improved")).alias("p_value"),
    )


def _run_metrics(results: DataFrame, name: str) -> DataFrame:
    """(metric, name) of a whole run."""
    # traces are counted apart: beside a distinct count, each trace would have a digest of latencies, all merged by one task
    traces = results.agg(F.countDistinct("trace_id").alias("traces"))
    row = results.agg(
        F.avg(F.col("invalid_output").cast("double")).alias("invalid_output_rate"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost"),
        F.percentile_approx("latency_ms", 0.95, 10_000).cast("double").alias("p95_latency_ms"),
    ).crossJoin(traces).withColumn("cost_per_trace", F.try_divide("cost", "traces"))
    return row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in RUN_METRICS])))


def gate(promotion: Promotion, base: DataFrame, candidate: DataFrame, slices: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """(part, rule, evaluator_id, slice, decided, base, candidate, p_value, verdict): a row a condition and a row a slice of each rule.

    ``part`` is all, any or slices; ``verdict`` is pass, fail, or, for slices
    under their rule's min_n, insufficient (which ``decided`` counts as the rule
    says).  A condition on a check that neither run has fails.
    """
    rules = [r for r in promotion.slices if r.no_regression]
    if rules and slices is None:
        raise ValueError("the gate has slice rules but no slices were given")
    sets = list(dict.fromkeys([(), *[r.fields() for r in rules]]))
    pairs = compare(base, candidate, slices, sets)
    run = _run_metrics(base, "base_rate").join(_run_metrics(candidate, "candidate_rate"), "metric")
    known = pairs.unionByName(run.select(F.col("metric").alias("evaluator_id"), F.lit("").alias("fields"), F.lit("{}").alias("slice"), "base_rate", "candidate_rate"), allowMissingColumns=True)
    number = lambda x: F.lit(None if x is None else float(x)).cast("double")
    listed = [
        F.struct(
            F.lit(part).alias("part"), F.lit(c.metric).alias("metric"), F.lit("{}").alias("whole"), F.lit(c.op).alias("op"), number(c.baseline_delta).alias("delta"), number(c.absolute).alias("absolute"),
            number(c.baseline_factor).alias("factor"), F.lit(c.significant).alias("significant"), F.lit(c.said()).alias("rule"),
        )
        for part, cs in (("all", promotion.all), ("any", promotion.any)) for c in cs
    ]
    conditions = base.sparkSession.range(1).select(F.inline(F.array(*listed)))
    # one join keeps conditions that nothing meets and slices alike, so that runs are compared once for both
    met = known.join(conditions, (F.col("evaluator_id") == F.col("metric")) & (F.col("slice") == F.col("whole")), "full")
    base_rate, candidate_rate = F.col("base_rate"), F.col("candidate_rate")
    target = F.coalesce(F.col("absolute"), base_rate + F.col("delta"), base_rate * F.col("factor"))
    # a millionth of a millionth, so that 0.1 + 0.2 reaches 0.3
    holds = F.when(F.col("op") == ">=", candidate_rate >= target - 1e-12).otherwise(candidate_rate <= target + 1e-12)
    way = F.when(F.col("op") == ">=", F.col("improved") > F.col("regressed")).otherwise(F.col("regressed") > F.col("improved"))
    passes = F.coalesce(holds & (~F.col("significant") | ((F.col("p_value") < alpha) & way)), F.lit(False))

    def row(part, rule, evaluator_id, slice_, verdict) -> Column:
        return F.struct(part.alias("part"), rule.alias("rule"), evaluator_id.alias("evaluator_id"), slice_.alias("slice"), "decided", base_rate.alias("base"), candidate_rate.alias("candidate"), "p_value", verdict.alias("verdict"))

    out = [F.when(F.col("metric").isNotNull(), row(F.col("part"), F.col("rule"), F.col("metric"), F.lit("{}"), F.when(passes, "pass").otherwise("fail")))]
    for r in rules:
        fields = ",".join(sorted(r.fields()))
        enough, kept = F.col("decided") >= r.min_n, candidate_rate >= base_rate - r.tolerance - 1e-12
        small = {"warn": "insufficient", "ignore": "insufficient", "fail": "fail"}[r.on_insufficient]
        verdict = F.when(~enough, small).when(kept, "pass").otherwise("fail")
        there = F.col("fields") == fields
        out.append(F.when(there if r.on_insufficient != "ignore" else there & enough, row(F.lit("slices"), F.lit(f"no regression by {fields}"), F.col("evaluator_id"), F.col("slice"), verdict)))
    return met.select(F.inline(F.array_compact(F.array(*out))))


def promotes(verdicts: DataFrame) -> bool:
    """Whether a gate's rows promote: all of ``all``, one of ``any`` if there are any, and no slice that fails."""
    n = lambda c: F.count(F.when(F.expr(c), 1))
    row = verdicts.agg(n("part in ('all', 'slices') and verdict = 'fail'").alias("failed"), n("part = 'any'").alias("asked"), n("part = 'any' and verdict = 'pass'").alias("met")).first()
    return row["failed"] == 0 and (row["asked"] == 0 or row["met"] > 0)
