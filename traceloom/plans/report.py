"""Rollups of tool-call results, and their Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import NONE


def called(prediction: Column) -> Column:
    """The calls of a selection row, comma-joined; ``none`` for no call."""
    listed = F.array_join(F.from_json(prediction, "array<string>"), ",")
    return F.coalesce(F.nullif(F.coalesce(listed, unquoted(prediction)), F.lit("")), F.lit(NONE))


def unquoted(json: Column) -> Column:
    v = F.try_parse_json(json)
    return F.coalesce(F.try_variant_get(v, "$.value", "string"), F.try_variant_get(v, "$", "string"))


def selection(results: DataFrame) -> DataFrame:
    """(called, judge_says, n, example) of disagreements, the most frequent first."""
    bad = results.where("passed = false and not invalid_output")
    pairs = bad.select("trace_id", called(F.col("normalized_prediction")).alias("called"), F.coalesce(unquoted(F.col("ground_truth")), F.lit(NONE)).alias("judge_says"))
    return pairs.groupBy("called", "judge_says").agg(F.count("*").alias("n"), F.min("trace_id").alias("example")).orderBy(F.desc("n"), "called", "judge_says")


def violations(results: DataFrame) -> DataFrame:
    """(code, n, tools, example); advisory ones of passing rows too."""
    items = results.select("trace_id", F.explode(F.from_json("raw_output", "violations array<struct<code:string,call:int,tool:string,message:string>>")["violations"]).alias("v"))
    grouped = items.groupBy("v.code").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("v.tool")).alias("tools"), F.min("trace_id").alias("example"))
    return grouped.select("code", "n", F.array_join("tools", ", ").alias("tools"), "example").orderBy(F.desc("n"), "code")


def failures(results: DataFrame) -> DataFrame:
    """(tool, error, n, example) of recorded failures."""
    items = results.select("trace_id", F.explode(F.from_json("raw_output", "failures array<struct<call:int,tool:string,error:string>>")["failures"]).alias("f"))
    named = items.select("trace_id", F.coalesce("f.tool", F.lit("—")).alias("tool"), F.coalesce("f.error", F.lit("—")).alias("error"))
    return named.groupBy("tool", "error").agg(F.count("*").alias("n"), F.min("trace_id").alias("example")).orderBy(F.desc("n"), "tool", "error")


def contradictions(results: DataFrame) -> DataFrame:
    """(trace_id, called, explanation) of replies that contradict their calls."""
    bad = results.where("passed = false and not invalid_output and error is null")
    return bad.select("trace_id", called(F.col("normalized_prediction")).alias("called"), "explanation").orderBy("trace_id")


def coverage(results: DataFrame) -> DataFrame:
    """(passed, failed, skipped, invalid, errored) of one check's rows; skipped holds errored rows too."""
    n = lambda c: F.count(F.when(c, 1))
    return results.agg(
        n(F.expr("passed and not invalid_output")).alias("passed"), n(F.expr("not passed and not invalid_output")).alias("failed"),
        n(F.expr("passed is null and not invalid_output")).alias("skipped"), n(F.col("invalid_output")).alias("invalid"), n(F.col("error").isNotNull()).alias("errored"),
    )


def trace_count(*results: DataFrame) -> DataFrame:
    ids = results[0].select("trace_id")
    for r in results[1:]:
        ids = ids.union(r.select("trace_id"))
    return ids.agg(F.countDistinct("trace_id").alias("traces"))


def cell(value: object) -> str:
    return ("" if value is None else str(value)).replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def table(df: DataFrame, top: int | None = None) -> list[str]:
    """The rows of an ordered rollup; with ``top`` its first, and how many are left out."""
    head = df.columns
    rows = [r for r in (df if top is None else df.limit(top + 1)).toLocalIterator()]
    if not rows:
        return []
    said = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(cell(r[c]) for c in head) + " |" for r in rows[:top]], ""]
    if top is not None and len(rows) > top:
        said += [f"{df.count() - top} more rows are not shown.", ""]
    return said


#: kind: (title, rollup, what there is to say if nothing was found, the coverage line)
SECTIONS = {
    "selection": ("Tool selection", selection, "Nothing found. The judge agreed on {passed} trace(s).", "agreed {passed} · not applicable {skipped} · invalid answers {invalid} · errored {errored}"),
    "registry": ("Registry violations", violations, "Nothing found. {passed} trace(s) checked against the registry.", "clean {passed} · no tool calls {skipped} · errored {errored}"),
    "consistency": ("Contradictions", contradictions, "Nothing found. {passed} trace(s) checked.", "consistent {passed} · no reply {skipped} · invalid answers {invalid} · errored {errored}"),
    "outcome": ("Failed calls", failures, "Nothing found. {passed} trace(s) recorded an outcome.", "succeeded {passed} · no outcome recorded {skipped} · errored {errored}"),
}


def evaluated(results: DataFrame, kinds: dict[str, str]) -> dict[str, str]:
    """Those of ``kinds`` whose check has rows: nothing found differs from not looked for."""
    there = {r[0] for r in results.where(F.col("evaluator_id").isin(list(kinds.values()))).select("evaluator_id").distinct().collect()}
    return {k: v for k, v in kinds.items() if v in there}


def markdown(results: DataFrame, kinds: dict[str, str], run_id: str | None = None, top: int | None = None) -> str:
    """A report without timestamps; ``kinds`` names the check of each section (SECTIONS).

    Sections stand in a fixed order, and only if their check was run; each says
    what it counted.  All rows are given unless ``top`` says how many.
    """
    if unknown := set(kinds) - set(SECTIONS):
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}; there are {', '.join(SECTIONS)}")
    there = evaluated(results, kinds)
    rows = {k: results.where(F.col("evaluator_id") == v) for k, v in there.items()}
    n = trace_count(*rows.values()).first()["traces"] if rows else 0
    out = ["# Tool-call report", "", (f"Run `{run_id}` · " if run_id else "") + f"{n} traces · **0 labels**", ""]
    for kind, (title, rollup, none, line) in SECTIONS.items():
        if kind in rows:
            counts = coverage(rows[kind]).first().asDict()
            out += [f"## {title}", "", *(table(rollup(rows[kind]), top) or [none.format(**counts), ""]), f"_{line.format(**counts)}_", ""]
    return "\n".join([*out, "---", "", "Judge answers are not calibrated against people; registry and outcome checks involve no model.", ""])
