"""Command line: validate, ingest, evaluate, snapshot, report, feedback.

Exit codes: 0 done, 1 problems found, 2 nothing to show.
"""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .api import load_traces
from .functions.paths import resolve
from .operators.judge import JudgeConfig
from .operators.judged import LlmQuestion, Rubric
from .plans import feedback, governance, report, suite
from .plans.splits import Splits, assign
from .sources.store import Store


#: Errors of an ingest that are printed; the rest is counted.
ERRORS = 20
#: The checks a report looks for, by their default ids.
DEFAULT_SECTIONS = {"selection": "tool_selection", "registry": "tool_registry_check", "consistency": "text_matches_tools", "outcome": "tool_call_outcome"}


def absolute(path: str | None) -> str | None:
    """A local path made absolute, so that one source has one identity; others as they are."""
    return path if path is None or "://" in path else os.path.abspath(path)


def with_splits(traces: DataFrame, splits: Splits) -> DataFrame:
    """``traces`` with ``__split``; fields and guard are paths into traces."""
    plain = traces.select("trace_id", *[resolve(p).text.alias(n) for n, p in (("field", splits.field), ("guard", splits.guard)) if p is not None])
    named = replace(splits, field=splits.field and "field", guard=splits.guard and "guard")
    return traces.join(assign(plain, named).withColumnRenamed("split", "__split"), "trace_id")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="traceloom", description=__doc__.split("\n")[0])
    p.add_argument("--store", default="traceloom-store", help="root folder of the tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"validate": ("project",), "ingest": ("project",), "snapshot": ("name",), "evaluate": ("project", "suite")}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name == "ingest":
            s.add_argument("--dry-run", action="store_true")
        if name == "evaluate":
            s.add_argument("--tools")
            s.add_argument("--split")
            s.add_argument("--limit", type=int)
            s.add_argument("--no-cache", action="store_true")
    for name in ("report", "feedback"):
        s = sub.add_parser(name)
        s.add_argument("run", nargs="?", help="a run id; the latest run without one")
        s.add_argument("--evaluator", action="append", default=[], help="section=id" if name == "report" else "id of the selection check")
        if name == "feedback":
            s.add_argument("--project", required=True)
            s.add_argument("--tools")
            s.add_argument("--out", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(a, spark or SparkSession.builder.appName("traceloom").getOrCreate())
    except config.ConfigError as e:
        print("\n".join(e.problems), file=sys.stderr)
        return 1


def run(a: argparse.Namespace, spark: SparkSession) -> int:
    store = Store(spark, a.store)
    if a.command == "validate":
        config.load_project(a.project)
        print("valid")
        return 0
    if a.command == "ingest":
        p = config.load_project(a.project)
        at = absolute(p.source.get("path"))
        source = {"jsonl": lambda: at, "parquet": lambda: spark.read.parquet(at)}.get(p.source["type"])
        if source is None:
            raise config.ConfigError([f"source.type: {p.source['type']} can be read with spark.read and passed as a DataFrame"])
        traces, errors = load_traces(spark, source(), p.mapping)
        bad = errors.count()
        for e in errors.limit(ERRORS).collect():
            print(f"{e['source_id']}: {e['message']}", file=sys.stderr)
        if bad > ERRORS:
            print(f"{bad - ERRORS} more errors are not shown", file=sys.stderr)
        n = traces.count()
        if not n:
            print("no traces", file=sys.stderr)
            return 1
        traces = governance.redact_traces(traces, p.redaction)
        for r in traces.select("trace_id", "input.user_request").orderBy("trace_id").limit(5).collect() if a.dry_run else ():
            print(f"{r['trace_id']}: {r['user_request'] or ''}")
        if not a.dry_run:
            split = None
            if p.splits is not None:
                traces, split = with_splits(traces, p.splits), F.col("__split")
            print_, new = store.write_snapshot(p.name, traces, {"type": p.source["type"], "path": at}, split)
            store.upsert_project(p.name, {"source": p.source, "mapping": p.mapping})
            print(f"{print_} {'written' if new else 'is there already'}")
        print(f"{n} traces")
        return 1 if bad else 0
    if a.command == "snapshot":
        latest = store.latest(a.name)
        if latest is None:
            return 2
        print(latest)
        store.split_counts(a.name, latest).orderBy("split").show(truncate=False)
        return 0
    if a.command == "evaluate":
        p = config.load_project(a.project)
        data, lines = config.load(a.suite)
        judges = {k: JudgeConfig(**v) for k, v in (data.pop("judges", None) or {}).items()}
        registry = config.load_registry(a.tools) if a.tools else None
        if problems := config.integrity_problems(p, judges):
            raise config.ConfigError(problems)
        checks = config.build_suite(data, registry, judges, lines, cache=None if a.no_cache else store.cache())
        latest = store.latest(p.name)
        if latest is None:
            print(f"{p.name} has not been ingested", file=sys.stderr)
            return 1
        traces = store.read_snapshot(p.name, latest, a.split).drop("split")
        traces = traces if a.limit is None else traces.limit(a.limit)
        run_id = uuid.uuid4().hex
        for c in checks:
            if hasattr(c, "judge"):
                store.register_judge(c.version_hash(), c.judge.identity(), c.system, c.schema() if isinstance(c, (LlmQuestion, Rubric)) else {})
        results = store.record(run_id, suite.run_suite(traces, checks), p.name, latest, suite.suite_hash(data.get("name") or data.get("suite") or "", checks), a.split)
        for c in checks:
            if not a.no_cache and getattr(c, "fresh", None) is not None:
                store.add_to_cache(c.fresh)
        print(run_id)
        summary = suite.summarize(results, checks).orderBy("evaluator_id")
        summary.show(len(checks) + sum(len(suite.ids_of(c)) for c in checks), truncate=False)
        return 0
    found = a.run or store.latest_run(getattr(a, "project", None))
    if found is None or not store.exists(store._path("results", f"run_id={found}")):
        print("no runs recorded" if found is None else f"no such run: {found}", file=sys.stderr)
        return 1
    results = store.results(found)
    if a.command == "report":
        kinds = dict(x.split("=", 1) for x in a.evaluator) or DEFAULT_SECTIONS
        if not report.evaluated(results, kinds):
            print(f"run {found} has no tool checks (looked for {', '.join(kinds.values())})", file=sys.stderr)
            return 2
        print(report.markdown(results, kinds, found))
        return 0
    latest = store.latest(a.project)
    traces = store.read_snapshot(a.project, latest)
    sealed = traces.where(F.col("split") == "test").select("trace_id")
    made = feedback.build_dpo(results.where(F.col("evaluator_id").isin(a.evaluator)), traces, config.load_registry(a.tools) if a.tools else None, sealed)
    made.dropped.show(truncate=False)
    if not made.rows.limit(1).count():
        return 2
    made.write_jsonl(a.out)
    print(made.manifest())
    return 0


if __name__ == "__main__":
    sys.exit(main())
