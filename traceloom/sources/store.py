"""Snapshots, results and the judge's cache, as Parquet tables under a root folder.

A snapshot's folder is its fingerprint: the same traces from the same place give
the same folder, and writing them again is nothing new.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canon import canonical, version_of

SPLITS = ("train", "dev", "validation", "test")


def duplicate_ids(traces: DataFrame) -> DataFrame:
    return traces.groupBy("trace_id").agg(F.count("*").alias("n")).where("n > 1")


def fingerprint(traces: DataFrame, source: dict) -> str:
    """Independent of row order: sums over the rows' hashes, in four parts of 60 bits."""
    part = lambda k: F.sum(F.conv(F.substring("content_hash", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{k}")
    row = traces.agg(F.count("*").alias("n"), *[part(k) for k in range(4)]).first()
    return version_of({"source": source, "rows": row["n"], "sums": [row[f"s{k}"] for k in range(4)]})


def row_hash(traces: DataFrame) -> Column:
    """A hash of all that a trace's row holds, kept beside it and taken again on a verified read."""
    return F.sha2(F.to_json(F.struct(*sorted(traces.columns))), 256)


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest ``order``: an aggregate that is partial ahead of the shuffle, not a sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(key, "__last.*")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def write_snapshot(self, project: str, traces: DataFrame, source: dict, split: Column | None = None) -> tuple[str, bool]:
        """(fingerprint, whether it is new).  Duplicate trace ids raise before anything is written."""
        twice = [r["trace_id"] for r in duplicate_ids(traces).orderBy("trace_id").limit(5).collect()]
        if twice:
            raise ValueError(f"duplicate trace ids: {', '.join(twice)}")
        print_ = fingerprint(traces, source)  # over contents, whatever the splits are
        path = self._path("snapshots", f"project={project}", f"fingerprint={print_}")
        if self.exists(path):
            return print_, False
        plain = traces.drop("__split")
        body = traces.withColumn("split", F.lit("train") if split is None else split).withColumn("row_hash", row_hash(plain)).select(*plain.columns, "row_hash", "split")
        if body.where(~F.col("split").isin(*SPLITS) | F.col("split").isNull()).limit(1).count():
            raise ValueError(f"a split must be one of {', '.join(SPLITS)}")
        body.write.mode("errorifexists").option("compression", "zstd").partitionBy("split").parquet(path)
        log = self.spark.createDataFrame([(project, print_, canonical(source))], "project string, fingerprint string, source string")
        log.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(self._path("snapshot_log"))
        return print_, True

    def read_snapshot(self, project: str, print_: str, split: str | None = None, verify: bool = False) -> DataFrame:
        df = self.spark.read.parquet(self._path("snapshots", f"project={project}", f"fingerprint={print_}"))
        if verify:
            source = json.loads(self.snapshots(project).where(F.col("fingerprint") == print_).first()["source"])
            whole = "row_hash" in df.columns and df.where(~F.col("row_hash").eqNullSafe(row_hash(df.drop("row_hash", "split")))).isEmpty()
            if not whole or fingerprint(df, source) != print_:
                raise ValueError(f"snapshot {print_} doesn't hold what it was written with")
        df = df.drop("row_hash")
        return df if split is None else df.where(F.col("split") == split)

    def snapshots(self, project: str) -> DataFrame:
        return self.spark.read.parquet(self._path("snapshot_log")).where(F.col("project") == project)

    def latest(self, project: str) -> str | None:
        if not self.exists(self._path("snapshot_log")):
            return None
        row = self.snapshots(project).orderBy(F.desc("created_at")).limit(1).first()
        return row["fingerprint"] if row else None

    def split_counts(self, project: str, print_: str) -> DataFrame:
        return self.read_snapshot(project, print_).groupBy("split").agg(F.count("*").alias("n"))

    def _log(self, table: str, row: dict) -> None:
        """Append a row to a log; the last row of a key is what holds."""
        kinds = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in row.items())
        self.spark.createDataFrame([tuple(row.values())], kinds).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(self._path(table))

    def _logged(self, table: str, key: str) -> DataFrame | None:
        """The last row of each key of a log; null if nothing was ever logged."""
        path = self._path(table)
        if not self.exists(path):
            return None
        return last_of_each(self.spark.read.option("mergeSchema", "true").parquet(path), key, "created_at")

    def upsert_project(self, name: str, config: dict) -> None:
        """Keep a project's configuration; the latest replaces those before it."""
        self._log("projects", {"name": name, "config": canonical(config)})

    def projects(self) -> DataFrame | None:
        return self._logged("projects", "name")

    def register_judge(self, hash: str, identity: dict, system: str | None, schema: object) -> bool:
        """Keep a judge under its version hash; False if it is there already: a changed judge has another hash."""
        known = self.judges()
        if known is not None and known.where(F.col("hash") == hash).limit(1).count():
            return False
        self._log("judges", {"hash": hash, "identity": canonical(identity), "system": system, "schema": canonical(schema)})
        return True

    def judges(self) -> DataFrame | None:
        return self._logged("judges", "hash")

    def runs(self, project: str | None = None) -> DataFrame | None:
        """(run_id, project, fingerprint, suite_hash, split, rows, created_at) of recorded runs."""
        rows = self._logged("runs", "run_id")
        return rows if rows is None or project is None else rows.where(F.col("project") == project)

    def latest_run(self, project: str | None = None) -> str | None:
        rows = self.runs(project)
        row = rows.orderBy(F.desc("created_at"), "run_id").limit(1).first() if rows is not None else None
        return row["run_id"] if row else None

    def record(self, run_id: str, results: DataFrame, project: str | None = None, fingerprint: str | None = None, suite_hash: str | None = None, split: str | None = None) -> DataFrame:
        """Write a run's results once; a run id can't be written twice.  The run is logged when they are whole."""
        path = self._path("results", f"run_id={run_id}")
        results.write.mode("errorifexists").parquet(path)
        written = self.results(run_id)
        self._log("runs", {"run_id": run_id, "project": project, "fingerprint": fingerprint, "suite_hash": suite_hash, "split": split, "rows": written.count()})
        return written

    def results(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(self._path("results", f"run_id={run_id}"))

    def cache(self) -> DataFrame | None:
        path = self._path("judge_cache")
        return self.spark.read.parquet(path).dropDuplicates(["cache_key"]) if self.exists(path) else None

    def add_to_cache(self, rows: DataFrame) -> None:
        known = self.cache()
        fresh = rows if known is None else rows.join(known.select("cache_key"), "cache_key", "left_anti")
        fresh.write.mode("append").parquet(self._path("judge_cache"))
