"""Session helpers: shipping the package to executors, the shared folder, cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    out = os.path.join(folder, "traceloom_py.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(Path(top.name) / p.relative_to(top)))
    spark.sparkContext.addPyFile(out)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests, a laptop) a folder of this machine is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "traceloom-shared")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the cluster's own cleaning removes the folder
        pass


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


#: Where each staged table lies; a table that nobody holds any more drops out.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staged(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of any executor.
    ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def renamed(table: DataFrame, view: DataFrame) -> DataFrame:
    """``view``, which alone stands for the staged ``table`` from now on."""
    if path := _paths.pop(table, None):
        _paths[view] = path
    return view


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing unwritten reads any more."""
    for t in tables:
        if path := _paths.pop(t, None):
            _remove(t.sparkSession, path)
