"""Artifacts by content: bytes in, a ``cas://<sha256>`` URI out, on any file system that Hadoop reaches.

A file is written under a name of its own beside its place and then renamed, so
that nothing half written ever stands at the address of its content; putting the
same content again writes nothing.  Reads hash what they read: content that has
changed is refused.  Folders fan out by the first four digits.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20


def digest_of(uri: str) -> str:
    """The content hash of a URI; anything but ``cas://`` and 64 lower-case hex digits is refused."""
    m = re.fullmatch(r"cas://([0-9a-f]{64})", uri)
    if not m:
        raise ValueError(f"not an artifact URI: {uri!r}")
    return m[1]


class Artifacts:
    """Making a store writes nothing; only puts make folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, digest: str) -> str:
        return f"{self.root}/{digest[:2]}/{digest[2:4]}/{digest}"

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _put(self, digest: str, chunks) -> str:
        fs, at = self._fs(self.path(digest))
        if not fs.exists(at):
            _, part = self._fs(f"{self.path(digest)}.{uuid.uuid4().hex}.partial")
            out = fs.create(part)
            try:
                for chunk in chunks:
                    out.write(bytearray(chunk))
            finally:
                out.close()
            if not fs.rename(part, at):
                fs.delete(part, False)
                if not fs.exists(at):  # else another put of the same content was first
                    raise OSError(f"can't write {self.path(digest)}")
        return f"cas://{digest}"

    def put_bytes(self, data: bytes) -> str:
        return self._put(hashlib.sha256(data).hexdigest(), [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)])

    def put_file(self, path: str | Path) -> str:
        """A file of the driver's, read twice in chunks: for its name, and to copy it."""
        found = hashlib.sha256()
        with open(path, "rb") as f:
            while chunk := f.read(CHUNK):
                found.update(chunk)
        with open(path, "rb") as f:
            return self._put(found.hexdigest(), iter(lambda: f.read(CHUNK), b""))

    def exists(self, uri: str) -> bool:
        fs, at = self._fs(self.path(digest_of(uri)))
        return fs.exists(at)

    def get_bytes(self, uri: str) -> bytes:
        digest = digest_of(uri)
        fs, at = self._fs(self.path(digest))
        if not fs.exists(at):
            raise FileNotFoundError(f"no such artifact: {uri}")
        stream = fs.open(at)
        try:
            data = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        if hashlib.sha256(data).hexdigest() != digest:
            raise ValueError(f"{uri} doesn't hold what it was written with")
        return data

    def fetch(self, uris: Sequence[str]) -> DataFrame:
        """(uri, content, whole): many artifacts, read and hashed by tasks; one that is missing raises when it is read."""
        paths = [self.path(digest_of(u)) for u in uris]
        if not paths:
            return self.spark.createDataFrame([], "uri string, content binary, whole boolean")
        name = F.regexp_extract("path", "([0-9a-f]{64})$", 1)
        return self.spark.read.format("binaryFile").load(paths).select(F.concat(F.lit("cas://"), name).alias("uri"), "content", (F.sha2("content", 256) == name).alias("whole"))
