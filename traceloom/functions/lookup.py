"""Configured tables as one literal, probed by name.

A chain of WHEN for each configured name makes plans that grow with the
configuration; here the rows are one constant of buckets by hash, so a plan has
the same size for four names and for four thousand, and a probe reads a bucket.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


class Lookup:
    """``rows`` by name; ``form`` lists their fields as in a DDL struct."""

    def __init__(self, rows: dict[str, dict], form: str):
        self.size = max(1, len(rows))
        buckets: list[list[dict]] = [[] for _ in range(self.size)]
        for name, row in rows.items():
            buckets[zlib.crc32(name.encode()) % self.size].append({"name": name, **row})
        self.literal = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<name:string,{form}>>>")

    def find(self, name: Column) -> Column:
        """The row of a name as a struct; null without one."""
        bucket = F.get(self.literal, (F.crc32(name.cast("binary")) % self.size).cast("int"))
        return F.get(F.filter(bucket, lambda x: x["name"] == name), F.lit(0))
