"""Canonical JSON and structural comparison.

Catalyst has neither recursion over free-form values nor Python's number text,
so these two run as Arrow-batched pandas UDFs; all else is built in.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    """Sorted keys, no spaces, non-ASCII as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def version_of(value: object) -> str:
    """The hash of a configuration: equal configurations, equal hashes."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def _canonical_text(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return canonical(json.loads(text))
    except (ValueError, RecursionError):
        return None


def canonical_json(text: Column | str) -> Column:
    """JSON text in canonical form; null for text that is no JSON."""

    @F.pandas_udf("string")
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([_canonical_text(x) for x in part], dtype=object)

    return made(text)


def content_hash(canonical_text: Column) -> Column:
    return F.sha2(canonical_text, 256)


@dataclass(frozen=True)
class MatchOptions:
    ignore_order: bool = False
    coerce_types: bool = False
    treat_null_as_missing: bool = True
    treat_empty_as_missing: bool = True
    allow_extra_arguments: bool = False
    ignore_paths: tuple[str, ...] = ()

    def payload(self) -> dict:
        return asdict(self)


def reduced(value: object, o: MatchOptions, path: str = "") -> object:
    """A value without what the options leave out; list elements have their list's path."""
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            at = f"{path}.{k}" if path else k
            if any(at == p or at.startswith(p + ".") for p in o.ignore_paths) or (v is None and o.treat_null_as_missing):
                continue
            v = reduced(v, o, at)
            if not (o.treat_empty_as_missing and isinstance(v, (dict, list)) and not v):
                out[k] = v
        return out
    if isinstance(value, list):
        items = [reduced(v, o, path) for v in value]
        return sorted(items, key=canonical) if o.ignore_order else items
    if o.coerce_types and isinstance(value, (int, float)) and not isinstance(value, bool):
        return str(value)
    return value


def divergence(want: object, got: object, extra: bool, at: str = "$") -> str | None:
    """The first difference, as the expected value drives it; booleans are no numbers."""
    if isinstance(want, dict) and isinstance(got, dict):
        for k in want:
            if k not in got:
                return f"{at}.{k} is missing"
            if found := divergence(want[k], got[k], extra, f"{at}.{k}"):
                return found
        unexpected = [k for k in got if k not in want]
        return f"{at}.{unexpected[0]} is unexpected" if unexpected and not extra else None
    if isinstance(want, list) and isinstance(got, list):
        if len(want) != len(got):
            return f"{at} has {len(got)} items, expected {len(want)}"
        return next((d for i, (a, b) in enumerate(zip(want, got)) if (d := divergence(a, b, extra, f"{at}[{i}]"))), None)
    if isinstance(want, bool) != isinstance(got, bool) or want != got:
        return f"{at}: expected {canonical(want)}, got {canonical(got)}"
    return None


def json_match(actual: Column, expected: Column, options: MatchOptions) -> Column:
    """struct(passed, reason, prediction, truth, error) of two JSON texts; a pair that can't be compared has an error, and costs its own row."""

    @F.pandas_udf("passed boolean, reason string, prediction string, truth string, error string")
    def matched(got: pd.Series, want: pd.Series) -> pd.DataFrame:
        rows = []
        for g, w in zip(got, want):
            if g is None or w is None:
                rows.append((None,) * 5)
                continue
            try:
                a, b = reduced(json.loads(g), options), reduced(json.loads(w), options)
                d = divergence(b, a, options.allow_extra_arguments)
                rows.append((d is None, d, canonical(a), canonical(b), None))
            except Exception as e:  # say, nested deeper than Python goes
                rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["passed", "reason", "prediction", "truth", "error"]).astype({"passed": "boolean"})

    return matched(actual, expected)
