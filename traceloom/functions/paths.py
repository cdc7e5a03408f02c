"""Paths into traces, compiled to columns.

``a.b``, ``a[0].b``, ``a.0.b``, negative indexes; keys are identifiers.  A path
gives a :class:`Found`: whether the value is there (MISSING and a stored null
are different answers), whether it is null, and its JSON and plain text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CALL, JSON_FIELDS, TRACE
from .canon import canonical

KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
INDEX = re.compile(r"-?[0-9]+\Z")


def split_path(path: str) -> list[str | int]:
    """The segments of a path; a malformed one raises ValueError."""
    if not isinstance(path, str) or not path.strip():
        raise ValueError("a path can't be empty")
    out: list[str | int] = []
    for part in path.split("."):
        m = re.fullmatch(r"\s*([^\[\]\s]*)\s*((?:\[\s*-?[0-9]+\s*\])*)\s*", part)
        if not m or not m[1]:
            raise ValueError(f"malformed path: {path!r}")
        if INDEX.match(m[1]):
            out.append(int(m[1]))
        elif KEY.match(m[1]):
            out.append(m[1])
        else:
            raise ValueError(f"malformed path: {path!r}")
        out += [int(x) for x in re.findall(r"-?[0-9]+", m[2])]
    return out


@dataclass(frozen=True)
class Found:
    present: Column
    is_null: Column
    json: Column
    text: Column

    @property
    def missing(self) -> Column:
        return ~self.present


def nothing() -> Found:
    null = F.lit(None).cast("string")
    return Found(F.lit(False), F.lit(True), null, null)


def plain_number(text: Column) -> Column:
    """A double's JSON text without an exponent where people would write none (from 0.0001 below 10^16)."""
    size = F.abs(text.try_cast("double"))
    digits = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?[0-9])0+$", "$1")
    return F.when(text.contains("E") & (size >= 1e-4) & (size < 1e16), F.coalesce(digits, text)).otherwise(text)


def _of_variant(v: Column, stored: Column) -> Found:
    """``stored`` is the same value as JSON text: VARIANT drops the zero of 45.0, which the text keeps."""
    null = F.coalesce(F.is_variant_null(v), F.lit(True))
    kind = F.schema_of_variant(v)
    plain = F.try_variant_get(v, "$", "string")
    literal = F.coalesce(stored, F.to_json(v))
    json = F.when(v.isNotNull() & null, F.lit("null")).when(kind == "STRING", F.to_json(v)).when(~null, literal)
    return Found(v.isNotNull(), null, json, F.when(kind == "BOOLEAN", F.initcap(plain)).when(kind == "STRING", plain).when(~null, plain_number(literal)))


def _in_json(text: Column, rest: list[str | int]) -> Found:
    v, step, at = F.try_parse_json(text), "$", F.lit("$")
    stored = lambda path: F.call_function("get_json_object", text, path)
    for seg in rest:
        if isinstance(seg, int) and seg < 0:
            v = F.try_element_at(F.try_variant_get(v, step, "array<variant>"), F.lit(seg))
            step, at = "$", F.concat(at, F.lit("["), (F.json_array_length(stored(at)) + seg).cast("string"), F.lit("]"))
        else:
            part = f"[{seg}]" if isinstance(seg, int) else f".{seg}"
            step, at = step + part, F.concat(at, F.lit(part))
    return _of_variant(F.try_variant_get(v, step, "variant") if step != "$" else v, stored(at))


def member_path(key: str) -> str | None:
    """The VARIANT path of one key, dots included; null for the few keys that no path can name."""
    quote = next((q for q in "'\"" if q not in key), None)
    return f"$[{quote}{key}{quote}]" if key and quote else None


def member(v: Column, key: str | Column, path: str | Column | None = None) -> Column:
    """A VARIANT object's value under a key; ``path`` is the key's ``member_path`` where ``key`` is a column."""
    if isinstance(key, str):
        path = member_path(key)
        if path is not None:
            return F.try_variant_get(v, path, "variant")
        return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))
    return F.when(path.isNotNull(), F.try_variant_get(v, path, "variant")).otherwise(F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), key))


def one_of(v: Column, values: Iterable) -> Column:
    """Whether a VARIANT equals one of some plain values; numbers as numbers, and booleans are none."""
    texts, numbers = comparable(values)
    same = F.to_json(v).isin(texts)
    return same | (F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & F.try_variant_get(v, "$", "double").isin(numbers)) if numbers else same


def comparable(values: Iterable) -> tuple[list[str], list[float]]:
    """(texts as VARIANT prints them, those that are numbers exact in doubles)."""

    def printed(x: object) -> object:
        if isinstance(x, dict):
            return {k: printed(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [printed(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 1e15 else x

    values = list(values)
    return [canonical(printed(x)) for x in values], [float(x) for x in values if isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) <= 2**53]


def calls_json(calls: Column) -> Column:
    """An array of calls as JSON text; null fields left out.

    Arguments and results stand as they are stored, so that 45.0 stays 45.0 and
    nulls inside them stay; a text that is no JSON stands as a string.
    """

    def field(c: Column, n: str) -> Column:
        quoted = F.to_json(c[n].cast("variant"))
        value = F.when(F.try_parse_json(c[n]).isNotNull(), c[n]).otherwise(quoted) if n in JSON_FIELDS else quoted
        return F.when(c[n].isNotNull(), F.concat(F.lit(f'"{n}":'), value))

    one = lambda c: F.concat(F.lit("{"), F.concat_ws(",", *[field(c, n) for n in ("name", "arguments", "call_id", "node", "result", "error")]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(calls, one), ","), F.lit("]"))


def resolve(path: str, root: Column | None = None, schema: T.StructType | None = None) -> Found:
    """The value at ``path`` of a trace.

    Typed fields are there whenever their parent is, so an unset ``output.text``
    is null, not missing.
    """
    kind: T.DataType = schema or T._parse_datatype_string(TRACE)
    cur, present = root, F.lit(True)
    segments = split_path(path)
    for n, seg in enumerate(segments):
        if isinstance(kind, T.StructType):
            if not isinstance(seg, str) or seg not in kind.fieldNames():
                return nothing()
            if cur is not None:
                present = present & cur.isNotNull()
            cur = F.col(seg) if cur is None else cur[seg]
            kind = kind[seg].dataType
            if seg in JSON_FIELDS:
                rest = segments[n + 1 :]
                found = _in_json(cur, rest)
                if not rest and seg not in ("ground_truth", "metadata"):  # a typed field: there even if null
                    return Found(present, cur.isNull() | found.is_null, found.json, found.text)
                return found
        elif isinstance(kind, T.ArrayType):
            if not isinstance(seg, int):
                return nothing()
            present = present & (F.size(cur) >= (-seg if seg < 0 else seg + 1))
            cur = F.try_element_at(cur, F.lit(seg if seg < 0 else seg + 1))
            kind = kind.elementType
        else:
            return nothing()
    present = F.coalesce(present, F.lit(False))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and "arguments" in kind.elementType.fieldNames():
        text = calls_json(F.coalesce(cur, F.array().cast(kind)))
        return Found(present, F.lit(False), text, text)
    if isinstance(kind, (T.ArrayType, T.StructType)):
        text = F.to_json(cur)
        return Found(present, cur.isNull(), text, text)
    return Found(present, cur.isNull(), F.to_json(cur.cast("variant")), cur.cast("string"))


def may_hold_calls(path: str) -> None:
    """Refuse a path that can lead to no calls: neither recorded ones nor into free-form values."""
    segments = split_path(path)
    if segments != ["output", "tool_calls"] and not any(s in JSON_FIELDS for s in segments):
        raise ValueError(f"{path!r} is no array of calls")


def calls_at(path: str) -> tuple[Column, Column]:
    """(calls, why not applicable) at a path: recorded calls, or a JSON array of objects elsewhere in the trace."""
    if split_path(path) == ["output", "tool_calls"]:
        calls = F.col("output.tool_calls")
        return calls, F.when(calls.isNull(), "no tool calls recorded").when(F.size(calls) == 0, "no tool calls")
    found = resolve(path)
    calls = F.from_json(F.when(found.json.startswith("["), found.json), f"array<{CALL}>")
    why = F.when(found.missing, f"no value at {path}").when(found.is_null, "no tool calls recorded").when(calls.isNull(), f"no array of calls at {path}")
    return calls, why.when(F.size(calls) == 0, "no tool calls")
