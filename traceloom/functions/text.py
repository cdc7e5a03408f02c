"""Scalar text functions, as built-in columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F




def normalize(text: Column, lower: bool = False, strip: bool = True, collapse_whitespace: bool = False) -> Column:
    """Null is empty; strip, then collapse, then lower."""
    out = F.coalesce(text, F.lit(""))
    if strip:
        out = F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
    if collapse_whitespace:
        out = F.regexp_replace(out, r"(?U)\s+", " ")
    return F.lower(out) if lower else out


def short(text: Column, limit: int = 120) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def as_bool(json: Column) -> Column:
    """A judge's answer as a boolean; null for what is neither."""
    plain = F.lower(F.regexp_replace(F.trim(F.regexp_replace(json, '^"|"$', "")), r"^\s+|\s+$", ""))
    return F.when(plain.isin("true", "yes", "y", "1", "pass"), True).when(plain.isin("false", "no", "n", "0", "fail"), False)


def render(template: str, values: dict[str, Column]) -> Column:
    """``{{ name }}`` in a template; an undeclared name raises here, a null value is ``None``."""
    parts: list[Column] = []
    for i, part in enumerate(re.split(r"\{\{\s*([A-Za-z_]\w*)\s*\}\}", template)):
        if i % 2 and part not in values:
            raise ValueError(f"the template uses {part!r}, which is no input")
        parts.append(F.coalesce(values[part], F.lit("None")) if i % 2 else F.lit(part))
    return F.concat(*parts)
