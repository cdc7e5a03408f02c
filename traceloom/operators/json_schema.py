"""JSON Schema as columns: a schema becomes one expression over a VARIANT.

Nothing is interpreted a row: types, bounds, patterns and nested properties and
items are built-in functions, higher-order ones for items.  A keyword that isn't
here is refused when the check is made, not ignored.  Numbers are numbers: 5.0
is an integer and equals 5; booleans equal no number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import member, one_of

TYPES = ("string", "number", "integer", "boolean", "array", "object", "null")
#: Keywords that say nothing about a value.
REMARKS = ("$schema", "$id", "title", "description", "default", "examples", "$comment")


def problems(schema: dict | bool, v: Column, at: str = "$") -> Column:
    """array<string> of what is wrong with a VARIANT (never SQL null; JSON null is a value), each with its path; items share their list's."""
    none = F.array().cast("array<string>")
    if isinstance(schema, bool):
        return none if schema else F.array(F.lit(f"{at} is not allowed"))
    out: list[Column] = []
    rest = dict(schema)
    kind = F.when(F.is_variant_null(v), "NULL").otherwise(F.schema_of_variant(v))
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    value = F.try_variant_get(v, "$", "double")
    is_ = {
        "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "NULL", "array": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT"),
        "number": number, "integer": number & F.coalesce(value == F.floor(value), F.lit(False)),
    }

    def expect(applies: Column | None, fits: Column, said: str) -> None:
        bad = ~F.coalesce(fits, F.lit(False))
        out.append(F.when(bad if applies is None else applies & bad, F.array(F.lit(f"{at} {said}"))).otherwise(none))

    def whole(name: str) -> int:
        n = rest.pop(name)
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise ValueError(f"{name} at {at} must be a whole number")
        return n

    for r in REMARKS:
        rest.pop(r, None)
    if "type" in rest:
        kinds = rest.pop("type")
        kinds = [kinds] if isinstance(kinds, str) else list(kinds)
        if unknown := [k for k in kinds if k not in TYPES]:
            raise ValueError(f"unknown type at {at}: {', '.join(map(str, unknown))}")
        fits = F.lit(False)
        for k in kinds:
            fits = fits | is_[k]
        expect(None, fits, f"is not of type {' or '.join(kinds)}")
    for name, values in (("enum", rest.pop("enum", None)), ("const", [rest.pop("const")] if "const" in rest else None)):
        if values is not None:
            expect(None, _among(v, kind, values), f"is not what {name} allows")
    bounds: dict[str, Callable[[Column, float], Column]] = {"minimum": lambda x, n: x >= n, "maximum": lambda x, n: x <= n, "exclusiveMinimum": lambda x, n: x > n, "exclusiveMaximum": lambda x, n: x < n}
    for name, holds in bounds.items():
        if name in rest:
            n = rest.pop(name)
            expect(number, holds(value, float(n)), f"is beyond {name} {n}")
    text = F.try_variant_get(v, "$", "string")
    if "minLength" in rest:
        n = whole("minLength")
        expect(is_["string"], F.length(text) >= n, f"is shorter than {n}")
    if "maxLength" in rest:
        n = whole("maxLength")
        expect(is_["string"], F.length(text) <= n, f"is longer than {n}")
    if "pattern" in rest:
        pattern = rest.pop("pattern")
        expect(is_["string"], text.rlike(pattern), f"doesn't match {pattern}")
    items = F.try_variant_get(v, "$", "array<variant>")
    if "minItems" in rest:
        n = whole("minItems")
        expect(is_["array"], F.size(items) >= n, f"has fewer than {n} items")
    if "maxItems" in rest:
        n = whole("maxItems")
        expect(is_["array"], F.size(items) <= n, f"has more than {n} items")
    if "items" in rest:
        each = rest.pop("items")
        out.append(F.when(is_["array"], F.flatten(F.transform(items, lambda x: problems(each, _value(x), f"{at}[]")))).otherwise(none))
    declared = rest.pop("properties", {})
    field = lambda name: member(v, name)
    for name, inner in declared.items():
        out.append(F.when(is_["object"] & field(name).isNotNull(), problems(inner, field(name), f"{at}.{name}")).otherwise(none))
    for name in rest.pop("required", []):
        out.append(F.when(is_["object"] & field(name).isNull(), F.array(F.lit(f"{at}.{name} is missing"))).otherwise(none))
    extra = rest.pop("additionalProperties", True)
    if not isinstance(extra, bool):
        raise ValueError(f"additionalProperties at {at} must be true or false")
    if not extra:
        keys = F.coalesce(F.json_object_keys(F.to_json(v)), none)
        more = F.filter(keys, lambda k: ~k.isin(list(declared))) if declared else keys
        out.append(F.when(is_["object"], F.transform(more, lambda k: F.concat(F.lit(f"{at}."), k, F.lit(" is not declared")))).otherwise(none))
    for inner in rest.pop("allOf", []):
        out.append(problems(inner, v, at))
    if "anyOf" in rest:
        fits = F.lit(False)
        for inner in rest.pop("anyOf"):
            fits = fits | (F.size(problems(inner, v, at)) == 0)
        expect(None, fits, "fits nothing of anyOf")
    if "not" in rest:
        expect(None, F.size(problems(rest.pop("not"), v, at)) > 0, "fits what it must not")
    if rest:
        raise ValueError(f"unsupported keywords at {at}: {', '.join(sorted(rest))}")
    return F.concat(*out) if out else none


def _value(x: Column) -> Column:
    """An item that is SQL null stands for JSON null."""
    return F.coalesce(x, F.parse_json(F.lit("null")))


def _among(v: Column, kind: Column, values: list) -> Column:
    some = [x for x in values if x is not None]
    fits = (kind == "NULL") if len(some) < len(values) else F.lit(False)
    return fits | ((kind != "NULL") & one_of(v, some)) if some else fits
