"""tool_registry_check and tool_call_outcome.

A trace's calls lie in one array and a registry is a constant that is probed by
name, so both checks are higher-order functions over the array: no explode, join
or shuffle, and a plan of one size for any registry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import version_of
from ..functions.lookup import Lookup
from ..functions.paths import calls_at, comparable, may_hold_calls, member, member_path, one_of, resolve, split_path
from ..functions.text import short
from ..registry import Registry
from .base import Narrow, helper, outcome

#: Codes that are reported without failing the check.
ADVISORY = ("duplicate_undeclared",)
ARGUMENT = "name:string,path:string,type:string,required:boolean,texts:array<string>,numbers:array<double>,listed:string"
TOOL = f"arguments:array<struct<{ARGUMENT}>>,names:array<string>,extra:boolean,side_effecting:boolean,description:string"


def tools_of(registry: Registry) -> Lookup:
    """What the checks need of each tool, by name."""
    rows = {}
    for name, tool in registry.tools.items():
        arguments = []
        for arg, s in tool.arguments.items():
            texts, numbers = comparable(s.enum) if s.enum is not None else (None, None)
            arguments.append({"name": arg, "path": member_path(arg), "type": s.type, "required": s.required, "texts": texts, "numbers": numbers, "listed": ", ".join(registry.enum_texts(name, arg))})
        rows[name] = {"arguments": arguments, "names": list(tool.arguments), "extra": tool.allow_extra_arguments, "side_effecting": tool.side_effecting, "description": tool.description}
    return Lookup(rows, TOOL)


def kind_of(v: Column) -> Column:
    """The type of a VARIANT as registries name types; 5.0 is a number but no integer."""
    schema = F.schema_of_variant(v)
    return (
        F.when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object")
        .when(schema.rlike(r"^(BIGINT|DECIMAL\((19|[23][0-9]),0\))$"), "integer").when(schema.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "number")
    )


def _problem(a: Column, v: Column) -> Column:
    """What is wrong with one declared argument's value; null if nothing is."""
    null = F.coalesce(F.is_variant_null(v), F.lit(False))
    named = lambda *parts: F.concat(F.lit("argument '"), a["name"], F.lit("'"), *parts)
    fits = (kind_of(v) == a["type"]) | ((a["type"] == "number") & (kind_of(v) == "integer"))
    listed = F.array_contains(a["texts"], F.to_json(v)) | (kind_of(v).isin("integer", "number") & F.coalesce(F.array_contains(a["numbers"], F.try_variant_get(v, "$", "double")), F.lit(False)))
    return (
        F.when(v.isNull(), F.when(a["required"], named(F.lit(" is required and not given"))))
        .when(null, F.when(a["required"], named(F.lit(" is required and null"))))
        .when(~fits, named(F.lit(" is not of type "), a["type"], F.lit(": "), F.to_json(v)))
        .when(a["texts"].isNotNull() & ~listed, named(F.lit(" is none of "), a["listed"], F.lit(": "), F.to_json(v)))
    )


def _problems(spec: Column, arguments: Column, parsed: Column) -> Column:
    none = F.array().cast("array<string>")
    object_ = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    declared = F.array_compact(F.transform(spec["arguments"], lambda a: _problem(a, member(parsed, a["name"], a["path"]))))
    keys = F.coalesce(F.json_object_keys(F.coalesce(arguments, F.lit("{}"))), none)
    undeclared = F.transform(F.filter(keys, lambda k: ~F.array_contains(spec["names"], k)), lambda k: F.concat(F.lit("argument '"), k, F.lit("' is not declared")))
    found = F.concat(declared, F.when(spec["extra"], none).otherwise(undeclared))
    return F.when(~object_, F.array(F.lit("arguments are not an object"))).otherwise(F.coalesce(found, none))


def argument_problems(registry: Registry, tool: Column, arguments: Column) -> Column:
    """An array of messages: declared arguments in order, then undeclared ones; arguments that are no object are one problem."""
    return _problems(tools_of(registry).find(tool), arguments, F.try_parse_json(F.coalesce(arguments, F.lit("{}"))))


#: A string's inside, or a number, of JSON text.
TOKENS = r'"((?:\\.|[^"\\])*)"|(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)'


def number_texts(json: Column) -> Column:
    """JSON text whose strings and keys begin with s and whose numbers are strings that begin with n, so that 5 and 5.0 stay different."""
    marked = F.regexp_replace(json, TOKENS, "\u0002$1\u0003$2\u0004")  # control characters never stand in JSON text as they are
    numbers = F.regexp_replace(marked, "\u0002\u0003([^\u0004]+)\u0004", '"n$1"')
    return F.regexp_replace(numbers, "\u0002([^\u0003]*)\u0003\u0004", '"s$1"')


def call_print(c: Column) -> Column:
    """What two equal calls share: the name and the arguments in order of keys, with 5 and 5.0 told apart wherever they stand."""
    arguments = F.coalesce(c["arguments"], F.lit("{}"))
    return F.concat_ws("\u0001", c["name"], F.coalesce(F.to_json(F.try_parse_json(number_texts(F.get_json_object(arguments, "$")))), arguments))


def with_first(rows: DataFrame, calls: Column, out: str) -> DataFrame:
    """``rows`` with, for each call, the place of the first equal call if that is ahead of it, else null.

    Calls are sorted once and cut where they change, so the work grows as their number.
    """
    heads, at = f"{out}_heads", F.col(out)
    rows = rows.withColumn(out, F.array_sort(F.transform(calls, lambda c, i: F.struct(call_print(c).alias("p"), i.alias("i")))))
    opens = F.transform(out, lambda x, k: F.when((k == 0) | (F.get(at, k - 1)["p"] != x["p"]), k))
    rows = rows.withColumn(heads, F.filter(opens, lambda k: k.isNotNull()))

    def alike(h: Column, j: Column) -> Column:
        many = F.coalesce(F.get(F.col(heads), j + 1), F.size(at)) - h
        first = F.get(at, h)["i"]
        return F.transform(F.slice(at, h + 1, many), lambda x: F.struct(x["i"].alias("i"), F.when(first < x["i"], first).alias("of")))

    marked = F.flatten(F.transform(heads, alike))
    return rows.withColumn(out, marked).withColumn(out, F.transform(F.array_sort(out), lambda x: x["of"])).drop(heads)


def violations(registry: Registry, calls: Column, default_node: Column | None = None, check_arguments: bool = True, first: Column | None = None) -> Column:
    """array<struct<code, call, tool, message>> of a trace's calls, in order; ``first`` as of with_first, to look for duplicates."""
    none = F.array().cast("array<struct<code:string,call:int,tool:string,message:string>>")
    tools, nodes = tools_of(registry), Lookup({n: {"tools": list(t)} for n, t in registry.nodes.items()}, "tools:array<string>")
    text = F.lit(None).cast("string")

    def probed(c: Column, i: Column) -> Column:
        node = F.coalesce(c["node"], default_node if default_node is not None else text)
        return F.struct(
            c["name"].alias("name"), c["arguments"].alias("arguments"), i.cast("int").alias("i"), node.alias("node"), tools.find(c["name"]).alias("spec"), nodes.find(node).alias("at"),
            (F.try_parse_json(F.coalesce(c["arguments"], F.lit("{}"))) if check_arguments else text).alias("parsed"), (F.get(first, i) if first is not None else F.lit(None).cast("int")).alias("again"),
        )

    def one(code: str, x: Column, *message: Column) -> Column:
        return F.array(F.struct(F.lit(code).alias("code"), x["i"].alias("call"), x["name"].alias("tool"), F.concat(*message).alias("message")))

    def of_call(x: Column) -> Column:
        name, spec = x["name"], x["spec"]
        parts = [
            F.when(x["node"].isNotNull() & x["at"].isNull(), one("unknown_node", x, F.lit("unknown node '"), x["node"], F.lit("'"))).otherwise(none),
            F.when(~F.array_contains(x["at"]["tools"], name), one("not_permitted_at_node", x, name, F.lit(" is not permitted at node '"), x["node"], F.lit("'"))).otherwise(none),
        ]
        if check_arguments:
            parts.append(F.transform(_problems(spec, x["arguments"], x["parsed"]), lambda m: F.struct(F.lit("invalid_arguments").alias("code"), x["i"].alias("call"), name.alias("tool"), F.concat(name, F.lit(": "), m).alias("message"))))
        if first is not None:
            again = (name, F.lit(" repeats call "), x["again"].cast("string"))
            parts.append(F.when(x["again"].isNotNull() & spec["side_effecting"], one("duplicate_side_effecting", x, *again)).when(x["again"].isNotNull() & spec["side_effecting"].isNull(), one("duplicate_undeclared", x, *again)).otherwise(none))
        return (
            F.when(name.isNull(), one("unnamed_call", x, F.lit("the call has no name")))
            .when(spec.isNull(), one("unregistered_tool", x, name, F.lit(" is not in the registry")))
            .otherwise(F.concat(*parts))
        )

    return F.flatten(F.transform(F.transform(calls, probed), of_call))


@dataclass(frozen=True)
class ToolRegistryCheck(Narrow):
    id: str
    registry: Registry
    actual: str = "output.tool_calls"
    node_path: str | None = None
    check_arguments: bool = True
    check_duplicates: bool = True
    expected: str | None = None

    def __post_init__(self):
        if self.expected is not None:
            raise ValueError("a registry check compares with the registry and takes no expected path")
        may_hold_calls(self.actual)

    def version_hash(self) -> str:
        return version_of(["tool_registry_check", self.id, self.registry.hash(), self.actual, self.node_path, self.check_arguments, self.check_duplicates])

    def columns(self, traces: DataFrame, tag: str) -> tuple[DataFrame, dict[str, Column]]:
        found, again, kept = (helper(tag, n) for n in ("violations", "again", "calls"))
        calls, why = calls_at(self.actual)
        rows = traces.withColumn(kept, calls)
        calls = F.col(kept)
        node = resolve(self.node_path).text if self.node_path else None
        if self.check_duplicates:
            rows = with_first(rows, calls, again)
        rows = rows.withColumn(found, F.when(why.isNull(), violations(self.registry, calls, node, self.check_arguments, F.col(again) if self.check_duplicates else None)))
        failing = F.filter(found, lambda x: ~x["code"].isin(*ADVISORY))
        cols = outcome(F.when(why.isNull(), F.size(failing) == 0), why)
        said = F.concat_ws("; ", F.transform(F.when(F.size(failing) > 0, failing).otherwise(F.col(found)), lambda x: x["message"]))
        cols["explanation"] = F.coalesce(cols["explanation"], F.nullif(said, F.lit("")))
        cols["raw_output"] = F.when(F.size(found) > 0, F.to_json(F.struct(F.col(found).alias("violations"))))
        cols["normalized_prediction"] = F.when(why.isNull(), F.to_json(F.transform(calls, lambda c: c["name"])))
        return rows, cols


@dataclass(frozen=True)
class ToolCallOutcome(Narrow):
    id: str
    actual: str = "output.tool_calls"
    error_field: str = "error"
    failure_values: tuple = ()
    expected: str | None = None

    def __post_init__(self):
        if self.expected is not None:
            raise ValueError("an outcome check reads what was recorded and takes no expected path")
        split_path(self.error_field)
        may_hold_calls(self.actual)

    def version_hash(self) -> str:
        return version_of(["tool_call_outcome", self.id, self.actual, self.error_field, list(self.failure_values)])

    def columns(self, traces: DataFrame, tag: str) -> tuple[DataFrame, dict[str, Column]]:
        from pyspark.sql import types as T

        from ..schema import CALL

        calls, why = calls_at(self.actual)
        schema = T._parse_datatype_string(CALL)

        def seen(c: Column, i: Column) -> Column:
            v = resolve(self.error_field, c, schema)
            recorded = v.present & ~v.is_null
            if self.failure_values:
                failed = one_of(F.try_parse_json(v.json), self.failure_values)
            else:  # a text that is not blank, or any other value that is not empty
                empty = v.json.isin("null", "false", "[]", "{}") | F.coalesce(v.json.try_cast("double") == 0, F.lit(False)) | v.json.rlike(r'^"(\s|\\[nrt])*"$')
                failed = ~F.coalesce(empty, F.lit(True))
            return F.struct(i.cast("int").alias("call"), c["name"].alias("tool"), short(v.text).alias("error"), recorded.alias("r"), (recorded & failed).alias("f"))

        seen_at = helper(tag, "outcomes")
        rows = traces.withColumn(seen_at, F.when(why.isNull(), F.transform(calls, seen)))
        recorded = F.size(F.filter(seen_at, lambda x: x["r"]))
        failures = F.transform(F.filter(seen_at, lambda x: x["f"]), lambda x: F.struct(x["call"].alias("call"), x["tool"].alias("tool"), x["error"].alias("error")))
        reason = F.coalesce(why, F.when(recorded == 0, "no call recorded an outcome"))
        passed = F.when(reason.isNull(), F.size(failures) == 0)
        cols = outcome(passed, reason)
        cols["explanation"] = F.coalesce(cols["explanation"], F.when(~passed, F.concat_ws("; ", F.transform(failures, lambda x: F.concat(x["tool"], F.lit(": "), x["error"])))))
        cols["raw_output"] = F.when(~passed, F.to_json(F.struct(failures.alias("failures"), recorded.alias("recorded"))))
        cols["normalized_prediction"] = F.when(why.isNull(), F.to_json(F.transform(calls, lambda c: c["name"])))
        return rows, cols
