"""JSONL scan with physical line numbers, mapping, and validation.

Lines get their number from where their block of the file starts: blocks count
their lines first, so that a large file is still read by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.canon import canonical_json, content_hash
from ..functions.paths import split_path
from ..schema import ARTIFACT_TYPES, INPUT, OUTPUT, ROLES
from ..session import ship


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every physical line, from 1."""
    at = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("i"), "value")
    first = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("i").alias("i0"))
    ahead = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    first = first.select("file", "block", "i0", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return lines.join(first, ["file", "block"]).select("file", (F.col("before") + F.col("i") - F.col("i0") + 1).alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): (source_id, data) of the objects, (source_id, message) of bad lines.

    Blank lines and those starting with ``//`` are skipped but counted.
    """
    value = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    lines = scan(spark, path).withColumn("value", value).where("value <> '' and not startswith(value, '//')")
    v = F.try_parse_json("value")
    typed = lines.select("line", F.concat(F.lit("line:"), F.col("line")).alias("source_id"), F.col("value").alias("data"), F.schema_of_variant(v).alias("kind"))
    good = typed.where("kind like 'OBJECT%'")
    message = F.when(F.col("kind").isNull(), F.concat(F.lit("line "), F.col("line"), F.lit(": invalid JSON"))).otherwise(F.concat(F.lit("line "), F.col("line"), F.lit(": expected an object, found "), F.lower("kind")))
    errors = typed.where("kind is null or kind not like 'OBJECT%'").select("source_id", message.alias("message"))
    rows = good.select("source_id", "data", "line")
    if limit is not None:
        rows = rows.orderBy("line").limit(limit)
    return rows.drop("line"), errors


def mapped(rows: DataFrame, mapping: dict[str, str] | None) -> DataFrame:
    """(source_id, data): trace paths filled from source columns (``{target: source}``); absent ones stay unset.

    A column may fill several paths.  Without a mapping the rows are trace-shaped
    already.  Source names are flat columns.  Targets are set at plan time, so
    conflicts raise here.
    """
    if not mapping:
        return rows
    tree: dict = {}
    for target, source in mapping.items():
        at = tree
        *head, last = split_path(target)
        if any(isinstance(s, int) for s in (*head, last)):
            raise ValueError(f"{target!r}: a mapping sets fields, not list items")
        for s in head:
            at = at.setdefault(s, {})
            if not isinstance(at, dict):
                raise TypeError(f"{target!r} goes through a field that is set itself")
        if last in at:
            raise TypeError(f"{target!r} is set twice")
        at[last] = source
    v = F.try_parse_json("data")

    def text(node: dict | str) -> Column:
        if isinstance(node, str):
            return F.to_json(F.try_variant_get(v, "$['" + node.replace("'", "\\'") + "']", "variant"))
        pairs = [F.when(text(x).isNotNull(), F.concat(F.lit(f'"{k}":'), text(x))) for k, x in node.items()]
        return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))

    return rows.select("source_id", text(tree).alias("data"))


#: Keys that a trace may have, and those of its parts with the kind of value each takes.
TOP = ("trace_id", "input", "output", "ground_truth", "metadata", "source_id")
KINDS = {
    "": {"trace_id": "STRING", "input": "OBJECT", "output": "OBJECT", "ground_truth": "OBJECT", "metadata": "OBJECT", "source_id": "STRING"},
    "input": {"messages": "ARRAY", "user_request": "STRING", "system_prompt": "STRING", "tools_available": "ARRAY"},
    "output": {"text": "STRING", "tool_calls": "ARRAY", "artifacts": "ARRAY"},
}
ITEMS = {
    "input.messages": {"role": "STRING", "content": "STRING"},
    "output.tool_calls": {"name": "STRING", "arguments": "OBJECT", "call_id": "STRING", "node": "STRING", "result": "", "error": "STRING"},
    "output.artifacts": {"type": "STRING", "uri": "STRING", "duration_ms": "BIGINT", "mime": "STRING"},
}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, wherever the plan moves the expression."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def malformed(v: Column) -> Column:
    """What is wrong with the kinds and keys of a trace's VARIANT, or null: typed reading would empty it without a word."""

    def kind_of(x: Column) -> Column:
        return F.nullif(F.schema_of_variant(x), F.lit("VOID"))

    def kind_fault(x: Column, where: str, kind: str) -> Column:
        return let(kind_of(x), lambda found: F.when(~found.startswith(kind), F.concat(F.lit(f"{where}: must be of kind {kind.lower()}, found "), F.lower(found))))

    def keys_of(x: Column) -> Column:
        return F.coalesce(F.json_object_keys(F.to_json(x)), F.array().cast("array<string>"))

    def unknown(x: Column, fields: dict[str, str]) -> Column:
        return F.filter(keys_of(x), lambda k: ~k.isin(*fields))

    def checker(at: str, fields: dict[str, str]) -> Callable[[Column], Column]:
        def wrong(x: Column) -> Column:
            faults = [F.when(~F.coalesce(kind_of(x).startswith("OBJECT"), F.lit(False)), F.lit(f"{at}: items must be objects"))]
            faults.append(F.concat(F.lit(f"{at}: unknown field: "), F.get(unknown(x, fields), F.lit(0))))
            for name, kind in fields.items():
                faults.append(kind_fault(F.try_variant_get(x, f"$.{name}", "variant"), f"{at}.{name}", kind))
            return F.coalesce(*faults)

        return wrong

    parts: list[Column] = []
    for at, fields in KINDS.items():
        owner = F.try_variant_get(v, f"$.{at}", "variant") if at else v
        for name, kind in fields.items():
            where = f"{at}.{name}" if at else name
            parts.append(kind_fault(F.try_variant_get(v, f"$.{where}", "variant"), where, kind))
        if at:
            extra = unknown(F.when(kind_of(owner).startswith("OBJECT"), owner), fields)
            parts.append(F.concat(F.lit(f"{at}: unknown field: "), F.get(extra, F.lit(0))))
    for at, fields in ITEMS.items():
        items = F.coalesce(F.try_variant_get(v, f"$.{at}", "array<variant>"), F.array().cast("array<variant>"))
        parts.append(F.get(F.filter(F.transform(items, checker(at, fields)), lambda m: m.isNotNull()), F.lit(0)))
    return F.coalesce(*parts)


def to_traces(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(traces, errors) from (source_id, data)."""
    ship(rows.sparkSession)
    raw_out = OUTPUT.replace("result:string", "result:variant")
    d = F.from_json("data", f"trace_id string, input {INPUT}, output {raw_out}, ground_truth string, metadata string, source_id string")
    # parsed once for the many looks into it
    base = rows.withColumn("d", d).select("source_id", "data", let(F.try_parse_json("data"), malformed).alias("kinds"), "d.trace_id", F.col("d.input").alias("i"), F.col("d.output").alias("o"), "d.ground_truth", "d.metadata", F.col("d.source_id").alias("own"))
    bad_role = F.exists("i.messages", lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)))
    bad_uri = F.exists("o.artifacts", lambda a: F.coalesce(F.trim(a["uri"]) == "", F.lit(True)) | a["uri"].startswith("data:"))
    bad_type = F.exists("o.artifacts", lambda a: ~F.coalesce(a["type"].isin(*ARTIFACT_TYPES), F.lit(False)))
    extra = F.filter(F.json_object_keys("data"), lambda k: ~k.isin(*TOP))
    why = (
        F.when(F.coalesce(F.col("trace_id"), F.lit("")) == "", "trace_id: must not be empty")
        .when(F.size(extra) > 0, F.concat(F.lit("unknown field: "), extra[0]))
    )
    why = F.coalesce(
        why,
        F.col("kinds"),
        F.when(F.coalesce(bad_role, F.lit(False)), f"input.messages: role must be one of {', '.join(ROLES)}")
        .when(F.coalesce(bad_uri, F.lit(False)), "output.artifacts: uri must be a reference, not blank or data:")
        .when(F.coalesce(bad_type, F.lit(False)), f"output.artifacts: type must be one of {', '.join(ARTIFACT_TYPES)}")
    )
    checked = base.withColumn("why", why)
    calls = F.transform("o.tool_calls", lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["arguments"], F.lit("{}")).alias("arguments"), c["call_id"].alias("call_id"), c["node"].alias("node"), F.to_json(c["result"]).alias("result"), c["error"].alias("error")))
    empty = F.array().cast(T._parse_datatype_string(OUTPUT)["tool_calls"].dataType)
    output = F.struct(F.col("o.text").alias("text"), F.coalesce(calls, empty).alias("tool_calls"), F.col("o.artifacts").alias("artifacts"))
    given = F.struct(F.col("i.messages").alias("messages"), F.col("i.user_request").alias("user_request"), F.col("i.system_prompt").alias("system_prompt"), F.col("i.tools_available").alias("tools_available"))
    identity = F.concat(F.lit("["), F.to_json(F.col("trace_id").cast("variant")), F.lit(","), *[x for n in ("input", "output", "ground_truth", "metadata") for x in (F.coalesce(F.get_json_object("data", f"$.{n}"), F.lit("{}")), F.lit("," if n != "metadata" else "]"))])
    good = checked.where("why is null").select("trace_id", given.alias("input"), output.alias("output"), "ground_truth", "metadata", F.coalesce("own", "source_id").alias("source_id"), content_hash(canonical_json(identity)).alias("content_hash"))
    errors = checked.where("why is not null").select("source_id", F.concat_ws(": ", "source_id", "why").alias("message"))
    return good, errors


def unmapped_fields(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(field): source columns that no mapping takes."""
    taken = F.array(*map(F.lit, sorted(set(mapping.values()))))
    return rows.select(F.explode(F.array_except(F.json_object_keys("data"), taken)).alias("field")).distinct()
