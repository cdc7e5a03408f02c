import json

import pytest
from pyspark.sql import functions as F

from traceloom.functions.canon import MatchOptions, canonical, canonical_json, divergence, json_match, reduced
from traceloom.functions.paths import resolve, split_path
from traceloom.functions.text import as_bool, normalize, render, short

from .helpers import trace, traces


@pytest.mark.parametrize("path,want", [("a.b", ["a", "b"]), ("a[0].b", ["a", 0, "b"]), ("a.0.b", ["a", 0, "b"]), ("a[-1]", ["a", -1]), (" a . b ", ["a", "b"])])
def test_split(path, want):
    assert split_path(path) == want


@pytest.mark.parametrize("path", ["", "  ", "a..b", "a.b[", "a-b", "a.[0]", ".a", "a."])
def test_malformed(path):
    with pytest.raises(ValueError):
        split_path(path)


def test_resolve(spark):
    rows = traces(spark, [trace("t", calls=[{"name": "find", "arguments": {"order_id": 7, "deep": [1, {"x": None}]}}, {"name": "send"}], truth={"tone": None, "n": 1.5, "ok": True, "list": ["a", "b"]})])
    want = {
        "trace_id": (True, False, "t"), "output.text": (True, True, None), "output.tool_calls[0].name": (True, False, "find"), "output.tool_calls.1.name": (True, False, "send"), "output.tool_calls[-1].name": (True, False, "send"),
        "output.tool_calls[0].arguments.order_id": (True, False, "7"), "output.tool_calls[0].arguments.deep[1].x": (True, True, None), "output.tool_calls[0].arguments.deep[-2]": (True, False, "1"),
        "output.tool_calls[2].name": (False, True, None), "output.tool_calls[0].name.x": (False, True, None), "output.nothing": (False, True, None), "ground_truth.tone": (True, True, None), "ground_truth.other": (False, True, None),
        "ground_truth.ok": (True, False, "True"), "ground_truth.list[-1]": (True, False, "b"), "ground_truth.list[5]": (False, True, None), "output.tool_calls[0].result": (True, True, None), "metadata": (False, True, None),
    }
    for path, expected in want.items():
        f = resolve(path)
        row = rows.select(f.present.alias("p"), f.is_null.alias("n"), f.text.alias("t")).first()
        assert (row["p"], row["n"] if row["p"] else True, row["t"]) == expected, path


def test_normalize_and_others(spark):
    one = spark.createDataFrame([("  A  b\tC ", "x" * 121, '" Yes "', "maybe")], "a string, b string, c string, d string")
    row = one.select(
        normalize(F.col("a")).alias("strip"), normalize(F.col("a"), lower=True, collapse_whitespace=True).alias("all"), normalize(F.lit(None).cast("string")).alias("null"), normalize(F.col("a"), strip=False).alias("raw"),
        short(F.col("b")).alias("short"), as_bool(F.col("c")).alias("yes"), as_bool(F.col("d")).alias("neither"), render("{{ a }}-{{ n }}", {"a": F.lit("v"), "n": F.lit(None).cast("string")}).alias("r"),
    ).first()
    assert (row["strip"], row["all"], row["null"], row["raw"]) == ("A  b\tC", "a b c", "", "  A  b\tC ")
    assert row["short"] == "x" * 119 + "…" and row["yes"] is True and row["neither"] is None and row["r"] == "v-None"
    with pytest.raises(ValueError, match="'b'"):
        render("{{ b }}", {})


def test_canonical_json(spark):
    texts = ['{"b":1.0,"a":[1, 2],"é":"ü"}', "1e-4", "nonsense", None, '{"a":1,"a":2}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical_json("t")).collect()]
    assert got == ['{"a":[1,2],"b":1.0,"é":"ü"}', "0.0001", None, None, '{"a":2}']


@pytest.mark.parametrize(
    "got,want,options,passed",
    [
        ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {}, True),
        ([1, 2], [2, 1], {}, False),
        ([1, 2], [2, 1], {"ignore_order": True}, True),
        ({"a": 42}, {"a": "42"}, {}, False),
        ({"a": 42}, {"a": "42"}, {"coerce_types": True}, True),
        ({"a": True}, {"a": "1"}, {"coerce_types": True}, False),
        ({"a": True}, {"a": 1}, {}, False),
        ({"a": 45}, {"a": 45.0}, {}, True),
        ({"a": 45}, {"a": 45.0}, {"coerce_types": True}, False),
        ({"a": None}, {}, {}, True),
        ({"a": None}, {}, {"treat_null_as_missing": False}, False),
        ({"a": {"b": None}}, {}, {}, True),
        ({"a": {}}, {}, {"treat_empty_as_missing": False}, False),
        ({"a": 1, "x": 1}, {"a": 1}, {}, False),
        ({"a": 1, "x": 1}, {"a": 1}, {"allow_extra_arguments": True}, True),
        ([{"arguments": {"id": 1, "k": 2}}], [{"arguments": {"id": 5, "k": 2}}], {"ignore_paths": ("arguments.id",)}, True),
        ([1], [1, 2], {}, False),
        ([], [], {}, True),
        ([], None, {}, False),
        ([None], [], {}, False),
        ([], {}, {}, False),
    ],
)
def test_structural_match(got, want, options, passed):
    o = MatchOptions(**options)
    assert (divergence(reduced(want, o), reduced(got, o), o.allow_extra_arguments) is None) is passed


def test_json_match_column(spark):
    rows = spark.createDataFrame([(json.dumps({"a": [1, 2]}), json.dumps({"a": [1, 3]})), ("1", "1"), (None, "1")], "g string, w string")
    got = [r["m"] for r in rows.select(json_match(F.col("g"), F.col("w"), MatchOptions()).alias("m")).collect()]
    assert got[0]["passed"] is False and got[0]["reason"] == "$.a[1]: expected 3, got 2" and got[0]["prediction"] == canonical({"a": [1, 2]})
    assert got[1]["passed"] is True and got[2]["passed"] is None
