"""Operators 11 to 13 against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import licenses, negatives, queries, search
from traceloom.llm.shared import over_cells

SF = "/root/testdata/sf0.001"


def test_over_cells_numbers_every_cell(spark):
    rows = spark.createDataFrame([(1, 10), (2, 1), (3, 4)], "id int, n int")
    got = sorted(tuple(r) for r in over_cells(rows.drop("n"), 5, "c", step=2).collect())
    assert got == [(i, c) for i in (1, 2, 3) for c in range(5)]
    got = sorted((r["id"], r["c"]) for r in over_cells(rows, F.col("n"), "c", step=4).collect())
    assert got == [(i, c) for i, n in ((1, 10), (2, 1), (3, 4)) for c in range(n)]


# 11: hard negatives


def brute_negatives(rows, every, positives, top, low, high, scale=256):
    """Rows (id, label, vector) that take part; all scores in Python's whole numbers."""
    whole = {i: [math.floor(scale * x) for x in v] for i, _, v in rows}
    label = {i: y for i, y, _ in rows}
    out = set()
    for a in (i for i in whole if i % every == 0):
        s = {b: sum(x * y for x, y in zip(whole[a], whole[b])) for b in whole if b != a}
        order = sorted(s, key=lambda b: (-s[b], b))
        for p in [b for b in order if label[b] == label[a]][:positives]:
            fit = [b for b in order if label[b] != label[a] and low * s[p] <= 100 * s[b] <= high * s[p]][:top]
            out |= {(a, p, k, b, s[p], s[b]) for k, b in enumerate(fit, 1)}
    return out


def mined(table, **options):
    return [tuple(r) for r in negatives.mine(table, **options).collect()]


@pytest.mark.parametrize("block,anchor_block,stripe,chunk", [(4096, 512, 64, 32), (70, 8, 3, 5), (16, 4, 64, 1)])
def test_negatives_match_brute_force(spark, block, anchor_block, stripe, chunk):
    rng = np.random.default_rng(block)
    x = rng.normal(size=(600, 12)) * rng.choice([0.2, 1, 3], 600)[:, None]
    x[100:250] = x[100]  # one common vector, and one common label
    label = np.where(rng.random(600) < 0.4, 3, rng.integers(0, 30, 600))
    rows = [(i, int(y), v.tolist()) for i, (y, v) in enumerate(zip(label, x))]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(7)
    got = mined(table, every=10, positives=4, top=6, block=block, anchor_block=anchor_block, stripe=stripe, chunk=chunk)
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows, 10, 4, 6, 30, 90)


def test_negatives_edges(spark):
    form = "vec_id long, label string, embedding array<double>, id string, v int, row int, ab int, k int"
    full = [(i, "ab"[i % 2], [1.0, float(i % 5)], "x", 1, 2, 3, 4) for i in range(21)]
    odd = [
        (None, "a", [1.0, 1.0]), (30, None, [1.0, 1.0]), (31, "a", None), (32, "a", [1.0, None]), (33, "a", [1.0, float("nan")]), (34, "a", [float("inf"), 1.0]),
        (35, "a", [1.0]), (36, "a", []), (37, "a", [1e300, 1.0]), (38, "a", [9e6, 9e6]), (3, "z", [50.0, 50.0]), (3, "b", [9.0, 9.0]), (40, "a", [0.0, 0.0]),
    ]
    table = spark.createDataFrame([*full, *full, *[(*r, None, None, None, None, None) for r in odd]], form)
    # of the rows of id 3 that with the least label, then vector
    part = [r[:3] for r in full] + [(38, "a", [9e6, 9e6]), (40, "a", [0.0, 0.0])]
    part = [(3, "b", [1.0, 3.0]) if r[0] == 3 else r for r in part]
    most = int((2**63 / 2) ** 0.5) - 1
    part = [r for r in part if all(abs(256 * x) < most for x in r[2])]
    got = mined(table, every=5, positives=3, top=4, low=10, high=100)
    assert len(got) == len(set(got)) and set(got) == brute_negatives(part, 5, 3, 4, 10, 100) and got
    assert mined(table.limit(0)) == [] and mined(table.where("vec_id % 5 <> 0"), every=5) == []


def test_products_beyond_doubles_are_exact():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-(2**30), 2**30, (5, 7)) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
    assert negatives.product(a, b).tolist() == want and negatives.product(a >> 20, b >> 20).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b >> 20] for r in a >> 20]


# 12: licenses


def plain_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_scan(text, phrases, templates, threshold):
    words = plain_words(text)
    places, base, labels, score = [], set(), set(), 0.0
    for label, phrase in phrases:
        p = plain_words(phrase)
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
                score = 1.0
    for label, template in templates:
        t = plain_words(template)
        half = 8
        while half < len(t):
            half *= 2
        for at in range(0, len(words), half):
            share = len(set(t) & set(words[at : at + 2 * half])) / len(set(t))
            if share >= threshold - 1e-12:
                labels.add(label)
                score = max(score, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score)


def scanned(table, **options):
    return [tuple(r) for r in licenses.scan(table, **options).collect()]


def test_scan_matches_brute_force(spark):
    rng = random.Random(12)
    common = [w for _, t in licenses.TEMPLATES for w in t.split()] + ["cc", "by", "nc"] * 8 + ["Under", "the", "MIT", "license"] * 4
    pieces = [t for _, t in licenses.TEMPLATES] + [p for _, p in licenses.PHRASES] + ["CC BY-NC", "Apache License, Version 2.0", "cc by nc cc by nc cc by nc", "under\nthe\tMIT-license"]
    rows = [(0, None), (1, ""), (2, "cc by nc"), (3, "¿cc by nc?"), (4, "ücc by nc"), (5, "cc by ncü"), (6, "... 日本 ..."), (7, "under the mit license " * 300), (8, "K under the K mit license")]
    for i in range(9, 260):
        out = []
        for _ in range(rng.randrange(1, 25)):
            pick = rng.random()
            if pick < 0.25:
                p = rng.choice(pieces).split(" ")
                for _ in range(rng.choice([0, 0, 1, 2])):
                    p[rng.randrange(len(p))] = rng.choice(common)
                rng.random() < 0.2 and rng.shuffle(p)
                out += p
            else:
                out += rng.choices(common, k=rng.randrange(4)) + [f"w{rng.randrange(500)}" for _ in range(rng.randrange(9))]
        rows.append((i, " ".join(out)))
    rows.append((260, " ".join(f"w{i % 977}" for i in range(150_000)) + " Released under the MIT License. " + "cc by nc " * 2000))
    rows += rows[2:12]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for threshold in (0.9, 0.6, 1.0):
        got = scanned(table, threshold=threshold)
        want = [(i, *brute_scan(t, licenses.PHRASES, licenses.TEMPLATES, threshold)) for i, t in rows]
        key = lambda r: (r[0], str(r))
        got, want = sorted([(r[0], *r[2:]) for r in got], key=key), sorted(want, key=key)
        assert [r[:-1] for r in got] == [r[:-1] for r in want]
        assert [r[-1] for r in got] == pytest.approx([r[-1] for r in want])
        assert len({r[6] for r in got}) > 10


def test_scan_with_other_columns_and_templates(spark):
    rows = [(1, "x", 5, "a b c d e f g h i j", None), (1, "x", 5, "a b c d e f g h i j", None), (None, None, None, "zero a", "t")]
    table = spark.createDataFrame(rows, "at long, held string, `n.words` int, body string, LABELS string")
    got = licenses.scan(table, text="body", phrases=[("one", "C d"), ("two", "a")], templates=[("three", "j i h g f e d c b zzz")])
    assert got.columns == ["at", "held", "n.words", "body", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted((tuple(r)[2], *tuple(r)[4:]) for r in got.collect() if r[2]) == [(5, 10, 2, 0, 2, "one,two", "one,three,two", 1.0)] * 2
    assert [tuple(r)[4:] for r in got.collect() if not r[2]] == [(2, 1, 1, 1, "two", "two", 1.0)]
    assert licenses.scan(table.limit(0), text="body").count() == 0
    found = licenses.license_blocks(table, ["at"], text="body", phrases=[("one", "c d")], templates=[("three", "j i h g f e d c b zzz")])
    assert sorted((r["row"]["at"], r["first_word"], r["label"], r["containment"], r["places"]) for r in found.where("label = 'one'").collect()) == [(1, 0, "one", 1.0, [2])] * 2
    with pytest.raises(ValueError):
        licenses.scan(table, text="body", phrases=[("none", "...")])


def test_scan_runs_no_python(spark):
    plan = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"), keep=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


# 13: ranked search


def plain_terms(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_rank(docs, items, top, once=True):
    """[(item, rank, doc, score)] over rows (id, text)."""
    held = [(d, Counter(plain_terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    total, terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for i, text in items:
        scores = []
        for d, c, n in held:
            m = 100 - 90 + (90 * n * total) // terms
            s = sum((1 if once else k) * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in Counter(plain_terms(text)).items() if t in c)
            if s:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, k, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top], 1)]
    return out


def by_row(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("options", [{}, {"rows": 3, "entries": 20, "item_block": 2, "bits": 1 << 16}, {"rows": 50, "item_block": 3, "once": False}])
def test_rank_matches_brute_force(spark, options):
    rng = random.Random(13)
    vocab = [f"w{i}" for i in range(60)] + ["the"] * 30 + ["Größe", "日本", "ΑΒΓ", "It", "s"]
    text = lambda n: rng.choice([" ", "_", "-", "\n"]).join(rng.choice(vocab) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 40))) for i in range(150)] + [(200, None), (201, ""), (202, "!?"), (None, "w1 w2"), (None, "w1 w2"), (203, "the w1 " * 30_000)]
    docs += [(i, "w1 w2 w3") for i in (91, 92, 7, 7, 7)] * 3  # ties and repeated rows
    items = [(i, text(rng.randrange(1, 30))) for i in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (23, "w1 W1 w1 w2"), (23, "w3"), (None, "w5 w5")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("block", F.lit("x")).withColumn("n", F.lit(2)).repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("y")).withColumn("doc_id", F.lit("z"))
    got = [tuple(r) for r in search.rank(d, i, **options).collect()]
    assert by_row(got) == by_row(brute_rank(docs, items, 10, options.get("once", True)))


def test_rank_matches_brute_force_over_many_tasks(spark):
    """Blocks of documents meet all items also where cells lie in tasks of their own."""
    rng = random.Random(31)
    docs = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 20)))) for i in range(120)]
    items = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(5))) for i in range(20)]
    d, i = (spark.createDataFrame(rows, f"{key} long, text string").repartition(3) for rows, key in ((docs, "doc_id"), (items, "item_id")))
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")
    try:
        got = [tuple(r) for r in search.rank(d, i, rows=10, item_block=4).collect()]
    finally:
        spark.conf.unset(merged)
    assert by_row(got) == by_row(brute_rank(docs, items, 10))


def test_rank_edges(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one")], "`a.id` string, `a.text` string")
    i = spark.createDataFrame([(1, "two ONE")], "`a.id` int, `q.text` string")
    got = search.rank(d, i, key="a.id", text="a.text", item_key="a.id", item_text="q.text")
    assert got.columns == ["a.id", "rank", "found_a.id", "score"] and [tuple(r)[:3] for r in sorted(got.collect(), key=lambda r: r[1])] == [(1, 1, "a"), (1, 2, "b"), (1, 3, None)]
    names = {"key": "a.id", "text": "a.text", "item_key": "a.id", "item_text": "q.text"}
    assert search.rank(d.limit(0), i, **names).count() == 0 and search.rank(d, i.limit(0), **names).count() == 0
    assert search.lengths(np.array([5, 10**12]), 10**11, 10**13).tolist() == [10 + 90 * 5 * 10**11 // 10**13, 10 + 90 * 10**12 * 10**11 // 10**13]


def test_queries_match_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    part = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in rows]
    assert {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in queries.op11(spark, SF).collect()} == brute_negatives(part, 100, 5, 10, 30, 90)
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op12(spark, SF).collect()}
    want = {d: brute_scan(t, licenses.PHRASES, licenses.TEMPLATES, 0.9) for d, t in texts}
    assert {d: r[:-1] for d, r in got.items()} == {d: r[:-1] for d, r in want.items()} and all(got[d][-1] == pytest.approx(want[d][-1]) for d in want)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert by_row(tuple(r) for r in queries.op13(spark, SF).collect()) == by_row(brute_rank(texts, items, 10))
