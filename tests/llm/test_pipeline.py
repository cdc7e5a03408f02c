"""The pipeline's stages, each against its own input."""

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before), name
        if name == "repeated_passages":
            assert set(after) == set(before) and all(len(after[k]) <= len(before[k]) for k in after)
        else:
            assert all(after[k] == before[k] for k in after)
        seen.append(len(after))
    assert seen[1] > 0.8 * seen[0] and seen[-1] > 0
    pieces = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(after)


def test_odd_rows(spark):
    rows = [(1, "one text", "en", "s", 8), (1, "one text", "en", "s", 8), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 2]
    for stage in (cp.cut_repeated_passages, cp.drop_leaks):
        assert stage(spark, docs, SF).count() == 5
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_rows_that_share_a_doc_id(spark):
    words = [f"word{i}" for i in range(80)]
    one, two = " ".join(words[:40]), " ".join(words[40:])
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, one), (5, one), (5, two), (1, two), (7, one), (7, leak), (None, leak)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, one), (1, two), (7, leak), (0, leak)])
    kept = cp.drop_leaks(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted(rows[:5])


def test_columns_of_any_name(spark):
    """Columns named like the stages' own, with dots, and without n_chars stay as they are."""
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "keep1", 7, "x"), (2, text, "keep2", 8, "y"), (3, leak, "keep3", 9, None), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ROW string, `a.b` int, component_id string")
    kept = cp.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], *rows[2:]]
    kept = cp.drop_leaks(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[1], rows[3]]
    cut = cp.cut_repeated_passages(spark, docs, SF)
    assert cut.columns == docs.columns and sorted(tuple(r)[2:] for r in cut.collect() if r["doc_id"] < 4) == [tuple(r)[2:] for r in rows[:3]]
