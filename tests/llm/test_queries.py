"""The registered queries on the smallest tables, against brute force."""

import re
import zlib

import numpy as np
import pytest

from traceloom.llm import decontaminate, queries
from traceloom.llm.queries import vocabulary

from .test_operators import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_decontamination(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    split = lambda t: np.array([hash(w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t.lower())])
    want = set()
    for d, t in texts.items():
        words = split(t)
        for i, x in items.items():
            w = split(x)
            most = int(0.2 * len(w) + 1e-9)
            if np.isin(w, words).sum() >= len(w) - most and decontaminate.best_fit(w, words)[0] <= most:
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1(spark, SF).collect()}
    assert got == want and want


def test_simhash(spark, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3(spark, SF).collect()}
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    parts = brute_components(list(fps), list(fps.values()), 4)
    assert got == {d: (f"{fps[d]:016x}", parts[d]) for d in texts}


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {d: [*tk.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    got = queries.op4(spark, SF).collect()
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op8(spark, SF).collect()}
    n = {d: len(tk.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    assert got == {d: (len(t.encode()), n[d], n[d] > 2048) for d, t in texts.items()}


@pytest.mark.parametrize("query,threshold", [("op5_quality", 0.7), ("op6_toxicity", 0.3)])
def test_classifiers(spark, texts, query, threshold):
    got = queries.queries()[query](spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
