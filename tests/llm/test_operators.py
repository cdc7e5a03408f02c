"""The operators against brute force on small tables, and their edge cases."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from traceloom.llm import components, decontaminate, neighbours, packing, quality, simhash, substrings, suffixes, tokens, toxicity, urls, warc
from traceloom.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


WORDS = [f"{a}{b}{c}" for a in ("thr", "ble", "on", "sta") for b in ("ea", "i", "ou") for c in ("n", "sh", "ter", "d")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# 9: repeated byte strings


def brute_repeats(texts, length):
    at = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            at.setdefault(t[i : i + length], []).append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for found in at.values():
        if len(found) > 1:
            for d, i in found:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for t, g in zip(texts, gone):
        kept = bytes(b for b, x in zip(t, g) if not x)
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out.append((len(t), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("bound", [4096, 900, 300])
def test_repeated_strings_match_brute_force(spark, bound):
    rng = random.Random(bound)
    base = prose(rng, 400)
    passage = prose(rng, 60)
    texts = [base, base, "", None, "a" * 1000, "ab" * 300, passage, base[:500] + "x" + base[500:], "é" * 350 + passage[:210]]
    for _ in range(25):
        t = prose(rng, rng.randrange(10, 90))
        cut = rng.randrange(len(t))
        texts.append(t[:cut] + passage[rng.randrange(0, 60) :] + t[cut:])
    for _ in range(20):  # near copies, each with a change or two
        t = list(base)
        for _ in range(rng.randrange(1, 3)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    got = {r[0]: tuple(r[1:]) for r in substrings.repeated(docs_of(spark, enumerate(texts)), 200, bound=bound).collect()}
    assert got == dict(enumerate(brute_repeats([(t or "").encode() for t in texts], 200)))


def test_repeated_strings_of_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"].encode() for r in rows.collect()}
    got = {r[0]: tuple(r[1:]) for r in substrings.repeated(rows, 200).collect()}
    assert got == dict(zip(texts, brute_repeats(list(texts.values()), 200)))


def test_repeated_strings_edges(spark):
    assert substrings.repeated(docs_of(spark, []), 200).count() == 0
    t = prose(random.Random(1), 50)
    rows = docs_of(spark, [(1, t), (1, t), (None, t), (2, "short")])
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.repeated(rows).collect()) == [(0, len(t)), (1, len(t)), (1, len(t)), (2, 0)]
    kept = substrings.without_repeated(rows.withColumn("spans", rows["lang"])).collect()
    assert sorted(r["text"] for r in kept) == ["", "", "", "short"]


def test_suffix_arrays_take_bounded_memory():
    """However many grams a task has, few enough are worked on at once for a small executor."""
    rng = random.Random(21)
    rows = []
    for gram in range(900):
        text = bytes(rng.choices(b"abcdefgh", k=280))
        rows += [(gram, i, text[:i] + b"XY" + text[i:]) for i in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["gram", "seg", "bytes"])
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in substrings._arrays(200)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == len(rows) and peak < 120e6


@pytest.mark.parametrize("seed", range(5))
def test_suffix_arrays(seed):
    rng = np.random.default_rng(seed)
    texts = [np.r_[rng.integers(1, rng.integers(2, 6), rng.integers(0, 50)), 0] for _ in range(6)]
    size = np.array([len(t) for t in texts])
    base = np.r_[0, np.cumsum(size)[:-1]]
    out = suffixes.suffix_arrays(np.concatenate(texts), base, size)
    for t, b, n in zip(texts, base, size):
        assert (out[b : b + n] - b).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


# 3: SimHash


def brute_fingerprint(text, k=4):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, fps, limit):
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                parent[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        least[root(i)] = min(k, least.get(root(i), k))
    return {k: least[root(i)] for i, k in enumerate(keys)}


def test_simhash_matches_brute_force(spark):
    rng = random.Random(4)
    base = prose(rng, 300).split()
    texts = ["", "  ", None, "One", "ONE", "one two three", "é ü one two"]
    for _ in range(60):  # near copies around one text make long lists
        t = list(base)
        t[rng.randrange(len(t))] = rng.choice(WORDS)
        texts.append(" ".join(t))
    texts += [prose(rng, 30) for _ in range(40)]
    rows = docs_of(spark, [(1000 - i, t) for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(rows).collect()}
    keys = [1000 - i for i in range(len(texts))]
    fps = [brute_fingerprint(t or "") for t in texts]
    assert [got[k][0] for k in keys] == fps
    assert {k: got[k][1] for k in keys} == brute_components(keys, fps, 4)


def test_simhash_links_around_and_chains(spark):
    rng = random.Random(9)
    fps = []
    for _ in range(5):
        c = rng.getrandbits(64)
        fps += [c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
        for _ in range(10):
            c ^= sum(1 << b for b in rng.sample(range(64), 4))
            fps.append(c)
    fps = sorted(set(f % (1 << 64) for f in fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    parts = {r["node"]: r["component"] for r in components.components(found).collect()}
    want = brute_components(signed, fps, 4)
    assert {s: parts.get(s, s) for s in signed} == want


def test_simhash_cover_has_a_list_for_any_four_positions():
    sets = simhash.cover(4)
    assert len(sets) == 20
    assert all(any(set(c) <= set(four) for c in sets) for four in simhash.combinations(range(8), 4))


def test_simhash_tally_drops_pairs_below_the_guarantee():
    # three bytes are alike, five differ by a bit each: they meet in a list, but fall short
    a, b = 0, 0x0101010101000000
    sets = simhash.cover(4)
    keys = np.array([sum(1 << p for p in sets[0]) << 32] * 2, np.int64)
    assert simhash._links(keys, np.array([a, b], np.uint64), sets, 4, 7) == []
    assert simhash._spread(np.array([a, b], np.uint64), 4, 7) == []


def jaccard(a, b, words=5):
    x, y = (set(simhash.shingle_hashes(t.encode(), words).tolist()) for t in (a, b))
    return len(x & y) / max(len(x | y), 1)


@pytest.mark.parametrize("chunk", [4096, 40])
def test_long_lists_are_cut_and_keep_their_components(spark, chunk):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(6):  # families under common bytes, near and not
        head = rng.getrandbits(40) << 24
        fps |= {head | rng.getrandbits(24) for _ in range(150)}
        at = rng.getrandbits(64)
        fps |= {at ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r["node"]: r["component"] for r in components.components(simhash.links(table, 4, chunk=chunk)).collect()}
    parts = brute_components(list(range(len(fps))), list(fps), 4)
    mine, theirs = {}, {}
    for i, f in enumerate(signed):
        mine.setdefault(got.get(f, f), set()).add(f)
        theirs.setdefault(parts[i], set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values())) and len(mine) < len(signed)


def test_similar_texts_match_brute_force(spark):
    """Components by similarity 0.8 of five-word shingles: never a link below it, and nearly all at it."""
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            t = list(base)
            for _ in range(rng.randrange(1, 6)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(4000)}"
            texts.append(" ".join(t))
    family = [f"f{i}" for i in range(200)]
    for i in range(150):  # many copies of one text, all different
        texts.append(" ".join([*family[:i], f"x{i}", *family[i + 1 :]]))
    texts += [texts[0], "", None, "one two", "one two"]
    rows = docs_of(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(rows).collect()}
    n = len(texts)
    near = [(i, j) for i in range(n) for j in range(i + 1, n) if texts[i] and texts[j] and jaccard(texts[i], texts[j]) >= 0.8]
    label = list(range(n))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in near:
        a, b = sorted((top(i), top(j)))
        label[b] = a
    want = {i: top(i) for i in range(n)}
    want[n - 3] = n - 4  # the null text is the empty one
    assert len(set(want.values())) < n / 2
    joined = [got[i] == got[j] for i, j in near]
    assert sum(joined) / len(joined) > 0.97
    assert all(want[i] == want[c] for i, c in got.items())  # nothing is linked that isn't similar
    assert {got[i] for i in range(n - 155, n - 5)} == {n - 155}
    assert got[n - 1] == got[n - 2] == n - 2


def test_sets_of_shingles_are_made_once_and_not_shuffled(spark, monkeypatch):
    plans, made = {}, {}

    def kept(df, tag, f=simhash.staged):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        out = f(df, tag)
        made[tag] = [r["t"] for r in out.collect()] if tag == "shingles" else None
        return out

    monkeypatch.setattr(simhash, "staged", kept)
    text = " ".join(f"word{i}" for i in range(60))
    rows = docs_of(spark, [(1, text), (1, text), (2, text + " more"), (2, text + " more"), (3, text), (4, "other words here")])
    got = sorted(tuple(r) for r in simhash.similar(rows).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]
    assert len(made["shingles"]) == len(set(made["shingles"])) == 2
    assert "Exchange" not in plans["shingles"].partition("MapInArrow")[0]


def test_pairs_of_near_copies_grow_with_their_number(spark, monkeypatch):
    """Many copies of one text, all different, become about as many pairs as there are copies, and one component."""
    made = {}

    def kept(df, tag, f=simhash.staged):
        out = f(df, tag)
        made[tag] = made.get(tag, 0) + (out.count() if tag in ("pairs", "near") else 0)
        return out

    monkeypatch.setattr(simhash, "staged", kept)
    family, n = [f"f{i}" for i in range(200)], 150
    rows = docs_of(spark, [(i, " ".join([*family[:i], f"x{i}", *family[i + 1 :]])) for i in range(n)])
    assert {r["component_id"] for r in simhash.similar(rows).collect()} == {0}
    assert n - 1 <= made["near"] <= made["pairs"] < 8 * n


def test_forest_spans_what_its_pairs_connect():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (2, 1), (30, 25), (60, 400)):
        a, b, far = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
        part = np.arange(n)
        x, y = simhash._forest(a, b, far, part)
        want = list(range(n))
        for i, j in zip(a.tolist(), b.tolist()):
            p, q = want[i], want[j]
            want = [p if w == q else w for w in want]
        assert len(x) == n - len(set(want))  # no pair too many
        assert len(set(zip(want, part.tolist()))) == len(set(want)) == len(set(part.tolist()))


def test_similar_edges(spark):
    assert simhash.similar(docs_of(spark, [])).count() == 0
    rows = docs_of(spark, [(3, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")]).withColumnRenamed("lang", "component")
    assert [r["component_id"] for r in simhash.similar(rows).collect()] == [3] * 4


def test_simhash_edges(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    rows = docs_of(spark, [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (3, "a b c d e")])
    assert {r["component_id"] for r in simhash.near_duplicates(rows).collect()} == {3}


# 4: packing


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(0, 900)) for _ in range(120)] + ["", None, "a  b\n\nc ", "x<|endoftext|>y", "日本 語", prose(rng, 4000)]
    rows = docs_of(spark, enumerate(texts)).repartition(3)
    path = vocabulary("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    ids = {i: [*(tk.encode(t, add_special_tokens=False).ids if t else []), 0] for i, t in enumerate(texts)}
    got = packing.pack(rows, path, 1024).collect()
    at, fill = {}, {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        d, n = r["doc_id"], r["length"]
        assert r["start"] == at.get(d, 0) and r["doc_tokens"] == len(ids[d])
        part = ids[d][r["start"] : r["start"] + n]
        assert len(part) == n > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        at[d] = r["start"] + n
        fill.setdefault(r["sequence_id"], []).append((r["offset"], n))
    assert at == {d: len(x) for d, x in ids.items()}
    for pieces in fill.values():
        total = 0
        for o, n in sorted(pieces):
            assert o == total
            total += n
        assert total <= 1024 and total & (total - 1) == 0  # no padding
    assert packing.pack(docs_of(spark, []), path).count() == 0


def test_sum_of_squares_choice():
    p = packing.Packer(10, 0)
    assert p.place(("a",), 6) is None and p.place(("b",), 6) is None  # a second window at 6 costs more than none
    assert p.place(("c",), 4) is not None  # fills a window
    assert p.count[6] == 1


# 8: token counts


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    texts = ["", None, "  \n ", "ΑΣ ΑΣ. é é x<|endoftext|>y <|startoftext|>", "it's I'LL 123 x y\x1cz 日本語 İstanbul", "　a\tb\r\nc", "'s 's' 've", "$$$ ### a.b,c", "ﬁ ½ ǅ"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = docs_of(spark, enumerate(texts))
    got = {r["doc_id"]: r for r in tokens.count_tokens(rows, path, 100, keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        n = len(tk.encode(t, add_special_tokens=False).ids) if t else 0
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)
    assert tokens.count_tokens(docs_of(spark, []), path).count() == 0


# 2: URLs


def test_urls_match_every_rule_tried(spark):
    import re

    url = ["http://A.org", "http://a.org/x", "http://example.org/es/1?q", "https://x.example.org/en/12", "http://a.com/fr/", "http://com/de/x", "http://b.com:80/de/", None, "", "no scheme",
           "http://ads.doubleclick.net/x", "http://x.net/keygens", "http://x.net/a.torrent", "http://x.net/banners/1/2.gif", "http://org/", "http://x/http://b.org/y", "HTTP://U@Y.ORG/#f", "http://casino.net", "http://mycasino.net"]
    rows = spark.createDataFrame([(i, u, "old") for i, u in enumerate(url)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in urls.filter_urls(rows).collect()}
    assert [got[i]["verdict"] for i in range(7)] == ["allow", "allow", "block", "block", "allow", "block", "allow"]
    assert got[0]["rule"] is None and got[1]["rule"] == "org/" and got[2]["rule"] == "example.org/es/"
    assert (got[15]["host"], got[15]["path"], got[16]["host"]) == ("x", "/http://b.org/y", "u@y.org")
    for i, u in enumerate(url):
        if got[i]["rule"] is None:
            hit = any(re.search(urls.pattern_regex(p), (u or "").lower()) for p in urls.PATTERNS)
            assert got[i]["verdict"] == ("block" if hit else "allow"), u
    assert [got[i]["verdict"] for i in (10, 11, 12, 13, 17, 18)] == ["block"] * 5 + ["allow"]


def test_ten_thousand_site_rules(spark):
    import time

    rng = random.Random(3)
    host = lambda: ".".join(rng.choice(["a", "b", "org", "com", "x-y"]) for _ in range(rng.randrange(1, 5)))
    rules = [(rng.choice(["allow", "block"]), host(), rng.choice(["/", "/p", "/p/q", "/é", ""])) for _ in range(9_500)] + [("block", f"h{i}.net", "/") for i in range(500)] + [("allow", "", "/p")]
    url = [f"http://{host()}{rng.choice(['', '.', '.h7.net', '.h7.net.'])}{rng.choice(['', '/', '/p/q/r', '/é?', '/z'])}" for _ in range(300)] + ["http://h7.net/", "http://xh7.net/", "http:///p", None]
    rows = spark.createDataFrame(list(enumerate(url)), "page_id long, url string")
    began = time.time()
    done = urls.filter_urls(rows, rules=rules, patterns=[])
    done._jdf.queryExecution().executedPlan()
    assert time.time() - began < 20
    last = {(h, p): v for v, h, p in rules}
    for r in done.collect():
        fits = [(len(h + p), h, p) for h, p in last if (r["host"] == h or r["host"].endswith(f".{h}")) and r["path"].startswith(p)]
        best = max(fits, default=None)
        assert (r["rule"], r["verdict"]) == ((best[1] + best[2], last[best[1:]]) if best else (None, "allow")), r


def test_pattern_index_runs_few_rules_of_many():
    import re

    rng = random.Random(8)
    patterns = [(f"||host{i}.", f"/path{i}/", f"/common/x{i}^", f"/common/*/y{i}.")[i % 4] for i in range(10_000)]
    assert urls.literal_tokens("||casino") == [] and urls.literal_tokens("||ads.x^") == ["ads", "x"] and urls.literal_tokens("/a*b/c^") == ["c"]
    index = urls.PatternIndex(patterns, {"common": 9000})
    plain = [(p, re.compile(urls.pattern_regex(p))) for p in patterns]
    hits = 0
    for _ in range(150):
        i = rng.randrange(10_000)
        url = rng.choice([f"http://host{i}.net/", f"http://a.b/path{i}/z", f"http://a.b/common/x{i}", f"http://a.b/common/q/y{i}.png", f"http://a.b/common/x{i}a"])
        want = any(rx.search(url) for _, rx in plain)
        assert index.blocks(url) == want, url
        hits += want
    assert 20 < hits < 140 and index.tried < 2 * 150


def test_url_columns_of_any_name(spark):
    rows = spark.createDataFrame([("http://a.org/x", 1, 2, 3)], "url string, _fits int, _blocked int, HOST int")
    (got,) = urls.filter_urls(rows).collect()
    assert got.asDict() == {"url": "http://a.org/x", "_fits": 1, "_blocked": 2, "host": "a.org", "path": "/x", "rule": "org/", "verdict": "allow"}
    assert tokens.count_tokens(docs_of(spark, [(1, "a")]).withColumnRenamed("lang", "N_TOKENS"), vocabulary("word_bpe_49k.json")).columns == ["doc_id", "text", "source", "n_chars", "n_bytes", "n_tokens", "over_limit"]


# 10: WARC


def test_warc_round_trip_with_magic_inside(spark):
    rng = random.Random(3)
    big = prose(rng, 300)
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    html = ["", None, "x" * 999, "x" * 999, big, big, big, fake * 3 + "tail", fake, "WARC/1.0\r\n", "é\r\n\r\n", big + "\r\n\r\n", "WARC/1.0\r\n" * 200, "WARC/1.0\r\n" * 200]
    rows = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    got = {r["page_id"]: tuple(r[1:]) for r in warc.round_trip(rows).collect()}
    want = {}
    for i, h in enumerate(html):
        b = (h or "").encode()
        last = max(j for j, x in enumerate(html) if x == h) if len(b) >= 1000 else i
        want[i] = (len(b), hashlib.sha1(b).hexdigest(), "response" if last == i else "revisit", None if last == i else last)
    assert got == want
    assert warc.round_trip(rows.limit(0)).count() == 0


def test_warc_when_scans_are_cut_otherwise_later(spark, monkeypatch):
    rng = random.Random(4)
    html = [prose(rng, rng.randrange(1, 400)) + ("WARC/1.0\r\n" if n % 7 == 0 else "") + prose(rng, 9) for n in range(1500)]
    rows = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    name, chain = "spark.sql.files.maxPartitionBytes", warc.chain

    def cut_anew(cand):
        # as if the cores had changed: all later scans are cut otherwise
        out = chain(cand)
        spark.conf.set(name, "50k")
        return out

    monkeypatch.setattr(warc, "chain", cut_anew)
    try:
        got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.round_trip(rows).collect()}
    finally:
        spark.conf.unset(name)
    assert got == {i: (len(h), hashlib.sha1(h.encode()).hexdigest()) for i, h in enumerate(html)}


def test_warc_chain_over_many_ranges(spark):
    """Archives read in ranges that records span, with records' text inside payloads; URLs are written."""
    rng = random.Random(9)
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    html = [prose(rng, rng.randrange(1, 60)) + fake * rng.choice((0, 0, 1, 60)) + prose(rng, rng.choice((1, 2000))) for n in range(120)]
    rows = spark.createDataFrame([(i, f"http://x.org/{i}\r\n?" if i % 2 else None, h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(2)
    name = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(name, "4k")
    try:
        got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.round_trip(rows, url="url").collect()}
    finally:
        spark.conf.unset(name)
    assert got == {i: (len(h), hashlib.sha1(h.encode()).hexdigest()) for i, h in enumerate(html)}
    text = [r[0] for r in warc.with_types(rows, url="url").select(warc.record_text()).collect()]
    assert sum("\r\nWARC-Target-URI: http://x.org/1%0D%0A?\r\n" in t for t in text) == 1 and sum("WARC-Target-URI" in t for t in text) == 60


def test_repeated_strings_in_very_long_texts_and_repeated_rows(spark):
    """A text over the pieces' size, with passages across their bounds, beside rows that repeat."""
    rng = random.Random(12)
    line = "".join(chr(97 + rng.randrange(26)) for _ in range(700))
    noise = np.random.default_rng(3).integers(97, 123, 1_100_000).astype(np.uint8).tobytes().decode()
    for at in (449_900, 899_700):  # across the bounds of pieces
        noise = noise[:at] + line[:400] + noise[at + 400 :]
    rows = [(1, noise), *[(2, line)] * 40, (3, "x" + line[100:650])]
    got = {}
    for r in substrings.repeated(docs_of(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"]))
    assert got == {1: [(1_100_000, 800, 2)], 2: [(700, 700, 1)] * 40, 3: [(551, 550, 1)]}


# 7: neighbours


def test_neighbours_reach_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:900] = x[500]  # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [1.0]), (3020, [None] + [1.0] * 15), (None, x[0].tolist()), (7, x[7].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(table, books=8, words=64, sample=1500, pool=300, block=1024, query_block=64).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    y = x.astype(np.float64)
    hit = 0
    for q in range(0, 3000, 20):
        s = y @ y[q]
        want = [int(j) for j in np.lexsort((np.arange(3000), -s)) if j != q][:20]
        assert sorted(got[q]) == list(range(1, 21))
        mine = [got[q][k][0] for k in range(1, 21)]
        assert all(abs(got[q][k][1] - s[got[q][k][0]]) < 1e-12 for k in range(1, 21)) and q not in mine
        hit += len(set(mine) & set(want))
    assert set(got) == set(range(0, 3000, 20)) and hit / (20 * 150) >= 0.95
    assert neighbours.search(table.limit(0)).count() == 0


def test_neighbours_that_codes_tell_apart_badly(spark):
    """Vectors that differ by less than codes leave of them, a few far longer ones, and ids with several vectors."""
    rng = np.random.default_rng(16)
    x = (5 + 0.02 * rng.normal(size=(2400, 16))).astype(np.float32)
    x[::200] = 1e4 * rng.normal(size=(12, 16))
    ids = [*range(2390), *range(10)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(table, books=4, words=16, sample=800, pool=100, block=1024, query_block=64).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    y = x.astype(np.float64)
    score = {}
    for at in (k for k in range(len(ids)) if ids[k] % 20 == 0):
        best = score.setdefault(ids[at], {})
        for j, s in zip(ids, (y * y[at]).cumsum(axis=1)[:, -1].tolist()):
            if j != ids[at]:
                best[j] = max(s, best.get(j, s))
    assert set(got) == set(score)
    for q, best in score.items():
        assert [got[q][k] for k in range(1, 21)] == sorted(best.items(), key=lambda p: (-p[1], p[0]))[:20]


# 1: decontamination


def test_leaks_are_found_and_others_left_alone(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    items = [[rng.choice(vocab) for _ in range(rng.randrange(15, 60))] for _ in range(30)]
    rows, want = [], {}
    for n in range(300):
        t = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        if n % 3 == 0:
            i = rng.randrange(30)
            w = list(items[i])
            for _ in range(rng.randrange(0, len(w) // 8)):
                w[rng.randrange(len(w))] = "changed"
            at = rng.randrange(len(t) + 1)
            t[at:at] = w
            want[n] = i
        rows.append((n, " ".join(t)))
    bench = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in enumerate(items)] + [(90, None), (91, "..."), (92, "only two")], "item_id long, text string")
    table = docs_of(spark, [*rows, (900, None), (901, "said only two words"), (902, "")])
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(table, bench, block_words=300).collect()}
    assert set(got) == {*want.items(), (901, 92)}
    for (d, i), r in got.items():
        if d < 900:
            text, w = rows[d][1].split(), items[i]
            row = [0] * (len(text) + 1)
            for a, x in enumerate(w, 1):
                old, row = row, [a]
                for b, y in enumerate(text, 1):
                    row.append(min(old[b] + 1, row[-1] + 1, old[b - 1] + (x != y)))
            assert r["distance"] == min(row)
    assert decontaminate.leaks(table, bench.limit(0)).count() == 0


def edited(rng, words, n):
    """``words`` with n words changed, added or removed, at most one edit to a place."""
    out = [[w] for w in words]
    for i in rng.sample(range(len(words)), n):
        out[i] = rng.choice([["changed"], [words[i], "added"], []])
    return [w for part in out for w in part]


def test_leaks_of_any_length_offset_and_allowed_edits(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(5000)]
    items = [[rng.choice(vocab) for _ in range(n)] for n in range(3, 21)]
    rows, want = [], set()
    for i, w in enumerate(items):
        for k in range(40):
            t = [rng.choice(vocab) for _ in range(40)]
            at = 2 * rng.randrange(20) + 1
            # as many edits as 0.8 allows; every fourth is an exact copy
            t[at:at] = edited(rng, w, len(w) // 5 if k % 4 else 0)
            want.add((len(rows), i))
            rows.append((len(rows), " ".join(t)))
            # a leak whose start lies several short texts ahead, and one edit too many
            if k % 10 == 0 and len(w) >= 15:
                rows += [(len(rows) + x, "a") for x in range(4)]
                want.add((len(rows), i))
                rows.append((len(rows), " ".join(w[len(w) // 5 :])))
                rows += [(len(rows) + x, "a") for x in range(4)]
                rows.append((len(rows), " ".join(w[len(w) // 5 + 1 :])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(spark, rows).coalesce(1), bench).collect()}
    assert got == want


# 5 and 6: classifiers


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, which):
    d = "/root/testdata/sf0.1"
    rows, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = rows.join(labels, "doc_id").select("doc_id", "text", labels[which].alias("y"))
    f = quality.score_quality if which == "quality" else toxicity.score_toxicity
    got = f(rows.select("doc_id", "text").unionByName(docs_of(spark, [(-1, None), (None, "x")]).select("doc_id", "text")), labels).collect()
    truth = {r["doc_id"]: r["y"] for r in rows.collect()}
    assert len(got) == len(truth) + 2 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    y, s = np.array([truth[r["doc_id"]] for r in held]), np.array([r["score"] for r in held])
    pos, neg = s[y == 1], s[y == 0]
    assert (pos[:, None] > neg[None]).mean() > (0.99 if which == "quality" else 0.97)
    p = np.array([r["predicted"] for r in held])
    assert (p == y).mean() > 0.96


def brute_grams(text):
    """Hashed n-grams by a plain loop over characters."""
    c = [ord(x) + 32 if "A" <= x <= "Z" else 32 if x in "\t\n\x0b\x0c\r" else ord(x) for x in f" {text} "]
    low, out = (1 << 32) - 1, set()
    for n in toxicity.SIZES:
        for i in range(len(c) - n + 1):
            h = (c[i] * 0x01000193 + 7) & low
            for x in c[i + 1 : i + n]:
                h = ((h * 0x01000193) & low) ^ ((x * 0x9E3779B1) & low)
            out.add(((h * 0x9E3779B1) & low) >> (32 - toxicity.BITS))
    return out


def test_toxicity_scores_match_a_plain_loop(monkeypatch):
    rng = np.random.default_rng(4)
    model = toxicity.NaiveBayesLinear()
    model.w, model.b = np.where(rng.random(1 << toxicity.BITS) < 0.2, rng.normal(size=1 << toxicity.BITS), 0).astype(np.float32), 0.3
    model.used = model.w != 0
    for part in (1 << 20, 16):  # in parts, too
        monkeypatch.setattr(toxicity, "PART", part)
        for text in ("", "a", "abc", "Hello\tWÖRLD, again and again and again 日本語日本語 🙂", prose(random.Random(3), 40)):
            assert set(toxicity.grams(text).tolist()) == brute_grams(text)
            total = sum(float(model.w[g]) for g in brute_grams(text)) + model.b
            assert model.score(text) == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-6)


def test_quality_scores_match_plain_sums():
    model = quality.BradleyTerry()
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, quality.N_FEATURES))
    model.fit(x, (x[:, 0] > 0).astype(int), 0.5, 0.7, pairs=500, rounds=50)
    for row, got in zip(x, model.score(x)):
        strength = sum(min(max((v - m) / s, -8), 8) * w for v, m, s, w in zip(row, model.mean, model.scale, model.w))
        assert got == pytest.approx(1 / (1 + np.exp(-(model.a * strength + model.b))), abs=1e-9)
    share = quality.features("Ab1 é.\n")[: 6 + len(quality.SIGNS)]
    assert share.tolist() == pytest.approx([1 / 8, 1 / 8, 1 / 8, 2 / 8, 2 / 8, 1 / 8, *[0] * (len(quality.SIGNS))][: len(share)], abs=1e-6)


def test_learning_rows_are_bounded_by_rows(spark):
    from traceloom.llm.features import learning_rows

    rows = docs_of(spark, [(i % 5, f"text {i}") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)], "doc_id long, quality int, toxic int")
    assert learning_rows(rows, labels, "toxic", 4).count() <= 4


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """Means and the cut are those of all labelled rows outside the held-out part, however many; pairs are in cells."""
    made = []
    monkeypatch.setattr(quality, "train", lambda *a, f=quality.train: made.append(f(*a)) or made[-1])
    rng = np.random.default_rng(8)
    y = (rng.random(14_000) < 0.9).astype(int)
    rows = [(i, "ab " * int(rng.integers(1, 9)) + ("." * int(rng.integers(0, 5)) if v else "|" * int(rng.integers(0, 9)))) for i, v in enumerate(y.tolist())]
    got = quality.score_quality(docs_of(spark, rows), spark.createDataFrame([(i, v) for i, v in enumerate(y.tolist())], "doc_id long, quality int")).collect()
    learnt = np.array([zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in rows])
    x = np.array([quality.features(t) for _, t in rows], np.float64)
    model = made[0]
    assert model.mean == pytest.approx(x[learnt].mean(0), abs=1e-6) and model.scale == pytest.approx(x[learnt].std(0) + 1e-3, abs=1e-6)
    score = np.array([r["score"] for r in sorted(got, key=lambda r: r["doc_id"])])
    assert score == pytest.approx(model.score(x), abs=1e-9)
    k = int(learnt.sum() - y[learnt].sum())
    assert np.sort(model.strength(x[learnt]))[k] == pytest.approx((np.log(0.7 / 0.3) - model.b) / model.a, abs=1e-6)
    values = spark.createDataFrame([(float(v),) for v in rng.normal(size=500).round(1)], "s double")
    held = sorted(r["s"] for r in values.collect())
    assert [quality.ranked(values, k, bins=8) for k in (0, 250, 499)] == [held[0], held[250], held[499]]
    rare = spark.createDataFrame([(i, int(i % 200 == 0), [float(i)]) for i in range(2000)], "k long, y int, x array<float>")
    cells = quality.dealt(rare, 10, 1990, 100).collect()
    assert sorted(v for c in cells for v in c["bad"]) == [i for i in range(2000) if i % 200] and all(len(c["good"]) == 10 for c in cells)


def test_classifiers_without_labels(spark):
    rows = docs_of(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_quality(rows, none).collect()} == {0.5}
    assert {r["predicted"] for r in toxicity.score_toxicity(rows, none).collect()} == {0}
