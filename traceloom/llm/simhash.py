"""Operator 3: SimHash near-duplicates by a byte-position inverted index.

Fingerprints (64 bits) of word shingles link when they differ in few bits.  A
pair that differs in at most 4 bits agrees in at least 4 of its 8 bytes, in
place.  The inverted index has lists under three positional bytes each: of the
56 sets of three positions the 20 that are inside any four (``cover``), so that
each pair with the guaranteed four shared bytes meets in a list.  There the
shared positional bytes of each pair are tallied; pairs with fewer than the
guaranteed number, which most chance meetings are, go, and the rest are verified
by their differing bits.  Only distinct fingerprints are indexed, so exact copies
cost nothing more; from a long list (many fingerprints around one) only links
that span its connected parts are emitted, never all pairs.

``similar`` links texts by the Jaccard similarity of their shingles instead.  Its
fingerprints are of two words, which an edit changes less than longer shingles;
pairs that share three positional bytes are candidates, and the sets of shingles
of both texts decide.

Null text counts as empty.  A text without words has fingerprint zero.  Rows
with a null key take part in links but can't name a component.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, has, over_cells, ship, staged, text_of, tidy

BYTES = 8
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
TO_LOWER = bytes.maketrans(UPPER, LOWER)
SEED = 42
#: Bit counts of 16-bit numbers.
ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
#: Lists up to this length are compared many at a time, longer ones each by itself; both tally and verify.
TOGETHER = 24
#: A fingerprint is hot if it has at least this share of the rows; so there are at most 1 / HOT of them.
HOT = 0.001
#: Bits of a text's sketch and of the wide one, and the orders of hashes that they come from.
SKETCH, WIDE = 1024, 4096
_ORDERS = np.random.default_rng(97).integers(1, 1 << 31, WIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) if hasattr(np, "bitwise_count") else ONES[x.view(np.uint16).reshape(-1, 4)].sum(1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, lower-cased and space-joined."""
    import xxhash

    found = WORD.findall(text.translate(TO_LOWER))
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    h = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found]).tolist()
    starts = [0, *ends]
    return np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is one where it is one in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        part = hashes[a : a + 65536].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 4, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long; one narrow pass."""
    has(docs, text)
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    @tidy
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.array([fingerprint(shingle_hashes(x.encode("utf-8", "surrogatepass"), words)) for x in part], np.uint64).view(np.int64))

    return docs.withColumn(name, made(text_of(text)))


def cover(shared: int) -> list[tuple[int, ...]]:
    """Sets of byte positions, one at least inside any ``shared`` positions.

    For four: the sets of three that lie inside one of the parts 0-2, 3-5, 6-7, or
    have two positions in a part and the third in the next part, in a circle.
    """
    if shared < 4:
        return list(combinations(range(BYTES), shared))
    part = (0, 0, 0, 1, 1, 1, 2, 2)
    held = ((0, 0, 0), (1, 1, 1), (0, 0, 1), (1, 1, 2), (0, 2, 2))
    return [c for c in combinations(range(BYTES), 3) if tuple(part[p] for p in c) in held]


def _first(sets: list[tuple[int, ...]]) -> np.ndarray:
    """For each mask of shared positions the mask of the first list in which such a pair meets."""
    masks = [sum(1 << p for p in c) for c in sets]
    return np.array([next((m for m in masks if m & e == m), -1) for e in range(1 << BYTES)])


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """The mask of positions at which a pair with the difference ``x`` agrees."""
    return np.packbits(x.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0]


def _spread(fps: np.ndarray, shared: int, limit: int) -> list[tuple[int, int]]:
    """Links that span the connected parts of one long list."""
    links, left = [], fps
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            x = left ^ at
            near = (ONES[shared_bytes(x)] >= shared) & (bit_count(x) <= limit)
            if near.any():
                new = left[near]
                links += [(int(at), int(y)) for y in new]
                frontier += list(new)
                left = left[~near]
    return links


def _links(keys: np.ndarray, fps: np.ndarray, sets: list[tuple[int, ...]], shared: int, limit: int) -> list[tuple[int, int]]:
    """Links within the lists of an index part; rows sorted by list."""
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[edge, len(keys)])
    out: list[tuple[int, int]] = []
    for a, n in zip(edge[size > TOGETHER].tolist(), size[size > TOGETHER].tolist()):
        out += _spread(np.unique(fps[a : a + n]), shared, limit)
    short = np.repeat((size > 1) & (size <= TOGETHER), size)
    k, f = keys[short], fps[short]
    first = _first(sets)
    for lag in range(1, TOGETHER):
        same = k[lag:] == k[:-lag] if len(k) > lag else np.empty(0, bool)
        if not same.any():
            break
        a, b = f[:-lag][same], f[lag:][same]
        mask = shared_bytes(a ^ b)
        # a pair is reported by the first list in which it meets
        ok = (ONES[mask] >= shared) & (first[mask] == k[:-lag][same] >> 32)
        ok[ok] = bit_count((a ^ b)[ok]) <= limit
        out += list(zip(a[ok].tolist(), b[ok].tolist()))
    return out


def _entries(sets: list[tuple[int, ...]]) -> list:
    """The list keys of column ``fp``: which positions, and the bytes there."""
    out = []
    for c in sets:
        key = F.lit(sum(1 << p for p in c) << 32).cast("long")
        for i, p in enumerate(c):
            key = key.bitwiseOR(F.shiftleft(F.expr(f"(shiftrightunsigned(fp, {8 * p}) & 255L)"), 8 * i))
        out.append(key)
    return out


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole lists, from batches sorted by column ``k``."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        k = t["k"].to_numpy()
        cut = int(np.searchsorted(k, k[-1]))  # the last list may go on in the next batch
        if cut:
            yield pa.concat_tables([*held, t.slice(0, cut)])
            held = []
        elif held and held[-1]["k"][-1].as_py() != k[0]:
            yield pa.concat_tables(held)
            held = []
        held.append(t.slice(cut))
    if held:
        yield pa.concat_tables(held)


def links(fps: DataFrame, limit: int = 4, chunk: int = 4096) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column ``fp`` (longs).

    All links of short lists; of long ones those that keep its parts connected.
    A list holds distinct fingerprints only, so copies don't lengthen it; one of
    more than two chunks is cut into chunks, each pair of which is a piece of
    work of its own, so that no task gets a whole list however long.
    """
    if not 0 <= limit < BYTES:
        raise ValueError("limit must be under 8: else no positional byte need be shared")
    shared = min(BYTES - limit, 4)
    ship(fps.sparkSession)
    sets = cover(shared)
    index = fps.select("fp").distinct().select("fp", F.explode(F.array(*_entries(sets))).alias("k"))
    # lists over two chunks; no more than entries / chunk
    long_ = staged(index.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > 2 * chunk).select("k", F.ceil(F.col("n") / chunk).alias("chunks")), "long")
    form = "a long, b long"

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_lists(batches):
            yield batch_of(_links(t["k"].to_numpy(), t["fp"].to_numpy().view(np.uint64), sets, shared, limit))

    def met_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_lists(batches):
            k, found = t["k"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
            edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
            yield batch_of([x for a, b in zip(edge[:-1], edge[1:]) for x in _spread(np.unique(found[a:b]), shared, limit)])

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    in_lists = lambda t, f: t.repartition("k").sortWithinPartitions("k").select("k", "fp").mapInArrow(tidy(f), form)
    if not long_.limit(1).count():
        return in_lists(index, met)
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    cut = over_cells(index.join(long_, "k").withColumn("own", own), F.col("chunks"), "other")
    cells = cut.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("k"), "fp")
    return in_lists(index.join(long_, "k", "left_anti"), met).unionByName(in_lists(cells, met_in_cells))


def _named(rows: DataFrame, least: DataFrame, parts: DataFrame, node: str) -> DataFrame:
    """``rows`` (id, node, ...) with component_id; ``least`` has each node's smallest id and number of rows.

    Nodes without links name themselves.  Hot nodes, of which there are at most
    1 / HOT, are joined by broadcast, so that no task gets all rows of one.
    """
    own = least.join(parts.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))
    of = own.groupBy("component").agg(F.min("id").alias("component_id"))
    each = staged(own.join(of, "component").select(node, "component_id", "n"), "components")
    total = each.agg(F.sum("n")).first()[0] or 0
    hot = each.where(F.col("n") >= F.lit(total * HOT)).select(node, F.col("component_id").alias("_hot"), F.lit(True).alias("_is_hot"))
    marked = rows.join(F.broadcast(hot), node, "left")
    first = marked.where("_is_hot").withColumn("component_id", F.col("_hot")).drop("_hot", "_is_hot")
    rest = marked.where("_is_hot is null").drop("_hot", "_is_hot")
    out = staged(first.unionByName(rest.join(each.select(node, "component_id"), node, "left")), "named")
    discard(each, rows, least, parts)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, limit: int = 4) -> DataFrame:
    """(key, fp, component_id): a row for each row of ``docs``.

    component_id is the smallest key reachable through links, its own included.
    """
    has(docs, key, text)
    prints = staged(with_fingerprint(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t")), "t", words).select("id", "fp"), "prints")
    least = staged(prints.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "least")
    joined = staged(links(least, limit), "near")
    parts = components(joined)
    discard(joined)
    named = _named(prints, least, parts, "fp")
    return named.select(F.col("id").alias(key if key != "fp" else "id"), "fp", "component_id")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, coarse: int = 2, limit: int = 12) -> DataFrame:
    """(key, component_id): a row for each row of ``docs``, by similarity of shingles.

    Texts link if their sets of ``words``-word shingles have a Jaccard similarity
    of at least ``similarity``.  Candidates are texts whose fingerprints of
    ``coarse``-word shingles share three positional bytes, as all do that differ in
    at most five bits, and differ in at most ``limit`` bits.  Equal texts are one text
    (by 64 bits of hash); texts without words are linked only to their equals.

    Lists keep only rows with a candidate.  Pairs leave a list only if sketches of
    their sets (one-bit minima) agree as pairs at the threshold do but for one in some
    10^7; those are verified on the whole sets.  There are three rounds: pairs that
    span what is connected in each list, nearest sketches first; the same again
    between the components of the links that were found, by wide sketches; then all
    pairs of different components.  So every pair is tried or connected, but many
    copies of one text don't become all their pairs.
    """
    has(docs, key, text)
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("id"), text_of(f"`{text}`").alias("text"))
    made = rows.select("id", F.xxhash64("text").alias("t"), _prints(coarse, words)(F.col("text")).alias("p"))
    prints = staged(made.select("id", "t", "p.fp", "p.s"), "prints")
    least = staged(prints.groupBy("t").agg(F.min("id").alias("id"), F.min("fp").alias("fp"), F.any_value("s").alias("s"), F.count("*").alias("n")), "least")
    sets = cover(3)
    index = least.where("fp <> 0").select("t", "fp", F.explode(F.array(*_entries(sets))).alias("k"))
    in_lists = lambda t, f, form: t.repartition("k").sortWithinPartitions("k", "fp", "t").mapInArrow(tidy(f), form)
    lists = staged(in_lists(index.select("k", "fp", "t"), _with_candidates(limit), "k long, fp long, t long"), "lists")
    form = "a long, b long, ca long, cb long"
    pairs = staged(in_lists(lists.join(least.select("t", "s"), "t").withColumn("c", F.col("t")), _spanning(limit, similarity, SKETCH), form).distinct(), "pairs")
    # each list's first pairs have all its texts that are in any
    of = staged(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct().withColumn("c", F.col("t")), "of")

    one = least.join(of, "t", "left_semi").select("t", F.col("id").alias("one"))
    texts = rows.withColumn("t", F.xxhash64("text")).join(one, "t").where(F.col("id").eqNullSafe(F.col("one"))).select("t", "text")
    # rows that repeat id and text are made one while the join still has them together; sets aren't shuffled for it
    texts = texts.groupBy("t").agg(F.any_value("text").alias("text"))
    shingles = staged(texts.mapInArrow(tidy(_shingle_sets(words)), "t long, h array<long>, s binary"), "shingles")

    for round_ in (None, _spanning(limit, similarity, WIDE), _unconnected(sets, limit, similarity, WIDE)):
        if round_:
            opened = staged(lists.join(of, "t"), "open")
            mixed = opened.groupBy("k").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("k")
            at = opened.join(mixed, "k", "left_semi").join(shingles.select("t", "s"), "t")
            pairs = staged(in_lists(at, round_, form).distinct(), "pairs")
            discard(opened)
        if pairs.isEmpty():
            break
        each = pairs.join(shingles.select(F.col("t").alias("a"), F.col("h").alias("x")), "a").join(shingles.select(F.col("t").alias("b"), F.col("h").alias("y")), "b")
        found = staged(each.select("ca", "cb", "x", "y").mapInArrow(tidy(_alike(similarity)), "a long, b long").distinct(), "near")
        joined = components(found)
        before, of = of, staged(of.join(joined.withColumnRenamed("node", "c"), "c", "left").select("t", F.coalesce("component", "c").alias("c")), "of")
        discard(pairs, found, joined, before)
    discard(lists, shingles)
    out = _named(prints.select("id", "t"), least.select("t", "id", "n"), of.select(F.col("t").alias("node"), F.col("c").alias("component")), "t")
    discard(prints, least, of)
    return out.select(F.col("id").alias(key), "component_id")


def _prints(coarse: int, words: int, together: int = 256):
    """The fingerprint of ``coarse``-word shingles and the sketch of the set of ``words``-word ones; one narrow pass."""

    @F.pandas_udf("fp long, s binary")
    @tidy
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fps, bits = [], []
            for n in range(0, len(part), together):
                texts = [x.encode("utf-8", "surrogatepass") for x in part.iloc[n : n + together]]
                fps += [fingerprint(shingle_hashes(x, coarse)) for x in texts]
                sets = [np.unique(shingle_hashes(x, words)) for x in texts]
                bits += [x.tobytes() for x in sketches(np.concatenate(sets), np.array([len(x) for x in sets]), SKETCH)]
            yield pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64), "s": pd.Series(bits, dtype=object)})

    return made


def differing(similarity: float, bits: int, errors: float = 5.5) -> int:
    """Bits of a sketch that sets of a similarity differ in on average, and so many standard errors more."""
    p = (1 - similarity) / 2
    return math.ceil(bits * p + errors * math.sqrt(bits * p * (1 - p)))


def sketches(flat: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """(set, word): a bit of the least hash under each of so many orders; a set without elements has none set."""
    out = np.zeros((len(size), bits // 64), np.uint64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    at, flat = (np.cumsum(size) - size)[some], (flat >> np.uint64(32)).astype(np.uint32)
    for n, step in enumerate(_ORDERS[:bits]):
        bit = (np.minimum.reduceat(flat * step, at) >> np.uint32(9)) & np.uint32(1)
        out[some, n // 64] |= bit.astype(np.uint64) << np.uint64(n % 64)
    return out


def _met(k: np.ndarray, fps: np.ndarray, part: np.ndarray, limit: int, words: np.ndarray | None = None, most: int = 0, pool: int = 1 << 19) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, far): places of pairs within lists, of different parts and near fingerprints and sketches (``words``, if any).

    ``far`` is by sketches, or else fingerprints.  Pairs come in the order of their
    distance in the list; those of parts that are made one meanwhile don't come.
    """
    live, lag, held, size = np.arange(len(k)), 1, [], 0

    def out():
        return tuple(np.concatenate(x) for x in zip(*held))

    while True:
        if lag & (lag - 1) == 0:  # at each power of two lists that are short or one part drop out
            if held:
                yield out()
                held, size = [], 0
            edge = np.flatnonzero(np.r_[True, k[live][1:] != k[live][:-1]]) if len(live) else live
            long = np.diff(np.r_[edge, len(live)])
            go = (long > lag) & (np.minimum.reduceat(part[live], edge) != np.maximum.reduceat(part[live], edge)) if len(live) else np.empty(0, bool)
            live = live[np.repeat(go, long)]
            if not len(live):
                return
            keys = k[live]
        same = np.flatnonzero(keys[lag:] == keys[:-lag])
        a, b = live[same], live[same + lag]
        open_ = part[a] != part[b]
        a, b = a[open_], b[open_]
        far = bit_count(fps[a] ^ fps[b]).astype(np.int64)
        near = far <= limit
        a, b, far = a[near], b[near], far[near]
        if words is not None:
            far = bit_count((words[a] ^ words[b]).reshape(-1)).reshape(len(a), words.shape[1]).sum(1, dtype=np.int64)
            near = far <= most
            a, b, far = a[near], b[near], far[near]
        if len(a):
            held.append((a, b, far))
            size += len(a)
        if size >= pool:
            yield out()
            held, size = [], 0
        lag += 1


def _forest(a: np.ndarray, b: np.ndarray, far: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of places those that span what they connect, nearest first; ``part`` (numbers of places) follows."""
    order = np.argsort(far, kind="stable")
    a, b = a[order], b[order]
    own, kept = np.arange(len(part)), []
    while True:
        x, y = part[a], part[b]
        go = x != y
        if not go.any():
            break
        a, b, x, y = a[go], b[go], x[go], y[go]
        first, rank = np.full(len(part), len(a)), np.arange(len(a))  # each part's nearest pair
        np.minimum.at(first, x, rank)
        np.minimum.at(first, y, rank)
        at = np.flatnonzero(first < len(a))
        e = first[at]
        to = own.copy()
        to[at] = np.where(x[e] == at, y[e], x[e])
        to = np.where((to[to] == own) & (own < to), own, to)  # of two that share their nearest pair the smaller is the root
        while (to[to] != to).any():
            to = to[to]
        part[:] = to[part]
        e = np.unique(e)
        kept.append((a[e], b[e]))
    return tuple(np.concatenate(x) for x in zip(*kept)) if kept else (a[:0], b[:0])


def _sketches_of(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["s"].to_pylist()), np.uint64).reshape(t.num_rows, -1)


def _with_candidates(limit: int):
    """Rows of lists with another one in the list that differs in at most ``limit`` bits."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_lists(batches):
            k, f = t["k"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
            part, keep = np.arange(len(k)), np.zeros(len(k), bool)
            for found in _met(k, f, part, limit):
                for ends in _forest(*found, part):
                    keep[ends] = True
            if keep.any():
                yield from t.filter(pa.array(keep)).to_batches()

    return made


def _of_parts(a: np.ndarray, b: np.ndarray, t: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """Pairs of places as texts, the smaller first, and their components."""
    a, b = np.where(t[a] < t[b], a, b), np.where(t[a] < t[b], b, a)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (t[a], t[b], c[a], c[b])], names=["a", "b", "ca", "cb"])


def _spanning(limit: int, similarity: float, bits: int):
    """Pairs that span what sketches connect of components (c) in each list: those that are similar but for chance, and then any that may be."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_lists(batches):
            k, t, c, f = (table[x].to_numpy() for x in ("k", "t", "c", "fp"))
            words = _sketches_of(table)
            # components by list, so that no list's pairs count in another
            part = np.unique(np.stack([k, c], 1), axis=0, return_inverse=True)[1].reshape(-1)
            for errors in (-2, 5.5):
                for found in _met(k, f.view(np.uint64), part, limit, words, differing(similarity, bits, errors)):
                    yield _of_parts(*_forest(*found, part), t, c)

    return made


def _unconnected(sets: list[tuple[int, ...]], limit: int, similarity: float, bits: int):
    """All pairs of different components (c) whose sketches may be similar, each in the first list in which it meets."""
    first, most = _first(sets), differing(similarity, bits)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_lists(batches):
            k, t, c, f = (table[x].to_numpy() for x in ("k", "t", "c", "fp"))
            f, part = f.view(np.uint64), np.unique(c, return_inverse=True)[1]
            for a, b, _ in _met(k, f, part, limit, _sketches_of(table), most):
                own = first[shared_bytes(f[a] ^ f[b])] == k[a] >> 32
                yield _of_parts(a[own], b[own], t, c)

    return made


def _shingle_sets(words: int, together: int = 256):
    """Of each text the set of shingles and its wide sketch."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for n in range(0, whole.num_rows, together):
                b = whole.slice(n, together)
                sets = [np.unique(shingle_hashes(x, words)) for x in b.column(1).cast(pa.large_binary()).to_pylist()]
                bits = [x.tobytes() for x in sketches(np.concatenate(sets), np.array([len(x) for x in sets]), WIDE)]
                columns = [b.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "h", "s"])

    return made


def _alike(similarity: float):
    """Components (ca, cb) of pairs whose sets of shingles are as similar as they need be."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(*(_arrays_of(b.column(n)) for n in ("x", "y"))):
                least, most = sorted((len(x), len(y)))
                ok = least >= similarity * most and least > 0
                if ok:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok = both >= similarity * (len(x) + len(y) - both)
                keep.append(ok)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("ca").filter(keep), b.column("cb").filter(keep)], names=["a", "b"])

    return made


def _arrays_of(lists: pa.ListArray) -> Iterator[np.ndarray]:
    flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    return (flat[a:z] for a, z in zip(at, at[1:]))
