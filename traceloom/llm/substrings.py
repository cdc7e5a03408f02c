"""Operator 9: repeated byte strings by suffix arrays of bounded parts.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else,
in another document or the same one.  Matches never cross documents; overlaps
count; strings are judged on the input.

1. Every string of ``length`` bytes has one least gram (of ``GRAM`` bytes, by
   hash); neighbouring strings mostly share it, and equal strings always do.  So
   a document is a list of runs of starts, each under its gram's hash; the bytes
   of a run's strings are its segment.
2. A gram with one run repeats nothing.  A gram whose runs' segments are all
   equal repeats every string of them.
3. For other grams the distinct segments (equal ones carry a count) are laid
   together and their suffix array is built by linear grouping (suffixes.py), of
   grams of similar size at once; neighbours in it that agree in ``length``
   bytes, compared byte by byte, are repeated strings.
4. A gram with more than ``bound`` bytes of distinct segments, which no task need
   hold, is split.  Equal strings hold their gram at the same place, so segments
   are cut into pieces of a few such places; all strings of a piece share its
   core, and equal strings lie in pieces of equal cores.  A piece that stands in
   several segments repeats whole; the distinct pieces of a core go through suffix
   arrays.  Those of a core over the bound again are cut into smaller pieces, whose
   cores are longer and so shared by fewer (``BLOCKS``), and only what is over the
   bound after the last cut goes string by string.
5. Each document gets its repeated starts back, and loses the bytes they cover.

Null text is empty.  Rows are told apart by key and text, so repeated rows are
copies of each other.  Equal segments are known by 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, has, ship, staged, text_of, tidy
from .suffixes import ranges, suffix_arrays

GRAM = 32
#: Bytes of text worked on at a time; places in it fit into PLACE bits.
PART, PLACE = 900_000, 20
#: Symbols that go through one call of suffix_arrays; it takes about 80 bytes each.
TOGETHER = 750_000
#: Places of a gram that a piece of a segment covers, cut after cut.
BLOCKS = (24, 6)
_CODE = np.random.default_rng(1729).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << PLACE) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    h, step, n = _CODE[b], _STEP, 1
    while n < GRAM:
        h = h[:-n] * step + h[n:]
        step, n = np.uint64(int(step) * int(step) & (1 << 64) - 1), 2 * n
    return _mixed(h)


def runs_of(b: np.ndarray, first: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(piece, start in ``b``, starts, gram) of each run; pieces of at least ``length`` bytes lie at ``first``."""
    h = gram_hashes(b)
    m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width, n = length - GRAM + 1, 1
    while 2 * n <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    if n < width:
        m = np.minimum(m[: len(m) - (width - n)], m[width - n :])
    starts = ranges(first, size - length + 1)
    piece = np.repeat(np.arange(len(first)), size - length + 1)
    at = (m[starts] & _LOW).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])])
    return piece[edge], starts[edge], np.diff(np.r_[edge, len(starts)]), h[at[edge]].view(np.int64)


def _runs(length: int) -> Callable:
    import xxhash

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest

        def work(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            whole = b"".join(x[3] for x in held)
            size = np.array([len(x[3]) for x in held])
            first = np.r_[0, np.cumsum(size)[:-1]]
            piece, start, n, gram = runs_of(np.frombuffer(whole, np.uint8), first, size, length)
            view = memoryview(whole)
            seg = np.array([digest(view[s:e]) for s, e in zip(start.tolist(), (start + n + length - 1).tolist())], np.uint64)
            a, b, off = (np.array([x[i] for x in held], np.int64) for i in range(3))
            cols = [gram, seg.view(np.int64), a[piece], b[piece], start - first[piece] + off[piece], n.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "seg", "a", "b", "start", "n"])

        held, total = [], 0
        for batch in batches:
            for a, b, t in zip(*(batch.column(i) for i in range(2)), batch.column(2).cast(pa.large_binary())):
                a, b, t = a.as_py(), b.as_py(), t.as_py()
                for o in range(0, len(t) - length + 1, PART // 2):
                    held.append((a, b, o, t[o : o + PART // 2 + length - 1]))
                    total += len(held[-1][3])
                    if total > PART // 2:
                        yield work(held)
                        held, total = [], 0
        if held:
            yield work(held)

    return made


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b, key, text): a and b tell rows apart."""
    k = F.col(f"`{key}`")
    return docs.select(k.alias("key"), text_of(text).alias("text")).select(F.xxhash64("key").alias("a"), F.xxhash64("text", "key").alias("b"), "key", "text")


def _cut(length: int) -> Callable:
    """The bytes of the segments wanted of each document."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for t, wanted in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist()):
                out += [(w["gram"], w["seg"], w["many"], w["size"], t[w["start"] : w["start"] + w["n"] + length - 1]) for w in wanted]
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["gram", "seg", "many", "size", "bytes"])

    return made


def places_of(segments: list[bytes], length: int) -> list[int]:
    """Where the least gram of each segment's first string stands."""
    width = length - GRAM + 1
    heads = gram_hashes(np.frombuffer(b"".join(s[:length] for s in segments), np.uint8)) >> np.uint64(PLACE)
    heads = np.r_[heads, np.zeros(GRAM - 1, np.uint64)].reshape(len(segments), length)[:, :width]
    return heads.argmin(1).tolist()


def pieces_of(segments: list[bytes], places: list[int], length: int, size: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(segment, block, first start, starts, its place, start and end of the core) of each piece; a segment's strings share the gram at ``places``."""
    out, width = [], length - GRAM + 1
    for j, (s, at) in enumerate(zip(segments, places)):
        last = at - (len(s) - length)  # the gram's place in the segment's last string
        for block in range(last // size, at // size + 1):
            lo, hi = block * size, min((block + 1) * size, width) - 1
            first = at - min(hi, at)
            out.append((j, block, first, at - max(lo, last) - first + 1, at - first, at - lo, at - hi + length))
    return out


PIECE = "gram long, seg long, many long, core long, piece long, s int, n int, place int, bytes binary"


def _pieces(length: int, size: int) -> Callable:
    """Pieces of segments (gram, seg, many, place, bytes); a null place is looked for."""
    import xxhash

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                segments, places = part.column(4).to_pylist(), part.column(3).to_pylist()
                if None in places:
                    places = places_of(segments, length)
                found = pieces_of(segments, places, length, size)
                j, _, s, n, place, _, _ = (np.array(c, np.int64) for c in zip(*found))
                cut = [segments[x][a : a + m + length - 1] for x, _, a, m, _, _, _ in found]
                core = np.array([digest(segments[x][a:e], seed=block) for x, block, _, _, _, a, e in found], np.uint64).view(np.int64)
                piece = np.array([digest(c) for c in cut], np.uint64).view(np.int64)
                cols = [*(part.column(i).take(pa.array(j)) for i in range(3)), core, piece, s.astype(np.int32), n.astype(np.int32), place.astype(np.int32), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "seg", "many", "core", "piece", "s", "n", "place", "bytes"])

    return made


def repeated_starts(groups: list[list[tuple[int, bytes]]], length: int) -> list[tuple[int, int, np.ndarray]]:
    """(group, segment, its repeated starts), from each group's distinct (id, bytes)."""
    parts, base, size = [], [], []
    n = 0
    for g in groups:
        joined = [p for _, s in g for p in (np.frombuffer(s, np.uint8).astype(np.int16) + 2, [1])]
        joined[-1] = [0]  # smallest, once
        whole = np.concatenate(joined).astype(np.int16)
        parts.append(whole)
        base.append(n)
        size.append(len(whole))
        n += len(whole)
    symbols = np.concatenate(parts).astype(np.int64)
    order = suffix_arrays(symbols, np.array(base), np.array(size))
    # where strings may start, and of which segment
    lens = np.array([len(s) for g in groups for _, s in g])
    at = np.r_[0, np.cumsum(lens + 1)[:-1]]
    may = np.zeros(n, bool)
    may[ranges(at, np.maximum(lens - length + 1, 0))] = True
    text = np.repeat(np.arange(len(groups)), size)
    x, y = order[:-1], order[1:]
    near = may[x] & may[y] & (text[x] == text[y])
    x, y = x[near], y[near]
    raw = (symbols - 2).clip(0).astype(np.uint8)
    words = np.ndarray((max(len(raw) - 7, 0),), "<u8", raw.tobytes(), 0, (1,))
    for off in sorted({*range(0, length - 7, 8), length - 8}, reverse=True):
        same = words[x + off] == words[y + off]
        x, y = x[same], y[same]
    again = np.zeros(n, bool)
    again[x] = again[y] = True
    out, k = [], 0
    for i, g in enumerate(groups):
        for j in range(len(g)):
            found = np.flatnonzero(again[at[k] : at[k] + max(lens[k] - length + 1, 0)])
            if len(found):
                out.append((i, j, found))
            k += 1
    return out


def spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Ascending starts as half-open spans."""
    edge = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, edge + 1]].tolist(), (starts[np.r_[edge, len(starts) - 1]] + 1).tolist()))


SPANS = "array<struct<s:int,e:int>>"
_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _arrays(length: int) -> Callable:
    """Spans of repeated starts of the segments of each gram; each gram's rows come together, the smallest grams first."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(groups: list[tuple[int, dict[int, bytes]]]) -> pa.RecordBatch:
            groups = sorted(groups, key=lambda g: sum(map(len, g[1].values())))
            found = repeated_starts([list(g[1].items()) for g in groups], length)
            cols = [[groups[i][0] for i, _, _ in found], [list(groups[i][1])[j] for i, j, _ in found], [[{"s": s, "e": e} for s, e in spans(f)] for _, _, f in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), _SPANS))], names=["gram", "seg", "spans"])

        groups: list[tuple[int, dict[int, bytes]]] = []
        total = 0
        for batch in batches:
            for gram, seg, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not groups or groups[-1][0] != gram:
                    if total + len(text) > TOGETHER:
                        yield work(groups)
                        groups, total = [], 0
                    groups.append((gram, {}))
                groups[-1][1][seg] = text
                total += len(text)
        if groups:
            yield work(groups)

    return made


def _finish(length: int, with_text: bool) -> Callable:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, found in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist()):
                gone = covered(found or [], length)
                kept, at = [], 0
                for s, e in gone:
                    kept.append(t[at:s])
                    at = e
                kept.append(t[at:])
                row = (len(t), sum(e - s for s, e in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest())
                out.append((*row, without(t, gone)) if with_text else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [batch.column("row")] + [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else None
            if cols:
                yield pa.RecordBatch.from_arrays(cols, names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols)])

    return made


def covered(found: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings from the given spans of starts cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"] - 1 + length) for x in found):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without(text: bytes, gone: list[tuple[int, int]]) -> str:
    """The text without the runs; a character that a run covers in part stays."""
    kept, at = [], 0
    for s, e in gone:
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return b"".join(kept).decode("utf-8", "replace")


def _by_array(cut: DataFrame, length: int) -> DataFrame:
    """(gram, seg, spans) of bounded grams by suffix arrays, those of similar size together."""
    ordered = cut.select("size", "gram", "seg", "bytes").repartition("gram").sortWithinPartitions("size", "gram").select("gram", "seg", "bytes")
    return ordered.mapInArrow(tidy(_arrays(length)), f"gram long, seg long, spans {SPANS}")


def _moved(spans: str, by: str) -> Column:
    return F.transform(spans, lambda x: F.struct((x["s"] + F.col(by)).alias("s"), (x["e"] + F.col(by)).alias("e")))


def _whole(n: str) -> Column:
    return F.array(F.struct(F.lit(0).alias("s"), F.col(n).alias("e")))


def _by_piece(big: DataFrame, length: int, bound: int, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """(gram, seg, spans) of the segments (gram, seg, many, place, bytes) of large grams that occur once, piece by piece."""
    pieces = staged(big.select("gram", "seg", "many", "place", "bytes").mapInArrow(tidy(_pieces(length, blocks[0])), PIECE), "pieces")
    # equal pieces have their gram at one place
    kinds = staged(pieces.groupBy("core", "piece").agg(F.sum("many").alias("many"), F.min("n").alias("n"), F.min("place").alias("place"), F.min("bytes").alias("bytes")), "kinds")
    sizes = staged(kinds.groupBy("core").agg(F.sum(F.length("bytes")).alias("size"), F.count("*").alias("c")).where("c > 1").drop("c"), "sizes")
    sized = kinds.join(sizes, "core")
    of_core = {"gram": "core", "seg": "piece"}
    by_array = _by_array(sized.where(F.col("size") <= bound).select("size", F.col("core").alias("gram"), F.col("piece").alias("seg"), "bytes"), length).withColumnsRenamed(of_core)
    once = kinds.where("many = 1").select("core", "piece")
    parts = [by_array.join(once, ["core", "piece"])]
    again = None
    if sizes.where(F.col("size") > bound).limit(1).count():
        large = sized.where(F.col("size") > bound)
        if len(blocks) > 1:
            again = _by_piece(large.select(F.col("core").alias("gram"), F.col("piece").alias("seg"), "many", "place", "bytes"), length, bound, blocks[1:])
            parts.append(again.withColumnsRenamed(of_core))
        else:  # each string by itself
            each = F.expr(f"transform(sequence(1, length(bytes) - {length - 1}), i -> xxhash64(substring(bytes, i, {length})))")
            strings = large.select("core", "piece", "many", F.posexplode(each).alias("s", "h"))
            again = staged(strings.groupBy("core", "h").agg(F.count("*").alias("k")).where("k > 1").select("core", "h"), "again")
            hit = strings.where("many = 1").join(again, ["core", "h"]).groupBy("core", "piece").agg(F.sort_array(F.collect_list("s")).alias("s"))
            parts.append(hit.select("core", "piece", F.transform("s", lambda i: F.struct(i.alias("s"), (i + 1).alias("e"))).alias("spans")))
    # a piece that occurs more than once repeats all its strings
    parts.append(kinds.where("many > 1").select("core", "piece", _whole("n").alias("spans")))
    # a table of its own, so that the join can split a piece that many segments hold
    found = staged(reduce(DataFrame.unionByName, parts), "found")
    held = pieces.where("many = 1").select("gram", "seg", "core", "piece", "s").join(found, ["core", "piece"])
    out = staged(held.select("gram", "seg", _moved("spans", "s").alias("spans")).groupBy("gram", "seg").agg(F.flatten(F.collect_list("spans")).alias("spans")), "by_piece")
    discard(pieces, kinds, sizes, found, *([again] if again is not None else []))
    return out


def _repeats(rows: DataFrame, length: int, bound: int) -> DataFrame:
    """(a, b, spans): spans of starts of repeated strings, for rows that have any."""
    kind = "gram long, seg long, a long, b long, start int, n int"

    def narrowed(batches):
        for b in _runs(length)(batches):
            yield b.set_column(4, "start", b.column("start").cast(pa.int32()))

    runs = staged(rows.select("a", "b", "text").mapInArrow(tidy(narrowed), kind), "runs")
    # the counts are a table of their own, so that the join with them can split a hot gram
    grams = runs.groupBy("gram").agg(F.count("*").alias("c"), (F.min("seg") == F.max("seg")).alias("alike")).where("c > 1").drop("c")
    grams = staged(grams, "grams")
    met = staged(runs.join(grams, "gram"), "met")
    discard(runs, grams)
    differ = met.where("not alike").drop("alike")
    some = differ.groupBy("gram", "seg").agg(F.count("*").alias("many"), F.min(F.struct("a", "b", "start", "n")).alias("at"))
    some = staged(some.select("gram", "seg", "many", "at.*"), "segments")
    sizes = some.groupBy("gram").agg(F.sum(F.col("n") + length).cast("long").alias("size"))
    wanted = some.join(sizes, "gram").groupBy("a", "b").agg(F.collect_list(F.struct("gram", "seg", "many", "size", "start", "n")).alias("w"))
    # rows that repeat key and text are cut once; dealt as the join needs them
    texts = rows.groupBy("a", "b").agg(F.first("text").alias("text"))
    cut = texts.join(wanted, ["a", "b"]).select("text", "w").mapInArrow(tidy(_cut(length)), "gram long, seg long, many long, size long, bytes binary")
    cut = staged(cut, "cut")
    by_array = _by_array(cut.where(F.col("size") <= bound), length)
    by_piece = _by_piece(cut.where(F.col("size") > bound).withColumn("place", F.lit(None).cast("int")), length, bound)
    # segments that occur more than once repeat all their strings
    several = some.where("many > 1").select("gram", "seg", _whole("n").alias("spans"))
    once = by_array.unionByName(by_piece).join(some.where("many = 1").select("gram", "seg"), ["gram", "seg"])
    marked = staged(once.unionByName(several), "marked")
    discard(cut, by_piece, some)
    parts = differ.join(marked, ["gram", "seg"]).select("a", "b", _moved("spans", "start").alias("spans"))
    alike = met.where("alike").select("a", "b", F.array(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e"))).alias("spans"))
    # a set: repeated rows say the same of themselves, however many they are
    found = staged(parts.unionByName(alike).groupBy("a", "b").agg(F.flatten(F.collect_set("spans")).alias("spans")), "repeats")
    discard(met, marked)
    return found


def repeated(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", bound: int = 16_384) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    has(docs, key, text)
    ship(docs.sparkSession)
    rows = _rows(docs, key, text)
    found = _repeats(rows, length, bound)
    kind = docs.schema[key].dataType.simpleString()
    joined = rows.join(found, ["a", "b"], "left").select(F.col("key").alias("row"), "text", "spans")
    out = joined.mapInArrow(tidy(_finish(length, False)), f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("row", key)


def without_repeated(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", bound: int = 16_384) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text, whole characters only."""
    has(docs, key, text)
    ship(docs.sparkSession)
    rows = _rows(docs, key, text)
    found = _repeats(rows, length, bound)
    whole = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]))
    k, t = F.col(f"`{key}`"), text_of(text)
    marked = whole.select("_row", t.alias("text"), F.xxhash64(k).alias("a"), F.xxhash64(t, k).alias("b")).join(found, ["a", "b"], "left")
    kinds = {"row": marked.schema["_row"].dataType, "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType(), "kept": T.StringType()}
    form = T.StructType([T.StructField(n, kind) for n, kind in kinds.items()])  # not as text: names may hold anything
    cut = marked.select(F.col("_row").alias("row"), "text", "spans").mapInArrow(tidy(_finish(length, True)), form)
    return cut.select(*[F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


#: The same rows from DuckDB, over every string; strings are told apart by a hash.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT r, i, hash(b[i:i + 199]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
again AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS opens FROM s JOIN again USING (h)),
run AS (SELECT r, k, min(i) AS lo, max(i) + 199 AS hi FROM (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k),
cut AS (SELECT r, coalesce(lag(hi) OVER w, 0) + 1 AS a, lo - 1 AS z FROM run WINDOW w AS (PARTITION BY r ORDER BY lo)
  UNION ALL SELECT d.r, coalesce(max(hi), 0) + 1, octet_length(any_value(b)) FROM d LEFT JOIN run USING (r) GROUP BY d.r),
kept AS (SELECT r, string_agg(CASE WHEN z >= a THEN hex(b[a:z]) ELSE '' END, '' ORDER BY a) AS x FROM cut JOIN d USING (r) GROUP BY r),
gone AS (SELECT r, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans FROM run GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)
"""
