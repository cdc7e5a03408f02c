"""Operator 1: benchmark decontamination by CGK embedding, bit sampling and pieces.

Texts are sequences of words (runs of letters and digits, A-Z lowered).  A CGK
random walk reads a window: at each step it puts out the word under it and, by a
random bit of that word and step, stays or goes on by one.  Windows at small
edit distance give embeddings at small Hamming distance.  Sampling a few steps
gives a key; windows of documents (from every ``stride``-th word) and of items
(from every word, so that any alignment meets) that share a key are candidates.
Walks find a leak with some probability only.  What makes the search whole is
that an item is also cut into one piece more than it may have edits: at least
one piece is then unchanged, and pieces are looked up at every word of a
document.  Every stretch within the allowed edits is thus a candidate.

Of a candidate, the words near it that the item has too are counted first; it is
then verified exactly: the item's edit distance to the best-fitting stretch of
the document, in words, against (1 - similarity) times the item's words.

Windows are item-sized: items fall into size classes, and documents are read
with the windows of every class that the benchmark has.  The benchmark goes to
the tasks in blocks of at most about ``block_words`` words; a larger one takes
more passes.  One narrow pass over the documents a block, no shuffle.

Null and empty texts leak nothing, and items without words can't be leaked.
Repeated document rows are reported each; repeated items by item id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import has, ship, text_of, tidy

#: Window sizes in words, largest first; an item has the largest that it fills.
CLASSES = (12, 6, 3, 1)
WALKS, SAMPLES, BITS_EACH = 3, 3, 7
#: Bytes of text that are worked on at a time.
PART = 1 << 20
LEAST = 1 << 15

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_RNG = np.random.default_rng(20240229)
_CODE = _RNG.integers(1, 1 << 62, 256, dtype=np.uint64)
_CODE[65:91] = _CODE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
STEPS = _RNG.integers(1, 1 << 63, (WALKS, 3 * CLASSES[0]), dtype=np.uint64) | np.uint64(1)
SAMPLE_SEED = 77


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_powers: dict[str, np.ndarray] = {}


def _upto(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        _powers[name] = powers(base, max(n, PART + LEAST))
    return _powers[name]


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of a byte array."""
    inside = _IN_WORD[buf]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    a, b = edge[::2], edge[1::2]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_CODE[buf] * _upto("up", _BASE, len(buf))[: len(buf)], out=total[1:])
    h = (total[b] - total[a]) * _upto("down", _INVERSE, len(buf))[a]
    h ^= h >> np.uint64(31)
    return (h * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1), a


def sampled(width: int) -> list[list[list[int]]]:
    """The steps sampled, for each walk and sample; a walk has 3 steps for 2 words."""
    rng = np.random.default_rng(SAMPLE_SEED + width)
    t = max(1, width * 3 // 2)
    return [[sorted(rng.choice(t, min(BITS_EACH, t), replace=False).tolist()) for _ in range(SAMPLES)] for _ in range(WALKS)]


def keys_of(words: np.ndarray, at: np.ndarray, end: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each walk and sample the keys of the windows from ``at``; words[end] stand for what follows a text."""
    for walk, samples in enumerate(sampled(width)):
        keys = [np.full(len(at), 1 + s, np.uint64) for s in range(SAMPLES)]
        i = at.copy()
        for step in range(max(max(s) for s in samples) + 1):
            w = words[i]
            for s, steps in enumerate(samples):
                if step in steps:
                    keys[s] = (keys[s] ^ w) * np.uint64(0x9FB21C651E98DF25)
                    keys[s] ^= keys[s] >> np.uint64(29)
            i += ((w * STEPS[walk, step]) >> np.uint64(63)).astype(i.dtype)
            np.minimum(i, end, out=i)
        yield from keys


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """A key of the ``width`` words from each place; zeros follow the last."""
    key = np.full(len(words), width, np.uint64)
    for j in range(width):
        key[: max(len(words) - j, 0)] ^= words[j:]
        key *= np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(29)
    return key


def table_of(keys: np.ndarray, item: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, whose they are, and which leading bits occur."""
    order = np.argsort(keys)
    seen = np.zeros(1 << 20, bool)
    seen[keys >> np.uint64(44)] = True
    return keys[order], item[order], offset[order], seen


def met(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among ``keys``, item, offset) of all equal keys."""
    theirs, item, offset, seen = table
    hit = np.flatnonzero(seen[keys >> np.uint64(44)])
    lo, hi = np.searchsorted(theirs, keys[hit]), np.searchsorted(theirs, keys[hit], "right")
    n = hi - lo
    x = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(hit, n), item[x], offset[x]


class Items:
    """The windows and pieces of a block of benchmark items under their keys."""

    def __init__(self, rows: list[tuple], similarity: float):
        self.similarity = similarity
        self.items: list[tuple[object, np.ndarray, int]] = []  # id, words, width
        by_width: dict[int, list[tuple[int, int]]] = {}
        pieces: dict[int, list[tuple[int, int, int]]] = {}  # key, item, offset
        for ident, text in rows:
            w, _ = words_of(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8))
            if len(w):
                width = next(c for c in CLASSES if len(w) >= c)
                by_width.setdefault(width, []).extend((len(self.items), o) for o in range(len(w) - width + 1))
                n = min(self.most(len(w)) + 1, len(w))
                cut = [len(w) * j // n for j in range(n + 1)]
                for a, b in zip(cut, cut[1:]):
                    pieces.setdefault(b - a, []).append((int(runs(w[a:b], b - a)[0]), len(self.items), a))
                self.items.append((ident, w, width))
        self.pieces = {}
        for width, found in pieces.items():
            keys, item, offset = zip(*found)
            self.pieces[width] = table_of(np.array(keys, np.uint64), np.array(item), np.array(offset))
        self.plain = [w.tolist() for _, w, _ in self.items]
        self.index: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        starts = np.cumsum([0] + [len(w) + 1 for _, w, _ in self.items])
        flat = np.concatenate([np.r_[w, np.uint64(0)] for _, w, _ in self.items]) if self.items else np.empty(0, np.uint64)
        for width, windows in by_width.items():
            item, offset = np.array(windows, np.int64).T
            at, end = starts[item] + offset, starts[item + 1] - 1
            self.index[width] = []
            for k in keys_of(flat, at, end, width):
                self.index[width].append(table_of(k, item, offset))

    def most(self, n: int) -> int:
        """Edits that an item of n words may have."""
        return int((1 - self.similarity) * n + 1e-9)

    def candidates(self, words: np.ndarray, first: np.ndarray, last: np.ndarray, stride: int) -> np.ndarray:
        """Rows (text, item, word at which it would start) for texts in ``words``; text t has first[t]..last[t]-1, and last[t] follows it."""
        n = -(-(last - first) // stride)
        text = np.repeat(np.arange(len(first)), n)
        at = first[text] + stride * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
        end = last[text]
        out = [np.empty((0, 3), np.int64)]
        for width, tables in self.index.items():
            # short windows have no other word to share, so each word starts one
            if width < stride:
                return self.candidates(words, first, last, 1)
            for k, table in zip(keys_of(words, at, end, width), tables):
                place, item, offset = met(k, table)
                out.append(np.c_[text[place], item, at[place] - offset])
        for width, table in self.pieces.items():
            # no item has the zero word between texts, so a piece lies in one
            place, item, offset = met(runs(words, width), table)
            out.append(np.c_[np.searchsorted(first, place, "right") - 1, item, place - offset])
        return self.likely(words, first, last, np.unique(np.concatenate(out), axis=0))

    def likely(self, words: np.ndarray, first: np.ndarray, last: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The candidates with enough words of the item near them."""
        keep = np.zeros(len(found), bool)
        order = np.argsort(found[:, 1], kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(found[order, 1])) + 1) if len(order) else []:
            w = self.items[found[rows[0], 1]][1]
            own, most = np.sort(w), self.most(len(w))
            span = np.arange(-most, len(w) + most)
            for part in np.split(rows, range(4096, len(rows), 4096)):
                t = found[part, 0]
                x = found[part, 2][:, None] + span
                inside = (x >= first[t][:, None]) & (x < last[t][:, None])
                there = words[np.clip(x, 0, len(words) - 1)]
                same = own[np.minimum(np.searchsorted(own, there), len(own) - 1)] == there
                keep[part] = (same & inside).sum(1) >= len(w) - most
        return found[keep]

    def verify(self, item: int, words: np.ndarray) -> tuple[int, int] | None:
        """(edit distance, last word) of the item in a stretch of words, if near enough."""
        w = self.items[item][1]
        most = self.most(len(w))
        there = set(words.tolist())
        if sum(map(there.__contains__, self.plain[item])) < len(w) - most:
            return None
        d, j = best_fit(w, words)
        return (d, j) if d <= most else None


def best_fit(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to any stretch of ``words``, and where that ends."""
    ramp = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, x in enumerate(item, 1):
        step = np.minimum(row[:-1] + (words != x), row[1:] + 1)
        row = np.minimum.accumulate(np.r_[i, step] - ramp) + ramp
    at = int(np.argmin(row))
    return int(row[at]), at


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, stride: int = 2, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_words: int = 200_000) -> DataFrame:
    """(key, item_key, item_words, distance, similarity): a row per document and leaked item."""
    has(docs, key, text)
    has(benchmark, item_key, item_text)
    ship(docs.sparkSession)
    parts = benchmark.select(F.col(f"`{item_key}`").alias("item"), text_of(f"`{item_text}`").alias("text"))
    # at most one word for two bytes
    size = parts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))
    found = None
    for block in range(blocks):
        rows = [tuple(r) for r in parts.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).distinct().collect()]
        some = _leaks(docs, rows, benchmark.schema[item_key].dataType.simpleString(), similarity, stride, key, text, item_key)
        found = some if found is None else found.unionByName(some)
    return found


def _leaks(docs: DataFrame, rows: list[tuple], item_kind: str, similarity: float, stride: int, key: str, text: str, item_key: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, similarity)
        for b in batches:
            if not b.num_rows:
                continue
            hits = find(items, b.column(1), stride)
            cols = list(zip(*hits)) if hits else [[]] * 5
            ids = pa.array([items.items[i][0] for i in cols[1]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int64())), ids if len(ids) else pa.array([], _arrow(item_kind)), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.float64())],
                names=[key, item_key, "item_words", "distance", "similarity"],
            )

    return docs.select(F.col(f"`{key}`"), text_of(f"`{text}`").alias("text")).mapInArrow(tidy(searched), f"`{key}` {kind}, `{item_key}` {item_kind}, item_words int, distance int, similarity double")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16()}.get(kind, pa.string())


def find(items: Items, texts: pa.Array, stride: int) -> list[tuple[int, int, int, int, float]]:
    """(row, item, item's words, distance, similarity) for a batch of texts."""
    if not items.items:
        return []
    out: list[tuple[int, int, int, int, float]] = []
    held: list[tuple[int, bytes]] = []
    size = 0

    def work() -> None:
        first_byte = np.cumsum([0] + [len(t) + 1 for _, t in held])
        w, at = words_of(np.frombuffer(b"\n".join(t for _, t in held) + b"\n", np.uint8))
        cut = np.searchsorted(at, first_byte)
        # a zero word after each text
        spaced = np.insert(w, cut[1:], np.uint64(0))
        first, last = cut[:-1] + np.arange(len(held)), cut[1:] + np.arange(len(held))
        near: dict[tuple[int, int], list[int]] = {}
        for t, item, start in items.candidates(spaced, first, last, stride).tolist():
            near.setdefault((t, item), []).append(start)
        for (t, item), starts in near.items():
            n = len(items.items[item][1])
            slack = int((1 - items.similarity) * n) + 2
            best, to = None, -1
            for s in sorted(set(starts)):
                if s <= to:
                    continue
                lo, hi = max(first[t], s - slack), min(last[t], s + n + 4 * slack)
                to = s + 2 * slack
                if lo < hi and (got := items.verify(item, spaced[lo:hi])) and (best is None or got[0] < best):
                    best = got[0]
            if best is not None:
                out.append((held[t][0], item, n, best, 1 - best / n))

    for row, t in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        if not t:
            continue
        held.append((row, t))
        size += len(t)
        if size >= PART:
            work()
            held, size = [], 0
    if held:
        work()
    return out
