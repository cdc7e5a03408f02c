"""Operator 4: sum-of-squares online packing of token streams.

A document's stream is its token ids and one separator id.  Whole windows of
``size`` tokens are cut off at once; what is left of a document (under a
window) is placed online into the partly filled windows: of all fill levels
that still take it, and a fresh window, the one that makes the sum over levels
of the squared count of windows at that level least.  The counts live in a
level array; a window that gets full leaves it.  At the end of a task the
windows still open are drained: their pieces are laid end to end and cut into
full windows, and the remainder into windows of powers of two, which need no
padding.  So each task packs what it reads, in one narrow pass; no shuffle.

Null text is the empty document, which is the separator alone.  Empty input
gives no rows.  Repeated rows are packed each on its own.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import has, ship, text_of, tidy

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: The splitting pattern of the byte-level vocabulary, and what it
#: comes to in a text without two white space characters side by side.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS_BETWEEN_SINGLE = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


class Encoder:
    """Token ids, as little-endian unsigned 32-bit bytes, of byte-level BPE texts.

    The ids are those of the tokenizers library for the same file.  Its merges
    are in the order of its ids, so the texts go through tiktoken, which gives
    equal ids several times faster; a text that holds a special string goes
    through tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in d["added_tokens"]]
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in w): i for w, i in d["model"]["vocab"].items() if w not in self.special}

        def ids(pattern: str):
            return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer

        self.any, self.single = ids(WORDS), ids(WORDS_BETWEEN_SINGLE)
        self.side_by_side = re.compile(r"\s\s").search

    def encode(self, text: str) -> bytes:
        for s in self.special:
            if s in text:
                return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ids = self.any if self.side_by_side(text) else self.single
        return np.frombuffer(ids(text, set()), np.uint32).astype("<u4", copy=False).tobytes()


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Places the pieces of one task; yields (piece, sequence, offset)."""

    def __init__(self, size: int, first: int):
        self.size, self.next = size, first
        self.count = np.zeros(size + 1, np.int64)  # the level array: open windows by fill
        self.open: list[list[list]] = [[] for _ in range(size + 1)]

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, piece: tuple, n: int) -> list[tuple] | None:
        """Place a piece of n < size tokens; a window that gets full is returned."""
        size, count = self.size, self.count
        # growth of the sum of squares, for the levels 0 (a fresh window) to size - n
        gain = 2 * count[n:].copy() + 1
        gain[-1] = 0  # full windows leave the array
        gain[1:] += 1 - 2 * count[1 : size - n + 1]
        gain[1:][count[1 : size - n + 1] == 0] = np.iinfo(np.int64).max
        at = int(np.argmin(gain[::-1]))  # among equals the fullest
        level = size - n - at
        if level:
            window = self.open[level].pop()
            count[level] -= 1
        else:
            window = []
        window.append(piece)
        if level + n == size:
            return window
        self.open[level + n].append(window)
        count[level + n] += 1
        return None

    def drain(self) -> list[tuple]:
        """The pieces of open windows, fullest window first."""
        left = [p for level in range(self.size - 1, 0, -1) for w in self.open[level] for p in w]
        self.open = [[] for _ in range(self.size + 1)]
        self.count[:] = 0
        return left


def pack(docs: DataFrame, path: str, size: int = 1024, separator: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: the key and where in which sequence the piece lies.

    start counts the document's ids before the piece; ids_crc32 is over the
    piece's ids as little-endian unsigned 32-bit numbers; sequence_id is unique
    (the task's number and a count within it), offsets in a sequence have no
    gaps.  Only the key and the text of ``docs`` are read.  ``size`` is a power
    of two.
    """
    has(docs, key, text)
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType
    last = int(separator).to_bytes(4, "little")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []

        def emit(window: list[tuple], number: int) -> None:
            at = 0
            for k, start, n, total, ids in window:
                rows.append((k, start, n, zlib.crc32(ids), total, number, at))
                at += n

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type=key_type)] + [pa.array(c, pa.int64()) for c in cols[1:]], names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.encode(t) + last if t else last
                total = len(ids) // 4
                full = total - total % size
                for start in range(0, full, size):
                    emit([(k, start, size, total, ids[4 * start : 4 * (start + size)])], packer.fresh())
                if full < total:
                    window = packer.place((k, full, total - full, total, ids[4 * full :]), total - full)
                    if window:
                        emit(window, packer.fresh())
                if len(rows) > 20_000:
                    yield flush()
        if key_type is None:
            return
        left = packer.drain()
        room, window, rest = 0, [], sum(p[2] for p in left)
        for k, start, n, total, ids in left:
            while n:
                if not room:
                    room = size if rest >= size else 1 << (rest.bit_length() - 1)
                    rest -= room
                cut = min(room, n)
                window.append((k, start, cut, total, ids[: 4 * cut]))
                start, n, ids, room = start + cut, n - cut, ids[4 * cut :], room - cut
                if not room:
                    emit(window, packer.fresh())
                    window = []
        yield flush()

    return docs.select(F.col(f"`{key}`"), text_of(f"`{text}`").alias("text")).mapInArrow(tidy(packed), f"`{key}` {kind.simpleString()}, {PIECES}")
