"""Operator 8: token counts by heap-and-linked-list byte-pair merging.

The vocabulary is a byte-pair model with word ends whose normaliser composes
(NFC), turns white space into a space and lower-cases, and whose words never
span white space.  A text's count is therefore the sum over its words, and a
word's count is its initial symbols minus the merges done.  Merging keeps the
symbols in a linked list and the adjacent pairs in a heap by rank; no
identifiers are made.

Null text counts as empty.  Empty and all-white texts have no tokens.  Special
strings inside a text count one each, as the library handles them by default.
Repeated rows are counted each.  Columns named like the new ones, in any case,
are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import has, ship, text_of, tidy

#: Words whose counts a worker remembers; the generation before is kept too.
REMEMBERED = 400_000

#: The words of a lower-case ASCII text, as the model's splitting pattern has them.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall


class Merger:
    """Counts tokens of texts with the model in ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.normalise = whole.normalizer.normalize_str
        self.words = whole.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        self.end = d["model"].get("end_of_word_suffix") or ""
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in d["model"]["merges"])
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.special = [t["content"] for t in d["added_tokens"]]
        self.known: dict[str, int] = {}  # of texts between white space
        self.merged: dict[str, int] = {}  # of words
        self.old_known: dict[str, int] = {}
        self.old_merged: dict[str, int] = {}

    def merges(self, word: str) -> int:
        """Tokens of one word of byte symbols."""
        part = list(word)
        n = len(part)
        if n < 2:
            return n
        part[-1] += self.end
        get, bits = self.rank.get, n.bit_length()
        low = (1 << bits) - 1
        pair = [get(p, -1) for p in zip(part, part[1:])]  # rank of the pair that starts here, now
        pair.append(-1)
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left, push, pop = n, heapq.heappush, heapq.heappop
        while heap:
            code = pop(heap)
            i = code & low
            if pair[i] != code >> bits:
                continue  # one of the two has been merged since
            j = after[i]
            part[i] += part[j]
            pair[j] = -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                pair[i] = r = get((part[i], part[k]), -1)
                if r >= 0:
                    push(heap, r << bits | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                pair[h] = r = get((part[h], part[i]), -1)
                if r >= 0:
                    push(heap, r << bits | h)
        return left

    def chunk(self, text: str) -> int:
        """Tokens of a text without white space and special strings."""
        if not text:
            return 0
        if text.isascii() and text.isprintable():  # the library's rules, where letters and digits are ASCII
            words = ASCII_WORDS(text.lower())
        else:
            words = [w for w, _ in self.words(self.normalise(text))]
        total, merged = 0, self.merged
        for w in words:
            n = merged.get(w)
            if n is None:
                n = merged[w] = self.old_merged.get(w) or self.merges(w)
            total += n
        return total

    def count(self, text: str) -> int:
        extra = 0
        for s in self.special:
            if s in text:
                extra += text.count(s)
                text = text.replace(s, " ")  # words never span either
        known, total = self.known, 0
        if len(known) > REMEMBERED:
            self.old_known, self.known = known, {}
            known = self.known
        if len(self.merged) > REMEMBERED:
            self.old_merged, self.merged = self.merged, {}
        for w in text.replace("\n", " ").split(" "):
            n = known.get(w)
            if n is None:
                n = self.old_known.get(w)
                known[w] = n = self.chunk(w) if n is None else n
            total += n
        return total + extra


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with n_bytes, n_tokens and over_limit.

    One narrow pass, no shuffle; ``path`` is the vocabulary file, which every
    executor has.
    """
    has(docs, text)
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    @tidy
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = merger(path)
        for part in parts:
            yield pd.Series([m.count(x) for x in part], dtype="int64")

    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    base = docs.select(*[F.col(f"`{c}`") for c in names], F.octet_length(text_of(f"`{text}`")).cast("long").alias("n_bytes"), counted(text_of(f"`{text}`")).alias("n_tokens"))
    return base.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
