"""Operator 13: ranked lexical search as a blocked sparse matrix product.

Scores are a product of two sparse matrices: items by terms, which holds how
often an item counts a term, and terms by documents, which holds int64 impacts
(a term's weight times its saturated frequency).  Both are kept in blocks.

One narrow pass reads whole texts and packs documents into blocks of bounded
size: their lengths, and the frequencies of those terms that items may have.
Which those are is told by a bit set of fixed size (``bits``) of the items' term
hashes, so what the tasks are sent doesn't grow with the benchmark; terms that
pass it by chance meet no item's term later.  Items are packed into blocks of
``item_block``.  A block of documents and one of items meet in one task, which
merges the rows of the impact matrix that an item's row names (Gustavson) and
keeps each item's ``top`` documents; the last step keeps the best of these.

A term is a maximal run of letters, digits and characters beyond ASCII, with A-Z
lowered.  With N documents that have a term, L terms in all of them, a term in
df documents, tf times in one of n terms: w = floor(1000 ln((2N+2)/(2df+1))), in
doubles; m = 10 + (90 n N) div L; impact = w ((10^9 tf) div (1000 tf + 8 m)), in
64-bit integers.

Null and empty texts have no terms: as documents they don't count and are never
found, as items they find nothing.  Every row is a document or an item of its
own, also where rows share an id; rows of equal scores go by ascending id, null
last, and such rows of one id are listed one after another.  Scores are above 0.
An empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import discard, has, over_cells, ship, staged, text_of, tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A-Z to a-z and all that separates terms to a space.
_PLAIN = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Terms that a worker remembers the hashes of.
REMEMBERED = 400_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def item_terms(items: DataFrame, key: str, text: str, once: bool) -> DataFrame:
    """(item, id, term, times): ``item`` numbers the rows of the table."""
    words = F.regexp_extract_all(F.translate(text_of(f"`{text}`"), UPPER, LOWER), F.lit(TERM), 0)
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{key}`").alias("id"), words.alias("words"))
    each = numbered.select("item", "id", F.explode("words").alias("term")).groupBy("item", "id", "term").agg(F.count("*").alias("times"))
    return each.withColumn("times", F.lit(1).cast("long")) if once else each


def term_bits(terms: DataFrame, bits: int) -> bytes:
    """A bit set over the terms' hashes; ``bits`` / 8 bytes, however many terms there are."""
    at = F.pmod(F.xxhash64("term"), F.lit(bits)) + 1
    parts = terms.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    out = bytearray(bits // 8)
    for r in parts.collect():  # at most bits / 32768 rows of 4096 bytes
        part = bytes(r["map"])
        out[(r["bucket"] - 1) * len(part) : r["bucket"] * len(part)] = part
    return bytes(out)


class _Block:
    """Documents of one block; frequencies go by term when it is closed."""

    def __init__(self):
        self.row, self.n, self.at, self.terms, self.tf = [], [], [], [], []

    def add(self, row: int, n: int, held: dict[bytes, int]) -> None:
        self.at += [len(self.row)] * len(held)
        self.row.append(row)
        self.n.append(n)
        self.terms += held
        self.tf += held.values()

    def close(self, keys: pa.Array) -> pa.RecordBatch:
        code = pa.array(self.terms, pa.binary()).dictionary_encode()
        by = code.indices.to_numpy()
        order = np.argsort(by, kind="stable")
        columns = {
            "id": keys.take(pa.array(self.row, pa.int64())),
            "n": pa.array(self.n, pa.int64()),
            "term": code.dictionary.cast(pa.string()),
            "held": pa.array(np.bincount(by, minlength=len(code.dictionary)), pa.int64()),
            "at": pa.array(np.array(self.at, np.int32)[order]),
            "tf": pa.array(np.array(self.tf, np.int64)[order]),
        }
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns.values()], names=list(columns))


def blocks_of(docs: DataFrame, key: str, text: str, held: bytes, rows: int, entries: int) -> DataFrame:
    """Documents in blocks of at most ``rows`` and, but for one that has more alone, ``entries`` frequencies."""
    bits = len(held) * 8
    kind = docs.schema[key].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bool] = {}
        for b in batches:  # a block ends with its batch, where its ids are
            block = _Block()
            for i, t in enumerate(b.column(1).cast(pa.large_binary())):
                terms = terms_of(t.as_py())
                if not terms:
                    continue
                if len(known) > REMEMBERED:
                    known = {}
                some = {}
                for term, tf in Counter(terms).items():
                    hit = known.get(term)
                    if hit is None:
                        at = xxhash.xxh64_intdigest(term, 42)
                        at = (at - (1 << 64) if at >> 63 else at) % bits
                        known[term] = hit = bool(held[at >> 3] >> (at & 7) & 1)
                    if hit:
                        some[term] = tf
                if block.row and (len(block.row) >= rows or len(block.at) + len(some) > entries):
                    yield block.close(b.column(0))
                    block = _Block()
                block.add(i, len(terms), some)
            if block.row:
                yield block.close(b.column(0))

    form = f"id array<{kind}>, n array<long>, term array<string>, held array<long>, at array<int>, tf array<long>"
    return docs.select(F.col(f"`{key}`").alias("id"), text_of(f"`{text}`").alias("text")).mapInArrow(tidy(packed), form)


def lengths(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """m of documents of n terms; in whole numbers of any size."""
    if 90 * int(n.max(initial=0)) * total < 2**63:
        return 10 + 90 * n * total // max(terms, 1)
    return np.array([10 + 90 * int(x) * total // terms for x in n], np.int64)


def _product(total: int, terms: int, top: int, form: T.StructType):
    """The function for one block of items and the blocks of documents that meet it."""
    schema = to_arrow_schema(form)

    def product(docs: pa.Table, items: pa.Table) -> pa.Table:
        if not docs.num_rows or not items.num_rows:
            return schema.empty_table()
        items = items.sort_by("item")
        term = items["term"].combine_chunks().dictionary_encode()
        code, times, w = term.indices.to_numpy(), items["times"].to_numpy(), items["w"].to_numpy()
        item = items["item"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(item)) + 1, len(item)]
        weight = np.zeros(len(term.dictionary), np.int64)
        weight[code] = w
        out = []
        for block in range(docs.num_rows):
            get = lambda c, block=block: docs[c][block].values
            at, tf, n = (get(c).to_numpy(zero_copy_only=False) for c in ("at", "tf", "n"))
            ends = np.cumsum(get("held").to_numpy(zero_copy_only=False))
            here = pc.index_in(term.dictionary, value_set=get("term")).fill_null(-1).to_numpy()  # where the items' terms stand in the block
            own = np.full(len(ends), -1)
            own[here[here >= 0]] = np.flatnonzero(here >= 0)
            of = np.repeat(own, np.diff(ends, prepend=0))  # the items' term of each entry
            impact = np.where(of >= 0, weight[of], 0) * ((1_000_000_000 * tf) // (1000 * tf + 8 * lengths(n, total, terms)[at]))
            for first, last in zip(cuts[:-1], cuts[1:]):
                score = np.zeros(len(n), np.int64)
                for k, often in zip(here[code[first:last]].tolist(), times[first:last].tolist()):
                    if k >= 0:  # merge the term's row; a document stands in it once
                        row = slice(ends[k - 1] if k else 0, ends[k])
                        score[at[row]] += often * impact[row]
                some = np.flatnonzero(score)
                if len(some) > top:
                    some = some[score[some] >= np.partition(score[some], -top)[-top]]
                if not len(some):
                    continue
                ids = get("id").take(pa.array(some))
                best = pc.sort_indices(pa.table({"s": score[some], "id": ids}), sort_keys=[("s", "descending"), ("id", "ascending")], null_placement="at_end")[:top]
                alike = pa.array(np.full(len(best), first))
                out.append(pa.table([items["item"].take(alike), items["id"].take(alike), ids.take(best), pa.array(score[some][best.to_numpy()])], schema=schema))
        return pa.concat_tables(out).combine_chunks() if out else schema.empty_table()

    return product


def rank(docs: DataFrame, items: DataFrame, top: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", once: bool = True, bits: int = 1 << 23, rows: int = 4096, entries: int = 400_000, item_block: int = 256) -> DataFrame:
    """(item_key, rank, key, score): each item's ``top`` documents, rank from 1.

    ``once``: an item counts each of its terms once, else as often as it has it.
    Where ``key`` is named like another column of the result it is called ``found_`` and that.
    """
    has(docs, key, text)
    has(items, item_key, item_text)
    ship(docs.sparkSession)
    asked = staged(item_terms(items, item_key, item_text, once), "items")
    blocks = staged(blocks_of(docs, key, text, term_bits(asked.select("term"), bits), rows, entries).withColumn("block", F.monotonically_increasing_id()), "blocks")
    added = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    n_blocks, total, terms = (x or 0 for x in blocks.agg(F.count("*"), F.sum(F.size("id")), F.sum(added)).first())

    # document frequencies: each block's own counts are added up
    df = blocks.select(F.explode(F.arrays_zip("term", "held")).alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.sum("x.held").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * total + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = staged(asked.join(df.select("term", weight.alias("w")), "term").where("w > 0"), "weighed")  # a term of no document finds nothing

    parts, cells = max(1, -(-weighed.select("item").distinct().count() // item_block)), max(1, n_blocks)
    # cells and parts are long on both sides: Spark hashes an int and a long of one value to different tasks
    part = F.pmod(F.xxhash64("item"), F.lit(parts)).cast("long")
    left = over_cells(blocks.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("long")), parts, "part")
    right = over_cells(weighed.withColumn("part", part), cells, "cell")
    form = T.StructType([T.StructField("item", T.LongType()), T.StructField("id", items.schema[item_key].dataType), T.StructField("doc", docs.schema[key].dataType), T.StructField("score", T.LongType())])
    found = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(_product(total, terms, top, form), form)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    name = f"found_{key}" if key.lower() in (item_key.lower(), "rank", "score") else key
    out = staged(best.select(F.col("id").alias(item_key), "rank", F.col("doc").alias(name), "score"), "ranked")
    discard(asked, blocks, weighed)
    return out


#: The same rows from DuckDB.
ORACLE = """
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'TERM') AS words FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, words, len(words) AS n FROM lowered WHERE len(words) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(words) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'TERM')) AS term FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)),
w AS (SELECT q, item_id, term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM i JOIN df USING (term), total),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score FROM w JOIN tf USING (term), total GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
""".replace("TERM", TERM)
