"""Operator 11: hard negatives by a two-dimensional block matrix product.

The scores of all anchors against all rows are one matrix product, done in tiles
in the manner of SUMMA: rows and anchors are sharded by hash into blocks, and
their vectors into chunks of dimensions.  A task multiplies the same chunk of a
block of anchors and a block of rows to a tile of partial int64 scores; partial
tiles are shuffled and added, in stripes of a few anchors; of each sum a stripe
keeps the best rows an anchor (or an anchor and positive) needs, and the last
step keeps the best of all stripes.

That is done twice.  First for positives: only rows of the anchor's label can be
any, so blocks are of rows whose labels hash alike, and a label of more rows than
a block has several blocks of rows and of anchors.  Then for negatives, over all
rows: by then each anchor carries the windows of its positives, so that a stripe
picks negatives at once and no tile is stored.  No block grows with the table;
the number of tiles does, as anchors times rows.

Components become floor(``scale`` * x) in double precision; all else is 64-bit
integer and exact.  Order is by score, highest first, then by id.

Rows with a null id, label or vector, with null or non-finite components, or
with a vector of another length than most rows, take no part, nor do rows with a
component so large that a score might not fit 64 bits (beyond 1.48 million for
64 dimensions).  Of rows that share an id the one with the smallest label, then
vector, takes part, so repeated rows count once.  Vectors of zeros take part.
Empty tables give no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import discard, has, over_cells, ship, staged


def whole_vectors(vectors: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, v): rows that take part, one an id, with whole components."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), label.alias("label"), v.alias("v"), finite.alias("ok")).where("ok and id is not null and label is not null and v is not null")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = size[0] if size else 0
    most = int((2**63 / max(size, 1)) ** 0.5) - 1
    rows = rows.where((F.size("v") == size) & ~F.exists("v", lambda x: F.abs(x * scale) >= most))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row"))
    return one.select("id", "row.label", F.transform("row.v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in int64; by doubles where these are exact."""
    top = lambda x: int(np.abs(x).max(initial=0))
    if top(a) * top(b) * max(a.shape[1], 1) < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _tiles(anchors: DataFrame, rows: DataFrame, chunk: int, stripe: int, dims: int) -> DataFrame:
    """Partial tiles of blocks that share ``ab`` and ``rb``: a row a stripe of anchors and chunk of dimensions.

    The first chunk's tiles also carry what belongs to the anchors and rows.
    """
    chunks = max(1, -(-dims // chunk))
    cut = lambda t: over_cells(t, chunks, "k").withColumn("v", F.slice("v", F.col("k") * chunk + 1, chunk))
    own = [f for f in anchors.schema if f.name not in ("ab", "rb", "v")]
    other = [f for f in rows.schema if f.name not in ("ab", "rb", "v")]
    form = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("ab", "rb", "stripe")]
        + [T.StructField("part", T.BinaryType())]
        + [T.StructField(f"a_{f.name}", T.ArrayType(f.dataType)) for f in own]
        + [T.StructField(f"b_{f.name}", T.ArrayType(f.dataType)) for f in other]
    )
    schema = to_arrow_schema(form)
    rows = rows.toDF(*rows.columns)  # columns of its own: both sides come of one table

    def lists(table: pa.Table, name: str, cuts: list[int], kind: pa.DataType, head: bool) -> pa.Array:
        if not head:
            return pa.nulls(len(cuts) - 1, kind)
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), table[name].combine_chunks()).cast(kind)

    def multiplied(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        a, b = a.sort_by("id"), b.sort_by("id")
        part, head = product(_matrix(a["v"]), _matrix(b["v"])), a["k"][0].as_py() == 0
        cuts = [*range(0, len(a), stripe), len(a)]
        n = len(cuts) - 1
        columns = [pa.array([a[c][0].as_py()] * n, pa.int64()) for c in ("ab", "rb")]
        columns += [pa.array(range(n), pa.int64()), pa.array([part[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())]
        columns += [lists(a, f.name, cuts, schema.field(f"a_{f.name}").type, head) for f in own]
        for f in other:
            kind = schema.field(f"b_{f.name}").type
            columns.append(pa.concat_arrays([lists(b, f.name, [0, len(b)], kind, head)] * n))
        return pa.table(columns, schema=schema)

    return cut(anchors).groupBy("ab", "rb", "k").cogroup(cut(rows).groupBy("ab", "rb", "k")).applyInArrow(multiplied, form)


class Tile:
    """The sum of a stripe's partial tiles: scores of a few anchors and a block of rows, both by id."""

    def __init__(self, parts: pa.Table):
        self.score = sum(np.frombuffer(x.as_py(), np.int64) for x in parts["part"])
        head = parts.filter(parts["a_id"].is_valid()).slice(0, 1).combine_chunks()
        self.get = lambda name: head[name].combine_chunks().flatten()
        self.anchor, self.row = (self.get(n).to_numpy() for n in ("a_id", "b_id"))
        code = pa.concat_arrays([self.get("a_label"), self.get("b_label")]).dictionary_encode().indices.to_numpy()
        self.anchor_label, self.row_label = code[: len(self.anchor)], code[len(self.anchor) :]
        self.score = self.score.reshape(len(self.anchor), len(self.row))

    def positives(self, top: int) -> list[np.ndarray]:
        """Columns anchor, id, score: the best other rows of each anchor's label."""
        out = []
        for anchor, label, score in zip(self.anchor, self.anchor_label, self.score):
            some = np.flatnonzero((self.row_label == label) & (self.row != anchor))
            best = some[np.argsort(-score[some], kind="stable")[:top]]
            out.append((np.full(len(best), anchor), self.row[best], score[best]))
        return [np.concatenate(x) for x in zip(*out)]

    def negatives(self, top: int, low: int, high: int) -> list[np.ndarray]:
        """Columns anchor, positive, its score, negative, its score: the best rows in each positive's window."""
        out = [[np.empty(0, np.int64)] * 5]
        for anchor, label, score, ids, scores in zip(self.anchor, self.anchor_label, self.score, self.get("a_positive"), self.get("a_score")):
            # low * positive <= 100 * negative <= high * positive, in whole numbers of any size
            windows = [(i, s, -(-low * s // 100), high * s // 100) for i, s in zip(ids.as_py(), scores.as_py())]
            least, most = min(w[2] for w in windows), max(w[3] for w in windows)
            some = np.flatnonzero((self.row_label != label) & (score >= least) & (score <= most))
            some = some[np.argsort(-score[some], kind="stable")]
            down = -score[some]
            for i, s, lo, hi in windows:
                if lo > hi:
                    continue
                at = np.searchsorted(down, -hi, "left")
                best = some[at : min(at + top, np.searchsorted(down, -lo, "right"))]
                out.append([np.full(len(best), anchor), np.full(len(best), i), np.full(len(best), s), self.row[best], score[best]])
        return [np.concatenate(x) for x in zip(*out)]


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, top: int = 10, low: int = 30, high: int = 90, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: int = 256, chunk: int = 32, block: int = 4096, anchor_block: int = 512, stripe: int = 64) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; their positives are
    their ``positives`` best other rows of the same label; of each positive the
    ``top`` best rows of other labels whose score is between ``low`` and ``high``
    per cent of the positive's are given, ``rank`` from 1.  ``label`` may be an
    expression over the table.
    """
    has(vectors, key, vector, *([label] if isinstance(label, str) else []))
    ship(vectors.sparkSession)
    rows = staged(whole_vectors(vectors, key, vector, F.col(f"`{label}`") if isinstance(label, str) else label, scale), "vectors")
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    anchor = F.col("id") % every == 0
    dims, parts = dims or 0, lambda count, size: F.greatest(F.lit(1), F.ceil(count / size))

    # positives: blocks of rows whose labels hash alike
    pile = F.pmod(F.xxhash64("label"), F.lit(max(1, -(-n // block))))
    piled = rows.withColumn("pile", pile)
    sizes = piled.groupBy("pile").agg(parts(F.count("*"), block).alias("n_rb"), parts(F.count(F.when(anchor, 1)), anchor_block).alias("n_ab"), F.count(F.when(anchor, 1)).alias("anchors")).where("anchors > 0").drop("anchors")
    piled = piled.join(sizes, "pile")
    name = lambda which: F.col("pile") * (1 << 31) + which
    of = lambda count: F.pmod(F.xxhash64("id"), F.col(count))
    left = over_cells(piled.where(anchor).withColumn("ab", name(of("n_ab"))), F.col("n_rb"), "rb").withColumn("rb", name(F.col("rb")))
    right = over_cells(piled.withColumn("rb", name(of("n_rb"))), F.col("n_ab"), "ab").withColumn("ab", name(F.col("ab")))
    columns = ["ab", "rb", "id", "label", "v"]
    tiles = _tiles(left.select(*columns), right.select(*columns), chunk, stripe, dims)

    def best_positives(parts: pa.Table) -> pa.Table:
        return pa.table(Tile(parts).positives(positives), names=["id", "positive", "score"])

    each = tiles.groupBy("ab", "rb", "stripe").applyInArrow(best_positives, "id long, positive long, score long")
    order = W.partitionBy("id").orderBy(F.desc("score"), "positive")
    each = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
    found = staged(each.groupBy("id").agg(F.collect_list(F.struct("positive", "score")).alias("x")).select("id", F.col("x.positive").alias("positive"), F.col("x.score").alias("score")), "positives")

    # negatives: all rows, with each anchor's windows
    n_ab, n_rb = max(1, -(-found.count() // anchor_block)), max(1, -(-n // block))
    left = rows.where(anchor).join(found, "id").withColumn("ab", F.pmod(F.xxhash64("id"), F.lit(n_ab)))
    right = rows.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(n_rb)))
    tiles = _tiles(over_cells(left, n_rb, "rb"), over_cells(right, n_ab, "ab"), chunk, stripe, dims)
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def best_negatives(parts: pa.Table) -> pa.Table:
        return pa.table(Tile(parts).negatives(top, low, high), names=names)

    each = tiles.groupBy("ab", "rb", "stripe").applyInArrow(best_negatives, ", ".join(f"{c} long" for c in names))
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    best = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = staged(best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(rows, found)
    return out


#: The same rows from DuckDB by brute force, for tables whose rows all take part.
ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
