"""Operator 7: nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one of each codebook.
The books are fitted to residuals on a bounded sample of rows (``sample``); the
codes of every row come from a beam search over the books, which keeps the best
partial sums.  A query makes one table of inner products with all codewords; the
guess of a row's score is the sum of its codes' entries.  About ``pool`` rows of
the whole table that are guessed best are scored first by the exact measure on
the original vectors, then all that the codes can't rule out.

Queries go against all rows, block by block.  A block's rows of best guess give a
query a score that ``top`` of its answers reach; a code's error, kept as the norm
of what it leaves of its vector, bounds how far a score may lie above its guess.
Every row that may reach that score is rescored from its original vector, so no
neighbour is lost however the vectors lie; rows that can't are never rescored.
Each block sends one row a query, with its ``top`` best.

Equal vectors are coded once: a distinct vector carries its ``top + 1`` smallest
ids, which is all that any answer can need.  Vectors that are null, zero, hold
null or non-finite components, or are of another length than most, take no part,
nor do rows with a null id.  Repeated rows of one id and vector count once; an id
with several vectors asks with each, and its best score counts either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import discard, has, ship, staged, tidy


class Books:
    """Codebooks, fitted by k-means on the residuals that the books before leave."""

    def __init__(self, books: int, words: int, beam: int):
        self.n, self.words, self.beam = books, words, beam
        self.book = np.empty(0, np.float32)

    def fit(self, x: np.ndarray, rounds: int = 12, seed: int = 7) -> Books:
        rng = np.random.default_rng(seed)
        left, out = x.astype(np.float32), []
        for _ in range(self.n):
            k = min(self.words, len(left))
            c = left[rng.choice(len(left), k, replace=False)].copy()
            for _ in range(rounds):
                at = nearest(left, c)
                total = one_hot(at, k).T @ left
                n = np.bincount(at, minlength=k)
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], left[rng.integers(0, len(left), k)])
            out.append(np.pad(c, ((0, self.words - k), (0, 0))))
            left = left - c[nearest(left, c)]
        self.book = np.stack(out).astype(np.float32)
        self.refit(x)
        return self

    def refit(self, x: np.ndarray, rounds: int = 2) -> None:
        """Least squares of all codewords together, given the beam search's codes."""
        m, k, d = self.book.shape
        for _ in range(rounds):
            codes = self.encode(x)[0].astype(np.int64) + k * np.arange(m)
            gram, right = np.zeros((m * k, m * k), np.float64), np.zeros((m * k, d), np.float64)
            for a in range(0, len(x), 2048):
                held = np.zeros((len(codes[a : a + 2048]), m * k), np.float32)
                np.put_along_axis(held, codes[a : a + 2048], 1, axis=1)
                gram += held.T @ held
                right += held.T @ x[a : a + 2048]
            lam = 0.05 * np.eye(m * k)
            old = self.book.reshape(m * k, d).astype(np.float64)
            self.book = np.linalg.solve(gram + lam, right + lam @ old).reshape(m, k, d).astype(np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, norms of the coded sums): the beam keeps the partial sums nearest to x."""
        m, k, d = self.book.shape
        codes, norms = np.empty((len(x), m), np.uint8), np.empty(len(x), np.float32)
        for a in range(0, len(x), 256):
            y = x[a : a + 256].astype(np.float32)
            n = len(y)
            left, path = y[:, None, :], np.empty((n, 1, 0), np.uint8)
            for c in self.book:
                b = left.shape[1]
                err = (left**2).sum(2)[:, :, None] - 2 * (left.reshape(-1, d) @ c.T).reshape(n, b, k) + (c**2).sum(1)
                flat = err.reshape(n, -1)
                keep = min(self.beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                row = np.arange(n)[:, None]
                order = np.argsort(flat[row, best], axis=1, kind="stable")
                best = best[row, order]
                from_, word = best // k, best % k
                left = left[row, from_] - c[word]
                path = np.concatenate([path[row, from_], word[:, :, None].astype(np.uint8)], axis=2)
            codes[a : a + n] = path[:, 0]
            norms[a : a + n] = ((y - left[:, 0]) ** 2).sum(1)
        return codes, norms

    def left(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Norms of what the coded sums leave of x, in double precision."""
        total = np.zeros(x.shape)
        for c, at in zip(self.book, codes.T):
            total += c[at]
        return np.linalg.norm(x - total, axis=1)

    def slack(self) -> float:
        """How far single precision may move a guess, for a query of norm 1."""
        m, _, d = self.book.shape
        return 4 * (m + d) * 2.0**-23 * float(np.linalg.norm(self.book.astype(np.float64), axis=2).max(1).sum())

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(query, book, word): inner products with all codewords."""
        return np.einsum("qd,mkd->qmk", q.astype(np.float32), self.book)


def one_hot(at: np.ndarray, k: int) -> np.ndarray:
    return (at[:, None] == np.arange(k)).astype(np.float32)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + 4096] @ c.T - half, axis=1) for a in range(0, len(x), 4096)])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows that take part, with the most common length only."""
    v = F.col(f"`{vector}`")
    finite = F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v"), finite.alias("ok")).where("ok and id is not null").select("id", "v")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size[0] if size else 0))


def search(vectors: DataFrame, every: int = 20, top: int = 20, key: str = "vec_id", vector: str = "embedding", books: int = 32, words: int = 64, beam: int = 8, sample: int = 12_000, pool: int = 400, block: int = 16_384, query_block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``top`` rows of largest inner product.

    Queries: ids divisible by ``every``; candidates: every row of another id.
    Ties go to the smaller id.  The books are fitted on at most ``sample``
    distinct vectors, chosen by hash; every row is indexed.
    """
    has(vectors, key, vector)
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, key, vector)

    # distinct vectors with their smallest ids; each task keeps no more than it needs ahead of the shuffle
    part = rows.select("v", "id", F.spark_partition_id().alias("p")).distinct()
    near = part.withColumn("r", F.row_number().over(W.partitionBy("v", "p").orderBy("id"))).where(F.col("r") <= top + 1)
    merged = near.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list("id"))), 1, top + 1).alias("ids"))
    distinct = staged(merged.select(F.xxhash64("v").alias("h"), "v", "ids"), "distinct")
    asked = staged(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v").distinct().withColumn("ask", F.xxhash64("query_id", "v")), "asked")

    picked = distinct.orderBy("h").limit(sample).select("v").toPandas()["v"]
    form = "query_id long, rank int, vec_id long, score double"
    if not len(picked):
        return spark.createDataFrame([], form)
    fitted = Books(books, words, beam).fit(np.array(picked.tolist(), np.float32))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"))
            codes = fitted.encode(x.astype(np.float32))[0]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("v"), b.column("ids"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(fitted.left(x, codes))], names=["h", "v", "ids", "code", "left"])

    block = min(block, max(256, (1 << 21) // len(picked[0])))  # a task holds its block's vectors
    n_blocks, n_query = -(-distinct.count() // block), max(1, -(-asked.count() // query_block))
    share = pool / n_blocks
    keep = min(pool, int(share + 4 * share**0.5) + 8)
    kind = distinct.schema["v"].dataType.simpleString()
    index = staged(distinct.mapInArrow(tidy(coded), f"h long, v {kind}, ids array<long>, code binary, left double"), "index")
    # each block of codes meets each block of queries in one task
    left = index.select("v", "ids", "code", "left", F.pmod("h", F.lit(n_blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("qb"))
    right = asked.select("query_id", "v", F.pmod("ask", F.lit(n_query)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"))
    found_form = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def scanned(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return found_form.empty_table()
        c = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1).T.copy()
        held = Block(_matrix(rows["v"].combine_chunks()), c, rows["left"].to_numpy(), rows["ids"].combine_chunks())
        q, who = _matrix(asks["v"].combine_chunks()), asks["query_id"].to_numpy()
        found = [x for a in range(0, len(q), 64) for x in held.nearest(fitted, q[a : a + 64], who[a : a + 64], top, keep)]
        return pa.table([asks["query_id"].combine_chunks(), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.float64()))], schema=found_form)

    def merged_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [best_of(ids.values.to_numpy(), s.values.to_numpy(), top) for ids, s in zip(b.column("ids"), b.column("scores"))]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array([x[0] for x in best], pa.list_(pa.int64())), pa.array([x[1] for x in best], pa.list_(pa.float64()))], schema=found_form)

    form_of = "query_id long, ids array<long>, scores array<double>"
    found = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInArrow(scanned, form_of)
    each = found.groupBy("query_id").agg(F.collect_list(F.struct("ids", "scores")).alias("x")).select("query_id", F.flatten(F.col("x.ids")).alias("ids"), F.flatten(F.col("x.scores")).alias("scores"))
    best = each.mapInArrow(tidy(merged_blocks), form_of).select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "x"))
    ranked = best.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    out = staged(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(index, distinct, asked)
    return out


class Block:
    """A block's vectors with their codes (book, row), what these leave of them, and their ids."""

    def __init__(self, x: np.ndarray, codes: np.ndarray, left: np.ndarray, ids: pa.ListArray):
        self.x, self.codes, self.left = x, codes, left
        self.ids, size = ids.flatten().to_numpy(), ids.value_lengths().to_numpy().astype(np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        # so many vectors of the block at most hold one id
        self.shared = int(np.unique(self.ids, return_counts=True)[1].max())
        self.norm = float(np.linalg.norm(x, axis=1).max())

    def nearest(self, books: Books, q: np.ndarray, who: np.ndarray, top: int, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the ``top`` best ids of the block for each query, but its own."""
        n = len(self.x)
        need = min(n, (top + 1) * self.shared)  # vectors that hold ``top`` ids besides the query's
        keep = min(n, max(keep, need))
        with np.errstate(all="ignore"):
            t, size = books.tables(q), np.linalg.norm(q, axis=1)[:, None]
            guess = np.zeros((len(q), n), np.float32)
            for m in range(len(self.codes)):
                guess += t[:, m, :][:, self.codes[m]]
            first = np.argpartition(-guess, keep - 1, axis=1)[:, :keep]
            reached = np.array([np.partition(self.x[at] @ y, keep - need)[keep - need] for at, y in zip(first, q)])[:, None]
            # the bound, and what rounding may add to either side; what compares with nothing stays in
            close = 8 * self.x.shape[1] * 2.0**-52 * size * self.norm
            may = ~(guess + size * (self.left + books.slack()) < reached - close)
            rows = np.flatnonzero(may.any(0))
            score = np.where(may[:, rows], q @ self.x[rows].T, -np.inf)
            low = np.partition(score, len(rows) - need, axis=1)[:, len(rows) - need, None] - close
            some = ~(score < low) & may[:, rows]
        for i, y in enumerate(q):
            at = rows[some[i]]
            exact = (self.x[at] * y).cumsum(axis=1)[:, -1]  # added up in order, as a plain loop would
            size = self.ends[at] - self.starts[at]
            ids = self.ids[np.repeat(self.starts[at] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
            others = ids != who[i]
            yield best_of(ids[others], np.repeat(exact, size)[others], top)


def best_of(ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` best distinct ids, ties by the smaller one, each with its best score."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:top]
    return ids[first], scores[first]


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix in double precision."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


#: The same rows from DuckDB by brute force, for tables whose vectors all take part.
ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
