"""Operator 10: WARC archives and boundary-chain verification.

Writing: a record per page.  Of pages with equal payloads of at least
``smallest`` bytes the one with the largest key is a response and the others
are revisits that refer to it.  Records are text and are written by Spark's text
writer, whose commit survives lost tasks; an archive is a part file.

Reading: archives are split at the magic ``WARC/1.0`` + CRLF by Spark's
splittable text reader, so that no archive is held whole.  The splits are
numbered and written once, since another scan may cut and number them otherwise
when executors come or go.  Each split is a candidate record: its offset in the
file, and the successor offset that its header's length gives.  Payloads may
hold the magic too; only candidates that the chain from the file's start reaches
are records.  Pointer jumping finds them in two steps.  Within the range of a
file that was read as one block, tasks jump to where the chain leaves the range;
across ranges, tables of these exits are jumped from the file's start, so that
rounds grow with the logarithm of a file's ranges.  Then each range marks what
is reached from where the chain enters it.  The bytes between a record's offset
and its successor are its own, magic inside included.

Null payloads are empty.  Pages with a null key are written and read with it.
Repeated rows are records each: of those that share payload and largest key all
are responses.  Line ends in URLs are written percent-encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import _remove, discard, has, shared_path, ship, staged

CRLF = "\r\n"
MAGIC = "WARC/1.0" + CRLF
#: What follows every record.
END = CRLF + CRLF


def with_types(pages: DataFrame, key: str = "page_id", payload: str = "html", smallest: int = 1000, url: str | None = None) -> DataFrame:
    """(key, url, payload, payload_bytes, payload_digest, record_type, refers_to); url is null without a column of that name."""
    has(pages, key, payload, *([url] if url else []))
    link = F.regexp_replace(F.regexp_replace(F.col(f"`{url}`").cast("string"), "\r", "%0D"), "\n", "%0A") if url else F.lit(None).cast("string")
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    base = pages.select(F.col(f"`{key}`").cast("long").alias("key"), link.alias("url"), body.alias("payload")).select(
        "key", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1(F.col("payload").cast("binary")).alias("payload_digest")
    )
    light = base.where(F.col("payload_bytes") >= smallest).select("key", "payload_bytes", "payload_digest")
    last = light.groupBy("payload_bytes", "payload_digest").agg(F.max("key").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    last = staged(last, "copied")  # a table of its own, so that the join can split a hot payload
    revisit = F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last"))
    return base.join(last, ["payload_bytes", "payload_digest"], "left").select(
        "key", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("last")).alias("refers_to"),
    )


def record_text(date: str = "2024-01-01T00:00:00Z") -> Column:
    """A record, without the two line ends after it, from the columns of with_types."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.col("record_type"),
        F.lit(f"{CRLF}WARC-Record-ID: "), name(F.col("key")),
        F.lit(f"{CRLF}WARC-Date: {date}"),
        F.coalesce(F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), F.col("url")), F.lit("")),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit(f"{CRLF}WARC-Payload-Digest: "), digest,
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )


def write_warc(typed: DataFrame, path: str, records_per_file: int = 4096) -> None:
    """Write the rows of with_types as archives below ``path``."""
    typed.select(record_text().alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _splits(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, i, value): what follows each magic, numbered in the order of each block of a file."""
    at = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return spark.read.option("lineSep", MAGIC).text(path).select(*at, F.monotonically_increasing_id().alias("i"), "value")


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """The splits as a table; it has all contents, so it is packed tighter than others."""
    return staged(_splits(spark, path), "raw", compression="zstd")


def _parts(value: Column) -> list[Column]:
    """(head, block) of a whole record's text; the two line ends after it are not its own."""
    cut = F.instr(value, END)
    return [F.substring(value, F.lit(1), cut + 1), F.substring(value, cut + 4, F.greatest(F.length(value) - cut - 7, F.lit(0)))]


def _as_it_is(head: Column, block: Column) -> list[Column]:
    return [head.alias("head"), block.alias("block")]


def read_warc(spark: SparkSession, path: str, wanted: Callable[[Column, Column], list[Column]] = _as_it_is) -> DataFrame:
    """(file, offset, ...): the verified records of the archives below ``path``.

    ``wanted`` makes columns of a record's header and its content, magic inside
    included; by default it gives both as head and block.  They are made where
    the splits are scanned, so that contents move only if they are wanted.
    """
    return _records(_raw(spark, path), wanted)


def _records(raw: DataFrame, wanted: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """read_warc of the staged splits of all archives."""
    magic = len(MAGIC)
    cut = F.instr("value", END)
    head = F.when(cut > 0, F.expr(f"substring(value, 1, instr(value, '{CRLF}{CRLF}') + 1)")).otherwise(F.col("value"))
    sized = raw.select("file", "block", "i", F.octet_length("value").cast("long").alias("n"), head.alias("head"), (cut > 0).alias("whole"))
    length = F.expr("try_cast(nullif(regexp_extract(head, '(?i)(?:^|\\r\\n)Content-Length: *([0-9]+) *\\r\\n', 1), '') as bigint)")
    light = staged(sized.select("file", "block", "i", "n", F.when(F.col("whole"), F.octet_length("head") + 2 + length).alias("takes")), "splits")
    # offsets: sums of sizes within a block of the file, then over the blocks ahead
    blocks = light.groupBy("file", "block").agg(F.sum(F.col("n") + magic).alias("all"))
    ahead = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("base"))
    inner = W.partitionBy("file", "block").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    placed = light.withColumn("off", F.coalesce(F.sum(F.col("n") + magic).over(inner), F.lit(0))).join(blocks, ["file", "block"])
    # a split's text starts at base + off; its magic ends there; the file's first split, ahead of any magic, is empty
    start = F.col("base") + F.col("off") - magic
    cand = staged(placed.select("file", "block", "i", start.alias("at"), (start + magic + F.col("takes") + len(END)).alias("next")).where("at >= 0"), "candidates")
    discard(light)
    marked = staged(chain(cand), "marked")
    discard(cand)
    # a split that is no record belongs to the record ahead of it, maybe of a range ahead
    last = marked.groupBy("file", "block").agg(F.max("offset").alias("last"))
    before = staged(last.select("file", "block", F.last("last", True).over(ahead).alias("before")), "before")
    owned = marked.join(before, ["file", "block"]).select("file", "i", "at", F.coalesce("offset", "before").alias("offset")).where("offset is not null")
    several_parts = owned.groupBy("file", "offset").agg(F.count("*").alias("n_parts")).where("n_parts > 1").drop("n_parts")
    several_parts = staged(several_parts, "several")
    owned = staged(owned.join(several_parts.withColumn("more", F.lit(True)), ["file", "offset"], "left").withColumn("n_parts", F.when(F.col("more"), 2).otherwise(1)).drop("more"), "owned")
    discard(marked, before, several_parts)
    alone = owned.where("n_parts = 1").select("file", "i", "offset")
    split = staged(owned.where("n_parts > 1").select("file", "i", "at", "offset"), "split")  # a table of its own: mostly small
    single = raw.select("file", "i", *wanted(*_parts(F.col("value")))).join(alone, ["file", "i"]).drop("i")
    several = raw.select("file", "i", "value").join(split, ["file", "i"]).groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    several = several.select("file", "offset", F.concat_ws(MAGIC, F.col("p.value")).alias("value")).select("file", "offset", *wanted(*_parts(F.col("value"))))
    return single.unionByName(several)


def _steps(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each candidate of a range, in order of offsets, the place of its successor there; its own if that is elsewhere or none."""
    to = np.searchsorted(at, after)
    here = np.arange(len(at))
    inside = (to < len(at)) & (at[np.minimum(to, len(at) - 1)] == after) & (to > here)
    return np.where(inside, to, here)


def _exits(t: pa.Table) -> pa.Table:
    """(file, at, next): where the chain from each candidate of a range leaves the range."""
    t = t.sort_by("at")
    at, after = t["at"].to_numpy(), t["next"].fill_null(-1).to_numpy()
    to = _steps(at, after)
    while not np.array_equal(far := to[to], to):
        to = far
    # a chain that breaks off leads nowhere
    out = np.where(after[to] > at[-1], after[to], -1) if len(at) else at
    keep = out >= 0
    return pa.table({"file": t["file"].filter(pa.array(keep)), "at": pa.array(at[keep]), "next": pa.array(out[keep])})


def _marked(t: pa.Table) -> pa.Table:
    """(file, block, i, at, offset): of each split the record of its range that it belongs to, null ahead of the first."""
    t = t.sort_by("at")
    at, entry = t["at"].to_numpy(), t["entry"][0].as_py()
    first = int(np.searchsorted(at, entry)) if entry is not None else len(at)
    reached = np.zeros(len(at), bool)
    if first < len(at):
        to = _steps(at, t["next"].fill_null(-1).to_numpy())
        reached[first] = True
        while True:
            more = reached.copy()
            more[to[reached]] = True
            if (more == reached).all():
                break
            reached, to = more, to[to]
    own = np.maximum.accumulate(np.where(reached, np.arange(len(at)), -1))
    offset = pa.array(at[np.maximum(own, 0)], mask=own < 0)
    return pa.table({"file": t["file"], "block": t["block"], "i": t["i"], "at": pa.array(at), "offset": offset})


def chain(cand: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(file, block, i, at, offset): ``cand`` with the record that each belongs to within its range, by the chain from each file's start.

    ``cand`` has (file, block, i, at, next); a range is a block of a file, and no
    longer than Spark reads as one.
    """
    ship(cand.sparkSession)
    exits = staged(cand.select("file", "block", "at", "next").groupBy("file", "block").applyInArrow(_exits, "file string, at long, next long"), "exits")
    # only where chains enter a range
    enter = exits.select("file", F.col("next").alias("at")).distinct()
    heads = staged(cand.select("file", "block", "at").where("at = 0").unionByName(cand.select("file", "block", "at").where("at > 0").join(enter, ["file", "at"], "left_semi")), "heads")
    entries = staged(reached(heads, exits.join(heads.select("file", "at"), ["file", "at"], "left_semi"), max_rounds), "entries")
    # a range is entered once; a table of its own for the join
    first = staged(heads.join(entries, ["file", "at"], "left_semi").groupBy("file", "block").agg(F.min("at").alias("entry")), "first")
    discard(exits, heads, entries)
    return cand.join(first, ["file", "block"], "left").groupBy("file", "block").applyInArrow(_marked, "file string, block long, i long, at long, offset long")


def reached(heads: DataFrame, exits: DataFrame, max_rounds: int) -> DataFrame:
    """(file, at) of the heads that exits lead to from each file's start.

    Round k knows what is within 2^k exits of the start and pointers of 2^k
    exits; it follows those from all it knows, and then doubles the pointers.
    """
    known = heads.where("at = 0").select("file", "at")
    jump = exits.select("file", "at", "next").join(heads.select("file", F.col("at").alias("next")), ["file", "next"], "left_semi").select("file", "at", "next")
    n, before = known.count(), None
    for _ in range(max_rounds):
        jump = staged(jump, "jump")
        found = known.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        more = staged(known.union(found).distinct(), "reached")
        now = more.count()
        discard(known, *([before] if before is not None else []))
        if now == n:
            discard(jump)
            return more
        known, n, before = more, now, jump
        jump = jump.join(jump.select("file", F.col("at").alias("next"), F.col("next").alias("far")), ["file", "next"]).select("file", "at", F.col("far").alias("next"))
    raise RuntimeError("the chain is longer than its rounds")


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", smallest: int = 1000, url: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, read them back, and report each record.

    (key, payload_bytes, payload_digest, record_type, refers_to): bytes and
    digest of a response are of the payload as read; a revisit has them from the
    response that it refers to.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(with_types(pages, key, payload, smallest, url), path)

    def wanted(head: Column, block: Column) -> list[Column]:
        number = lambda name: F.regexp_extract(head, rf"(?i)\r\n{name}: <urn:page:(-?[0-9]+)>", 1).try_cast("long")
        body = F.substring(block, F.instr(block, END) + 4, F.length(block))
        return [
            number("WARC-Record-ID").alias(key),
            F.regexp_extract(head, r"(?i)(?:^|\r\n)WARC-Type: ([a-z]+)", 1).alias("record_type"),
            number("WARC-Refers-To").alias("refers_to"),
            F.regexp_extract(head, r"(?i)\r\nWARC-Payload-Digest: sha1:([0-9a-f]+)", 1).alias("says"),
            F.octet_length(body).cast("long").alias("n"),
            F.sha1(body.cast("binary")).alias("d"),
        ]

    raw = _raw(spark, path)
    _remove(spark, path)
    rows = staged(_records(raw, wanted).drop("file", "offset"), "records")
    discard(raw)
    if (found := rows.count()) != (written := pages.count()):
        raise RuntimeError(f"{written} pages were written as records, but {found} records were read back")
    of = rows.where("record_type = 'response'").select(F.col(key).alias("refers_to"), F.col("d").alias("says"), F.col("n").alias("rn"), F.col("d").alias("rd"))
    wanted = rows.where("record_type = 'revisit'").select("refers_to", "says").distinct()
    of = staged(of.join(wanted, ["refers_to", "says"], "left_semi").distinct(), "originals")
    out = rows.join(of, ["refers_to", "says"], "left")
    return out.select(key, F.coalesce("rn", "n").alias("payload_bytes"), F.coalesce("rd", "d").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH a AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
b AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) ELSE page_id END AS last FROM a)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to FROM b
"""
