"""The corpus pipeline: documents from filtering to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
that the stage before it kept.  All stages but the last return the columns of
``documents``:

1. toxicity: documents that the classifier predicts toxic go.
2. near_duplicates: of each group of documents whose sets of five-word shingles
   have a Jaccard similarity of 0.8 or more the one with the smallest doc_id stays;
   SimHash's byte-position index finds the pairs.
3. repeated_passages: bytes that a repeated 200-byte string covers are cut from
   the texts (whole characters only); documents stay, if need be with empty text.
4. decontamination: documents that leak a benchmark item go.
5. packing: documents become pieces of sequences of 1024 tokens.

Filters decide by row, also where rows share a doc_id; near_duplicates keeps all
rows with a null doc_id.  Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import decontaminate, packing, simhash, substrings, toxicity
from traceloom.llm.queries import vocabulary
from traceloom.llm.shared import read, ship, staged, text_of, unused


def named(docs: DataFrame) -> list:
    """The columns of ``docs``, whatever their names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones, doesn't predict toxic."""
    ship(spark)
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(model)(text_of("text")) < 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: of those with the smallest doc_id that with the least text hash."""
    # a doc_id may stand on rows with different texts, which are in groups of their own
    row = unused(docs, "row")
    rows = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64(text_of("text")).alias("text"))))
    found = simhash.similar(rows.select(row, "text"), key=row, words=5, similarity=0.8)
    gone = found.where(F.col(row) != F.col("component_id")).select(row).distinct()
    # rows that repeat a doc_id and text are rare; only they are brought together to keep one
    again = staged(found.where(F.col(row) == F.col("component_id")).groupBy(row).count().where("count > 1").select(row), "again")
    single = rows.join(staged(gone.unionByName(again), "gone"), row, "left_anti")
    first = rows.join(again, row, "left_semi").dropDuplicates([row])
    return single.unionByName(first).select(*named(docs))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what other texts, or they themselves, repeat; n_chars follows."""
    cut = substrings.without_repeated(docs, length=200)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item."""
    row = unused(docs, "row")
    rows = docs.withColumn(row, F.sha2(text_of("text").cast("binary"), 256))
    leaked = staged(decontaminate.leaks(rows.select(row, "text"), read(spark, sf_dir, "benchmark"), key=row).select(row).distinct(), "leaked")
    return rows.join(leaked, row, "left_anti").select(*named(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), 1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
