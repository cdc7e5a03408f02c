"""The registered queries of the ten operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, negatives, neighbours, packing, quality, search, simhash, substrings, tokens, toxicity, urls, warc
from .shared import read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=4, limit=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 1024)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), every=20, top=20)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048, keep=["doc_id"])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated(read(spark, sf_dir, "documents"), length=200)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"), url="url")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), every=100, positives=5, top=10, low=30, high=90, label=label, scale=256)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), top=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1,
        "op2_url_filter": op2,
        "op3_simhash": op3,
        "op4_packing": op4,
        "op5_quality": op5,
        "op6_toxicity": op6,
        "op7_neighbours": op7,
        "op8_token_counts": op8,
        "op9_substrings": op9,
        "op10_warc": op10,
        "op11_hard_negatives": op11,
        "op12_licenses": op12,
        "op13_search": op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": urls.oracle_sql(), "op7_neighbours": neighbours.ORACLE, "op9_substrings": substrings.ORACLE, "op10_warc": warc.ORACLE, "op11_hard_negatives": negatives.ORACLE, "op12_licenses": licenses.oracle_sql(), "op13_search": search.ORACLE}
