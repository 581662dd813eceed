"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import cross_polytope, language_id, line_dedup, near_dup, packing, quality_rules, sentencepiece_bpe, suffix_dedup, url_rules, warc_zstd
from tessera.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rules.mine(pages, table(spark, sf_dir, "labels")))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return cross_polytope.search(rows.where("vec_id % 20 = 0"), rows)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.round_trip(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs.select("doc_id", "text"), model).drop("text")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_cross_polytope": op2_cross_polytope,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_suffix_array": op6_suffix_array,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_near_dup": op10_near_dup,
}
ORACLE_SQL: dict[str, str] = {"op3_warc": warc_zstd.ORACLE_SQL, "op10_near_dup": near_dup.ORACLE_SQL}
