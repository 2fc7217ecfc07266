"""The queries of this subpackage over the given tables, and the SQL that must agree where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import html_text, id_files, language, neighbours, packing, pieces, pitman_yor, prefix_trie, quality, similar_texts, toxicity, url_rules, vector_codes
from lectern.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(table(spark, sf_dir, "documents"))


SQL["op3_quality_rules"] = quality.quality_sql()


@_query
def op4_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.id_file_rows(table(spark, sf_dir, "documents"))


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@_query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_rows(table(spark, sf_dir, "documents"))


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts.similarity_classes(table(spark, sf_dir, "documents"))


SQL["op2_ngram_jaccard_join"] = similar_texts.similarity_sql()


@_query
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query
def op5_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.model_rows(table(spark, sf_dir, "documents"))


@_query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_rows(table(spark, sf_dir, "documents"))


@_query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.given_rules(spark))


SQL["op13_url_filter"] = url_rules.rules_sql()


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_rows(table(spark, sf_dir, "embeddings"))


SQL["op12_vector_codes"] = vector_codes.codes_sql()


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_rows(table(spark, sf_dir, "conversations"))


SQL["op11_prefix_trie"] = prefix_trie.trie_sql()
