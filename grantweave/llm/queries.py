"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import align, decontam, fm_dedup, id_files, jaccard, lang_id, mixing, mtree, pii, suffix_dedup, tokens, url_tree, word_runs
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages together, so that markup, address and host evidence take part."""
    return lang_id.corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where a page's markup, address suffix and host add evidence to its text."""
    return lang_id.pages(table(spark, sf_dir, "pages"), lang_id.fit(table(spark, sf_dir, "documents")))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.over_budget(table(spark, sf_dir, "documents"))


def op6_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_tree.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digest(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.run_digest(table(spark, sf_dir, "documents"))


def op13_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.id_digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_ngram_jaccard, op3_language_id, pages_language_id, op4_personal_data, op5_token_counts, op6_mtree_top_k, op7_suffix_array_dedup, op8_url_filter, op9_substring_dedup, op10_source_mixing, op11_tokenizer_alignment, op12_periodic_runs, op13_token_id_files)}

SQL = {
    "op2_ngram_jaccard": jaccard.sql(),
    "op6_mtree_top_k": mtree.sql(),
    "op7_suffix_array_dedup": suffix_dedup.sql(),
    "op8_url_filter": url_tree.sql(),
    "op9_substring_dedup": fm_dedup.sql(),
    "op12_periodic_runs": word_runs.sql(),
}
