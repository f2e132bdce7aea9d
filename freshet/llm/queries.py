"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freshet.llm import best_fit, byte_bpe, collocations, cross_entropy, extendible, fourier_quality, line_frequency, lsh_forest, prefix_trie, quotations, secret_scan, simple8b, warc
from freshet.llm.common import table


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.line_frequency(table(spark, sf_dir, "documents"))


def op2_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.read_ids(spark, simple8b.write_ids(table(spark, sf_dir, "documents")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op4_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_groups(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(secret_scan.labelled_samples(docs)))


def op6_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    target = table(spark, sf_dir, "labels").where("quality = 1")
    return cross_entropy.differences(docs, target)


def op7_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(table(spark, sf_dir, "conversations"))


def op8_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.exact_groups(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"))


def op10_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fourier_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_line_frequency": op1_line_frequency,
    "op2_simple8b_ids": op2_simple8b_ids,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_lsh_forest_join": op4_lsh_forest_join,
    "op5_markov_secrets": op5_markov_secrets,
    "op6_cross_entropy": op6_cross_entropy,
    "op7_quotation_links": op7_quotation_links,
    "op8_extendible_dedup": op8_extendible_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_fourier_quality": op10_fourier_quality,
    "op11_warc_archives": op11_warc_archives,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op1_line_frequency": line_frequency.ORACLE,
    "op7_quotation_links": quotations.ORACLE,
    "op8_extendible_dedup": extendible.ORACLE,
    "op11_warc_archives": warc.ORACLE,
    "op12_phrase_collocations": collocations.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
