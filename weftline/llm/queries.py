"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, gam, hilbert, html_text, importance, langid, licences, lloyd, mcd, rp_forest, simhash, temperature_mix, token_files
from ..sources.tables import spread
from ._shared import read_table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(spread(read_table(spark, sf_dir, "documents")), path, public_tokenizers.PATTERN)


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(read_table(spark, sf_dir, "documents"))


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each time that the budget takes a document, by source, epoch and block."""
    mixed = temperature_mix.mix(read_table(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "source", "__tokens AS n_tokens", "__epoch AS epoch", "__block AS block", "__turn AS turn")


def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd.quality_rules(spread(read_table(spark, sf_dir, "documents")))


def op6_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.score_quality(spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "labels"))


def op7_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spread(read_table(spark, sf_dir, "pages")))


def op8_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.link_vectors(read_table(spark, sf_dir, "embeddings"))


def op9_unigram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spread(read_table(spark, sf_dir, "documents")), public_tokenizers.path("piece_bpe_32k.model"))


def op10_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    parts = token_files.write_sequences(read_table(spark, sf_dir, "documents"), path)
    return token_files.read_documents(spark, parts)


def op11_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(read_table(spark, sf_dir, "embeddings"))


def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_licence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_hilbert_shards,
        op3_temperature_mix,
        op4_simhash_pivots,
        op5_mcd_outliers,
        op6_gam_quality,
        op7_html_tree_scoring,
        op8_rp_forest,
        op9_unigram_langid,
        op10_arrow_sequences,
        op11_weighted_lloyd,
        op12_importance_draw,
        op13_licence_index,
    )
}
# The first ten have no oracle: checksums, seeded hashes, learned models and
# iterated closures aren't to be had in SQL.  tests/llm holds each against a
# brute-force version, a round trip or held-out rows instead.
ORACLES: dict[str, str] = {"op11_weighted_lloyd": lloyd.oracle_sql(), "op12_importance_draw": importance.oracle_sql()}
