"""Thin queries over the operators of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import avi, codes, crf, knn, lloyd, mix, pii, quotes, radix, rtree, shard, whiten
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.bpe_digests(table(spark, sf_dir, "documents"), bpe.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken")), tokenizer_pattern())


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_documents(table(spark, sf_dir, "documents"))


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn_join(table(spark, sf_dir, "embeddings"))


def op3_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.repeat_digests(table(spark, sf_dir, "documents"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.quote_links(table(spark, sf_dir, "conversations"))


def quoting_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op5 over conversations that do quote: each message with what quotes.QUOTING_SQL adds to it."""
    return quotes.quote_links(quotes.quoting(table(spark, sf_dir, "conversations")))


def op6_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_digests(table(spark, sf_dir, "documents"))


def op9_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.near_duplicates(table(spark, sf_dir, "documents"))


def op10_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"))


def op11_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster_digests(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_voronoi_knn": op2_voronoi_knn,
    "op3_suffix_radix": op3_suffix_radix,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quotation_linking": op5_quotation_linking,
    "quoting_conversations": quoting_conversations,
    "op6_boosted_pii": op6_boosted_pii,
    "op7_line_crf": op7_line_crf,
    "op8_motion_jpeg": op8_motion_jpeg,
    "op9_count_rtree": op9_count_rtree,
    "op10_extendible_sharding": op10_extendible_sharding,
    "op11_rotated_codes": op11_rotated_codes,
    "op12_lobpcg_whitening": op12_lobpcg_whitening,
    "op13_delta_lloyd": op13_delta_lloyd,
}

ORACLE: dict[str, str] = {
    "op1_pareto_mix": mix.MIX_SQL,
    "op2_voronoi_knn": knn.KNN_SQL,
    "op5_quotation_linking": quotes.QUOTES_SQL,
    "quoting_conversations": quotes.QUOTING_SQL,
    "op10_extendible_sharding": shard.SHARD_SQL,
    "op11_rotated_codes": codes.CODES_SQL,
    "op13_delta_lloyd": lloyd.CLUSTER_SQL,
}
