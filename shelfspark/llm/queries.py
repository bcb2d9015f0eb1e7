"""The registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchor_codes, chosen_path, embedding_dedup, exact_dedup, exact_topk, importance_resampling, line_dedup, mixture, pii, quality_pu, sentencepiece_codec, toxicity, url_filter
from .common import table

TOKENIZER = "piece_bpe_32k.model"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_pages(table(spark, sf_dir, "pages"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.jaccard_join(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(docs, public_tokenizers.path(TOKENIZER)))


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_anchor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_embedding_dedup, op3_exact_topk, op4_line_dedup, op5_ngram_jaccard_join, op6_pii, op7_sentencepiece, op8_quality_pu, op9_toxicity, op10_mixture, op11_exact_dedup, op12_anchor_codes, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": exact_topk.ORACLE_SQL, "op1_url_filters": url_filter.ORACLE_SQL, "op4_line_dedup": line_dedup.ORACLE_SQL,
        "op11_exact_dedup": exact_dedup.ORACLE_SQL, "op12_anchor_codes": anchor_codes.ORACLE_SQL, "op13_importance_resampling": importance_resampling.ORACLE_SQL}
