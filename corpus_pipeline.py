"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the
next one's input. Toxic documents go, cross-site boilerplate lines go, one document of each
near-duplicate group stays, sources are mixed to their target weights (a document taken twice
stands twice), and the rest is encoded by SentencePiece."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import chosen_path, line_dedup, mixture, sentencepiece_codec, toxicity
from shelfspark.llm.common import shared_dir, table
from shelfspark.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.remix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = sentencepiece_codec.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return sentencepiece_codec.digests(coded)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: Several stages learn or sample; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{n}")
        docs = spark.read.parquet(f"{at}/{n}")
    return docs
