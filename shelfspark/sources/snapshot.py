"""Sources and sinks of the catalog: raw snapshots, inventories, cases, offers, catalog tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contract import UUID_V4


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). Only a local session may leave
    it unset and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _located(df: DataFrame, path: str = "path") -> DataFrame:
    key = F.regexp_extract(path, "([^/]+)\\.json$", 1)
    return df.withColumn("category", F.regexp_extract(path, "([^/]+)/[^/]+$", 1)).withColumn("upstream_key", F.when(F.regexp_like(key, F.lit(UUID_V4)), key))


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file: (category, file, upstream_key, raw)."""
    raw = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return _located(raw).select("category", F.col("path").alias("file"), "upstream_key", F.col("value").alias("raw"))


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line, the category in the folder name."""
    return spark.read.text(path).select("category", F.col("value").alias("raw"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths alone, whether or not the files parse."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


def inventory(paths: DataFrame) -> DataFrame:
    """(category, file, upstream_key): presence; the key is null where the name is none."""
    return _located(paths).select("category", F.col("path").alias("file"), "upstream_key")


def parse_json(raw: DataFrame, max_bytes: int) -> DataFrame:
    """``raw`` with ``doc`` (variant) and ``status``: ok, raw_size_limit or invalid_json."""
    doc = F.try_parse_json("raw")
    status = F.when(F.octet_length("raw") > max_bytes, "raw_size_limit").when(doc.isNull(), "invalid_json").otherwise("ok")
    return raw.withColumn("doc", doc).withColumn("status", status)


def unmodeled_paths(raw: DataFrame, modeled: list[str]) -> DataFrame:
    """Per category, how often each top-level field occurs that is not modeled."""
    keys = raw.select("category", F.explode(F.json_object_keys("raw")).alias("path"))
    return keys.filter(~F.col("path").isin(modeled)).groupBy("category", "path").agg(F.count("*").alias("n"))


def write_catalog(parts: dict[str, DataFrame], path: str) -> None:
    """Fan out the catalog's tables, partitioned by category."""
    for name, df in parts.items():
        df.write.mode("overwrite").partitionBy("category").parquet(f"{path}/{name}")


def labelled_cases(cases: DataFrame, labels: DataFrame, overrides: DataFrame) -> DataFrame:
    """Cases with their labels (every case needs one) and overrides by id."""
    out = cases.join(labels, "case_id", "left").join(overrides.withColumnRenamed("expected", "__over"), "case_id", "left")
    full = F.when(F.assert_true(F.col("class").isNotNull(), F.lit("a case has no label")).isNull(), F.col("class"))
    return out.select("case_id", full.alias("class"), F.coalesce("__over", "expected").alias("expected"))


def explode_hits(responses: DataFrame, hit_schema: str) -> DataFrame:
    """Marketplace responses (response_id, body) as one row per hit."""
    parsed = responses.select("response_id", F.from_json("body", f"hits array<struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in hit_schema.split(','))}>>").alias("b"))
    return parsed.select("response_id", F.inline("b.hits"))
