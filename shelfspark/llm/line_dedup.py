"""Line deduplication by distinct-site spread.

A line's key is a 128-bit hash of the trimmed, lower-cased line. Sites per key are counted by HyperLogLog
sketches that merge in a distributed aggregation; keys whose estimate lies near the threshold get
exact distinct counts. A key on ``min_sites`` sites or more is cross-site boilerplate: one
occurrence stays (that of the smallest doc_id, first in its text), all others go.

Defined cases: null text stays null and has no lines; lines shorter than ``min_chars`` never
count; a null site is a site of its own; rows that repeat a doc_id count as one document; other
columns stay as they are; an empty table gives an empty table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_keys


def _clean(line: Column) -> Column:
    return F.lower(F.trim(line))


def _key(line: Column, min_chars: int) -> Column:
    clean = _clean(line)
    return F.when(F.length(clean) >= min_chars, F.struct(*row_keys(clean)))


def _lines(docs: DataFrame, text: str, site: str, min_chars: int) -> DataFrame:
    line = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col(site)), F.lit("")).alias("site"), F.explode(F.split(text, "\n")).alias("line"))
    return line.select("doc_id", "site", _key(F.col("line"), min_chars).alias("key")).filter("key is not null")


def boilerplate_lines(docs: DataFrame, min_sites: int = 5, min_chars: int = 16, text: str = "text", site: str = "source", lg_k: int = 12, band: float = 0.25) -> DataFrame:
    """(key, first_doc) of the lines that stand on ``min_sites`` sites or more. ``band``: how far
    from the threshold, as a share of it, an estimate still asks for an exact count; it is over ten
    times the sketch's standard error (1.04 / sqrt(2 ** lg_k))."""
    lines = _lines(docs, text, site, min_chars)
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("first_doc"))
    spread = materialize(spread.select("key", "first_doc", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - band)))
    near = spread.filter(F.col("sites") <= min_sites * (1 + band))
    exact = lines.join(near.select("key"), "key", "left_semi").select("key", "site").distinct().groupBy("key").agg(F.count("*").alias("exact_sites")).filter(F.col("exact_sites") >= min_sites)
    clear = spread.filter(F.col("sites") > min_sites * (1 + band)).select("key", "first_doc")
    return materialize(clear.unionByName(near.join(exact, "key").select("key", "first_doc")))


def line_dedup(docs: DataFrame, min_sites: int = 5, min_chars: int = 16, text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` with the text cleaned, plus ``n_lines`` and ``n_removed``."""
    common = boilerplate_lines(docs, min_sites, min_chars, text, site)
    hit = _lines(docs, text, site, min_chars).select("doc_id", "key").join(common, "key")
    per = hit.groupBy("doc_id").agg(
        F.collect_set(F.when(~F.col("doc_id").eqNullSafe(F.col("first_doc")), F.col("key"))).alias("__drop"),
        F.collect_set(F.when(F.col("doc_id").eqNullSafe(F.col("first_doc")), F.col("key"))).alias("__own"),
    )
    per = materialize(per).withColumnRenamed("doc_id", "__id")
    # the lists grow with the documents, so the join is by shuffle at every size
    out = docs.join(per.hint("merge"), docs.doc_id.eqNullSafe(F.col("__id")), "left").drop("__id")
    lines = F.split(text, "\n")
    keys = F.transform(lines, lambda x: _key(x, min_chars))
    hit_doc = F.col("__drop").isNotNull()
    keys = F.when(hit_doc & (F.size("__own") > 0), keys)

    def keep(x: Column, i: Column) -> Column:
        key = _key(x, min_chars)
        again = F.coalesce(F.array_contains("__own", key), F.lit(False)) & (F.array_position("__keys", key) != i + 1)
        return ~(F.coalesce(F.array_contains("__drop", key), F.lit(False)) | F.coalesce(again, F.lit(False)))

    out = out.withColumn("__keys", keys)
    left = F.when(hit_doc, F.filter(lines, keep)).otherwise(lines)
    out = out.withColumn("__left", left).withColumn("n_lines", F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", (F.col("n_lines") - F.coalesce(F.when(F.col(text).isNotNull(), F.size("__left")), F.lit(0))).cast("long"))
    out = out.withColumn(text, F.when(hit_doc, F.array_join("__left", "\n")).otherwise(F.col(text)))
    return out.select(*docs.columns, "n_lines", "n_removed")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The pipeline's form: cleaned rows with the columns of ``docs``; a row of which only blank
    lines are left after removals goes."""
    out = line_dedup(docs, **options)
    gone = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", "\\s+", "")) == "")
    out = out.filter(~gone)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


ORACLE_SQL = """
WITH docs AS (SELECT doc_id, text, coalesce('s' || source, '') AS site FROM documents),
lines AS (
  SELECT doc_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs
), keyed AS (
  SELECT *, CASE WHEN length(lower(trim(line))) >= 16 THEN lower(trim(line)) END AS k FROM lines
), common AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT site) >= 5
), placed AS (
  SELECT keyed.*, first_doc, row_number() OVER (PARTITION BY keyed.doc_id, keyed.k ORDER BY pos) AS nth
  FROM keyed LEFT JOIN common ON keyed.k = common.k
), kept AS (
  SELECT doc_id, pos, line, (first_doc IS NULL OR (first_doc = doc_id AND nth = 1)) AS stays FROM placed
)
SELECT docs.doc_id, count(kept.pos) AS n_lines, count(kept.pos) FILTER (WHERE NOT stays) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS text_sha256
FROM docs LEFT JOIN kept ON docs.doc_id = kept.doc_id
GROUP BY docs.doc_id
"""
