"""Streaming jobs over the given tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sync as S
from ..streaming import jobs as J
from .base import Catalog, query


def _events(c: Catalog) -> DataFrame:
    e = J.table_stream(c.spark, c.sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("class"), F.col("value").alias("cost"))


@query("SELECT date_trunc('hour', ts) AS start, class, count(*) AS requests, round(sum(cost), 4) AS cost, max(cost) AS largest FROM v_events GROUP BY 1, 2")
def stream_request_metrics(c: Catalog) -> DataFrame:
    return J.latest_updates(J.request_metrics(_events(c)), "start", "class").withColumn("cost", F.round("cost", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT date_trunc('hour', ts) AS start, class, count(*) AS n, greatest(0, count(*) - 5) AS excess FROM v_events GROUP BY 1, 2")
def stream_budget_excess(c: Catalog) -> DataFrame:
    return J.latest_updates(J.budget_excess(_events(c), 5), "start", "class").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH n AS (SELECT product_id, 1 + offer_id % 2 AS epoch, observed_at, price, row_number() OVER (PARTITION BY product_id ORDER BY offer_id % 2 DESC, observed_at DESC, offer_id DESC) AS nth FROM v_offers), w AS (SELECT max(observed_at) - INTERVAL 10 MINUTE AS mark FROM v_offers)
    SELECT product_id, epoch, CASE WHEN observed_at + INTERVAL 60 DAY > mark THEN 'complete' ELSE 'pending' END AS status, CASE WHEN observed_at + INTERVAL 60 DAY > mark THEN price END AS lowest_price FROM n, w WHERE nth = 1"""
)
def stream_offer_summary(c: Catalog) -> DataFrame:
    lines = J.table_stream(c.spark, c.sf_dir, "lineitem")
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("long")
    offers = lines.select(F.col("l_partkey").alias("product_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("offer_id"), price.alias("price"), F.col("l_shipdate").cast("timestamp").alias("observed_at"))
    offers = offers.withColumn("epoch", 1 + F.col("offer_id") % 2)
    return J.latest_updates(J.offer_summary(offers), "product_id").select("product_id", "epoch", "status", "lowest_price")


@query("SELECT upstream_key, name, CASE WHEN p % 17 <> 0 AND p % 7 = 0 THEN price + 1 ELSE price END AS price, CASE WHEN p % 17 <> 0 THEN 1 ELSE 0 END AS version FROM (SELECT *, CAST(substr(upstream_key, 2) AS BIGINT) AS p FROM v_snapshot_a)")
def stream_ingest(c: Catalog) -> DataFrame:
    k = F.col("p_partkey")
    new = J.table_stream(c.spark, c.sf_dir, "part").filter(k % 17 != 0)
    new = new.select(F.concat(F.lit("K"), k.cast("string")).alias("upstream_key"), F.col("p_name").alias("name"), F.when(k % 7 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")).alias("price"), F.lit(1).alias("version"))
    store = c.snapshot_a.select("upstream_key", "name", "price", F.lit(0).alias("version"))
    return J.ingest(new, store, "upstream_key", lambda old, batch: S.upsert(old, batch, ["upstream_key"], "version"))
