"""Offers and price summaries over the order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import offers as O
from .base import Catalog, query

_CHECK = "(10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({0}, CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(substr({0}, 13, 1) AS INT)"


@query(
    f"""WITH ids AS (SELECT product_id, value_key AS code, 1 AS t, 1 AS r, 1 AS o FROM v_identifiers WHERE type = 'ean' UNION ALL SELECT product_id, '49' || lpad(CAST(product_id * 3 AS VARCHAR), 11, '0'), 0, CASE WHEN product_id % 2 = 0 THEN 0 ELSE 1 END, 0 FROM v_products WHERE product_id % 2 = 0),
    k AS (SELECT product_id, code, min(t * 100 + r * 10 + o) AS p FROM ids WHERE {_CHECK.format('code')} GROUP BY 1, 2)
    SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY p, code) AS rank, code FROM k QUALIFY rank <= 3"""
)
def lookup_candidates(c: Catalog) -> DataFrame:
    up = c.identifiers.filter("type = 'ean'").select("product_id", "type", "value_key", F.lit("all").alias("region"), "origin")
    jan = c.products.filter("product_id % 2 = 0").select("product_id", F.lit("jan").alias("type"), F.concat(F.lit("49"), F.lpad((F.col("product_id") * 3).cast("string"), 11, "0")).alias("value_key"), F.lit("jp").alias("region"), F.lit("local").alias("origin"))
    return O.lookup_candidates(up.unionByName(jan))


@query(
    """WITH h AS (SELECT offer_id, product_id, seller_id, price, in_stock, condition, offer_id // 8 AS response_id FROM v_offers)
    SELECT offer_id, product_id, price FROM h WHERE product_id % 5 <> 0 AND in_stock AND condition = 'new' AND response_id NOT IN (SELECT response_id FROM h WHERE price <= 905)"""
)
def normalize_offers(c: Catalog) -> DataFrame:
    h = c.offers.select("offer_id", "product_id", "seller_id", F.when(F.col("price") > 905, F.col("price")).alias("price"), "in_stock", "condition", F.expr("offer_id div 8").alias("response_id"))
    h = h.withColumn("code", F.col("product_id")).withColumn("asked", F.when(F.col("product_id") % 5 != 0, F.col("product_id")))
    return O.normalize(h).select("offer_id", "product_id", "price")


@query("SELECT product_id, seller_id, offer_id, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id, seller_id ORDER BY price, offer_id) AS nth FROM v_offers) WHERE nth = 1")
def dedupe_offers(c: Catalog) -> DataFrame:
    return O.dedupe(c.offers, ["product_id", "seller_id"]).select("product_id", "seller_id", "offer_id", "price")


@query("SELECT seller_id, CASE WHEN seller_id % 3 = 0 THEN s_name END AS shop, count(*) AS n FROM v_offers o JOIN supplier s ON s_suppkey = seller_id GROUP BY 1, 2")
def tag_sellers(c: Catalog) -> DataFrame:
    shops = c.supplier.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("shop"))
    return O.tag_sellers(c.offers, shops).groupBy("seller_id", "shop").agg(F.count("*").alias("n"))


@query(
    """WITH per AS (SELECT product_id, seller_id AS code, count(*) FILTER (WHERE in_stock AND price > 2500) AS n, min(observed_at) AS f, row_number() OVER (PARTITION BY product_id ORDER BY seller_id) AS rank FROM v_offers GROUP BY 1, 2),
    t AS (SELECT *, min(f) OVER (PARTITION BY product_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS fresh FROM per WHERE rank <= 3)
    SELECT product_id, min_by(code, rank) AS code, min_by(n, rank) AS n, CAST(min_by(fresh, rank) AS TIMESTAMP) AS fetched_at FROM t WHERE n > 0 GROUP BY 1"""
)
def first_nonempty_candidate(c: Catalog) -> DataFrame:
    from pyspark.sql import Window

    o = c.offers.select("product_id", F.col("seller_id").alias("code"), (F.col("in_stock") & (F.col("price") > 2500)).alias("keep"), F.col("observed_at").alias("fetched_at"))
    codes = o.select("product_id", "code").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("product_id").orderBy("code"))).filter("rank <= 3")
    return O.first_nonempty(codes, o)


@query(
    """SELECT product_id, CASE WHEN product_id % 10 = 9 THEN 'unsupported' WHEN n IS NULL THEN 'empty' ELSE 'complete' END AS status, CASE WHEN product_id % 10 <> 9 THEN low END AS lowest_price, CASE WHEN product_id % 10 <> 9 THEN coalesce(n, 0) ELSE 0 END AS offer_count
    FROM v_products p LEFT JOIN (SELECT product_id AS pid, min(price) AS low, count(*) AS n FROM v_offers WHERE in_stock AND condition = 'new' AND price < 1500 GROUP BY 1) o ON o.pid = p.product_id"""
)
def offer_summary(c: Catalog) -> DataFrame:
    products = c.products.select("product_id", (F.col("product_id") % 10 != 9).alias("supported"))
    return O.summary(products, c.offers.filter("in_stock AND condition = 'new' AND price < 1500"))


@query(
    """SELECT product_id, observed_at, price FROM (SELECT o.product_id, observed_at, price, row_number() OVER (PARTITION BY o.product_id ORDER BY observed_at DESC, offer_id DESC) AS nth FROM v_offers o JOIN v_products p ON p.product_id = o.product_id AND active = 1) WHERE nth = 1"""
)
def upsert_summary(c: Catalog) -> DataFrame:
    s = c.offers.select("product_id", "observed_at", F.col("offer_id").alias("fetched_at"), "price")
    return O.newest(s, c.products).select("product_id", "observed_at", "price")


@query(
    """WITH asked AS (SELECT o_orderkey AS pos, o_custkey * 3 AS product_id, o_orderdate AS at, 1 + o_orderkey % 2 AS epoch, CASE WHEN o_orderkey % 5 = 0 THEN 'g2' ELSE 'g1' END AS generation FROM orders),
    kept AS (SELECT product_id, 1 + offer_id % 2 AS epoch, CASE WHEN offer_id % 3 = 0 THEN 'g2' ELSE 'g1' END AS generation, observed_at, observed_at - INTERVAL 1 MINUTE AS fetched_at, CASE offer_id % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'unsupported' ELSE 'complete' END AS status,
        CASE WHEN offer_id % 7 > 1 THEN price END AS lowest_price, CASE WHEN offer_id % 7 > 1 THEN offer_id % 8 ELSE 0 END AS offer_count FROM v_offers),
    ranked AS (SELECT pos, k.* EXCLUDE (product_id, epoch, generation), row_number() OVER (PARTITION BY pos ORDER BY k.observed_at DESC, fetched_at DESC, status DESC, lowest_price DESC NULLS LAST, offer_count DESC) AS nth
        FROM asked a JOIN kept k ON k.product_id = a.product_id AND k.epoch = a.epoch AND k.generation = a.generation AND k.observed_at <= a.at AND a.at < k.observed_at + INTERVAL 400 DAY)
    SELECT a.pos, a.product_id, CASE WHEN p.product_id IS NULL THEN 'missing' ELSE coalesce(r.status, 'pending') END AS status, CASE WHEN p.product_id IS NOT NULL THEN lowest_price END AS lowest_price, CASE WHEN p.product_id IS NOT NULL THEN offer_count END AS offer_count,
        CASE WHEN p.product_id IS NOT NULL THEN fetched_at END AS fetched_at FROM asked a LEFT JOIN v_products p ON p.product_id = a.product_id AND active = 1 LEFT JOIN ranked r ON r.pos = a.pos AND nth = 1"""
)
def lookup_summaries(c: Catalog) -> DataFrame:
    pos, offer = F.col("o_orderkey"), F.col("offer_id")
    asked = c.orders.select(pos.alias("pos"), (F.col("o_custkey") * 3).alias("product_id"), F.col("o_orderdate").cast("timestamp").alias("asked_at"), (1 + pos % 2).alias("epoch"), F.when(pos % 5 == 0, "g2").otherwise("g1").alias("generation"))
    seen = F.col("observed_at").cast("timestamp")
    status = F.when(offer % 7 == 0, "empty").when(offer % 7 == 1, "unsupported").otherwise("complete")
    kept = c.offers.select(
        "product_id", (1 + offer % 2).alias("epoch"), F.when(offer % 3 == 0, "g2").otherwise("g1").alias("generation"), seen.alias("observed_at"), (seen - F.expr("INTERVAL 1 MINUTE")).alias("fetched_at"),
        (seen + F.expr("INTERVAL 400 DAYS")).alias("expires_at"), status.alias("status"), F.when(offer % 7 > 1, F.col("price")).alias("lowest_price"), F.when(offer % 7 > 1, offer % 8).otherwise(0).alias("offer_count"),
    )
    found = O.lookup(asked, c.products, kept)
    return found.withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))
