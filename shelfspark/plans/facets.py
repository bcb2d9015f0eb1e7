"""Predicates, requests, facets and filter metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import facet_bits
from ..operators import filters as P
from ..operators.equal import leaders, spread
from .base import Catalog, query


def _requests(c: Catalog) -> DataFrame:
    """A table of requests derived from the suppliers: each asks for a brand or a word, and sizes."""
    s = F.col("s_suppkey")
    cond = lambda field, value, low, high: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    null = F.lit(None)
    category = F.element_at(F.array(*[F.lit(x) for x in ("economy", "small", "medium", "large", "promo", "standard")]), (s % 6 + 1).cast("int"))
    ranged = cond("size_mm", null, s % 30, s % 30 + 15)
    first = F.when(s % 3 == 0, cond("manufacturer", F.concat(F.lit("Brand#"), (s % 25 + 1).cast("string")), null, null)).otherwise(cond("word", F.element_at(F.array(F.lit("red"), F.lit("blue"), F.lit("small")), (s % 3 + 1).cast("int")), null, null))
    return c.supplier.select(s.alias("request_id"), category.alias("category"), F.array(ranged, first).alias("conditions"))


def _values(c: Catalog) -> DataFrame:
    p = c.products.filter("active = 1")
    base = p.select("product_id", "category", F.lit("manufacturer").alias("field"), F.col("manufacturer").alias("value"), F.lit(None).cast("double").alias("number"))
    spec = c.spec.join(p.select("product_id", "category"), "product_id").select("product_id", "category", F.lit("size_mm").alias("field"), F.col("size_mm").cast("string").alias("value"), F.col("size_mm").cast("double").alias("number"))
    facet = c.facets.join(p.select("product_id", "category"), "product_id").select("product_id", "category", F.col("attribute").alias("field"), "value", F.lit(None).cast("double").alias("number"))
    return base.unionByName(spec).unionByName(facet)


_ASKED = [f"Brand#{i}" for i in range(1, 16)]


@query(
    f"""SELECT p.product_id, name, manufacturer, size_mm, price FROM v_products p JOIN v_spec s ON p.product_id = s.product_id
    WHERE category = 'small' AND active = 1 AND manufacturer IN {tuple(_ASKED)} AND size_mm BETWEEN 5 AND 45
    AND EXISTS (SELECT 1 FROM v_facets f WHERE f.product_id = p.product_id AND attribute = 'word' AND value IN ('red', 'blue', 'small', 'green'))
    ORDER BY manufacturer, CASE WHEN series IS NULL OR series = '' THEN 1 ELSE 0 END, lower(coalesce(series, '')), lower(name), p.product_id LIMIT 20"""
)
def filter_search(c: Catalog) -> DataFrame:
    """Category, typed filter, range and facet, display-ordered first page."""
    rows = P.scope(c.products, "small").join(c.spec, "product_id")
    rows = rows.filter(P.select_values(F.col("manufacturer"), _ASKED) & P.within(F.col("size_mm"), 5, 45))
    rows = P.has_facets(rows, c.facets, {"word": ["red", "blue", "small", "green"]})
    return rows.orderBy(*C.display_keys()).limit(20).select("product_id", "name", "manufacturer", "size_mm", "price")


@query("SELECT product_id, name FROM v_products WHERE category = 'medium' AND active = 1")
def filter_scope(c: Catalog) -> DataFrame:
    return P.scope(c.products, "medium").select("product_id", "name")


@query("SELECT product_id FROM v_products WHERE manufacturer IN ('Brand#2', 'Brand#7') AND category IN ('large', 'promo')")
def filter_select(c: Catalog) -> DataFrame:
    ok = P.select_values(F.col("manufacturer"), ["Brand#2", "Brand#7"]) & P.select_values(F.col("category"), ["large", "promo"])
    return c.products.filter(ok).select("product_id")


@query("SELECT product_id, size_mm FROM v_spec WHERE size_mm >= 10 AND size_mm <= 20 AND price >= 950")
def filter_range(c: Catalog) -> DataFrame:
    return c.spec.filter(P.within(F.col("size_mm"), 10, 20) & P.within(F.col("price"), low=950)).select("product_id", "size_mm")


@query(
    """SELECT product_id FROM v_products p WHERE EXISTS (SELECT 1 FROM v_facets f WHERE f.product_id = p.product_id AND attribute = 'word' AND value IN ('red', 'green'))
    AND EXISTS (SELECT 1 FROM v_facets f WHERE f.product_id = p.product_id AND attribute = 'size_band' AND value IN ('1', '2'))"""
)
def filter_facet(c: Catalog) -> DataFrame:
    return P.has_facets(c.products, c.facets, {"word": ["red", "green"], "size_band": ["1", "2"]}).select("product_id")


@query("SELECT DISTINCT product_id FROM v_identifiers WHERE value_key = 'BRAND#2-11' AND type = 'mpn'")
def filter_identifier(c: Catalog) -> DataFrame:
    return P.has_identifier(c.products, c.identifiers, "BRAND#2-11", "mpn").select("product_id")


@query("SELECT p.product_id, s.price AS price, p.manufacturer, s.size_mm FROM v_products p JOIN v_spec s ON p.product_id = s.product_id")
def field_precedence(c: Catalog) -> DataFrame:
    products = c.products.withColumn("price", F.lit(-1.0))
    return P.resolve_fields(c.spec, products, ["price", "manufacturer", "size_mm"])


_REQUESTS_SQL = """r AS (SELECT s_suppkey AS request_id, ['economy', 'small', 'medium', 'large', 'promo', 'standard'][s_suppkey % 6 + 1] AS category, s_suppkey % 30 AS low, s_suppkey % 30 + 15 AS high,
    CASE WHEN s_suppkey % 3 = 0 THEN 'Brand#' || (s_suppkey % 25 + 1) END AS brand, CASE WHEN s_suppkey % 3 <> 0 THEN ['red', 'blue', 'small'][s_suppkey % 3 + 1] END AS word FROM supplier)"""


@query(
    f"""WITH {_REQUESTS_SQL} SELECT request_id, p.product_id FROM r JOIN v_products p ON p.category = r.category AND active = 1 JOIN v_spec s ON s.product_id = p.product_id
    WHERE size_mm BETWEEN low AND high AND (brand IS NULL OR manufacturer = brand) AND (word IS NULL OR EXISTS (SELECT 1 FROM v_facets f WHERE f.product_id = p.product_id AND attribute = 'word' AND value = word))"""
)
def filter_requests(c: Catalog) -> DataFrame:
    first, members = leaders(_requests(c), ["category", "conditions"], "request_id")
    return spread(P.request_hits(_values(c), first), members, "request_id")


@query(
    """SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 7 = 0 THEN 'range_order' WHEN s_suppkey % 5 = 0 THEN 'values' ELSE 'ok' END AS code FROM supplier"""
)
def request_limits(c: Catalog) -> DataFrame:
    s = F.col("s_suppkey")
    value = lambda i: F.struct(F.lit("manufacturer").alias("field"), i.cast("string").alias("value"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    many = F.transform(F.sequence(F.lit(1), F.when(s % 5 == 0, 12).otherwise(3)), value)
    ranged = F.array(F.struct(F.lit("size_mm").alias("field"), F.lit(None).cast("string").alias("value"), F.when(s % 7 == 0, 9.0).otherwise(1.0).alias("low"), F.lit(5.0).alias("high")))
    return P.request_code(c.supplier.select(s.alias("request_id"), F.concat(many, ranged).alias("conditions")))


@query(
    """SELECT product_id FROM v_products WHERE lower(manufacturer) = 'brand#3' AND contains(lower(name), 'r') AND (contains(lower(name), 'bolt') OR contains(lower(name), 'ring'))
    AND list_contains(string_split(lower(name), ' '), 'red')"""
)
def select_set(c: Catalog) -> DataFrame:
    name = F.lower("name")
    ok = (F.lower("manufacturer") == "brand#3") & name.contains("r") & (name.contains("bolt") | name.contains("ring")) & F.array_contains(C.tokens(F.col("name")), "red")
    return c.products.filter(ok).select("product_id")


@query("SELECT product_id FROM v_products WHERE category = 'promo' AND lower(manufacturer) = 'brand#4' AND (release_year BETWEEN 2005 AND 2015 OR release_year IS NULL) AND active = 1")
def scope_filter(c: Catalog) -> DataFrame:
    year = F.col("release_year")
    ok = (F.col("category") == "promo") & (C.name_key(F.col("manufacturer")) == "brand#4") & (P.within(year, 2005, 2015) | year.isNull()) & (F.col("active") == 1)
    return c.products.filter(ok).select("product_id")


@query("SELECT product_id, series IS NULL OR trim(series) = '' AS series_missing, release_year IS NULL AS year_missing FROM v_products")
def missing_predicate(c: Catalog) -> DataFrame:
    return c.products.select("product_id", F.coalesce(C.missing(F.col("series")), F.lit(True)).alias("series_missing"), C.missing(F.col("release_year")).alias("year_missing"))


# ---------------------------------------------------------------- metadata and facet counts

@query(
    """SELECT category, 'manufacturer' AS field, string_agg(DISTINCT manufacturer, ',' ORDER BY manufacturer) AS options, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM v_products WHERE active = 1 GROUP BY category
    UNION ALL SELECT category, 'size_mm', NULL, min(size_mm), max(size_mm) FROM v_products p JOIN v_spec s ON p.product_id = s.product_id WHERE active = 1 GROUP BY category
    UNION ALL SELECT category, attribute, string_agg(DISTINCT value, ',' ORDER BY value), NULL, NULL FROM v_products p JOIN v_facets f ON p.product_id = f.product_id WHERE active = 1 GROUP BY category, attribute"""
)
def filter_metadata(c: Catalog) -> DataFrame:
    rows = c.products.filter("active = 1").join(c.spec, "product_id")
    one = rows.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("manufacturer")), ",").alias("brands"), F.min("size_mm").cast("double").alias("low"), F.max("size_mm").cast("double").alias("high"))
    none = F.lit(None).cast("double")
    parts = F.array(F.struct(F.lit("manufacturer").alias("field"), F.col("brands").alias("options"), none.alias("low"), none.alias("high")), F.struct(F.lit("size_mm").alias("field"), F.lit(None).cast("string").alias("options"), F.col("low").alias("low"), F.col("high").alias("high")))
    scalar = one.select("category", F.inline(parts))
    facet = c.facets.join(c.products.filter("active = 1").select("product_id", "category"), "product_id").groupBy("category", F.col("attribute").alias("field")).agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("options"))
    return scalar.unionByName(facet.select("category", "field", "options", none.alias("low"), none.alias("high")))


@query("SELECT DISTINCT coalesce(series, '') AS value FROM v_products WHERE series IS NOT NULL AND trim(series) <> '' AND length(series) <= 200")
def option_validity(c: Catalog) -> DataFrame:
    return c.products.filter(P.valid_option(F.col("series"))).select(F.col("series").alias("value")).distinct()


@query("SELECT 'manufacturer' AS field, count(DISTINCT manufacturer) AS options FROM v_products")
def option_limit(c: Catalog) -> DataFrame:
    out = c.products.agg(F.lit("manufacturer").alias("field"), F.count_distinct("manufacturer").alias("options"))
    return out.select("field", F.when(F.assert_true(F.col("options") <= 512, F.lit("too many options")).isNull(), F.col("options")).alias("options"))


_FACETS_SQL = f"""WITH {_REQUESTS_SQL}, met AS (SELECT request_id, p.product_id, manufacturer, size_mm, coalesce(size_mm BETWEEN low AND high, false) AS in_size, brand IS NULL OR manufacturer = brand AS in_brand,
        word IS NULL OR EXISTS (SELECT 1 FROM v_facets f WHERE f.product_id = p.product_id AND attribute = 'word' AND value = word) AS in_word FROM r JOIN v_products p ON p.category = r.category AND active = 1 JOIN v_spec s ON s.product_id = p.product_id),
    has AS (SELECT product_id, 'manufacturer' AS field, manufacturer AS value FROM v_products UNION ALL SELECT product_id, 'size_mm', CAST(size_mm AS VARCHAR(20)) FROM v_spec WHERE size_mm IS NOT NULL UNION ALL SELECT product_id, attribute, value FROM v_facets)
    SELECT request_id, field, value, count(*) AS n FROM met JOIN has ON has.product_id = met.product_id WHERE """


@query(_FACETS_SQL + "in_size AND in_brand AND in_word GROUP BY request_id, field, value")
def facet_counts(c: Catalog) -> DataFrame:
    """Products per field and value under all conditions of each request."""
    first, members = leaders(_requests(c), ["category", "conditions"], "request_id")
    return spread(facet_bits.counts(_values(c), first, own=True), members, "request_id")


@query(_FACETS_SQL + "(in_size OR field = 'size_mm') AND (in_brand OR field = 'manufacturer') AND (in_word OR field = 'word') GROUP BY request_id, field, value")
def facet_self_exclude(c: Catalog) -> DataFrame:
    """Each field of each request counted without the field's own conditions."""
    first, members = leaders(_requests(c), ["category", "conditions"], "request_id")
    return spread(facet_bits.counts(_values(c), first), members, "request_id")


@query(
    """WITH n AS (SELECT category, 'manufacturer' AS field, manufacturer AS value, count(*) AS n FROM v_products GROUP BY 1, 3 UNION ALL SELECT category, 'release_year', CAST(release_year AS VARCHAR), count(*) FROM v_products WHERE release_year IS NOT NULL GROUP BY 1, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY category, field ORDER BY n DESC, value) AS nth FROM n) SELECT category, field, value, n FROM r WHERE nth <= 18"""
)
def value_distribution(c: Catalog) -> DataFrame:
    from pyspark.sql import Window

    n = P.option_rows(c.products, ["manufacturer", "release_year"], ["category"])
    w = Window.partitionBy("category", "field").orderBy(F.desc("n"), "value")
    return n.withColumn("nth", F.row_number().over(w)).filter("nth <= 18").drop("nth")
