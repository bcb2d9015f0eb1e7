"""Audits: completeness, duplicates, fingerprints, quantiles, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import order as O
from .base import Catalog, query

FIELDS = ("name", "series", "release_year", "size_mm")


def completeness_of(rows: DataFrame, fields: tuple[str, ...], groups: list[list[str]]) -> DataFrame:
    """(group keys..., field, present, missing, coverage) in one pass; no rows give a null rate."""
    keys = sorted({k for g in groups for k in g})
    aggs = [F.count_if(~C.missing(F.col(f))).alias(f"__{f}") for f in fields]
    out = rows.groupingSets([[F.col(k) for k in g] for g in groups], *[F.col(k) for k in keys]).agg(F.count("*").alias("__n"), F.grouping_id().alias("level"), *aggs)
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__{f}").alias("present")) for f in fields])
    flat = out.select(*keys, "level", "__n", F.inline(parts))
    return flat.select(*keys, "level", "field", "present", (F.col("__n") - F.col("present")).alias("missing"), F.round(F.try_divide("present", "__n"), 6).alias("coverage"))


_PRESENT = " UNION ALL ".join(
    f"SELECT {{g}}, '{f}' AS field, count(*) FILTER (WHERE {f} IS NOT NULL AND trim(CAST({f} AS VARCHAR)) <> '') AS present, count(*) FILTER (WHERE {f} IS NULL OR trim(CAST({f} AS VARCHAR)) = '') AS missing, round(count(*) FILTER (WHERE {f} IS NOT NULL AND trim(CAST({f} AS VARCHAR)) <> '') / count(*), 6) AS coverage FROM rows {{w}}" for f in FIELDS
)
_ROWS = "WITH rows AS (SELECT p.*, size_mm FROM v_products p LEFT JOIN v_spec s ON p.product_id = s.product_id) "


@query(_ROWS + _PRESENT.replace("{g}", "category").replace("{w}", "GROUP BY category"))
def completeness(c: Catalog) -> DataFrame:
    return completeness_of(c.products.join(c.spec, "product_id", "left"), FIELDS, [["category"]]).drop("level")


@query(
    _ROWS + "SELECT * FROM (" + _PRESENT.replace("{g}", "category, manufacturer").replace("{w}", "GROUP BY category, manufacturer") + ") UNION ALL SELECT * FROM ("
    + _PRESENT.replace("{g}", "category, CAST(NULL AS VARCHAR) AS manufacturer").replace("{w}", "GROUP BY category") + ") UNION ALL SELECT * FROM ("
    + _PRESENT.replace("{g}", "CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS manufacturer").replace("{w}", "") + ")"
)
def completeness_by_manufacturer(c: Catalog) -> DataFrame:
    rows = c.products.join(c.spec, "product_id", "left")
    return completeness_of(rows, FIELDS, [["category", "manufacturer"], ["category"], []]).drop("level")


@query(
    """WITH g AS (SELECT DISTINCT type, CASE WHEN type = 'mpn' THEN lower(manufacturer) END AS vendor, value_key, i.product_id FROM v_identifiers i JOIN v_products p ON i.product_id = p.product_id),
    n AS (SELECT type, vendor, value_key, count(*) AS products FROM g GROUP BY 1, 2, 3 HAVING count(*) > 1)
    SELECT g.type, g.vendor, g.value_key, products, product_id FROM g JOIN n ON g.type = n.type AND g.vendor IS NOT DISTINCT FROM n.vendor AND g.value_key = n.value_key"""
)
def duplicate_identifiers(c: Catalog) -> DataFrame:
    """Evidence as rows: a key that very many products share has as many rows and no long list."""
    vendor = F.when(F.col("type") == "mpn", C.name_key(F.col("manufacturer")))
    rows = c.identifiers.join(c.products.select("product_id", "manufacturer"), "product_id").select("type", vendor.alias("vendor"), "value_key", "product_id").distinct()
    many = rows.groupBy("type", "vendor", "value_key").agg(F.count("*").alias("products")).filter("products > 1")
    same = (rows["type"] == many["type"]) & rows["vendor"].eqNullSafe(many["vendor"]) & (rows["value_key"] == many["value_key"])
    return rows.join(many, same).select(rows["*"], "products")


@query(
    """SELECT category, lower(manufacturer) AS manufacturer_key, lower(name) AS name_key, count(*) AS products, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM v_identifiers i WHERE i.product_id = p.product_id AND type = 'ean')) AS without_ean
    FROM v_products p GROUP BY 1, 2, 3 HAVING count(*) > 1"""
)
def duplicate_names(c: Catalog) -> DataFrame:
    eans = c.identifiers.filter("type = 'ean'").select("product_id").distinct().withColumn("has", F.lit(True))
    rows = c.products.join(eans, "product_id", "left")
    g = rows.groupBy("category", C.name_key(F.col("manufacturer")).alias("manufacturer_key"), C.name_key(F.col("name")).alias("name_key"))
    return g.agg(F.count("*").alias("products"), F.count_if(F.col("has").isNull()).alias("without_ean")).filter("products > 1")


@query(
    """WITH g AS (SELECT type, value_key FROM v_identifiers GROUP BY 1, 2 HAVING count(DISTINCT product_id) > 1)
    SELECT i.type, count(DISTINCT i.value_key) AS conflicts, count(DISTINCT i.product_id) AS products FROM v_identifiers i JOIN g ON i.type = g.type AND i.value_key = g.value_key GROUP BY 1"""
)
def duplicate_summary(c: Catalog) -> DataFrame:
    groups = c.identifiers.groupBy("type", "value_key").agg(F.count_distinct("product_id").alias("n")).filter("n > 1")
    return c.identifiers.join(groups, ["type", "value_key"], "left_semi").groupBy("type").agg(F.count_distinct("value_key").alias("conflicts"), F.count_distinct("product_id").alias("products"))


@query(
    """WITH a AS (SELECT category, sha256(concat_ws('|', product_id, name, manufacturer)) AS h FROM v_products),
    b AS (SELECT category, substr(h, 1, 6) AS place, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM a GROUP BY 1, 2), d AS (SELECT category, substr(place, 1, 3) AS place, sha256(string_agg(h, '' ORDER BY place)) AS h, sum(n) AS n FROM b GROUP BY category, substr(place, 1, 3))
    SELECT category, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, '' ORDER BY place)) AS digest FROM d GROUP BY 1"""
)
def table_fingerprint(c: Catalog) -> DataFrame:
    return O.fingerprint(c.products, F.concat_ws("|", "product_id", "name", "manufacturer"), "category")


@query(
    """WITH r AS (SELECT class, cost, row_number() OVER (PARTITION BY class ORDER BY cost) AS rn, count(*) OVER (PARTITION BY class) AS n FROM v_events)
    SELECT class, min(cost) FILTER (WHERE rn >= greatest(1, ceil(0.5 * n))) AS median, min(cost) FILTER (WHERE rn >= greatest(1, ceil(0.95 * n))) AS p95, max(cost) AS largest FROM r GROUP BY class"""
)
def quantile_nearest(c: Catalog) -> DataFrame:
    return O.nearest_rank(c.events, "class", "cost", {"median": 0.5, "p95": 0.95})


@query(
    """WITH stored AS (SELECT upstream_key, name, CASE WHEN ascii(right(upstream_key, 1)) % 7 = 0 THEN price + 1 ELSE price END AS price, size_mm FROM v_snapshot_a WHERE active = 1)
    SELECT kind, count(*) AS n FROM (SELECT unnest([CASE WHEN s.upstream_key IS NULL THEN 'missing' END, CASE WHEN a.upstream_key IS NULL THEN 'extra' END, CASE WHEN s.upstream_key IS NOT NULL AND a.upstream_key IS NOT NULL AND s.price IS DISTINCT FROM a.price THEN 'price' END]) AS kind
    FROM v_snapshot_a a FULL JOIN stored s ON a.upstream_key = s.upstream_key) WHERE kind IS NOT NULL GROUP BY kind"""
)
def source_integrity(c: Catalog) -> DataFrame:
    source = c.snapshot_a
    stored = source.filter("active = 1").withColumn("price", F.when(F.ascii(F.substring("upstream_key", -1, 1)) % 7 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return mismatches(source, stored, "upstream_key", ["name", "price", "size_mm"])


def mismatches(source: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(kind, n): rows missing from the store, extra in it, and differing columns."""
    both = source.select(key, F.struct(*columns).alias("a")).join(stored.select(key, F.struct(*columns).alias("b")), key, "full_outer")
    kinds = [F.when(F.col("b").isNull(), "missing"), F.when(F.col("a").isNull(), "extra")]
    kinds += [F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")), x) for x in columns]
    return both.select(F.explode(F.array_compact(F.array(*kinds))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    """WITH corpus AS (SELECT product_id, category, name FROM v_products WHERE product_id % 50 <> 1 UNION ALL SELECT product_id, category, name FROM v_products WHERE product_id % 97 = 5
        UNION ALL SELECT product_id, 'other', name FROM v_products WHERE product_id % 89 = 2),
    docs AS (SELECT product_id, count(*) AS n, bool_or(category = 'other') AS other FROM corpus GROUP BY 1)
    SELECT count(*) FILTER (WHERE p.active = 1 AND d.product_id IS NULL) AS missing, count(*) FILTER (WHERE d.n > 1) AS duplicated, count(*) FILTER (WHERE d.other) AS wrong_category, count(*) FILTER (WHERE p.active = 0 AND d.n > 0) AS inactive
    FROM v_products p LEFT JOIN docs d ON p.product_id = d.product_id"""
)
def corpus_integrity(c: Catalog) -> DataFrame:
    p = c.products.select("product_id", "category", "name")
    k = F.col("product_id")
    corpus = p.filter(k % 50 != 1).unionByName(p.filter(k % 97 == 5)).unionByName(p.filter(k % 89 == 2).withColumn("category", F.lit("other")))
    docs = corpus.groupBy("product_id").agg(F.count("*").alias("n"), F.collect_set("category").alias("in"))
    both = c.products.join(docs, "product_id", "left")
    wrong = F.exists("in", lambda x: x != F.col("category"))
    return both.agg(F.count_if((F.col("active") == 1) & F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("duplicated"), F.count_if(wrong).alias("wrong_category"), F.count_if((F.col("active") == 0) & (F.col("n") > 0)).alias("inactive"))
