"""Order, keyset pages, first of group, set operations, and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import order as O
from .base import Catalog, query

_KEYS = "lower(manufacturer), CASE WHEN series IS NULL OR series = '' THEN 1 ELSE 0 END, lower(coalesce(series, '')), lower(name), product_id"


def page_after(rows: DataFrame, keys: list, last: tuple, size: int) -> DataFrame:
    """The first ``size`` rows after the tuple ``last`` in the order of ``keys``: a seek. The bound
    on the leading key stands beside the tuple comparison, so that files can be skipped by it."""
    lits = [F.lit(v) for v in last]
    after = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]) > F.struct(*[v.alias(f"k{i}") for i, v in enumerate(lits)])
    return rows.filter((keys[0] >= lits[0]) & after).orderBy(*keys).limit(size)


def _placed(c: Catalog, keys: list, name: str) -> DataFrame:
    """(category, product_id, ``name``): each product's place in its category."""
    return O.ranked(c.products, ["category"], keys, name).select("category", "product_id", name)


@query(f"SELECT product_id, row_number() OVER (PARTITION BY category ORDER BY {_KEYS}) AS place FROM v_products")
def display_order(c: Catalog) -> DataFrame:
    return _placed(c, C.display_keys(), "place").select("product_id", "place")


@query(f"SELECT product_id, row_number() OVER (PARTITION BY category ORDER BY release_year IS NULL, release_year, {_KEYS}) AS place FROM v_products")
def order_by_field(c: Catalog) -> DataFrame:
    return _placed(c, [F.col("release_year").isNull(), F.col("release_year"), *C.display_keys()], "place").select("product_id", "place")


@query(
    """SELECT product_id, name FROM v_products WHERE category = 'economy' AND (manufacturer, name, product_id) > ('Brand#2', 'green gear', 0) ORDER BY manufacturer, name, product_id LIMIT 25"""
)
def page_keyset(c: Catalog) -> DataFrame:
    rows = c.products.filter("category = 'economy'")
    return page_after(rows, [F.col("manufacturer"), F.col("name"), F.col("product_id")], ("Brand#2", "green gear", 0), 25).select("product_id", "name")


@query(
    f"""WITH o AS (SELECT category, product_id, row_number() OVER (PARTITION BY category ORDER BY {_KEYS}) AS rn FROM v_products)
    SELECT category, (rn - 1) // 20 AS page, min_by(product_id, rn) AS first_id, max_by(product_id, rn) AS last_id, count(*) AS n FROM o GROUP BY 1, 2"""
)
def page_number_all(c: Catalog) -> DataFrame:
    rows = _placed(c, C.display_keys(), "rn")
    page = F.floor((F.col("rn") - 1) / 20)
    return rows.groupBy("category", page.alias("page")).agg(F.min_by("product_id", "rn").alias("first_id"), F.max_by("product_id", "rn").alias("last_id"), F.count("*").alias("n"))


@query(
    f"""WITH o AS (SELECT category, product_id, row_number() OVER (PARTITION BY category ORDER BY {_KEYS}) AS rn, row({_KEYS}) AS k FROM v_products), l AS (SELECT *, lag(k) OVER (PARTITION BY category ORDER BY rn) AS before FROM o)
    SELECT category, count(*) AS rows, count(*) FILTER (WHERE before >= k) AS violations, count(DISTINCT product_id) = count(*) AS all_distinct FROM l GROUP BY category"""
)
def page_invariants(c: Catalog) -> DataFrame:
    """The pages' order is checked from outside: along the places that ``display_order`` gives, keys
    must rise; a second look at the places themselves finds gaps and repeats."""
    keys = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(C.display_keys())])
    rows = _placed(c, C.display_keys(), "place").join(c.products.select("product_id", keys.alias("k")), "product_id")
    rows = O.previous(rows, ["category"], [F.col("place")], F.struct("k", "place"), "before")
    bad = F.count_if(F.col("before").isNotNull() & ~((F.col("before.k") < F.col("k")) & (F.col("before.place") + 1 == F.col("place"))))
    ids = rows.groupBy("category", "product_id").agg(F.count("*").alias("n")).groupBy("category").agg((F.max("n") == 1).alias("all_distinct"))
    return rows.groupBy("category").agg(F.count("*").alias("rows"), bad.alias("violations")).join(ids, "category")


@query(
    f"""WITH o AS (SELECT category, product_id, row_number() OVER (PARTITION BY category ORDER BY {_KEYS}) AS rn FROM v_products)
    SELECT category, count(*) FILTER (WHERE rn <= 30) AS n, max(rn) > 30 AS has_more, CASE WHEN max(rn) > 30 THEN 30 END AS next_offset FROM o WHERE rn <= 31 GROUP BY category"""
)
def page_lookahead(c: Catalog) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("category").orderBy(*C.display_keys()))
    rows = c.products.select("category", rn.alias("rn")).filter("rn <= 31")
    more = F.max("rn") > 30
    return rows.groupBy("category").agg(F.count_if(F.col("rn") <= 30).alias("n"), more.alias("has_more"), F.when(more, 30).alias("next_offset"))


@query("SELECT name, product_id, manufacturer FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY active DESC, release_year DESC NULLS LAST, product_id) AS nth FROM v_products) WHERE nth = 1")
def first_of_group(c: Catalog) -> DataFrame:
    w = Window.partitionBy("name").orderBy(F.desc("active"), F.desc_nulls_last("release_year"), "product_id")
    return c.products.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("name", "product_id", "manufacturer")


# ---------------------------------------------------------------- sets

@query("SELECT origin, type, count(*) AS n, count(DISTINCT value_key) AS keys FROM v_identifiers GROUP BY origin, type")
def union_identifiers(c: Catalog) -> DataFrame:
    upstream, local = c.identifiers.filter("origin = 'upstream'").drop("origin"), c.identifiers.filter("origin = 'local'").drop("origin")
    both = upstream.withColumn("origin", F.lit("upstream")).unionByName(local.withColumn("origin", F.lit("local")), allowMissingColumns=True)
    return both.groupBy("origin", "type").agg(F.count("*").alias("n"), F.count_distinct("value_key").alias("keys"))


@query(
    """WITH a AS (SELECT category, product_id FROM v_products WHERE product_id % 3 = 0), b AS (SELECT category, product_id FROM v_products WHERE product_id % 2 = 0)
    SELECT coalesce(a.category, b.category) AS category, count(*) FILTER (WHERE a.product_id IS NOT NULL AND b.product_id IS NOT NULL) AS tp, count(*) FILTER (WHERE b.product_id IS NULL) AS fp,
    count(*) FILTER (WHERE a.product_id IS NULL) AS fn, count(*) FILTER (WHERE a.product_id IS NULL OR b.product_id IS NULL) = 0 AS exact FROM a FULL JOIN b ON a.category = b.category AND a.product_id = b.product_id GROUP BY 1"""
)
def set_equality(c: Catalog) -> DataFrame:
    returned = c.products.filter("product_id % 3 = 0").select("category", "product_id", F.lit(True).alias("a"))
    relevant = c.products.filter("product_id % 2 = 0").select("category", "product_id", F.lit(True).alias("b"))
    both = returned.join(relevant, ["category", "product_id"], "full_outer")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.groupBy("category").agg(F.count_if(a & b).alias("tp"), F.count_if(a & ~b).alias("fp"), F.count_if(b & ~a).alias("fn"), (F.count_if(~(a & b)) == 0).alias("exact"))


@query(
    """SELECT coalesce(a.upstream_key, b.upstream_key) AS upstream_key, CASE WHEN a.upstream_key IS NULL THEN 'only_b' WHEN b.upstream_key IS NULL THEN 'only_a' ELSE concat_ws(',', CASE WHEN a.price IS DISTINCT FROM b.price THEN 'price' END, CASE WHEN a.size_mm IS DISTINCT FROM b.size_mm THEN 'size_mm' END) END AS differs
    FROM v_snapshot_a a FULL JOIN v_snapshot_b b ON a.upstream_key = b.upstream_key WHERE a.upstream_key IS NULL OR b.upstream_key IS NULL OR a.price IS DISTINCT FROM b.price OR a.size_mm IS DISTINCT FROM b.size_mm"""
)
def ref_differences(c: Catalog) -> DataFrame:
    return row_differences(c.snapshot_a, c.snapshot_b, "upstream_key", ["price", "size_mm"])


def row_differences(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, differs): rows on one side only, and the columns in which shared rows differ."""
    both = a.select(key, F.struct(*columns).alias("a")).join(b.select(key, F.struct(*columns).alias("b")), key, "full_outer")
    off = F.array_compact(F.array(*[F.when(~F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")), F.lit(x)) for x in columns]))
    kind = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise(F.array_join(off, ","))
    return both.select(key, kind.alias("differs")).filter("differs <> ''")


# ---------------------------------------------------------------- joins

@query("SELECT p.product_id, category, size_mm, price FROM v_products p JOIN v_spec s ON p.product_id = s.product_id")
def join_product_spec(c: Catalog) -> DataFrame:
    return c.products.join(c.spec, "product_id").select("product_id", "category", "size_mm", "price")


@query("SELECT product_id FROM v_products p WHERE EXISTS (SELECT 1 FROM v_facets f WHERE f.product_id = p.product_id AND value = 'red')")
def join_semi_facet(c: Catalog) -> DataFrame:
    return c.products.join(c.facets.filter("value = 'red'"), "product_id", "left_semi").select("product_id")


@query("SELECT product_id FROM v_products p WHERE NOT EXISTS (SELECT 1 FROM v_identifiers i WHERE i.product_id = p.product_id AND type = 'ean')")
def join_anti_missing(c: Catalog) -> DataFrame:
    return c.products.join(c.identifiers.filter("type = 'ean'"), "product_id", "left_anti").select("product_id")


@query(
    """WITH refs AS (SELECT c_custkey AS pos, 'K' || (c_custkey * 3) AS upstream_key FROM customer UNION ALL SELECT c_custkey + 1000000, 'K' || c_custkey FROM customer WHERE c_custkey % 10 = 0)
    SELECT pos, refs.upstream_key, product_id, CASE WHEN product_id IS NULL THEN 'missing' WHEN active = 1 THEN 'active' ELSE 'inactive' END AS status FROM refs LEFT JOIN v_products p ON p.upstream_key = refs.upstream_key"""
)
def resolve_refs(c: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    refs = c.customer.select(k.alias("pos"), F.concat(F.lit("K"), (k * 3).cast("string")).alias("upstream_key"))
    refs = refs.unionByName(c.customer.filter(k % 10 == 0).select((k + 1000000).alias("pos"), F.concat(F.lit("K"), k.cast("string")).alias("upstream_key")))
    status = F.when(F.col("product_id").isNull(), "missing").when(F.col("active") == 1, "active").otherwise("inactive")
    return refs.join(c.products.select("upstream_key", "product_id", "active"), "upstream_key", "left").select("pos", "upstream_key", "product_id", status.alias("status"))


@query(
    """SELECT p.product_id, price, (SELECT string_agg(k, ';' ORDER BY k) FROM (SELECT type || ':' || value_key || ':' || string_agg(DISTINCT origin, '+' ORDER BY origin) AS k FROM v_identifiers i WHERE i.product_id = p.product_id GROUP BY type, value_key)) AS identifiers
    FROM v_products p JOIN v_spec s ON p.product_id = s.product_id"""
)
def product_detail(c: Catalog) -> DataFrame:
    ids = c.identifiers.groupBy("product_id", "type", "value_key").agg(F.array_join(F.array_sort(F.collect_set("origin")), "+").alias("origins"))
    ids = ids.groupBy("product_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "type", "value_key", "origins"))), ";").alias("identifiers"))
    asked = c.products.select("product_id")
    return asked.join(c.spec, "product_id").join(ids, "product_id", "left").select("product_id", "price", "identifiers")


@query(
    """WITH page AS (SELECT product_id FROM v_products WHERE category = 'promo' ORDER BY name, product_id LIMIT 50)
    SELECT page.product_id, (SELECT string_agg(attribute || '=' || value, ',' ORDER BY attribute, value) FROM v_facets f WHERE f.product_id = page.product_id) AS facets,
    (SELECT count(*) FROM v_identifiers i WHERE i.product_id = page.product_id) AS identifiers FROM page"""
)
def expand_page(c: Catalog) -> DataFrame:
    page = c.products.filter("category = 'promo'").orderBy("name", "product_id").limit(50).select("product_id")
    few = F.broadcast(page)  # one page: at most 50 rows
    facets = c.facets.join(few, "product_id", "left_semi").groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attribute", "value"))), lambda x: F.concat_ws("=", x["attribute"], x["value"])), ",").alias("facets"))
    ids = c.identifiers.join(few, "product_id", "left_semi").groupBy("product_id").agg(F.count("*").alias("identifiers"))
    return page.join(facets, "product_id", "left").join(ids, "product_id", "left").select("product_id", "facets", F.coalesce("identifiers", F.lit(0)).cast("long").alias("identifiers"))


@query(
    """SELECT product_id, name, CASE WHEN product_id % 4 = 0 THEN 'shelf=' || (product_id % 9) WHEN product_id % 4 = 1 THEN 'note=' || name END AS overlay FROM v_products"""
)
def overlay_enrichment(c: Catalog) -> DataFrame:
    k = F.col("product_id")
    local = c.products.filter("product_id % 4 = 0").select(k, F.lit("shelf").alias("key"), (k % 9).cast("string").alias("value"))
    local = local.unionByName(c.products.filter("product_id % 4 = 1").select(k, F.lit("note").alias("key"), F.col("name").alias("value")))
    maps = local.groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return c.products.join(maps, "product_id", "left").select("product_id", "name", text.alias("overlay"))


@query(
    """SELECT coalesce(n.n_nationkey, s.k) AS category, CASE WHEN s.k IS NULL THEN 'missing' WHEN n.n_nationkey IS NULL THEN 'unsupported' ELSE 'supported' END AS status
    FROM nation n FULL JOIN (SELECT DISTINCT s_nationkey + 3 AS k FROM supplier) s ON n.n_nationkey = s.k"""
)
def category_coverage(c: Catalog) -> DataFrame:
    registry = c.nation.select(F.col("n_nationkey").alias("category"), F.lit(True).alias("known"))
    observed = c.supplier.select((F.col("s_nationkey") + 3).alias("category")).distinct().withColumn("seen", F.lit(True))
    status = F.when(F.col("seen").isNull(), "missing").when(F.col("known").isNull(), "unsupported").otherwise("supported")
    return registry.join(observed, "category", "full_outer").select("category", status.alias("status"))
