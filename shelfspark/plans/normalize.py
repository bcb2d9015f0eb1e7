"""Scans, scalar normalization, and validation with a reject side."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import contract, records
from ..operators.categories import CATEGORIES, ORIGINAL
from ..sources import snapshot
from . import raw_cases
from .base import Catalog, query


def _documents(c: Catalog) -> DataFrame:
    """One raw document for each product, over all categories, parsed."""
    return c.spread("raw").select("product_id", "category", F.try_parse_json("raw").alias("doc"))


@query("SELECT p_partkey, nullif(trim(regexp_replace('  ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '   x ' ELSE '' END, '\\s+', ' ', 'g')), '') AS name FROM part")
def norm_text(c: Catalog) -> DataFrame:
    raw = F.concat(F.lit("  "), "p_name", F.when(F.col("p_partkey") % 3 == 0, "   x ").otherwise(""))
    return c.part.select("p_partkey", C.clean_text(raw).alias("name"))


@query("SELECT p_partkey, upper(trim(' ' || p_brand || '-0' || p_size || ' a')) AS value_key FROM part")
def norm_identifier_key(c: Catalog) -> DataFrame:
    raw = F.concat(F.lit(" "), "p_brand", F.lit("-0"), F.col("p_size").cast("string"), F.lit(" a"))
    return c.part.select("p_partkey", C.identifier_key(raw, normalized=False).alias("value_key"))


@query(
    """WITH r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '-' || p_size WHEN 2 THEN p_size || '.5' WHEN 3 THEN 'n/a' ELSE '0' END AS t, CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'yes' END AS b FROM part),
    n AS (SELECT *, TRY_CAST(t AS DOUBLE) AS d FROM r)
    SELECT p_partkey, CASE WHEN d >= 0 THEN d END AS number, CASE WHEN d > 0 THEN d END AS positive, CASE WHEN d >= 0 AND d = floor(d) THEN CAST(d AS BIGINT) END AS whole, CASE b WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS flag FROM n"""
)
def norm_numbers(c: Catalog) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    t = F.when(k % 5 == 0, size).when(k % 5 == 1, F.concat(F.lit("-"), size)).when(k % 5 == 2, F.concat(size, F.lit(".5"))).when(k % 5 == 3, "n/a").otherwise("0")
    b = F.when(k % 3 == 0, "true").when(k % 3 == 1, "false").otherwise("yes")
    return c.part.select("p_partkey", C.non_negative(t).alias("number"), C.positive(t).alias("positive"), C.safe_integer(t).alias("whole"), C.flag(b).alias("flag"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ASUS' WHEN 1 THEN 'G.Skill' WHEN 2 THEN 'Intel' ELSE p_brand END AS manufacturer FROM part"""
)
def norm_manufacturer(c: Catalog) -> DataFrame:
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, " asus ").when(k == 1, "G.SKILL").when(k == 2, "iNTEL").otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" ")))
    return c.part.select("p_partkey", C.brand(raw).alias("manufacturer"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'LGA ' || (1000 + p_size) ELSE 'AM' || p_size END AS socket FROM part")
def norm_socket(c: Catalog) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("lga"), (F.lit(1000) + F.col("p_size")).cast("string"))).otherwise(F.concat(F.lit("AM"), F.col("p_size").cast("string")))
    return c.part.select("p_partkey", C.socket(raw).alias("socket"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Ryzen 7' WHEN 1 THEN 'Core i5' WHEN 2 THEN 'Core Ultra 9' END AS family,
    CASE WHEN p_partkey % 4 = 0 THEN CAST(5000 + p_size AS VARCHAR) END AS generation FROM part"""
)
def extract_family(c: Catalog) -> DataFrame:
    k = F.col("p_partkey") % 4
    size = (F.lit(5000) + F.col("p_size")).cast("string")
    series = F.when(k == 0, F.concat(F.lit("Ryzen™ 7 "), size))
    meta = F.when(k == 1, F.concat(F.lit("Intel CORE  i5 "), "p_name"))
    name = F.when(k == 2, F.concat(F.lit("core ultra 9 "), "p_name")).otherwise(F.col("p_name"))
    found = C.cpu_family(series, meta, name)
    return c.part.select("p_partkey", found["family"].alias("family"), found["generation"].alias("generation"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'GeForce RTX ' || CAST(10 + p_size AS VARCHAR) WHEN 1 THEN 'Radeon RX 7000' WHEN 2 THEN 'Arc A' END AS series,
    CASE WHEN p_partkey % 5 < 4 THEN 4.0 END AS generation, CASE WHEN p_partkey % 5 < 4 THEN p_size END AS lanes FROM part"""
)
def extract_gpu_series(c: Catalog) -> DataFrame:
    k, size = F.col("p_partkey") % 5, F.col("p_size")
    chipset = F.when(k == 0, F.concat(F.lit("GeForce  rtx "), (size + 10).cast("string"), F.lit("60"))).when(k == 1, "Radeon RX 7800 XT").when(k == 2, "Intel ARC a770").otherwise("Quadro")
    link = F.when(k < 4, F.concat(F.lit("PCIe 4.0 x"), size.cast("string"))).otherwise("AGP x8")
    generation, lanes = C.pcie(link)
    return c.part.select("p_partkey", C.gpu_series(chipset).alias("series"), generation.alias("generation"), lanes.alias("lanes"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 3.0 END AS generation, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 16 END END AS lanes FROM part"""
)
def extract_pcie(c: Catalog) -> DataFrame:
    link = F.when(F.col("p_partkey") % 2 == 0, F.when(F.col("p_size") % 2 == 0, "M.2 pcie 3 X16").otherwise("PCIe 3.0")).otherwise("SATA x4")
    generation, lanes = C.pcie(link)
    return c.part.select("p_partkey", generation.alias("generation"), lanes.alias("lanes"))


@query(raw_cases.expected_specs(list(ORIGINAL)))
def derive_specs(c: Catalog) -> DataFrame:
    """Typed specs of the nine original categories from raw documents: families, series, fallbacks,
    products, sums, sizes and memberships, each row a known spec."""
    return records.spec_values(_documents(c), ["product_id"], list(ORIGINAL))


@query(raw_cases.expected_specs([k for k in CATEGORIES if k not in ORIGINAL]))
def map_declared_specs(c: Catalog) -> DataFrame:
    """Typed specs of the 21 categories that the registry declares by path and conversion."""
    return records.spec_values(_documents(c), ["product_id"], [k for k in CATEGORIES if k not in ORIGINAL])


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS rank FROM orders")
def enum_map(c: Catalog) -> DataFrame:
    return c.orders.select("o_orderkey", contract.enum_value(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}).alias("rank"))


@query(
    """SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 3 > 0 THEN 'hdmi' END, CASE WHEN p_size % 2 > 0 THEN 'usb_c' END) AS ports FROM part"""
)
def map_presence_keys(c: Catalog) -> DataFrame:
    counts = F.create_map(F.lit("hdmi"), F.col("p_size") % 3, F.lit("usb_c"), F.col("p_size") % 2, F.lit("scart"), F.lit(1))
    return c.part.select("p_partkey", F.array_join(contract.present_keys(counts, ["hdmi", "usb_c", "vga"]), ",").alias("ports"))


@query("SELECT DISTINCT p_partkey AS product_id, 'word' AS attribute, unnest(string_split(p_name || ' ' || p_name, ' ')) AS value FROM part")
def explode_facets(c: Catalog) -> DataFrame:
    words = F.split(F.concat("p_name", F.lit(" "), "p_name"), " ")
    return contract.facet_rows(c.part.select(F.col("p_partkey").alias("product_id"), words.alias("word")), ["word"])


@query(
    """SELECT DISTINCT product_id, type, value, upper(trim(value)) AS value_key, origin_field FROM (
    SELECT p_partkey AS product_id, 'mpn' AS type, p_brand || '-' || p_size AS value, 'part_numbers' AS origin_field FROM part
    UNION ALL SELECT p_partkey, 'ean', lpad(CAST(p_partkey AS VARCHAR), 13, '0'), 'identifiers' FROM part)"""
)
def explode_identifiers(c: Catalog) -> DataFrame:
    part_numbers = F.array(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")), F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")))
    listed = F.array(F.struct(F.lit("ean").alias("type"), F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("value")))
    return contract.identifier_rows(c.part.select(F.col("p_partkey").alias("product_id"), part_numbers.alias("part_numbers"), listed.alias("identifiers")))


@query("SELECT p_partkey, sha256('2:' || lower(p_type) || ':' || p_name) AS content_hash FROM part")
def content_hash(c: Catalog) -> DataFrame:
    return c.part.select("p_partkey", contract.content_hash(2, F.lower("p_type"), F.col("p_name")).alias("content_hash"))


@query(
    """SELECT p.product_id, concat_ws(' ', manufacturer, name, nullif(series, ''), (SELECT string_agg(value, ' ' ORDER BY type, value) FROM v_identifiers i WHERE i.product_id = p.product_id)) AS search_text FROM v_products p"""
)
def build_search_text(c: Catalog) -> DataFrame:
    ids = c.identifiers.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("type", "value"))).alias("ids"))
    joined = c.products.join(ids, "product_id", "left")
    return joined.select("product_id", contract.search_text([F.col("manufacturer"), F.col("name"), F.col("series")], F.transform("ids", lambda x: x["value"])).alias("search_text"))


@query(
    """SELECT p.product_id, p.category, name, manufacturer, coalesce(series, '') AS series, CASE WHEN p.category IN ('small', 'large') THEN CAST(size_mm AS VARCHAR) ELSE '' END AS family
    FROM v_products p LEFT JOIN v_spec s ON p.product_id = s.product_id WHERE active = 1"""
)
def build_projection(c: Catalog) -> DataFrame:
    family = F.when(F.col("category").isin("small", "large"), F.col("size_mm").cast("string")).otherwise("")
    joined = c.products.filter("active = 1").join(c.spec, "product_id", "left")
    return joined.select("product_id", "category", "name", "manufacturer", F.coalesce("series", F.lit("")).alias("series"), family.alias("family"))


@query("SELECT p_partkey, CASE WHEN p_retailprice * p_size <= 30000 THEN round(p_retailprice * p_size, 4) END AS derived, CASE WHEN p_retailprice * p_size > 30000 THEN 'derived_limit' END AS issue FROM part")
def cap_derived(c: Catalog) -> DataFrame:
    value, issue = contract.capped(F.col("p_retailprice") * F.col("p_size"), 30000)
    return c.part.select("p_partkey", F.round(value, 4).alias("derived"), issue.alias("issue"))


@query("SELECT DISTINCT attribute, value, CASE WHEN attribute = 'size_band' THEN CASE value WHEN '0' THEN 'tiny' WHEN '1' THEN 'small' ELSE value END ELSE value END AS label FROM v_facets")
def label_options(c: Catalog) -> DataFrame:
    labels = c.spark.createDataFrame([("size_band", "0", "tiny"), ("size_band", "1", "small")], "attribute string, value string, label string")
    return contract.labelled(c.facets.select("attribute", "value").distinct(), labels)


@query(
    """WITH k AS (SELECT p_partkey, '4' || lpad(CAST(p_partkey * 37 AS VARCHAR), 11, '0') AS body FROM part),
    s AS (SELECT p_partkey, body, (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(body, CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 AS digit FROM k)
    SELECT p_partkey, body || CAST(CAST((digit + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END) % 10 AS INT) AS VARCHAR) AS ean, p_partkey % 13 <> 0 AS valid FROM s"""
)
def checksum_gtin(c: Catalog) -> DataFrame:
    body = F.concat(F.lit("4"), F.lpad((F.col("p_partkey") * 37).cast("string"), 11, "0"))
    digit = C.gtin_digit(body)
    ean = F.concat(body, ((digit + F.when(F.col("p_partkey") % 13 == 0, 1).otherwise(0)) % 10).cast("string"))
    return c.part.select("p_partkey", ean.alias("ean"), C.gtin_check(ean).alias("valid"))


@query("SELECT product_id, lower(name) AS name_key, lower(manufacturer) AS manufacturer_key FROM v_products")
def name_keys(c: Catalog) -> DataFrame:
    return c.products.select("product_id", C.name_key(F.col("name")).alias("name_key"), C.name_key(F.col("manufacturer")).alias("manufacturer_key"))


# ---------------------------------------------------------------- validation

@query("SELECT product_id, expected AS code FROM v_broken")
def quarantine_records(c: Catalog) -> DataFrame:
    """The contract's product-level rules over whole documents: too deep, too many nodes, too long, not
    JSON, no identity, no name, no known category."""
    return records.rejected(c.spread("broken").select("product_id", "category", "raw")).select("product_id", "code")


@query(raw_cases.expected_issues())
def null_invalid_fields(c: Catalog) -> DataFrame:
    """Every field of every category that is not what the registry asks for, by rule and path."""
    return records.issues(_documents(c), ["product_id"])


@query(
    """SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'atx' END, CASE WHEN p_size % 3 = 0 THEN 'itx' END) AS kept,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'atx' END AS semantic FROM part"""
)
def filter_array_elements(c: Catalog) -> DataFrame:
    s = F.col("p_size")
    raw = F.array(F.when(s % 2 == 0, "atx").otherwise(""), F.when(s % 3 == 0, "itx"), F.lit("  "))
    semantic = F.when(s % 5 == 0, F.array(F.lit("atx"), F.lit("odd"))).otherwise(F.array(F.lit("atx")))
    kept, all_known = contract.sound_elements(raw), contract.all_or_none(semantic, ["atx", "itx"])
    return c.part.select("p_partkey", F.array_join(kept, ",").alias("kept"), F.array_join(all_known, ",").alias("semantic"))


@query(
    """SELECT product_id, type, value, CASE WHEN type = 'mpn' THEN true ELSE regexp_matches(value, '^[0-9]{13}$') END AS ok FROM v_identifiers"""
)
def validate_identifiers(c: Catalog) -> DataFrame:
    return c.identifiers.select("product_id", "type", "value", contract.identifier_ok(F.col("type"), F.col("value")).alias("ok"))


@query("SELECT count(*) AS rows, 0 AS violations FROM part")
def assert_invariants(c: Catalog) -> DataFrame:
    rules = {"price": F.col("p_retailprice") >= 0, "size": F.col("p_size").between(1, 1000), "name": F.length(F.trim("p_name")) > 0}
    return contract.invariants(c.part, rules)


@query(
    """SELECT 'within' AS scope, category, value_key AS id, count(*) AS n FROM v_identifiers i JOIN v_products p ON i.product_id = p.product_id WHERE type = 'mpn' GROUP BY category, value_key HAVING count(*) > 1
    UNION ALL SELECT 'across', NULL, value_key, count(DISTINCT category) FROM v_identifiers i JOIN v_products p ON i.product_id = p.product_id WHERE type = 'mpn' GROUP BY value_key HAVING count(DISTINCT category) > 1"""
)
def identity_collisions(c: Catalog) -> DataFrame:
    rows = c.identifiers.filter("type = 'mpn'").join(c.products.select("product_id", "category"), "product_id").select("category", F.col("value_key").alias("id"))
    return contract.collisions(rows)


@query(
    """SELECT lower(p_type) AS category, bool_or(p_partkey % 500 = 7) AS held, count(*) FILTER (WHERE p_partkey % 500 = 7) AS odd_files FROM part GROUP BY 1"""
)
def hold_ambiguous_layout(c: Catalog) -> DataFrame:
    name = F.when(F.col("p_partkey") % 500 == 7, "readme.json").otherwise(F.concat(contract.uuid_of(F.col("p_partkey")), F.lit(".json")))
    return contract.layout_holds(c.part.select(F.concat_ws("/", F.lit("snapshot"), F.lower("p_type"), name).alias("path")))


# ---------------------------------------------------------------- scans and sinks

@query("SELECT lower(p_type) AS category, count(*) AS files, count(*) FILTER (WHERE p_partkey % 500 = 7) AS unkeyed FROM part GROUP BY 1")
def scan_inventory(c: Catalog) -> DataFrame:
    name = F.when(F.col("p_partkey") % 500 == 7, "readme.json").otherwise(F.concat(contract.uuid_of(F.col("p_partkey")), F.lit(".json")))
    found = snapshot.inventory(c.part.select(F.concat_ws("/", F.lit("snapshot"), F.lower("p_type"), name).alias("path")))
    return found.groupBy("category").agg(F.count("*").alias("files"), F.count_if(F.col("upstream_key").isNull()).alias("unkeyed"))


@query("SELECT lower(p_type) AS category, p_partkey AS key, p_name AS name FROM part")
def scan_snapshot(c: Catalog) -> DataFrame:
    """Writes the products as JSON lines by category, reads them back as raw text, and parses."""
    at = f"{snapshot.shared_dir(c.spark)}/snapshot/{uuid.uuid4().hex}"
    rows = c.part.select(F.lower("p_type").alias("category"), F.to_json(F.struct(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))).alias("value"))
    rows.write.partitionBy("category").text(at)
    raw = snapshot.scan_lines(c.spark, at)
    return raw.select("category", F.from_json("raw", "key long, name string").alias("r")).select("category", "r.key", "r.name")


@query("SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN length(props) > 9 THEN 'raw_size_limit' ELSE 'ok' END AS status FROM events")
def parse_raw_json(c: Catalog) -> DataFrame:
    return snapshot.parse_json(c.events.select("event_id", F.col("props").alias("raw")), max_bytes=9).select("event_id", F.try_variant_get("doc", "$.k", "bigint").alias("k"), "status")


@query(raw_cases.expected_paths())
def field_path_profile(c: Catalog) -> DataFrame:
    """How often each unmodeled path occurs in a category, at any level of the registry's tree."""
    return records.unmodeled(_documents(c))


@query(
    """SELECT p.product_id, size_mm, (SELECT string_agg(type || '=' || value_key, ',' ORDER BY type, value_key) FROM v_identifiers i WHERE i.product_id = p.product_id) AS identifiers,
    (SELECT string_agg(attribute || '=' || value, ',' ORDER BY attribute, value) FROM v_facets f WHERE f.product_id = p.product_id) AS facets FROM v_products p JOIN v_spec s ON p.product_id = s.product_id"""
)
def denormalize_catalog(c: Catalog) -> DataFrame:
    nested = contract.denormalize(c.products, c.spec, c.identifiers, c.facets)
    flat = lambda a, k, v: F.array_join(F.transform(a, lambda x: F.concat_ws("=", x[k], x[v])), ",")
    return nested.select("product_id", "size_mm", flat("identifiers", "type", "value_key").alias("identifiers"), flat("facets", "attribute", "value").alias("facets"))


@query(
    """SELECT 'products' AS part, count(*) AS n FROM v_products UNION ALL SELECT 'spec', count(*) FROM v_spec UNION ALL SELECT 'identifiers', count(*) FROM v_identifiers UNION ALL SELECT 'facets', count(*) FROM v_facets"""
)
def write_catalog(c: Catalog) -> DataFrame:
    at = f"{snapshot.shared_dir(c.spark)}/catalog/{uuid.uuid4().hex}"
    cat = c.products.select("product_id", "category")
    parts = {"products": c.products, "spec": c.spec.join(cat, "product_id"), "identifiers": c.identifiers.join(cat, "product_id"), "facets": c.facets.join(cat, "product_id")}
    snapshot.write_catalog(parts, at)
    counts = [c.spark.read.parquet(f"{at}/{name}").agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name in parts]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


@query(
    """SELECT item_id AS case_id, CASE WHEN item_id % 2 = 0 THEN 'lookup' ELSE 'browse' END AS class, CASE WHEN item_id % 5 = 0 THEN 'override' ELSE string_split(text, ' ')[1] END AS expected FROM benchmark"""
)
def scan_cases(c: Catalog) -> DataFrame:
    cases = c.benchmark.select(F.col("item_id").alias("case_id"), F.split("text", " ")[0].alias("expected"))
    labels = c.benchmark.select(F.col("item_id").alias("case_id"), F.when(F.col("item_id") % 2 == 0, "lookup").otherwise("browse").alias("class"))
    overrides = c.benchmark.filter("item_id % 5 = 0").select(F.col("item_id").alias("case_id"), F.lit("override").alias("expected"))
    return snapshot.labelled_cases(cases, labels, overrides)


@query("SELECT l_orderkey AS response_id, l_linenumber AS code, round(l_extendedprice, 2) AS price FROM lineitem")
def scan_offers(c: Catalog) -> DataFrame:
    hit = F.struct(F.col("l_linenumber").alias("code"), F.col("l_extendedprice").alias("price"))
    responses = c.lineitem.groupBy(F.col("l_orderkey").alias("response_id")).agg(F.to_json(F.struct(F.collect_list(hit).alias("hits"))).alias("body"))
    found = snapshot.explode_hits(responses, "code int, price double")
    return found.select("response_id", "code", F.round("price", 2).alias("price"))


@query(
    """WITH r AS (SELECT event_type AS code, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM events)
    SELECT code, user_id AS scope, event_id AS sample, n, greatest(n - 3, 0) AS omitted FROM r WHERE nth <= 3"""
)
def report_sink(c: Catalog) -> DataFrame:
    return contract.issue_report(c.events.select(F.col("class").alias("code"), F.col("user_id").alias("scope"), F.col("event_id").alias("sample")), 3)


@query(
    """SELECT 'category' AS kind, category AS a, CAST(active AS VARCHAR) AS b, count(*) AS n FROM v_products GROUP BY 2, 3 UNION ALL SELECT 'identifier', origin, type, count(*) FROM v_identifiers GROUP BY 2, 3"""
)
def catalog_stats(c: Catalog) -> DataFrame:
    a = c.products.groupBy("category", F.col("active").cast("string").alias("b")).count().select(F.lit("category").alias("kind"), F.col("category").alias("a"), "b", F.col("count").alias("n"))
    b = c.identifiers.groupBy("origin", "type").count().select(F.lit("identifier").alias("kind"), F.col("origin").alias("a"), F.col("type").alias("b"), F.col("count").alias("n"))
    return a.unionByName(b)
