"""Normalization and validation operators: specs, facets, identifiers, quarantine, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

UUID_V4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
DIGITS = {"ean": 13, "jan": 13, "upc": 12, "gtin": 14}


def derived_specs() -> list[Column]:
    """Specs with fallbacks and arithmetic over raw columns."""
    capacity = F.coalesce(C.positive(F.col("capacity")), C.positive(F.col("modules.capacity_gb") * F.col("modules.quantity")))
    return [
        F.col("p_partkey"), capacity.alias("capacity_gb"), F.col("modules.quantity").alias("kit_quantity"), F.coalesce("max_noise", "min_noise").alias("noise_max_db"),
        F.array_contains("profiles", "XMP").cast("int").alias("xmp"), F.when(F.col("m2").isNotNull(), F.size("m2")).alias("m2_slots"), (F.col("sata_6") + F.col("sata_3")).alias("sata_ports"),
    ]


def declared_specs(raw: DataFrame, mapping: dict[str, tuple[str, str]], keys: list[str]) -> DataFrame:
    """One column per declared field (target: path, type) of JSON text ``raw``, in one select; a
    value of the wrong type is null; booleans become 0 or 1."""
    doc = raw.withColumn("__doc", F.try_parse_json("raw"))
    cols = []
    for name, (path, kind) in mapping.items():
        v = F.try_variant_get("__doc", path, kind)
        cols.append((v.cast("int") if kind == "boolean" else v).alias(name))
    return doc.select(*keys, *cols)


def enum_value(c: Column, values: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def present_keys(counts: Column, allowed: list[str]) -> Column:
    """Allowed keys of a map whose count is positive, in the order allowed."""
    return F.array_intersect(F.array(*[F.lit(a) for a in allowed]), F.map_keys(F.map_filter(counts, lambda _, v: v > 0)))


def facet_rows(rows: DataFrame, attributes: list[str], max_length: int = 200) -> DataFrame:
    """Array columns as distinct (product_id, attribute, value) rows, cleaned, over-long dropped."""
    named = F.array(*[F.struct(F.lit(a).alias("attribute"), F.array_distinct(F.transform(a, C.clean_text)).alias("values")) for a in attributes])
    out = rows.select("product_id", F.inline(named)).select("product_id", "attribute", F.explode("values").alias("value"))
    return out.filter((F.length("value") > 0) & (F.length("value") <= max_length))


def identifier_rows(rows: DataFrame) -> DataFrame:
    """Part numbers and listed identifiers as one row set with keys; exact duplicates removed."""
    own = F.transform("part_numbers", lambda v: F.struct(F.lit("mpn").alias("type"), v.alias("value"), F.lit("part_numbers").alias("origin_field")))
    listed = F.transform("identifiers", lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), F.lit("identifiers").alias("origin_field")))
    out = rows.select("product_id", F.inline(F.array_distinct(F.concat(own, listed))))
    return out.select("product_id", "type", "value", C.identifier_key(F.col("value")).alias("value_key"), "origin_field")


def content_hash(version: int, category: Column, raw: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(version)), category, raw).cast("binary"), 256)


def search_text(fields: list[Column], identifiers: Column) -> Column:
    parts = F.concat(F.array(*fields), F.coalesce(identifiers, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")


def capped(value: Column, limit: float) -> tuple[Column, Column]:
    return F.when(value <= limit, value), F.when(value > limit, "derived_limit")


def labelled(options: DataFrame, labels: DataFrame) -> DataFrame:
    return options.join(labels, ["attribute", "value"], "left").withColumn("label", F.coalesce("label", "value"))


def reject_code(raw: DataFrame, max_bytes: int) -> DataFrame:
    """``raw`` with ``code``: the first product-level rule it breaks, or 'accepted'."""
    code = (
        F.when(~F.coalesce(F.regexp_like("upstream_key", F.lit(UUID_V4)), F.lit(False)), "invalid_key")
        .when(~F.coalesce(F.regexp_like("name", F.lit("[\\p{L}\\p{N}]")), F.lit(False)), "invalid_name")
        .when(F.octet_length("raw") > max_bytes, "raw_size_limit")
        .otherwise("accepted")
    )
    return raw.withColumn("code", code)


def null_invalid(rows: DataFrame, rules: dict[str, list[tuple[str, Column]]], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with fields nulled where a rule holds, and (key, field, issue) rows; records survive."""
    issue = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(name).alias("issue"))) for f, rs in rules.items() for name, bad in rs]))
    marked = rows.withColumn("__issues", issue)
    fixed = marked
    for f in rules:
        fixed = fixed.withColumn(f, F.when(~F.array_contains(F.transform("__issues", lambda x: x["field"]), f), F.col(f)))
    return fixed.drop("__issues"), marked.select(key, F.inline("__issues"))


def sound_elements(c: Column, max_length: int = 200) -> Column:
    return F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "") & (F.length(x) <= max_length))


def all_or_none(c: Column, known: list[str]) -> Column:
    """An array with an unknown element is unknown as a whole."""
    return F.when(F.forall(c, lambda x: x.isin(known)), c)


def identifier_ok(kind: Column, value: Column) -> Column:
    ok = F.lit(True)
    for k, n in DIGITS.items():
        ok = F.when(kind == k, F.regexp_like(value, F.lit(f"^[0-9]{{{n}}}$"))).otherwise(ok)
    return ok


def invariants(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rows, violations); a violation fails the job, as it is a bug and not bad data."""
    held = [F.count_if(~F.coalesce(rule, F.lit(False))) for rule in rules.values()]
    total = held[0]
    for h in held[1:]:
        total = total + h
    out = rows.agg(F.count("*").alias("rows"), total.alias("violations"))
    return out.select("rows", F.when(F.assert_true(F.col("violations") == 0, F.lit("invariant violated")).isNull(), F.col("violations")).alias("violations"))


def collisions(rows: DataFrame) -> DataFrame:
    """Ids twice within a category (holds it), and ids in several categories (reported only)."""
    within = rows.groupBy("category", "id").count().filter("count > 1").select(F.lit("within").alias("scope"), "category", "id", F.col("count").alias("n"))
    across = rows.groupBy("id").agg(F.count_distinct("category").alias("n")).filter("n > 1").select(F.lit("across").alias("scope"), F.lit(None).cast("string").alias("category"), "id", "n")
    return within.unionByName(across)


def uuid_of(key: Column) -> Column:
    """A version-4 shaped key from an id."""
    h = F.md5(key.cast("string").cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def layout_holds(paths: DataFrame) -> DataFrame:
    """Categories with files whose names are no keys."""
    stem = F.regexp_extract("path", "([^/]+)\\.json$", 1)
    odd = ~F.regexp_like(stem, F.lit(UUID_V4))
    category = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    return paths.groupBy(category.alias("category")).agg(F.bool_or(odd).alias("held"), F.count_if(odd).alias("odd_files"))


def denormalize(products: DataFrame, spec: DataFrame, identifiers: DataFrame, facets: DataFrame) -> DataFrame:
    """Each product with its spec, identifiers and facets as sorted arrays."""
    ids = identifiers.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("type", "value_key", "value", "origin"))).alias("identifiers"))
    fs = facets.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("attribute", "value"))).alias("facets"))
    return products.join(spec, "product_id").join(ids, "product_id", "left").join(fs, "product_id", "left")


def issue_report(issues: DataFrame, bound: int) -> DataFrame:
    """Per (code, scope) the first ``bound`` samples, the total and how many were left out."""
    w = Window.partitionBy("code", "scope")
    out = issues.withColumn("n", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy("sample")))
    return out.filter(F.col("nth") <= bound).select("code", "scope", "sample", "n", F.greatest(F.col("n") - bound, F.lit(0)).alias("omitted"))
