"""Predicates over the catalog, for one request and for whole tables of requests; facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import in_ranges


def scope(products: DataFrame, category: str) -> DataFrame:
    return products.filter((F.col("category") == category) & (F.col("active") == 1))


def select_values(field: Column, values: list) -> Column:
    """Any of 1 to 20 values; null matches nothing."""
    if not 1 <= len(values) <= 20:
        raise ValueError("a selection has 1 to 20 values")
    return field.isin(values)


def within(field: Column, low=None, high=None) -> Column:
    """Inclusive range, open on either side; null is outside."""
    ok = field.isNotNull()
    ok = ok & (field >= low) if low is not None else ok
    return ok & (field <= high) if high is not None else ok


def has_facets(products: DataFrame, facets: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Products with any chosen value of every attribute."""
    for attribute, values in chosen.items():
        products = products.join(facets.filter((F.col("attribute") == attribute) & F.col("value").isin(values)), "product_id", "left_semi")
    return products


def has_identifier(products: DataFrame, identifiers: DataFrame, key: str, kind: str | None = None) -> DataFrame:
    hit = identifiers.filter(F.col("value_key") == key)
    return products.join(hit.filter(F.col("type") == kind) if kind else hit, "product_id", "left_semi")


def request_hits(values: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, product_id) of a whole table of requests in one job. ``requests``: (request_id,
    category, conditions array of (field, value, low, high)); a condition without a value is a
    range. ``values``: (product_id, category, field, value, number), several rows per field for
    facets. A product must meet every field of the request, any condition of a field. Ranges meet
    numbers by equality of cells (``ranges``), values by equality."""
    conditions = requests.select("request_id", "category", F.size(F.array_distinct(F.transform("conditions", lambda x: x["field"]))).alias("n"), F.inline("conditions"))
    equal = conditions.filter(F.col("value").isNotNull()).select("request_id", "category", "n", "field", "value")
    ranged = conditions.filter(F.col("value").isNull()).select("request_id", "category", "n", "field", "low", "high")
    hit = values.join(equal, ["category", "field", "value"]).select("request_id", "product_id", "n", "field")
    hit = hit.unionByName(in_ranges(values, ranged, ["category", "field"]).select("request_id", "product_id", "n", "field"))
    met = hit.groupBy("request_id", "product_id", "n").agg(F.count_distinct("field").alias("met"))
    return met.filter("met = n").select("request_id", "product_id")


def request_code(requests: DataFrame, fields: int = 8, per_field: int = 10, in_all: int = 40) -> DataFrame:
    """(request_id, code): the first complexity limit a request breaks, or 'ok'."""
    c = requests.select("request_id", F.explode_outer("conditions").alias("c")).select("request_id", "c.*")
    per = c.groupBy("request_id", "field").agg(F.count("*").alias("k"), F.bool_or(F.coalesce(F.col("low") > F.col("high"), F.lit(False))).alias("crossed"))
    total = per.groupBy("request_id").agg(F.count("field").alias("fields"), F.max("k").alias("most"), F.sum("k").alias("all"), F.bool_or("crossed").alias("crossed"))
    code = F.when(F.col("crossed"), "range_order").when(F.col("fields") > fields, "fields").when(F.col("most") > per_field, "values").when(F.col("all") > in_all, "total").otherwise("ok")
    return total.select("request_id", code.alias("code"))


def resolve_fields(spec: DataFrame, products: DataFrame, fields: list[str]) -> DataFrame:
    """Request fields from the category's spec where it has the column, else from the product."""
    joined = products.alias("p").join(spec.alias("s"), "product_id")
    return joined.select("product_id", *[F.col(f"s.{f}" if f in spec.columns else f"p.{f}").alias(f) for f in fields])


def failed_fields(conditions: dict[str, Column]) -> Column:
    """The condition fields that a row fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(f)) for f, ok in conditions.items()]))


def self_excluding_counts(rows: DataFrame, fields: list[str], conditions: dict[str, Column]) -> DataFrame:
    """(field, value, n) with each field counted under all conditions but its own, in one pass: a
    row counts for a field if it fails no other."""
    marked = rows.withColumn("__failed", failed_fields(conditions)).filter(F.size("__failed") <= 1)
    grouped = marked.groupBy("__failed", *fields).count()  # scalars are counted before the unpivot
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    flat = grouped.select("__failed", "count", F.inline(pairs)).filter(F.col("value").isNotNull())
    counts = flat.filter((F.size("__failed") == 0) | (F.element_at("__failed", 1) == F.col("field")))
    return counts.groupBy("field", "value").agg(F.sum("count").alias("n"))


def option_rows(rows: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """(keys..., field, value, n) for several fields in one pass."""
    grouped = rows.groupBy(*keys, *fields).count()
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return grouped.select(*keys, "count", F.inline(pairs)).filter(F.col("value").isNotNull()).groupBy(*keys, "field", "value").agg(F.sum("count").alias("n"))


def valid_option(value: Column, max_length: int = 200) -> Column:
    return value.isNotNull() & (F.trim(value) != "") & (F.length(value) <= max_length)


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)
