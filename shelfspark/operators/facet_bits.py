"""Facet counts for a whole table of requests, on a bitmap index: for each (category, field, value) one
64-bit word for every 64 product ids that holds any of them. Conditions are unions of value bitmaps,
candidates their intersections, and counts the set bits of candidate and value words that meet by
equality, so that products are never listed again for a request. Each field is counted without its
own conditions where asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import stored
from .ranges import in_ranges

KEY = ["category", "field", "value"]
_WORD, _BIT = "shiftright(product_id, 6)", "shiftleft(1L, CAST(pmod(product_id, 64) AS INT))"


def index(values: DataFrame) -> DataFrame:
    """(category, field, value, number, word, bits) of ``values`` (product_id, category, field, value,
    number); several rows of a product and field are its facets. Repeated rows change nothing."""
    rows = values.filter("value is not null and product_id is not null")
    return rows.groupBy(*KEY, "number", F.expr(_WORD).alias("word")).agg(F.expr(f"bit_or({_BIT})").alias("bits"))


def everything(values: DataFrame) -> DataFrame:
    """(category, word, bits) of all products."""
    rows = values.filter("product_id is not null")
    return rows.groupBy("category", F.expr(_WORD).alias("word")).agg(F.expr(f"bit_or({_BIT})").alias("bits"))


def chosen(held: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, field, word, bits): for every conditioned field the products that meet any of its
    conditions. ``requests``: (request_id, category, conditions array of (field, value, low, high));
    a condition without a value is a range."""
    conditions = requests.select("request_id", "category", F.inline("conditions"))
    equal = held.join(conditions.filter("value is not null").select("request_id", *KEY), KEY)
    ranged = in_ranges(held, conditions.filter("value is null").select("request_id", "category", "field", "low", "high"), ["category", "field"])
    both = equal.select("request_id", "field", "word", "bits").unionByName(ranged.select("request_id", "field", "word", "bits"))
    return both.groupBy("request_id", "field", "word").agg(F.expr("bit_or(bits)").alias("bits"))


def counts(values: DataFrame, requests: DataFrame, own: bool = False) -> DataFrame:
    """(request_id, field, value, n) of every field and value of a request's category with any product
    under the request's conditions; without those of the counted field itself, if ``own`` is false."""
    held = stored(index(values))  # it feeds conditions, fields and counts
    met = chosen(held, requests)
    asked = requests.select("request_id", "category", F.array_distinct(F.transform("conditions", lambda x: x["field"])).alias("fields"))
    none = F.lit("")  # no field is left out (a field has a name)
    targets = asked.select("request_id", "category", F.size("fields").alias("all"), F.explode(F.array(none) if own else F.array_append("fields", none)).alias("left_out"))
    # a candidate word is the intersection of the words of all products and of every condition that counts
    base = targets.join(everything(values), "category").select("request_id", "left_out", "word", "bits")
    other = targets.select("request_id", "left_out").join(met, "request_id").filter("field <> left_out").select("request_id", "left_out", "word", "bits")
    need = targets.select("request_id", "category", "left_out", (F.col("all") + F.when(F.col("left_out") == none, 1).otherwise(0)).alias("need"))
    words = base.unionByName(other).groupBy("request_id", "left_out", "word").agg(F.expr("bit_and(bits)").alias("candidate"), F.count("*").alias("n")).filter("candidate <> 0")
    joined = words.join(need, ["request_id", "left_out"]).filter("n = need").select("request_id", "left_out", "category", "word", "candidate")
    # each of a category's fields is counted on the candidates that leave it out, or else on those of all conditions
    fields = asked.join(held.select("category", "field").distinct(), "category")
    side = fields.select("request_id", "field", F.when(F.lit(not own) & F.array_contains("fields", F.col("field")), F.col("field")).otherwise(none).alias("left_out"))
    placed = joined.join(side, ["request_id", "left_out"]).select("request_id", "category", "field", "word", "candidate")
    hit = placed.join(held, ["category", "field", "word"]).withColumn("n", F.bit_count(F.col("candidate").bitwiseAND(F.col("bits"))))
    return hit.groupBy("request_id", "field", "value").agg(F.sum("n").cast("long").alias("n")).filter("n > 0")
