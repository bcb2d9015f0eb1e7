"""Marketplace offers: candidates, normalization, deduplication, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import gtin_check
from .order import running_max, stored
from .ranges import in_ranges

FOREVER = 2**63 - 1  # the end of a summary without one


def lookup_candidates(identifiers: DataFrame, most: int = 3) -> DataFrame:
    """(product_id, rank, code): up to ``most`` checked barcodes of each product: jan before ean,
    region jp before all, local before upstream, then by code; distinct before the limit."""
    ok = identifiers.filter(F.col("type").isin("jan", "ean") & gtin_check(F.col("value_key")))
    rank = F.struct(F.when(F.col("type") == "jan", 0).otherwise(1), F.when(F.col("region") == "jp", 0).otherwise(1), F.when(F.col("origin") == "local", 0).otherwise(1))
    one = ok.groupBy("product_id", F.col("value_key").alias("code")).agg(F.min(rank).alias("r"))
    w = Window.partitionBy("product_id").orderBy("r", "code")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("product_id", "rank", "code")


def normalize(hits: DataFrame) -> DataFrame:
    """In-stock, new offers with the asked code; one malformed hit rejects its whole response."""
    bad = hits.groupBy("response_id").agg(F.bool_or(F.col("price").isNull() | (F.col("price") <= 0) | F.col("seller_id").isNull()).alias("bad")).filter("bad")
    return hits.filter((F.col("code") == F.col("asked")) & F.col("in_stock") & (F.col("condition") == "new")).join(bad, "response_id", "left_anti")


def dedupe(offers: DataFrame, keys: list[str]) -> DataFrame:
    """One offer per key: the lowest price, then the smallest offer id."""
    w = Window.partitionBy(*keys).orderBy("price", "offer_id")
    return offers.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def tag_sellers(offers: DataFrame, shops: DataFrame) -> DataFrame:
    return offers.join(shops, "seller_id", "left")


def first_nonempty(candidates: DataFrame, offers: DataFrame) -> DataFrame:
    """(product_id, code, n, fetched_at): the first candidate in order that has offers, never a
    union; freshness is the earliest of the candidates tried up to it."""
    per = offers.groupBy("product_id", "code").agg(F.count_if("keep").alias("n"), F.min("fetched_at").alias("fetched_at"))
    j = candidates.join(per, ["product_id", "code"], "left").fillna(0, ["n"])
    w = Window.partitionBy("product_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    tried = j.withColumn("fresh", F.min("fetched_at").over(w))
    first = tried.filter("n > 0").groupBy("product_id").agg(F.min_by(F.struct("code", "n", "fresh"), "rank").alias("f"))
    return first.select("product_id", "f.code", "f.n", F.col("f.fresh").alias("fetched_at"))


def summary(products: DataFrame, offers: DataFrame) -> DataFrame:
    """(product_id, status, lowest_price, offer_count)."""
    per = offers.groupBy("product_id").agg(F.min("price").alias("lowest_price"), F.count("*").alias("offer_count"))
    j = products.join(per, "product_id", "left")
    status = F.when(~F.col("supported"), "unsupported").when(F.col("offer_count").isNull(), "empty").otherwise("complete")
    price = F.when(F.col("supported"), F.col("lowest_price"))
    return j.select("product_id", status.alias("status"), price.alias("lowest_price"), F.when(F.col("supported"), F.coalesce("offer_count", F.lit(0))).otherwise(0).cast("long").alias("offer_count"))


def newest(summaries: DataFrame, products: DataFrame) -> DataFrame:
    """The newest observation of each product (ties: the later fetch); inactive ones rejected."""
    w = Window.partitionBy("product_id").orderBy(F.desc("observed_at"), F.desc("fetched_at"))
    ok = summaries.join(products.filter("active = 1"), "product_id", "left_semi")
    return ok.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def lookup(asked: DataFrame, products: DataFrame, summaries: DataFrame) -> DataFrame:
    """(pos, product_id, status, lowest_price, offer_count, fetched_at) for ``asked`` (pos, product_id, asked_at, epoch,
    generation). A summary counts while observed_at <= asked_at < expires_at within its epoch and
    generation, the newest first: complete, empty or unsupported; otherwise the product is pending, and missing where it is not
    active. Summaries and times stand in one order within (product, epoch, generation): the newest summary up to a time answers
    it unless it has ended. Only times that an older summary with a later end still covers meet validity
    intervals, by equality of cells, so that a product with many summaries is not compared row by row."""
    same = ["product_id", "epoch", "generation"]
    keyed = " and ".join(f"{x} is not null" for x in same)
    s = F.struct("observed_at", "fetched_at", "status", "lowest_price", "offer_count")
    until = F.coalesce(F.unix_micros("expires_at"), F.lit(FOREVER))  # the end itself is outside
    valid = summaries.filter(keyed).select(*same, F.unix_micros("observed_at").alias("at"), until.alias("until"), s.alias("s"))
    times = asked.filter(f"{keyed} and asked_at is not null").select("pos", *same, F.unix_micros("asked_at").alias("at"))
    none = lambda c: F.lit(None).cast(valid.schema[c].dataType).alias(c)
    rows = valid.select(F.lit(None).cast(times.schema["pos"].dataType).alias("pos"), *same, "at", F.lit(0).alias("kind"), "until", "s")
    rows = rows.unionByName(times.select("pos", *same, "at", F.lit(1).alias("kind"), none("until"), none("s")))
    newest_ = F.when(F.col("kind") == 0, F.struct("s", "until"))
    order = [F.col("at"), F.col("kind"), F.coalesce("pos", F.xxhash64("s"))]
    placed = running_max(rows, same, order, {"newest": newest_, "last_end": F.col("until")}).filter("kind = 1")
    live = placed.withColumn("open", F.col("newest.until") > F.col("at"))
    direct = live.filter("open").select("pos", F.col("newest.s").alias("s"))
    late = stored(live.filter("not open and last_end > at").select("pos", *same, "at"))
    found = direct
    if not late.isEmpty():
        covered = valid.join(late.select(*same).distinct(), same, "left_semi")
        number = lambda c: F.col(c) / 1e6
        spans = covered.select(*same, number("at").alias("low"), F.when(F.col("until") < FOREVER, (F.col("until") - 1) / 1e6).alias("high"), "s")
        found = direct.unionByName(in_ranges(late.select("pos", *same, number("at").alias("number")), spans, same).select("pos", "s"))
    found = found.groupBy("pos").agg(F.max("s").alias("s"))
    known = asked.select("pos", "product_id").join(products.filter("active = 1").select("product_id", F.lit(True).alias("known")), "product_id", "left").join(found, "pos", "left")
    status = F.when(F.col("known").isNull(), "missing").otherwise(F.coalesce("s.status", F.lit("pending")))
    return known.select("pos", "product_id", status.alias("status"), *[F.when(F.col("known"), F.col(f"s.{x}")).alias(x) for x in ("lowest_price", "offer_count", "fetched_at")])
