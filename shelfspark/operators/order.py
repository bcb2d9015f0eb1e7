"""Positions in an order without a task that holds a whole group: rows are dealt into ranges, ranges
are numbered apart, and each range starts where those before it end."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshot import shared_dir


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its rows and partitions stand from then
    on, whatever is lost or run again."""
    at = f"{shared_dir(df.sparkSession)}/stored/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def ranges(rows: DataFrame, by: list[str], keys: list[Column]) -> DataFrame:
    """``rows`` with their sort keys ``__k0``, ... and the number ``__p`` of their range in the order
    of ``by``, then ``keys``; stored, so that every use sees the same ranges. Keys must be a total
    order within a group: a hot group spreads over ranges by them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    dealt = keyed.repartitionByRange(n, *by, *[f"__k{i}" for i in range(len(keys))])
    return stored(dealt.withColumn("__p", F.spark_partition_id()))


def _same(a: DataFrame, b: DataFrame, on: list[str]) -> Column:
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in on])


def ranked(rows: DataFrame, by: list[str], keys: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... in the order of ``keys`` within each group ``by``."""
    dealt = ranges(rows, by, keys)
    order = [F.col(f"__k{i}") for i in range(len(keys))]
    local = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__p", *by).orderBy(*order)))
    sizes = dealt.groupBy("__p", *by).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))).drop("__n")  # at most a row for each range and for each group
    joined = local.join(before, _same(local, before, ["__p", *by]))
    return joined.select(*[local[c] for c in rows.columns], (F.col("__before") + F.col("__r")).alias(name))


def previous(rows: DataFrame, by: list[str], keys: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: ``value`` of the row before in the same order, across ranges too."""
    dealt = ranges(rows, by, keys).withColumn("__v", value)
    order = [F.col(f"__k{i}") for i in range(len(keys))]
    w = Window.partitionBy("__p", *by).orderBy(*order)
    local = dealt.withColumn("__before", F.lag("__v").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    last = dealt.groupBy("__p", *by).agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    last = last.withColumn("__end", F.lag("__last").over(Window.partitionBy(*by).orderBy("__p"))).drop("__last")
    joined = local.join(last, _same(local, last, ["__p", *by]))
    return joined.select(*[local[c] for c in rows.columns], F.when(F.col("__first"), F.col("__end")).otherwise(F.col("__before")).alias(name))


def running_max(rows: DataFrame, by: list[str], keys: list[Column], values: dict[str, Column]) -> DataFrame:
    """``rows`` with each of ``values``: its largest one of the rows up to this one in the order of ``keys``
    within each group, across ranges too."""
    dealt = ranges(rows.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()]), by, keys)
    upto = Window.partitionBy("__p", *by).orderBy(*[F.col(f"__k{i}") for i in range(len(keys))]).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *[F.max(f"__v_{n}").over(upto).alias(f"__upto_{n}") for n in values])
    last = dealt.groupBy("__p", *by).agg(*[F.max(f"__v_{n}").alias(f"__last_{n}") for n in values])
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each range and for each group
    last = last.select("__p", *by, *[F.max(f"__last_{n}").over(before).alias(f"__before_{n}") for n in values])
    joined = local.join(last.hint("merge"), _same(local, last, ["__p", *by]))
    return joined.select(*[local[c] for c in rows.columns], *[F.greatest(f"__upto_{n}", f"__before_{n}").alias(n) for n in values])


def nearest_rank(rows: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles and the maximum per group (never interpolated). Values are counted
    first; running sums are taken per range and start at the counts of the ranges before."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    dealt = ranges(counts, [by], [F.col(value)])
    local = dealt.withColumn("__upto", F.sum("n").over(Window.partitionBy("__p", by).orderBy(value)))
    sizes = dealt.groupBy("__p", by).agg(F.sum("n").alias("__n"))
    w = Window.partitionBy(by)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__n").over(w)).drop("__n")
    joined = local.join(sizes, _same(local, sizes, ["__p", by])).select(local[by].alias(by), local[value].alias(value), (F.col("__before") + F.col("__upto")).alias("upto"), "__all")
    cols = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("__all"))), F.col(value))).alias(name) for name, q in quantiles.items()]
    return joined.groupBy(by).agg(*cols, F.max(value).alias("largest"))


def fingerprint(rows: DataFrame, text: Column, by: str, levels: tuple[int, ...] = (6, 3)) -> DataFrame:
    """(by, rows, digest): order-independent, by a tree of hashes. A row's hash goes to the node of
    its first hexadecimal digits; nodes hash their sorted members, level by level, so that an array
    holds one node's members and never a whole group (with ``levels`` 6 and 3: the rows of 1 in
    16 million, then 4,096 nodes twice)."""
    now = rows.select(by, F.sha2(text.cast("binary"), 256).alias("h")).select(by, F.col("h").alias("place"), "h", F.lit(1).cast("long").alias("n"))
    for digits in (*levels, 0):
        node = F.substring("place", 1, digits)
        tied = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "h"))), lambda x: x["h"]), "")
        now = now.groupBy(by, node.alias("place")).agg(F.sha2(tied.cast("binary"), 256).alias("h"), F.sum("n").alias("n"))
    return now.select(by, F.col("n").alias("rows"), F.col("h").alias("digest"))
