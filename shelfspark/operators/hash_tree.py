"""Comparing two keyed tables by trees of hashes: nodes are the first digits of the key's hash, a node's
hash sums its rows' hashes, and a comparison goes down only where nodes differ. Equal tables are told
by their roots; otherwise only the rows of leaves that differ meet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import stored

LEVELS = (0, 1, 3, 5)  # hexadecimal digits: 1, 16, 4,096 and a million nodes


@dataclass(frozen=True)
class Tree:
    """``rows`` (key, h, leaf) and ``nodes`` (level, node, n, s, t) of a table."""

    rows: DataFrame
    nodes: DataFrame


def tree(table: DataFrame, key: str, h: str) -> Tree:
    """The tree of ``table`` by ``key`` with row hashes ``h``; both parts are stored, as every level of a comparison reads
    them. Two sums of independent hashes and the number of rows make a node's hash; upper levels add up the lower."""
    digits = F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, LEVELS[-1])
    rows = stored(table.select(F.col(key).alias("key"), F.col(h).alias("h"), F.coalesce(digits, F.lit("0" * LEVELS[-1])).alias("leaf")))
    sums = [F.sum(F.xxhash64(F.lit(i), "key", "h").cast("decimal(38,0)")) for i in (1, 2)]
    now = rows.groupBy(F.col("leaf").alias("node")).agg(F.count("*").alias("n"), sums[0].alias("s"), sums[1].alias("t"))
    levels = stored(now.withColumn("level", F.lit(len(LEVELS) - 1)))
    upper = [F.struct(F.lit(i).alias("level"), F.substring("node", 1, d).alias("node")) for i, d in enumerate(LEVELS[:-1])]
    above = levels.select("n", "s", "t", F.inline(F.array(*upper))).groupBy("level", "node").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("t").cast("decimal(38,0)").alias("t"))
    return Tree(rows, levels.unionByName(above))


def differences(want: Tree, got: Tree) -> tuple[DataFrame, list[int]]:
    """((key, status): missing, extra or differs, for every key that is not the same on both sides), and how
    many nodes each level of the comparison opened; it stops at the first level without any."""
    opened: list[int] = []
    differ = None
    for level, digits in enumerate(LEVELS):
        a, b = (t.nodes.filter(F.col("level") == level).drop("level") for t in (want, got))
        if differ is not None:
            above = F.substring("node", 1, LEVELS[level - 1])
            a, b = (x.join(differ.withColumnRenamed("node", "up"), above == F.col("up"), "left_semi") for x in (a, b))
        both = a.join(b.select("node", F.struct("n", "s", "t").alias("other")), "node", "full_outer")
        differ = stored(both.filter(~F.struct("n", "s", "t").eqNullSafe(F.col("other"))).select("node"))
        opened.append(differ.count())
        if not opened[-1]:
            break
    rows = [t.rows.join(differ.withColumnRenamed("node", "leaf"), "leaf", "left_semi") if opened[-1] else t.rows.limit(0) for t in (want, got)]
    # equal keys of a table stand as often as they do: rows are compared as multisets of hashes
    left, right = (r.groupBy("key").agg(F.array_sort(F.collect_list("h")).alias("h")) for r in rows)
    met = left.join(right.withColumnRenamed("h", "other"), "key", "full_outer").filter(~F.col("h").eqNullSafe(F.col("other")))
    status = F.when(F.col("other").isNull(), "missing").when(F.col("h").isNull(), "extra").otherwise("differs")
    return met.select("key", status.alias("status")), opened
