"""The segment index, range cells, and answers that follow their tables."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import filters, ranges
from shelfspark.operators.search import postings
from shelfspark.operators.segments import SegmentIndex
from shelfspark.plans import registry


def _docs(spark, rows):
    return spark.createDataFrame(rows, "category string, id long, name string, note string")


def _rows(df):
    return sorted(tuple(r) for r in df.select("category", "doc", "field", "pos", "term").collect())


def _files(spark, path):
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return {(r["path"], r["modificationTime"]) for r in listed.select("path", "modificationTime").collect()}


def test_index_follows_its_documents(spark, tmp_path):
    index, fields = SegmentIndex(spark, str(tmp_path / "i"), buckets=4), ["name", "note"]
    assert index.read().count() == 0 and index.source() is None
    first = [("a", 1, "red ring", "x1"), ("a", 2, "blue ring", None), ("b", 1, "red gear", ""), ("b", 3, None, None)]
    assert index.sync(_docs(spark, first), "id", fields, "v1")
    assert _rows(index.read()) == _rows(postings(_docs(spark, first), "id", fields))
    before = _files(spark, str(tmp_path / "i" / "postings"))
    assert not index.sync(_docs(spark, first), "id", fields, "v1") and not index.sync(_docs(spark, first), "id", fields, "v2")
    assert _files(spark, str(tmp_path / "i" / "postings")) == before and index.source() == "v2"
    second = [("a", 1, "green ring", "x1"), ("b", 1, "red gear", ""), ("b", 2, "red ring", None), ("a", 3, "new", None)]  # changed, gone, moved and new
    assert index.sync(_docs(spark, second), "id", fields, "v3")
    assert _rows(index.read()) == _rows(postings(_docs(spark, second), "id", fields))
    after = _files(spark, str(tmp_path / "i" / "postings"))
    assert before < after  # nothing was rewritten
    third = first
    index.sync(_docs(spark, third), "id", fields, "v4")
    assert _rows(index.read()) == _rows(postings(_docs(spark, third), "id", fields))  # back again: tombstones end only what stood before them
    assert index.sync(_docs(spark, []), "id", fields, "v5") and index.read().count() == 0


def test_merge_rewrites_only_buckets_of_many_segments(spark, tmp_path):
    index = SegmentIndex(spark, str(tmp_path / "i"), buckets=8)
    docs = {i: ("a", i, f"common w{i}", None) for i in range(6)}
    for n in range(4):
        docs[n] = ("a", n, f"common v{n}", None)
        index.sync(_docs(spark, list(docs.values())), "id", ["name"], f"v{n}")
    want = _rows(postings(_docs(spark, list(docs.values())), "id", ["name"]))
    before = _files(spark, str(tmp_path / "i" / "postings"))
    chosen = index.merge(most=3)
    common = spark.range(1).select(index.bucket(F.lit("common"))).first()[0]
    assert ("a", common) in chosen and len(chosen) < 8
    assert _rows(index.read()) == want and before < _files(spark, str(tmp_path / "i" / "postings"))
    assert {(r["category"], r["bucket"]) for r in index.live() if r["kind"] == "postings" and r["n"] == 5} == set(chosen)
    assert index.merge(most=3) == []
    docs[0] = ("a", 0, "other", None)
    index.sync(_docs(spark, list(docs.values())), "id", ["name"], "later")
    assert _rows(index.read()) == _rows(postings(_docs(spark, list(docs.values())), "id", ["name"]))


def test_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    index = SegmentIndex(spark, str(tmp_path / "i"), buckets=8)
    index.sync(_docs(spark, [("a", i, f"w{i}", None) for i in range(40)] + [("b", 1, "w1", None)]), "id", ["name"], "v")
    asked = index.read(categories=["a"], terms=["w1"])
    assert [(r["category"], r["doc"]) for r in asked.collect()] == [("a", 1)]
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "category" in plan.split("PartitionFilters")[1].split("]")[0]


@pytest.mark.parametrize("name", ["build_postings", "corpus_stats", "match_all", "hit_mrr", "topk_search", "parse_intent"])
def test_queries_answer_from_the_table_as_it_is(spark, tmp_path, name):
    """One session, one folder: the tables grow between two calls, and so does the answer."""
    source = "/root/testdata/sf0.001"
    for t in ("part", "documents", "benchmark", "customer", "supplier", "lineitem"):
        whole = spark.read.parquet(f"{source}/{t}.parquet")
        whole.limit(40 if t in ("part", "documents", "customer") else 10**9).write.parquet(str(tmp_path / f"{t}.parquet"))
    first = registry.queries()[name](spark, str(tmp_path)).collect()
    for t in ("part", "documents", "customer"):
        spark.read.parquet(f"{source}/{t}.parquet").write.mode("overwrite").parquet(str(tmp_path / f"{t}.parquet"))
    again = sorted(map(str, registry.queries()[name](spark, str(tmp_path)).collect()))
    assert again == sorted(map(str, registry.queries()[name](spark, source).collect())) and again != sorted(map(str, first))


def test_range_cells_against_comparison(spark):
    rng = random.Random(4)
    pick = lambda: rng.choice([None, rng.uniform(-50, 50), float(rng.randrange(-300, 300)), rng.uniform(-1, 1) * 10 ** rng.randrange(12), 0.0, -0.5, float(ranges.EDGE), -float(ranges.EDGE) - 1])
    values = spark.createDataFrame([(i, "ab"[i % 2], pick()) for i in range(300)] + [(900, "a", float("nan"))], "id long, k string, number double")
    asked = spark.createDataFrame([(i, "ab"[i % 2], pick(), pick()) for i in range(200)] + [(901, "a", 5.0, 4.0), (902, "a", None, None)], "r long, k string, low double, high double")
    got = sorted((r["id"], r["r"]) for r in ranges.in_ranges(values, asked, ["k"]).select("id", "r").collect())
    inside = lambda x, lo, hi: x is not None and x == x and (lo is None or x >= lo) and (hi is None or x <= hi)
    want = sorted((v["id"], a["r"]) for v in values.collect() for a in asked.collect() if v["k"] == a["k"] and inside(v["number"], a["low"], a["high"]))
    assert got == want and len(want) > 1000
    most = asked.select(F.size(ranges.cells_of_range(F.col("low"), F.col("high"))).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 2 * (ranges.BASE - 1) * ranges.LEVELS + 4


def test_requests_never_pair_all_numbers_with_all_ranges(spark):
    """One narrow range each over many products of one category: rows met stay near the hits."""
    values = spark.range(4000).selectExpr("id AS product_id", "'c' AS category", "'size' AS field", "CAST(NULL AS STRING) AS value", "CAST(id AS DOUBLE) AS number")
    asked = spark.range(500).selectExpr("id AS request_id", "'c' AS category", "array(named_struct('field', 'size', 'value', CAST(NULL AS STRING), 'low', CAST(id * 8 AS DOUBLE), 'high', CAST(id * 8 + 3 AS DOUBLE))) AS conditions")
    assert filters.request_hits(values, asked).count() == 2000
    placed = values.select(F.inline(ranges.cells_of_number(F.col("number"))))
    cells = asked.select(F.inline(ranges.cells_of_range(F.col("conditions")[0]["low"], F.col("conditions")[0]["high"])))
    assert placed.join(cells, ["level", "cell"]).count() <= 2 * 2000
