"""Hash trees, prefix intervals and summaries as of a time, against plain comparison."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shelfspark.operators import hash_tree, offers, search


def _tree(spark, rows):
    return hash_tree.tree(spark.createDataFrame(rows, "k string, h string"), "k", "h")


def test_equal_tables_stop_at_the_root(spark):
    rows = [(f"k{i}", str(i)) for i in range(500)] + [(None, "n"), ("twice", "a"), ("twice", "b")]
    found, opened = hash_tree.differences(_tree(spark, rows), _tree(spark, rows[::-1]))
    assert opened == [0] and found.count() == 0
    found, opened = hash_tree.differences(_tree(spark, []), _tree(spark, []))
    assert opened == [0] and found.count() == 0


def test_planted_rows_are_found_and_little_else_is_opened(spark):
    rows = [(f"k{i}", str(i)) for i in range(2000)]
    other = [r for r in rows if r[0] != "k7"] + [("new", "x")]
    other = [(k, "changed" if k == "k1999" else h) for k, h in other] + [("k3", "3")]  # k3 stands twice now
    found, opened = hash_tree.differences(_tree(spark, rows), _tree(spark, other))
    assert sorted(tuple(r) for r in found.collect()) == [("k1999", "differs"), ("k3", "differs"), ("k7", "missing"), ("new", "extra")]
    assert opened[0] == 1 and opened[1] <= 4 and opened[-1] == 4
    found, _ = hash_tree.differences(_tree(spark, rows[:5]), _tree(spark, []))
    assert {r["status"] for r in found.collect()} == {"missing"} and found.count() == 5


def test_prefix_terms_against_startswith(spark):
    rng = random.Random(6)
    words = {(c, "".join(rng.choices("abé1𝒳", k=rng.randrange(1, 5)))) for c in "xy" for _ in range(150)}
    asked = {(c, "".join(rng.choices("abé1𝒳", k=rng.randrange(1, 4)))) for c in "xyz" for _ in range(30)}
    got = search.prefix_terms(spark.createDataFrame(sorted(words), "category string, term string"), spark.createDataFrame(sorted(asked), "category string, prefix string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((c, p, t) for c, p in asked for d, t in words if c == d and t.startswith(p))


def test_lookup_as_of_a_time(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    kept = [(1, 1, "g", "complete", 10, 2, at(0), at(0), at(10)), (1, 1, "g", "empty", None, 0, at(4), at(4), at(6)), (1, 2, "g", "complete", 99, 9, at(0), at(0), at(99)), (2, 1, "g", "unsupported", None, 0, at(0), at(0), at(10)), (3, 1, "g", "complete", 5, 1, at(0), at(0), at(10))]
    summaries = spark.createDataFrame(kept, "product_id long, epoch int, generation string, status string, lowest_price long, offer_count long, fetched_at timestamp, observed_at timestamp, expires_at timestamp")
    products = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1)], "product_id long, active int")
    asked = [(1, 1, 3, 1, "g"), (2, 1, 5, 1, "g"), (3, 1, 6, 1, "g"), (4, 1, 10, 1, "g"), (5, 1, 3, 2, "g"), (6, 1, 3, 3, "g"), (7, 1, 3, 1, "h"), (8, 2, 3, 1, "g"), (9, 3, 3, 1, "g"), (10, 4, 3, 1, "g"), (11, 9, 3, 1, "g"), (12, 1, -1, 1, "g"), (13, 1, 0, 1, "g")]
    rows = spark.createDataFrame([(p, i, at(h), e, g) for p, i, h, e, g in asked], "pos long, product_id long, asked_at timestamp, epoch int, generation string")
    got = {r["pos"]: (r["status"], r["lowest_price"], r["offer_count"]) for r in offers.lookup(rows, products, summaries).collect()}
    none = (None, None)
    assert got == {1: ("complete", 10, 2), 2: ("empty", None, 0), 3: ("complete", 10, 2), 4: ("pending", *none), 5: ("complete", 99, 9), 6: ("pending", *none), 7: ("pending", *none), 8: ("unsupported", None, 0), 9: ("missing", *none), 10: ("pending", *none), 11: ("missing", *none), 12: ("pending", *none), 13: ("complete", 10, 2)}
    assert offers.lookup(rows, products, summaries.filter(F.lit(False))).filter("status = 'complete'").count() == 0


def test_lookup_meets_cells_only_where_an_older_summary_outlasts_a_newer_one(spark):
    rng = random.Random(3)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    kept = [(rng.randrange(4), i, rng.randrange(3000), rng.choice([5, 400, 2500])) for i in range(300)]  # product, price, observed, lifetime
    asked = [(i, rng.randrange(5), rng.randrange(6000)) for i in range(300)]
    row = lambda p, i, s, life: (p, 1, "g", "complete", i, 1, at(s), at(s), at(s + life))
    schema = "product_id long, epoch int, generation string, status string, lowest_price long, offer_count long, fetched_at timestamp, observed_at timestamp, expires_at timestamp"
    products = spark.createDataFrame([(p, 1) for p in range(5)], "product_id long, active int")
    rows = spark.createDataFrame([(i, p, at(s), 1, "g") for i, p, s in asked], "pos long, product_id long, asked_at timestamp, epoch int, generation string")
    for lives in (lambda life: life, lambda life: 700):
        found = offers.lookup(rows, products, spark.createDataFrame([row(p, i, s, lives(life)) for p, i, s, life in kept], schema))
        want = {i: max(((o, price) for q, price, o, life in kept if q == p and o <= s < o + lives(life)), default=(None, None))[1] for i, p, s in asked}
        assert {r["pos"]: r["lowest_price"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # one lifetime for all: no summary is cut into cells
