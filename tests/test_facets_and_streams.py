"""Facet counts of request tables against counts of hits, and streams that run again or empty."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shelfspark.operators import facet_bits, filters
from shelfspark.operators import sync as S
from shelfspark.streaming import jobs
from shelfspark.streaming.store import BucketStore

CONDITION = "array<struct<field: string, value: string, low: double, high: double>>"


def test_bitmap_counts_equal_counts_of_hits(spark):
    rng = random.Random(2)
    products = [(i if i % 9 else -i, "xy"[i % 2], rng.choice("abc"), rng.randrange(20) if rng.random() < 0.9 else None, rng.sample("pqrs", rng.randrange(3))) for i in range(1, 400)]
    rows = []
    for pid, cat, brand, size, tags in products:
        rows.append((pid, cat, "brand", brand, None))
        rows += [(pid, cat, "size", str(size), float(size))] * 2 if size is not None else [(pid, cat, "size", None, None)]
        rows += [(pid, cat, "tag", t, None) for t in tags]
    values = spark.createDataFrame(rows, "product_id long, category string, field string, value string, number double")
    asked = {1: ("x", []), 2: ("x", [("brand", "a", None, None), ("brand", "b", None, None)]), 3: ("y", [("size", None, 5.0, 12.0), ("tag", "p", None, None)]), 4: ("x", [("size", None, None, 3.0), ("size", None, 15.0, None), ("brand", "c", None, None), ("tag", "q", None, None)]), 5: ("y", [("brand", "none", None, None)]), 6: ("z", [])}
    requests = spark.createDataFrame([(k, c, conds) for k, (c, conds) in asked.items()], f"request_id long, category string, conditions {CONDITION}")

    def ok(p, field, conds):
        _, _, brand, size, tags = p
        if field == "brand":
            return any(brand == v for _, v, _, _ in conds)
        if field == "tag":
            return any(v in tags for _, v, _, _ in conds)
        return size is not None and any((lo is None or size >= lo) and (hi is None or size <= hi) for _, _, lo, hi in conds)

    for own in (False, True):
        want = {}
        for k, (cat, conds) in asked.items():
            by = {f: [c for c in conds if c[0] == f] for f in {c[0] for c in conds}}
            for p in products:
                for field, held in (("brand", [p[2]]), ("size", [str(p[3])] if p[3] is not None else []), ("tag", p[4])):
                    if p[1] == cat and all(ok(p, f, cs) for f, cs in by.items() if own or f != field):
                        for v in held:
                            want[k, field, v] = want.get((k, field, v), 0) + 1
        got = {(r["request_id"], r["field"], r["value"]): r["n"] for r in facet_bits.counts(values, requests, own).collect()}
        assert got == want
    hits = {r["request_id"]: r["n"] for r in filters.request_hits(values, requests.filter(F.size("conditions") > 0)).groupBy("request_id").agg(F.count("*").alias("n")).collect()}
    assert all(sum(n for (k, f, _), n in got.items() if k == q and f == "brand") == n for q, n in hits.items())
    assert facet_bits.counts(values.limit(0), requests).count() == 0 and facet_bits.counts(values, requests.limit(0)).count() == 0


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), "k", "k string, v long, version int", buckets=8)
    rows = lambda r: spark.createDataFrame(r, "k string, v long, version int")
    merge = lambda old, new: S.upsert(old, new, ["k"], "version")
    store.merge(rows([(f"k{i}", i, 0) for i in range(40)]), 0, lambda old, new: new)
    before = store.live()
    changed = store.merge(rows([("k1", 100, 1), ("new", 7, 1)]), 1, merge)
    assert 1 <= len(changed) <= 2 and {b for b, n in store.live().items() if n == 1} == set(changed) and all(store.live()[b] == 0 for b in before if b not in changed)
    want = sorted([(f"k{i}", i, 0) for i in range(40) if i != 1] + [("k1", 100, 1), ("new", 7, 1)])
    assert sorted(tuple(r) for r in store.read().collect()) == want
    assert store.merge(rows([("k2", 5, 9)]), 1, merge) == []  # the batch is done already
    assert store.merge(rows([("k1", 100, 1)]), 2, merge) == [] and store.merge(rows([]), 3, merge) == []
    assert sorted(tuple(r) for r in store.read().collect()) == want


def _events(spark, at):
    return spark.readStream.schema("ts timestamp, class string, cost double").option("maxFilesPerTrigger", 1).parquet(at)


def test_metrics_of_an_empty_stream(spark, tmp_path):
    (tmp_path / "none").mkdir()
    got = jobs.latest_updates(jobs.request_metrics(_events(spark, str(tmp_path / "none"))), "start", "class")
    assert got.count() == 0 and got.columns == ["start", "class", "requests", "cost", "largest"]
    assert jobs.latest_updates(jobs.budget_excess(_events(spark, str(tmp_path / "none")), 2), "start", "class").count() == 0


def test_windows_leave_the_state_and_late_rows_are_dropped(spark, tmp_path):
    """Forty hours in forty files, then a row forty hours late: the state holds the last windows alone."""
    base, at = dt.datetime(2024, 1, 1), str(tmp_path / "in")
    for h in [*range(40), -1]:
        when = base + dt.timedelta(hours=h if h >= 0 else 0, minutes=30)
        spark.createDataFrame([(when, "a", 1.0), (when, "a", 2.0)], "ts timestamp, class string, cost double").coalesce(1).write.mode("append").parquet(at)
    sizes, seen = [], {}
    stream = jobs.request_metrics(_events(spark, at))

    def each(batch, n):
        for r in batch.collect():
            seen[r["start"]] = r["requests"]

    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])
    assert len(seen) == 40 and set(seen.values()) == {2} and max(sizes) <= 4 and dropped >= 1


def _offer_stream(spark, at, files, start=None):
    """Each list of (product, epoch, offer, price, days, minutes) is one file, so one batch."""
    base = dt.datetime(2024, 1, 1)
    schema = "product_id long, epoch long, offer_id long, price long, observed_at timestamp"
    for rows in files:
        rows = [(p, e, o, price, base + dt.timedelta(days=d, minutes=m)) for p, e, o, price, d, m in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(at)


def test_offers_late_equal_expired_and_of_a_new_epoch(spark, tmp_path):
    files = [
        [(1, 1, 10, 100, 0, 0), (2, 1, 11, 200, 0, 0), (3, 1, 12, 300, 0, 0), (4, 5, 13, 400, 0, 0), (6, 1, 14, 600, 0, 0)],
        [(1, 1, 9, 90, 0, 0), (2, 1, 20, 190, 0, 0), (3, 2, 21, 310, 0, -5), (4, 4, 22, 410, 0, 9), (5, 1, 23, 500, 0, 9)],  # equal times: the higher offer; epochs before times
        [(1, 1, 30, 130, 1, 0), (1, 1, 31, 70, 0, 9), (None, 1, 32, 1, 1, 0), (7, None, 33, 1, 1, 0)],  # out of order within a batch; rows that lack something
        [(1, 1, 40, 999, 0, 8), (5, 1, 41, 510, 5, 0)],  # later than the watermark: dropped
        [(6, 1, 50, 610, 6, 0)],
        [(1, 1, 60, 160, 70, 0)],  # all others run out
    ]
    stream = jobs.offer_summary(_offer_stream(spark, str(tmp_path / "in"), files), ttl_days=60)
    before = spark.conf.get(jobs.STORE[0])
    got = {r["product_id"]: (r["epoch"], r["status"], r["lowest_price"]) for r in jobs.latest_updates(stream, "product_id").collect()}
    assert got == {1: (1, "complete", 160), 2: (1, "pending", None), 3: (2, "pending", None), 4: (5, "pending", None), 5: (1, "pending", None), 6: (1, "pending", None)}
    assert spark.conf.get(jobs.STORE[0]) == before
    stream = jobs.offer_summary(_offer_stream(spark, str(tmp_path / "short"), files[:5]), ttl_days=60)
    got = {r["product_id"]: (r["epoch"], r["status"], r["lowest_price"], r["observed_at"].day) for r in jobs.latest_updates(stream, "product_id").collect()}
    assert got == {1: (1, "complete", 130, 2), 2: (1, "complete", 190, 1), 3: (2, "complete", 310, 31), 4: (5, "complete", 400, 1), 5: (1, "complete", 510, 6), 6: (1, "complete", 610, 7)}


def test_offers_by_random_batches_equal_the_newest_of_all(spark, tmp_path):
    rng = random.Random(8)
    files = [[(rng.randrange(12), rng.randrange(3), 100 * n + i, rng.randrange(1, 999), 0, rng.randrange(9)) for i in range(15)] for n in range(4)]
    best = {}
    for p, e, o, price, _, m in (r for f in files for r in f):
        best[p] = max(best.get(p, (-1, -1, -1, 0)), (e, m, o, price))
    got = {r["product_id"]: (r["epoch"], r["lowest_price"]) for r in jobs.latest_updates(jobs.offer_summary(_offer_stream(spark, str(tmp_path / "in"), files)), "product_id").collect()}
    assert got == {p: (b[0], b[3]) for p, b in best.items()}
    (tmp_path / "none").mkdir()
    assert jobs.latest_updates(jobs.offer_summary(_offer_stream(spark, str(tmp_path / "none"), [])), "product_id").count() == 0
