"""Whole texts are shuffled only where a join asks for them."""

import random

from pyspark.sql import functions as F

from shelfspark.llm import chosen_path, common


def _shuffled(spark, run) -> int:
    """Bytes that the stages of ``run`` write to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    seen = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(i) for found in [store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)] for i in range(found.size()))}
    before = seen()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in seen().items() if k not in before)


def test_the_join_leaves_texts_without_partners_where_they_are(spark):
    made = random.Random(5)
    texts = [" ".join(f"{made.getrandbits(48):x}" for _ in range(1500)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, texts[3] + " end"), (7, texts[7]), (7, "one two three")]
    docs = common.materialize(spark.createDataFrame(rows, "doc_id long, text string"))
    size = docs.agg(F.sum(F.length("text"))).first()[0]
    kept, was = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = _shuffled(spark, lambda: kept.extend(chosen_path.deduplicated(docs).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted({r for r in rows if r[0] != 500})
    assert moved < 0.5 * size


def test_flagged_misses_no_key(spark):
    keys = spark.range(0, 9000, 3).select((F.col("id") * 7919 - 11_000_000).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"))
    others = spark.range(9000).select((F.col("id") + 10**12).alias("a"), F.lit(None).cast("long").alias("b"))
    count = lambda rows, **more: common.flagged(rows, keys, ["a", "b"], "hit", **more).filter("hit").count()
    assert count(keys) == 3000
    assert count(others) < 0.1 * 9000
    assert count(keys, most=1) == 3000  # a full map asks for more rows, but for no fewer
    assert common.flagged(others, keys.limit(0), ["a", "b"], "hit").filter("not hit").count() == 9000
