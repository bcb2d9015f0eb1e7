"""Rules that the given tables do not show: nulls, empty inputs, idempotence, isolation."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import columns as C
from shelfspark.operators import contract, filters, intents, order, search, sync
from shelfspark.sources import snapshot


def test_text_and_keys(spark):
    rows = spark.createDataFrame([(" a  b ",), ("   ",), (None,), ("ｆｕｌｌ a",)], "s string")
    got = rows.select(C.clean_text(F.col("s")), C.identifier_key(F.col("s"), normalized=False)).collect()
    assert [r[0] for r in got] == ["a b", None, None, "ｆｕｌｌ a"]
    assert [r[1] for r in got] == ["A  B", "", None, "FULL A"]


def test_missing_is_null_or_blank_only(spark):
    rows = spark.createDataFrame([("0",), ("None",), ("",), (" ",), (None,)], "s string")
    assert [r[0] for r in rows.select(C.missing(F.col("s"))).collect()] == [False, False, True, True, True]


@pytest.mark.parametrize(("code", "ok"), [("4006381333931", True), ("4006381333932", False), ("0000000000000", False), ("96385074", True), ("x", False)])
def test_gtin(spark, code, ok):
    assert spark.createDataFrame([(code,)], "c string").select(C.gtin_check(F.col("c"))).first()[0] is ok


def test_quarantine_survives_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None), ("x", "name", "{}"), ("0b6c1d2e-0000-4000-8000-000000000000", "--", "{}"), ("0b6c1d2e-0000-4000-8000-000000000000", "ok", "{}")], "upstream_key string, name string, raw string")
    assert [r["code"] for r in contract.reject_code(rows, 10).collect()] == ["invalid_key", "invalid_key", "invalid_name", "accepted"]


def test_invariant_violation_fails(spark):
    with pytest.raises(Exception, match="invariant"):
        contract.invariants(spark.range(3), {"id": F.col("id") > 0}).collect()


def test_facet_counts_equal_search_counts(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i % 3, None if i % 4 else i) for i in range(40)], "product_id long, brand string, size long, year long")
    cond = {"brand": F.col("brand") == "a", "size": F.col("size") == 1}
    got = {(r["field"], r["value"]): r["n"] for r in filters.self_excluding_counts(rows, ["brand", "size", "year"], cond).collect()}
    assert got[("brand", "b")] == rows.filter("size = 1 and brand = 'b'").count()
    assert got[("size", "2")] == rows.filter("brand = 'a' and size = 2").count()
    assert sum(n for (f, _), n in got.items() if f == "year") == rows.filter("brand = 'a' and size = 1 and year is not null").count()


def _store(spark):
    cols = "upstream_key string, category string, name string, price double, active int"
    return spark.createDataFrame([("a", "x", "A", 1.0, 1), ("b", "x", "B", 2.0, 1), ("c", "x", "C", 3.0, 0), ("d", "held", "D", 4.0, 1)], cols)


def test_apply_is_idempotent_and_never_deletes_held(spark):
    stored = _store(spark)
    new = spark.createDataFrame([("a", "x", "A2", 1.0), ("c", "x", "C", 3.0), ("n", "x", "N", 9.0)], "upstream_key string, category string, name string, price double")
    held = spark.createDataFrame([("held",)], "category string")
    planned = sync.plan(stored, new, new, held)
    assert {r["upstream_key"]: r["mode"] for r in planned.collect()} == {"a": "accepted", "b": "deleted", "c": "accepted", "d": "retained", "n": "accepted"}
    once = sync.apply(stored, planned, new, ["category", "name", "price"])
    twice = sync.apply(once, sync.plan(once, new, new, held), new, ["category", "name", "price"])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r["upstream_key"]: r["active"] for r in once.collect()} == {"a": 1, "b": 0, "c": 1, "d": 1, "n": 1}


def test_ids_are_dense_and_stable(spark):
    new = spark.createDataFrame([(f"k{i:03d}",) for i in range(57)], "upstream_key string")
    got = {r["upstream_key"]: r["id"] for r in sync.assign_ids(new, 100).collect()}
    assert [got[k] for k in sorted(got)] == list(range(101, 158))


def test_scores_ignore_other_categories(spark):
    docs = spark.createDataFrame([(1, "x", "red ring"), (2, "x", "blue ring"), (3, "y", "red red red")], "id long, category string, name string")
    q = spark.createDataFrame([(1, "x", "red")], "query_id long, category string, query string")
    both = search.bm25(search.postings(docs, "id", ["name"]), search.query_terms(q)).collect()
    alone = search.bm25(search.postings(docs.filter("category = 'x'"), "id", ["name"]), search.query_terms(q)).collect()
    assert both == alone and [r["doc"] for r in both] == [1]


def test_filters_reach_the_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/part.parquet").filter((F.col("p_type") == "SMALL") & filters.within(F.col("p_size"), 5, 9)).select("p_partkey")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(p_size,5)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string,p_size:int>" in plan
    assert "p_name" not in plan


def test_snapshot_files(spark, tmp_path):
    (tmp_path / "cpu").mkdir()
    (tmp_path / "cpu" / "0b6c1d2e-0000-4000-8000-000000000000.json").write_text('{"a": 1}')
    (tmp_path / "cpu" / "notes.json").write_text("{")
    files = {r["file"].rsplit("/", 1)[1]: r for r in snapshot.scan_files(spark, str(tmp_path)).collect()}
    assert files["notes.json"]["upstream_key"] is None and files["notes.json"]["category"] == "cpu"
    parsed = snapshot.parse_json(snapshot.scan_files(spark, str(tmp_path)), 100)
    assert sorted(r["status"] for r in parsed.select("status").collect()) == ["invalid_json", "ok"]
    assert snapshot.inventory(snapshot.list_files(spark, str(tmp_path))).count() == 2


def test_entry_works(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("partitions", ["1", "200"])
def test_order_does_not_depend_on_partitions(spark, partitions):
    """One group holds most rows, one is null, keys tie but for the id."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [(i, "hot" if i % 10 else ("a", None)[i // 10 % 2], i * 7 % 50) for i in range(600)]
        df = spark.createDataFrame(rows, "id long, g string, v long")
        keys = [F.col("v"), F.col("id")]
        groups = {g: sorted((v, i) for i, h, v in rows if h == g) for g in ("hot", "a", None)}
        got = {r["id"]: r["place"] for r in order.ranked(df, ["g"], keys, "place").collect()}
        assert got == {i: n for g in groups.values() for n, (_, i) in enumerate(g, 1)}
        got = {r["id"]: r["before"] for r in order.previous(df, ["g"], keys, F.col("id"), "before").collect()}
        assert got == {i: (g[n - 1][1] if n else None) for g in groups.values() for n, (_, i) in enumerate(g)}
        got = {r["g"]: (r["half"], r["largest"]) for r in order.nearest_rank(df, "g", "v", {"half": 0.5}).collect()}
        assert got == {g: (x[-(-len(x) // 2) - 1][0], x[-1][0]) for g, x in groups.items()}
        a, b = (order.fingerprint(d, F.col("id").cast("string"), "g", (2, 1)) for d in (df, df.repartition(5)))
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str) and a.agg(F.sum("rows")).first()[0] == 600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_intents_keep_what_rules_do_not_take(spark):
    rows = [("memory", "8gb 16gb kit"), ("memory", "gskill 32GB 6000 ddr5"), ("memory", "model 6000"), ("storage", "wd 2tb sn850"), ("psu", "9000w atx"), ("desk", "120mm 8gb"), ("memory", None), ("memory", "")]
    got = [(r["remaining"], [tuple(s) for s in r["specs"] or []]) for r in intents.parse(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "query_id int, category string, query string")).orderBy("query_id").collect()]
    assert got[0] == ("8gb 16gb kit", [])
    assert got[1] == ("g skill", [("capacity_gb", "32"), ("ram_type", "DDR5"), ("speed", "6000")])
    assert got[2] == ("model 6000", []) and got[3] == ("wd sn850", [("capacity_gb", "2000")])
    assert got[4] == ("9000w", [("form_factor", "ATX")]) and got[5] == ("120mm 8gb", [])
    assert got[6][1] == [] and got[7] == ("", [])


def test_keywords_limits_and_forms(spark):
    from shelfspark.operators import search as S

    face = "\U0001f600"
    rows = [(1, None), (2, ""), (3, " -- "), (4, "ＲＴＸ　５０８０"), (5, "ﬁne" + " a" * 11), (6, "a " * 13), (7, "a" * 200), (8, "a" * 201), (9, "a" + face * 99), (10, "a" + face * 100), (11, "x" * 5000), (12, "ｘ" * 200)]
    df = spark.createDataFrame(rows, "query_id long, query string")
    got = {r["query_id"]: (r["keyword"], r["code"]) for r in S.keywords(df).collect()}
    codes = {k: v[1] for k, v in got.items()}
    assert codes == {1: None, 2: "token-count", 3: "token-count", 4: None, 5: None, 6: "token-count", 7: None, 8: "too-long", 9: None, 10: "too-long", 11: "too-long", 12: None}
    assert got[4][0] == "RTX 5080" and got[5][0].startswith("fine a") and got[12][0] == "x" * 200
    assert {k for k, v in got.items() if v[0] is None} == {1, 2, 3, 6, 8, 10, 11}
    admitted = S.admit(df)
    assert admitted.columns == ["query_id", "query"] and {r["query_id"] for r in admitted.collect()} == {4, 5, 7, 9, 12}
    assert S.admit(df.limit(0)).count() == 0
