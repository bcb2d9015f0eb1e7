"""The category registry and the contract, on documents whose results are written beside them."""

import json

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import records
from shelfspark.operators.categories import CATEGORIES, ORIGINAL, tree

ID = "0b6c1d2e-0000-4000-8000-000000000000"


@pytest.fixture(scope="module")
def parsed(spark):
    def make(rows):
        raw = spark.createDataFrame([(i, c, json.dumps({"opendb_id": ID, "metadata": {"name": "n 1"}} | d)) for i, (c, d) in enumerate(rows)], "k long, category string, raw string")
        return raw.withColumn("doc", F.try_parse_json("raw"))

    return make


def test_registry_is_whole():
    assert len(CATEGORIES) == 30 and list(CATEGORIES)[:9] == list(ORIGINAL)
    assert sum(not c.fields and not c.facets for c in CATEGORIES.values()) == 15
    assert {len(c.fields) for c in CATEGORIES.values()} >= {0, 2, 16}
    assert CATEGORIES["case"].table == "pc_case" and CATEGORIES["memory"].upstream == "RAM"
    assert tree("cpu")["specifications.memory"] and not tree("cpu")["specifications.memory.types"] and tree("monitor")["video_outputs"]
    assert all(p.count(".") < 3 for c in CATEGORIES.values() for p in c.inputs())


def test_every_field_is_typed(parsed):
    """A category's typed table has a column for every field, of the type of its conversion."""
    values = records.spec_values(parsed([("cpu", {"cores": {"total": 8}, "clocks": {"performance": {"base": 3.5}}}), ("memory", {"ram_type": "DDR5"})]), ["k"])
    row = records.typed(values, "cpu", ["k"])
    assert row.columns == ["k", *[f.name for f in CATEGORIES["cpu"].fields]] and dict(row.dtypes)["core_count"] == "bigint" and dict(row.dtypes)["family"] == "string"
    assert [(r["core_count"], r["base_clock_ghz"], r["socket"]) for r in row.collect()] == [(8, 3.5, None)]


def test_facets(parsed):
    got = records.facet_values(parsed([("cpu_cooler", {"cpu_sockets": ["AM5", "lga1700", "LGA 1700", "", None, 3, "x" * 201]}), ("monitor", {"video_outputs": {"usb_c": 1, "vga": 0, "hdmi_2_1": 2, "odd": 9}}), ("keyboard", {"connectivity": ["Wired", " Wired ", "BT"], "features": "no"}), ("desk", {"features": ["a"]})]), ["k"])
    assert sorted((r["k"], r["attribute"], r["value"]) for r in got.collect()) == [(0, "socket", "AM5"), (0, "socket", "LGA 1700"), (1, "ports", "hdmi_2_1"), (1, "ports", "usb_c"), (2, "connectivity", "BT"), (2, "connectivity", "Wired")]


def test_limits_of_texts_and_numbers(parsed):
    rows = [("keyboard", {"layout": "x" * 200, "polling_rate": 1e9}), ("keyboard", {"layout": "x" * 201, "polling_rate": 1.1e9}), ("keyboard", {"layout": "\U0001f600" * 101}), ("keyboard", {"layout": "a\x01b"}), ("cpu", {"general_product_information": {"manufacturer_url": "u" * 2048}}), ("cpu", {"general_product_information": {"manufacturer_url": "u" * 2049}}), ("microphone", {"features": ["a"] * 257})]
    found = sorted((r["k"], r["code"], r["field"]) for r in records.issues(parsed(rows), ["k"]).collect())
    assert found == [(1, "invalid_value", "layout"), (1, "invalid_value", "polling_rate"), (2, "invalid_value", "layout"), (3, "invalid_value", "layout"), (5, "invalid_value", "general_product_information.manufacturer_url"), (6, "invalid_array", "features")]
    assert sorted((r["k"], r["field"]) for r in records.spec_values(parsed(rows), ["k"]).collect()) == [(0, "layout"), (0, "polling_rate_hz")]


def test_identifiers(parsed):
    def doc(ids, **more):
        return ("os", {"identifiers": {"version": 1, "identifiers": ids} | more})

    good = [{"type": t, "value": v, "region": "jp"} for t, v in (("mpn", "A 1"), ("ean", "1" * 8), ("jan", "1" * 13), ("upc", "1" * 12), ("gtin", "1" * 14))]
    bad = [{"type": "isbn", "value": "1", "region": "jp"}, {"type": "ean", "value": "1" * 12, "region": "jp"}, {"type": "mpn", "value": "A"}, {"type": "mpn", "value": "A", "region": "r" * 33}, 7]
    got = records.identifier_issues(parsed([doc(good), doc(good + bad), doc(good, schema_version=2), ("os", {"identifiers": []}), ("os", {"identifiers": {"version": 0, "identifiers": []}}), ("os", {"identifiers": None})]), ["k"])
    assert sorted((r["k"], r["field"]) for r in got.collect()) == sorted([*[(1, f"identifiers.identifiers/{i}") for i in range(5, 10)], (2, "identifiers"), (3, "identifiers"), (4, "identifiers")])


@pytest.mark.parametrize(("text", "nodes", "depth"), [("1", 1, 0), ("[]", 1, 0), ("[1]", 2, 1), ('{"a": [1, {"b": []}], "c": "[,{"}', 6, 3), ('["\\"[", "x\\\\"]', 3, 1), ("[" * 40 + "]" * 40, 40, 39), ('{"a" : { } , "b" : [ [ ] , [ 2 ] ]}', 6, 3)])
def test_structure(spark, text, nodes, depth):
    def walk(v, d):
        kids = list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
        below = [walk(k, d + 1) for k in kids]
        return 1 + sum(n for n, _ in below), max([d, *[m for _, m in below]])

    assert walk(json.loads(text), 0) == (nodes, depth)
    row = spark.createDataFrame([(text,)], "raw string").select(records.structure(records.bare(F.col("raw"))).alias("s")).first()["s"]
    assert row["nodes"] == nodes and (row["depth"] == depth or (depth <= 32 and row["depth"] <= 32))


def test_rejected_keeps_every_row(spark):
    rows = spark.createDataFrame([(None, None), ("cpu", None), ("cpu", ""), ("cpu", "null"), ("zz", "{}"), ("cpu", "{}"), ("cpu", json.dumps({"opendb_id": ID.upper(), "metadata": {"name": "é"}}))], "category string, raw string")
    assert [r["code"] for r in records.rejected(rows).collect()] == ["invalid_json", "invalid_json", "invalid_json", "invalid_structure", "unsupported_category", "invalid_identity", "accepted"]
    assert records.rejected(rows.limit(0)).count() == 0
