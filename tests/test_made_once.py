"""What a row or a group needs several times is made once."""

import pandas as pd
from pyspark.sql import functions as F

from shelfspark.functions import columns as C
from shelfspark.plans import registry


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_code_is_made_once_for_its_check(spark):
    codes = spark.createDataFrame([("5901234123457",), ("5901234123458",), ("00000000",), ("12x45678",), (None,), ("96385074",)], "code string")
    checked = codes.select("code", C.gtin_check(F.reverse(F.reverse("code"))).alias("ok"))
    assert [r["ok"] for r in checked.collect()] == [True, False, False, False, False, True]
    assert _plan(checked).count("reverse(reverse(") == 1


def test_equal_queries_get_their_cost_class_once(spark, tmp_path):
    rows = pd.DataFrame({"event_id": range(40), "ts": 0, "user_id": 1, "event_type": ["click", "view"] * 20, "value": [None if i == 7 else 10.0 * i for i in range(40)], "props": ""})
    rows.to_parquet(tmp_path / "events.parquet")
    found = registry.queries()["cost_classifier_eval"](spark, str(tmp_path))
    kind = lambda i: "bootstrap" if i % 2 == 0 else "normal" if i % 3 == 1 else "expensive"
    for r in found.collect():
        costs = [10.0 * i for i in range(40) if kind(i) == r["predicted"] and i != 7]
        n = sum(kind(i) == r["predicted"] for i in range(40))
        assert (r["n"], r["mean"], r["false_negatives"]) == (n, round(sum(costs) / len(costs), 6), sum(x > 200 for x in costs) if r["predicted"] != "expensive" else 0)
    below = _plan(found).rsplit("Aggregate", 1)[1].split("\n", 1)[1]
    assert "parquet" in below and "regexp" not in below  # parsed after the events are grouped
