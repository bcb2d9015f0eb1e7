"""Two runs compared with all their metrics, and cost classes with the distribution of what they cost."""

import pandas as pd
from pyspark.sql import functions as F

from shelfspark.operators import evaluate as E
from shelfspark.plans import registry


def test_two_runs_compared(spark):
    run = lambda rows: spark.createDataFrame(rows, "case_id long, doc long, rank int, score double")
    cases = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "case_id long")
    before = run([(1, 10, 1, 0.9), (1, 11, 2, 0.5), (2, 10, 1, 1.0), (3, 12, 1, 1.0)])
    after = run([(1, 11, 1, 0.7), (1, 12, 2, 0.6), (2, 10, 1, 1.0), (3, 12, 1, 0.25)])
    relevant = spark.createDataFrame([(1, 10), (1, 12), (2, 10), (2, 99), (4, 5)], "case_id long, doc long")
    got = {r["case_id"]: r for r in E.compared(cases, before, after, relevant, 1).collect()}
    told = ["gone", "came", "moved", "changed", "max_score_delta", "relevant", "precision_before", "coverage_before", "rank_before", "precision_after", "coverage_after", "rank_after", "still_failing"]
    assert [got[1][x] for x in told] == [1, 1, 1, True, 0.2, 2, 0.5, 0.5, 1, 0.5, 0.5, 2, False]
    assert [got[2][x] for x in told] == [0, 0, 0, False, 0.0, 2, 1.0, 0.5, 1, 1.0, 0.5, 1, False]
    assert [got[3][x] for x in told] == [0, 0, 0, False, 0.75, 0, 0.0, None, None, 0.0, None, None, True]
    assert [got[4][x] for x in told] == [0, 0, 0, False, None, 1, 0.0, 0.0, None, 0.0, 0.0, None, True]


def test_compare_runs_takes_the_metrics_of_both_runs(spark):
    rows = registry.queries()["compare_runs"](spark, "/root/testdata/sf0.001").collect()
    assert any((r["max_score_delta"] or 0) > 0 for r in rows) and any(r["changed"] for r in rows)
    assert all(0 <= r[x] <= 1 for r in rows for x in ("precision_before", "precision_after"))


def test_cost_classes_with_their_distribution(spark, tmp_path):
    kinds = ["click", "view", "purchase", "signup", "error", None]
    rows = pd.DataFrame({"event_id": range(600), "ts": 0, "user_id": 1, "event_type": [kinds[i // 3 % 6] for i in range(600)], "value": [None if i % 50 == 7 else float(i * 7 % 400) for i in range(600)], "props": ""})
    rows.to_parquet(tmp_path / "events.parquet")

    def kind(i):
        name = kinds[i // 3 % 6]
        fixed = {"click": "bootstrap", "signup": "uncached"}
        return fixed.get(name) or ("normal" if i % 3 == (2 if name == "purchase" else 1) else "expensive")

    got = {r["predicted"]: r for r in registry.queries()["cost_classifier_eval"](spark, str(tmp_path)).collect()}
    assert set(got) == {"bootstrap", "uncached", "normal", "expensive"}
    for name, r in got.items():
        costs = sorted(i * 7 % 400 for i in range(600) if kind(i) == name and i % 50 != 7)
        nearest = lambda q: costs[-(-int(q * 100) * len(costs) // 100) - 1]
        dear = name in ("expensive", "uncached")
        assert (r["p50"], r["p95"], r["largest"]) == (nearest(0.5), nearest(0.95), costs[-1])
        assert (r["false_negatives"], r["conservative"]) == (0 if dear else sum(x > 200 for x in costs), sum(x <= 200 for x in costs) if dear else 0)


def test_a_chipset_is_no_model(spark):
    asked = spark.createDataFrame([("asus b650", True, False), ("asus b650", False, False), ("", False, False), (None, False, False), ("990pro", False, True)], "words string, named boolean, posted boolean")
    got = asked.select(E.cost_class(F.col("words"), F.lit(False), F.col("named"), F.col("posted")).alias("x")).collect()
    assert [r["x"] for r in got] == ["expensive", "normal", "expensive", "bootstrap", "uncached"]
