"""Passages meet whole texts in one scan: no posting of the documents is written, and no text is left out."""

import pandas as pd
import pytest
from oracle import same

from shelfspark.operators import search
from shelfspark.plans import registry
from shelfspark.plans.base import Catalog

DOCS = [(1, "one two three. Four"), (2, "four three two one"), (3, "two three"), (4, ""), (5, None), (6, "zero ONE two two, three four one"), (7, "bone two three fours")]
PASSAGES = [(1, ["one", "two", "three"]), (2, ["two", "three"]), (3, []), (4, ["two", "two"])]


def test_overlaps_and_passages(spark):
    docs = spark.createDataFrame(DOCS, "doc long, text string")
    passages = spark.createDataFrame(PASSAGES, "query_id long, terms array<string>")
    shared = search.overlaps(docs, passages)
    got = {(r["query_id"], r["doc"]): (r["n"], r["shared"], r["length"]) for r in shared.collect()}
    assert {d: x for (q, d), x in got.items() if q == 1} == {1: (3, 3, 4), 2: (3, 3, 4), 3: (3, 2, 2), 6: (3, 3, 7), 7: (3, 2, 4)}
    assert {d: x for (q, d), x in got.items() if q == 4} == {1: (1, 1, 4), 2: (1, 1, 4), 3: (1, 1, 2), 6: (1, 1, 7), 7: (1, 1, 4)}
    found = search.passages_in(docs, passages, shared.filter("shared = n"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (2, 3), (2, 6), (2, 7), (4, 6)]


@pytest.mark.parametrize("name", ["match_all", "match_phrase", "precision_recall_k", "family_purity", "metrics_breakdown", "hit_mrr", "compare_runs", "diagnose_missing"])
def test_no_posting_of_the_documents_is_written(spark, monkeypatch, name):
    monkeypatch.setattr(Catalog, "index", lambda *a: pytest.fail("the documents are indexed"))
    registry.queries()[name](spark, "/root/testdata/sf0.001")


def test_prefixes_are_counted_from_the_texts(spark, monkeypatch, tmp_path):
    """A document of several rows, an empty one, none and a letter outside of the basic plane."""
    monkeypatch.setattr(Catalog, "index", lambda *a: pytest.fail("the documents are indexed"))
    texts = [(1, "en", "Ring rings RINGER ri r"), (1, "en", "ring road"), (2, "en", "ring 𝒳yz1 é12"), (3, "de", ""), (4, "de", None), (5, "de", "Straße rin"), (1, "de", "ring")]
    pd.DataFrame(texts, columns=["doc_id", "lang", "text"]).to_parquet(tmp_path / "documents.parquet")
    found = registry.queries()["prefix_df"](spark, str(tmp_path))
    same(found, registry.oracle_sql()["prefix_df"], str(tmp_path))
    got = {(r["category"], r["prefix"]): r["df"] for r in found.collect()}
    assert got["en", "ri"] == 2 and got["en", "ring"] == 2 and got["de", "rin"] == 2 and got["en", "road"] == 1
