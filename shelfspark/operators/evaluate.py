"""Search-quality metrics as aggregates over results and relevant sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import tokens


# fixed values: the pattern of a model number in a query, and case classes that browse
MODEL_LIKE = "^[a-z]{0,5}[0-9]{3,5}[a-z0-9]{0,4}$"
BROWSE = ("family", "broad", "spec_only", "model_spec", "typed_spec", "facet", "range")


def intent_of(given: Column, identifier: Column, keyword: Column, filters: Column, case_class: Column) -> Column:
    """lookup, identifier, browse, browse_filter or filter_only; an intent given by hand stands."""
    identified = identifier.isNotNull() | (case_class == "identifier")
    worded = F.when(filters > 0, "browse_filter").when(case_class.isin(*BROWSE), "browse").otherwise("lookup")
    return F.coalesce(given, F.when(identified, "identifier").when(keyword.isNull() | (keyword == ""), "filter_only").otherwise(worded))


def cost_class(words: Column, spec_only: Column, named: Column | None = None, posted: Column | None = None) -> Column:
    """Predicted cost of a request by the words left of its query: no GET, a plain listing, a model number, or
    anything else. ``named``: the query names a family or a chipset, which many products share."""
    model = F.exists(tokens(words), lambda t: F.regexp_like(t, F.lit(MODEL_LIKE)))
    broad = F.coalesce(spec_only, F.lit(False)) | (F.lit(False) if named is None else named)
    plain = F.when(words.isNull(), "bootstrap").when(~broad & model, "normal").otherwise("expensive")
    return plain if posted is None else F.when(posted, "uncached").otherwise(plain)


def first_ranks(cases: DataFrame, results: DataFrame, relevant: DataFrame) -> DataFrame:
    """(case_id, first_rank): the rank of the first relevant result, null if there is none."""
    hit = results.join(relevant, ["case_id", "doc"], "left_semi").groupBy("case_id").agg(F.min("rank").alias("first_rank"))
    return cases.select("case_id").join(hit, "case_id", "left")


def hit_metrics(ranks: DataFrame, keys: list[Column], cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Hit@k and MRR per group; cases without a relevant result count zero."""
    hits = [F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}") for k in cuts]
    mrr = F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr")
    return ranks.groupBy(*keys).agg(F.count("*").alias("cases"), *hits, mrr)


def precision_recall(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(case_id, precision, recall) at ``k``: a fixed denominator for precision."""
    r = relevant.withColumn("hit", F.lit(1))
    got = results.filter(F.col("rank") <= k).join(r, ["case_id", "doc"], "left").groupBy("case_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("tp"))
    size = relevant.groupBy("case_id").agg(F.count("*").alias("size"))
    return size.join(got, "case_id", "left").select("case_id", F.round(F.coalesce("tp", F.lit(0)) / k, 6).alias("precision"), F.round(F.coalesce("tp", F.lit(0)) / F.col("size"), 6).alias("recall"))


def failure_class(has_relevant: Column, matched: Column, first_rank: Column, cutoff: int = 10) -> Column:
    return F.when(~has_relevant, "MISSING_PRODUCT").when(~matched, "NO_SEARCH_MATCH").when(first_rank.isNull() | (first_rank > cutoff), "RANKING_FAILURE").otherwise("HIT")


def first_ranked(scored: DataFrame, order: list[Column], k: int) -> DataFrame:
    """(case_id, doc, rank, score) of each case's first ``k`` results in a total order."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("case_id", "doc", "rank", "score")


def compared(cases: DataFrame, before: DataFrame, after: DataFrame, relevant: DataFrame, cutoff: int) -> DataFrame:
    """Two runs (case_id, doc, rank, score), a row for each case: results that are gone, came and moved, whether any
    of that holds, the largest change of a score of those in both, precision over the results returned, coverage of
    the relevant ones and the first one's rank in each run, and whether both runs fail the ``cutoff``."""
    runs = {"before": before, "after": after}
    sides = [r.select("case_id", "doc", F.col("rank").alias(n), F.col("score").alias(f"score_{n}")) for n, r in runs.items()]
    j = sides[0].join(sides[1], ["case_id", "doc"], "full_outer").join(relevant.select("case_id", "doc", F.lit(True).alias("hit")), ["case_id", "doc"], "left")
    of = lambda n: F.when(F.col("hit"), F.col(n))
    sums = [x for n in runs for x in (F.count(n).alias(f"returned_{n}"), F.count(of(n)).alias(f"hits_{n}"), F.min(of(n)).alias(f"rank_{n}"))]
    per = j.groupBy("case_id").agg(
        F.count_if(F.col("after").isNull()).alias("gone"), F.count_if(F.col("before").isNull()).alias("came"), F.count_if(F.col("after") != F.col("before")).alias("moved"),
        F.max(F.abs(F.col("score_after") - F.col("score_before"))).alias("delta"), *sums,
    )
    size = relevant.groupBy("case_id").agg(F.count("*").alias("relevant"))
    counts = ["gone", "came", "moved", "relevant", *[f"{x}_{n}" for n in runs for x in ("returned", "hits")]]
    every = cases.select("case_id").join(per, "case_id", "left").join(size, "case_id", "left").fillna(0, counts)
    told = [x for n in runs for x in (F.round(F.coalesce(F.try_divide(f"hits_{n}", f"returned_{n}"), F.lit(0.0)), 6).alias(f"precision_{n}"), F.round(F.try_divide(f"hits_{n}", "relevant"), 6).alias(f"coverage_{n}"), F.col(f"rank_{n}"))]
    fails = [F.col(f"rank_{n}").isNull() | (F.col(f"rank_{n}") > cutoff) for n in runs]
    return every.select("case_id", "gone", "came", "moved", (F.col("gone") + F.col("came") + F.col("moved") > 0).alias("changed"), F.round("delta", 6).alias("max_score_delta"), "relevant", *told, (fails[0] & fails[1]).alias("still_failing"))
