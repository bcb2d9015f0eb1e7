"""Every operator and pipeline stage on empty tables and on rows with nulls in any column, empty
and long texts, ties, repeated rows and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm import anchor_codes, chosen_path, embedding_dedup, exact_dedup, exact_topk, importance_resampling, line_dedup, mixture, pii, quality_pu, sentencepiece_codec, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, score double, leaf long, block int, n int, source_size long, target double, n_lines string, spans string, ids string"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int, weight int, table string, id long"


def _extra(i):
    return ("k", 1, 0.5, 3, 4, 5, 6, 7.0, "x", "y", "z")


@pytest.fixture(scope="module")
def docs(spark):
    long = "word " * 30000
    base = "the quick brown fox jumps over the lazy dog and runs away again today"
    texts = [(1, base, "s1"), (1, base, "s1"), (2, base, None), (3, None, "s1"), (4, "", "s2"), (5, long, "s2"), (6, base + " end", "s3"), (7, "x", None), (None, base, "s4"), (8, "\n\n", "s1"), (9, "a\nb\n" * 50, "s5")]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", s, None, *_extra(i)) for i, t, s in texts], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1), (None, 1, 1), (6, 0, None), (9, 1, 1)], LABELS)


def test_url_filter(spark):
    entries = spark.createDataFrame([("l", "domain:a.com", "block", "2024-01-01"), ("l", "domain:a.com", "remove", "2024-02-01"), ("m", "prefix:a.com/ok", "allow", "2024-01-01"), ("m", None, "block", "2024-01-01"), ("l", "domain:b.com", "block", None), ("l", "domain:c.com", "block", "2024-01-05"), ("l", "domain:c.com", "remove", "2024-01-05")], "list_name string, pattern string, action string, at string")
    entries = entries.withColumn("effective_at", F.col("at").cast("timestamp"))
    rows = [(1, "http://x.a.com/p", "2024-01-15"), (2, "http://a.com/ok/1", "2024-01-15"), (3, "http://a.com/p", "2024-02-01"), (4, None, "2024-01-15"), (5, "junk", "2024-01-15"), (6, "http://a.com/", None), (7, "http://a.com/p", "2023-12-31"), (8, "http://A.COM:80/okay", "2024-01-31"), (1, "http://x.a.com/p", "2024-01-15"), (9, "http://c.com", "2024-01-06"), (None, "http://a.com", "2024-01-02")]
    captures = spark.createDataFrame(rows, "page_id long, url string, at string").withColumn("fetched_at", F.col("at").cast("timestamp")).withColumn("host", F.lit("clash"))
    got = sorted((r["page_id"] or 0, r["kept"]) for r in url_filter.temporal_url_filter(captures, entries).collect())
    assert got == [(0, False), (1, False), (1, False), (2, True), (3, True), (4, True), (5, True), (6, True), (7, True), (8, False), (9, True)]
    assert url_filter.temporal_url_filter(captures.limit(0), entries).count() == 0
    assert url_filter.temporal_url_filter(captures, entries.limit(0)).filter("not kept").count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [2.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 1.0, 0.0]), (9, [None, 1.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0]), (200, [0.0, 0.0, -1.0]), (1, [1.0, 0.0, 0.0])]
    v = spark.createDataFrame([(i, e, None, 1, "t", 5) for i, e in rows], VECTORS)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(v).collect()}
    assert (got[1]["n_links"], got[2]["n_links"], got[3]["n_links"]) == (3, 3, 3)
    assert {got[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (4, 5, 6, 7, 8, 9, 10, 100, 200))
    assert embedding_dedup.near_duplicates(v.limit(0)).count() == 0
    top = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk.exact_topk(v, F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert top == [(100, 1, 2, 10240), (100, 2, 1, 0), (100, 3, 1, 0), (200, 1, 1, 0), (200, 2, 1, 0), (200, 3, 2, 0)]
    assert exact_topk.exact_topk(v.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_line_dedup(docs, empty):
    assert line_dedup.line_dedup(docs).count() == docs.count()
    assert line_dedup.line_dedup(docs, min_sites=2).filter("doc_id = 3 and text is null").count() == 1
    assert line_dedup.line_dedup(empty).count() == 0


def test_jaccard_join(docs, empty):
    got = {r["doc_id"]: r for r in chosen_path.jaccard_join(docs).collect()}
    assert got[1]["n_links"] == 3 and got[2]["n_links"] == 3 and got[6]["n_links"] == 3  # 1 twice, 2, 6
    assert got[2]["component_id"] == 1 and got[2]["class_id"] == 1 and not got[6]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (3, 4, 7, 8, None))
    assert chosen_path.jaccard_join(empty).count() == 0
    assert sorted(r["doc_id"] or 0 for r in chosen_path.deduplicated(docs).select("doc_id").collect()) == [0, 1, 3, 4, 5, 7, 8, 9]


def test_pii(docs, empty):
    assert pii.digest(pii.detect(docs)).count() == docs.count()
    assert pii.detect(empty).count() == 0


def test_codec(docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode_decode(docs, path, check_every=1).collect()}
    assert got[3]["ids"] == [] and got[4]["decoded"] == "" and got[8]["decoded"] == "\n\n"
    assert sentencepiece_codec.encode_decode(empty, path).count() == 0


def test_classifiers(spark, docs, empty, labels):
    for op in (quality_pu, toxicity):
        got = op.classify(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert op.classify(empty, labels).count() == 0
        assert op.classify(docs, labels.limit(0)).count() == docs.count()


def test_mixture(docs, empty):
    got = mixture.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["copies"] <= 3 for r in got)
    assert {r["copies"] for r in got if r["size"] == 0} <= {0}
    assert mixture.mix(empty).count() == 0
    assert mixture.remix(docs).columns == docs.columns and mixture.remix(empty).count() == 0
    taken = lambda rows: sorted((r["doc_id"] or 0, r["text"] or "") for r in rows for _ in range(r.asDict().get("copies", 1)))
    texts = {r["t"]: r["text"] for r in docs.select("text", F.xxhash64(F.lit(1), "text").alias("t")).collect()}
    want = sorted((r["doc_id"] or 0, texts[r["t"]] or "") for r in got for _ in range(r["copies"]))
    assert taken(mixture.remix(docs).collect()) == want and any(i == 0 for i, _ in want)


def test_mixture_of_equal_rows(spark):
    """A third of all rows are one row, and one id has many texts: each row is drawn for itself."""
    rows = [(7, "one two three", "a")] * 900 + [(8, f"word {'x ' * (i % 5)}{i}", "a") for i in range(900)] + [(None, f"b {i}", "b") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixture.mix(df).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("source"):
        assert abs((g["copies"] * g["size"]).sum() - g["target"].iloc[0]) <= 0.01 * g["target"].iloc[0]
    assert mixture.remix(df).count() == got["copies"].sum()
    again = mixture.mix(df.repartition(3)).toPandas()
    key = ["doc_id", "size", "t", "n"]
    assert got.sort_values(key)["copies"].tolist() == again.sort_values(key)["copies"].tolist()


def test_values_on_edge_rows(spark, docs):
    """What line dedup and personal data return on nulls, repeats and a null id."""
    n = docs.count()
    lines = line_dedup.line_dedup(docs, min_sites=2).collect()
    assert len(lines) == n and {r["doc_id"]: r["n_lines"] for r in lines}[9] == 101
    gone = sorted((r["doc_id"] or 0, r["n_removed"]) for r in lines if r["n_removed"])
    assert gone == [(0, 1), (2, 1)]  # rows of id 1 count as one document, the first that has the line
    rows = spark.createDataFrame([(1, "a@b.c and 10.0.0.1"), (1, None), (None, "x@y.z"), (2, "")], "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["spans"]) for r in pii.digest(pii.detect(rows)).collect())
    assert out == [(0, 1, 0, "email:0:5"), (1, 0, 0, ""), (1, 1, 1, "email:0:5,ip:10:18"), (2, 0, 0, "")]


def test_mixture_keeps_ids_beyond_doubles(spark):
    """A null id and ids above 2**53 in one block: no id is lost, none is made up, no row goes."""
    ids = [None, *[(1 << 53) + 2 * i + 1 for i in range(40)]]
    df = spark.createDataFrame([(i, f"word {'x ' * (n % 7)}{n}", "s", "k") for n, i in enumerate(ids)], "doc_id long, text string, source string, key string")
    got = {r["doc_id"]: r["copies"] for r in mixture.mix(df).collect()}
    assert set(got) == set(ids) and len(got) == 41
    rows = [r["doc_id"] for r in mixture.remix(df).collect()]
    assert {i: rows.count(i) for i in ids} == got
    small = spark.createDataFrame([(i % 3 if i else None, f"w {i}", None) for i in range(60)], "doc_id long, text string, source string")
    assert mixture.remix(small).count() == sum(r["copies"] for r in mixture.mix(small).collect())


def test_exact_dedup(spark, docs, empty):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == docs.count()
    by_text = {r["doc_id"]: r for r in got}
    assert [by_text[i]["group_size"] for i in (1, 2, 3, 4, 5, None)] == [4, 4, 2, 2, 1, 4]
    assert by_text[None]["keep_id"] == 1 and by_text[4]["keep_id"] == 3 and not by_text[2]["kept"]
    assert sorted(r["kept"] for r in got if r["doc_id"] == 1) == [False, True]  # rows equal in id and text: one stays
    nulls = spark.createDataFrame([(None, "a  b"), (None, "a\tb"), (None, "ab"), (7, "c "), (None, "c\n")], "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(nulls).collect())
    assert out == [(0, 0, 1, True), (0, 0, 2, False), (0, 0, 2, True), (0, 7, 2, False), (7, 7, 2, True)]
    assert exact_dedup.exact_duplicates(empty).count() == 0
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.select("doc_id").collect()) == [1, 3, 5, 6, 7, 8, 9]


def test_codes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0, 0.5, 0.25]), (2, [1.0, 0.01, 0.0, 0.0]), (2, [1.0, 0.01, 0.0, 0.0]), (4, None), (6, []), (7, [nan, 1.0, 0.0, 0.0]), (8, [inf, 1.0, 0.0, 0.0]), (9, [None, 1.0, 0.0, 0.0]), (10, [1.0, -0.1]), (None, [0.0, 0.0, 0.0, -1.0])]
    v = spark.createDataFrame([(i, e, None if (i or 0) > 4 else 1, 1, "t", 5) for i, e in rows], VECTORS)
    got = sorted(((r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in anchor_codes.compress(v).collect()))
    # three entries for the four rows of length 4 that differ, lower indexes for equal entries; other lengths apart
    assert [g[0] for g in got] == [0, 2, 2, 5, 6, 10] and {g[2] for g in got} == {0} and {g[3] for g in got} == {0}
    assert got[1] == got[2] and got[4][1] == "00000000" == got[5][1]
    assert anchor_codes.compress(v.limit(0)).count() == 0 and anchor_codes.compress(v.filter("vec_id = 4")).count() == 0
    with pytest.raises(Exception, match="too large"):
        anchor_codes.compress(spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")).count()


def test_resampling(spark, docs, empty):
    target = docs.select(F.col("text").alias("words"), "key")
    got = importance_resampling.resample(docs, target, target_text="words", min_words=2).collect()
    assert len(got) == docs.count()
    fit = [r for r in got if r["n_features"] >= 3]
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, len(fit) * 25 // 100 + 1)) and all(r["n_features"] >= 3 for r in got if r["rank"])
    assert {(r["n_features"], r["weight"]) for r in got if r["doc_id"] in (3, 4, 8)} == {(0, 0)}
    assert importance_resampling.resample(empty, target, target_text="words").count() == 0
    assert importance_resampling.resample(docs, empty, percent=100, min_words=0).filter("rank is null").count() == 0


@pytest.mark.parametrize("rows", ["docs", "empty"])
def test_stages(spark, request, labels, tmp_path, rows):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = request.getfixturevalue(rows)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == now.columns, name
        out.write.parquet(str(tmp_path / str(n)))
        now = spark.read.parquet(str(tmp_path / str(n)))
    assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_vectors_under_one_id_and_of_two_lengths(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.01, 1.0, 0.0]), (3, [0.01, 1.0, 0.0]), (7, [1.0, 1.0]), (5, [1.0, 1.01]), (9, [0.5])]
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (5, 1, 5, True), (7, 1, 5, False), (9, 0, 9, True)]


def test_texts_under_one_id(spark):
    a, b = "the quick brown fox jumps over the lazy dog and runs away", "a wholly different text about rivers and the boats that sail on them"
    rows = [(2, a, 1), (3, a, 2), (3, b, 3), (4, b + " today", 4), (3, b, 5), (5, "", 6), (5, "", 7), (None, a, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 int")
    got = sorted((r["doc_id"] or 0, r["n_links"], r["class_id"] or 0, r["component_id"] or 0) for r in chosen_path.jaccard_join(df).collect())
    assert got == [(0, 0, 0, 0), (2, 1, 2, 2), (3, 1, 2, 2), (3, 2, 3, 3), (3, 2, 3, 3), (4, 2, 4, 3), (5, 0, 5, 5), (5, 0, 5, 5)]
    left = sorted((r["doc_id"] or 0, r["text"]) for r in chosen_path.deduplicated(df).collect())
    assert left == [(0, a), (2, a), (3, b), (5, ""), (5, "")]
    assert chosen_path.deduplicated(df).columns == df.columns
