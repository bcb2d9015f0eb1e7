"""Results against brute force, the given SQL, the tokenizer library, and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from oracle import same
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from shelfspark.llm import anchor_codes, chosen_path, embedding_dedup, exact_dedup, exact_topk, importance_resampling, line_dedup, mixture, pii, quality_pu, queries, sentencepiece_codec, toxicity
from shelfspark.llm.common import components
from shelfspark.llm.sentencepiece_codec import vocabulary

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    same(queries.queries()[name](spark, SMALL), queries.oracle_sql()[name], SMALL)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (9, 9), (7, 6), (6, 5)] + [(i + 100, i + 101) for i in range(40)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4} | {i: 100 for i in range(100, 141)}


def test_embedding_recall(spark):
    rng, rows = np.random.default_rng(4), []
    for k in range(900):
        v = rng.standard_normal(64)
        v /= np.linalg.norm(v)
        z = rng.standard_normal(64)
        z -= (z @ v) * v
        c = 0.86 + 0.13 * rng.random()
        rows += [(k, v), (10000 + k, c * v + np.sqrt(1 - c * c) * z / np.linalg.norm(z))]
    hot = rng.standard_normal(64)
    rows += [(20000 + k, hot + 0.05 * rng.standard_normal(64)) for k in range(600)]  # a hot group, over several blocks
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, block_rows=128).collect()}
    x = np.array(df.orderBy("vec_id").toPandas()["embedding"].tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = sorted(got)
    links = np.array([got[i]["n_links"] for i in ids])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.95 * near.sum()
    assert {got[i]["component_id"] for i in ids if i >= 20000} == {20000}


def test_embedding_recall_with_a_common_direction(spark):
    rng, rows = np.random.default_rng(12), []
    common = rng.standard_normal(64)
    common /= np.linalg.norm(common)

    def across(*to):
        z = rng.standard_normal(64)
        for x in (common, *to):
            z -= (z @ x) * x
        return z / np.linalg.norm(z)

    for k in range(600):
        r = across()
        c = 0.67 + 0.03 * rng.random()  # cosine 0.901 to 0.91 with the common part
        rows += [(k, np.sqrt(0.7) * common + np.sqrt(0.3) * r), (10000 + k, np.sqrt(0.7) * common + np.sqrt(0.3) * (c * r + np.sqrt(1 - c * c) * across(r)))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    have = np.array([got[i] for i, _ in rows])
    assert (have <= want).all(), (have.sum(), want.sum())
    assert have.sum() >= 0.97 * want.sum()


def test_topk_many_pages(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-3, 4, 8) / 4).tolist()) for i in range(1500)]  # many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in exact_topk.exact_topk(df, F.col("vec_id") % 100 == 0, page_rows=100, block_queries=4, fan=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = np.floor(np.array([v for _, v in rows]) * 1024).astype(int)
    for q in range(0, 1500, 100):
        s = x @ x[q]
        want = sorted(((-s[i], i) for i in range(1500) if i != q))[:10]
        assert got[q] == [(i, -v) for v, i in want]


def test_topk_leaves_out_most_pages(spark):
    """Clustered rows: the tree has inner levels, and blocks visit less than half of its nodes."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((60, 16)) * 4
    x = np.concatenate([centres[i % 60] + rng.standard_normal(16) / 8 for i in range(6000)]).reshape(6000, 16)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = exact_topk.integers(rows, 1024, "vec_id", "embedding")
    best, pairs, tree = exact_topk.search(v, v.filter("id % 100 = 0"), 16, 10, block_queries=8, fan=6, page_rows=100)
    assert len(tree.levels) >= 2 and tree.pages.count() >= 60
    share = pairs.count() / (tree.pages.count() * pairs.select("block").distinct().count())
    assert share < 0.5, share
    got = defaultdict(list)
    for r in best.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    n = np.floor(x * 1024).astype(np.int64)
    for q in range(0, 6000, 100):
        s = n @ n[q]
        assert got[q] == [(i, -b) for b, i in sorted((-s[i], i) for i in range(6000) if i != q)[:10]]


def _sets(docs):
    out = {}
    for i, t in docs:
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def _near(sets, threshold=0.8):
    where, links = defaultdict(list), defaultdict(set)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for j in where[g]:
                if j > i:
                    shared[j] += 1
        for j, k in shared.items():
            if k >= threshold * (len(s) + len(sets[j]) - k) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    return links


def test_jaccard_join(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    for k in range(400):  # a large group of near copies, and a passage that many documents share
        copy = list(base)
        copy[rng.randrange(120)] = f"x{k}"
        docs.append((10000 + k, " ".join(copy)))
        docs.append((20000 + k, " ".join(base[:40] + [f"y{rng.randint(0, 10**6)}" for _ in range(80)])))
    got = {r["doc_id"]: r for r in chosen_path.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), leaf_rows=64).collect()}
    want = _near(_sets(docs))
    assert all(got[i]["n_links"] <= len(want[i]) for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(len(x) for x in want.values())
    assert {got[10000 + k]["component_id"] for k in range(400)} == {10000}


def test_jaccard_join_where_every_shingle_is_frequent(spark):
    """Sets and their subsets at the threshold, out of passages that many unlike documents share,
    so that every node splits to the last level."""
    rng, docs = random.Random(6), []
    parts = [[[f"p{i}v{j}w{k}" for k in range(20)] for j in range(3)] for i in range(10)]
    for k in range(400):
        text = [w for slot in parts for w in slot[rng.randrange(3)]]
        docs += [(k, " ".join(text)), (1000 + k, " ".join(text[:162]))]
    got = {r["doc_id"]: r["n_links"] for r in chosen_path.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), leaf_rows=32).collect()}
    sets = _sets(docs)
    column = {g: c for c, g in enumerate(sorted(set().union(*sets.values())))}
    x = np.zeros((len(docs), len(column)), np.float32)
    for i, (d, _) in enumerate(docs):
        x[i, [column[g] for g in sets[d]]] = 1
    shared, n = x @ x.T, x.sum(1)
    want = (shared >= 0.8 * (n[:, None] + n - shared) - 1e-6).sum(1) - 1
    have = np.array([got[d] for d, _ in docs])
    assert (have <= want).all() and have.sum() >= 0.99 * want.sum()


def test_base_spans_against_plain_patterns():
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    rng = random.Random(6)
    texts = ["".join(rng.choice("a@.b1 2+-()0_c4@.é9") for _ in range(rng.randint(0, 70))) for _ in range(4000)]
    texts += ["4111 1111 1111 1111", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1 (555) 010-9999.", "999.1.1.1", "0000255.1.1.1"]
    for t in texts:
        want = []
        for k, p in enumerate(plain):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                ok = (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 14 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 10 <= len(d) <= 15)
                want += [(m.start(), k, m.end())] if ok else []
        assert pii.base_spans(t) == sorted(want), t


def test_field_carries_labels_to_repeats():
    texts = ["mail joe.black@shop.example.com or joe.black@shop now", "call +1 (555) 010-9999 or 1 (555) 010-9999", "nothing here 7"] * 30
    graph, base = pii.Graph(), [pii.base_spans(t) for t in texts]
    for n, t in enumerate(texts):
        graph.add(n, t, base[n])
    field = pii.Field(np.zeros((pii.FEATURES, 5)), np.zeros((5, 5)), np.array([4.0, 3.0]))
    more = pii.added_spans(graph, field, texts, base)
    assert [texts[0][s:e] for s, k, e in more[0] if k == 0] == ["joe.black@shop"]
    assert pii.Field.fit(graph).agree.min() > 0


def test_messages_equal_enumeration():
    """Marginals of a chain with a skip edge (a tree: exact) and of a loop (near) by enumeration."""
    rng = np.random.default_rng(2)
    for edges, exact in (([(0, 1, 0), (1, 2, 0), (1, 3, 2)], True), ([(0, 1, 0), (1, 2, 0), (0, 2, 1)], False)):
        graph = pii.Graph()
        graph.edges, n = edges, 1 + max(b for _, b, _ in edges)
        graph.x, graph.fixed, graph.tokens = rng.standard_normal((n, pii.FEATURES)).tolist(), [0] * n, [(0, i, i + 1) for i in range(n)]
        chain = rng.standard_normal((5, 5)) / 2
        field = pii.Field(rng.standard_normal((pii.FEATURES, 5)) / 4, chain + chain.T, np.array([0.7, 0.5]))
        unary, table = np.array(graph.x) @ field.unary, field.tables()
        want = np.zeros((n, 5))
        for labels in np.ndindex(*[5] * n):
            weight = np.exp(sum(unary[i, k] for i, k in enumerate(labels)) + sum(table[t][labels[i], labels[j]] for i, j, t in edges))
            for i, k in enumerate(labels):
                want[i, k] += weight
        want /= want.sum(1, keepdims=True)
        assert np.abs(field.marginals(graph, rounds=200) - want).max() < (1e-3 if exact else 0.12)


def test_field_gradient():
    """The pseudo-likelihood's gradient against finite differences."""
    rng = np.random.default_rng(4)
    x, one, around, counts = rng.standard_normal((30, pii.FEATURES)), np.eye(5)[rng.integers(0, 5, 30)], rng.integers(0, 3, (3, 30, 5)).astype(float), np.full(30, 1 / 30)
    w, c, a = rng.standard_normal((pii.FEATURES, 5)) / 3, rng.standard_normal((5, 5)), np.array([0.4, -0.2])
    c = c + c.T
    value = lambda *p: pii.Field.loss(x, one, around, counts, *p, 0.01)[0]
    _, (g_w, g_c, g_a) = pii.Field.loss(x, one, around, counts, w, c, a, 0.01)
    e = np.zeros_like(w)
    e[3, 2] = 1e-6
    assert abs((value(w + e, c, a) - value(w - e, c, a)) / 2e-6 - g_w[3, 2]) < 1e-6
    e = np.zeros_like(c)
    e[1, 3] = e[3, 1] = 1e-6
    assert abs((value(w, c + e, a) - value(w, c - e, a)) / 2e-6 - 2 * g_c[1, 3]) < 1e-6
    for s in (0, 1):
        e = np.eye(2)[s] * 1e-6
        assert abs((value(w, c, a + e) - value(w, c, a - e)) / 2e-6 - g_a[s]) < 1e-6


def test_skip_edges_earn_their_weights(spark):
    """Both agreements leave their start where tied tokens have labels: same tokens on the given
    texts (which have no similar ones), similar ones on mail addresses of one domain."""
    assert pii.train(spark.read.parquet(f"{MIDDLE}/documents.parquet")).agree[0] > pii.MILD + 0.5
    texts = [f"write to ann{i}@corp{i}.example.com, not to bob{i}@corp{i}.example.com; room {i}, line {i + 3}" for i in range(60)]
    graph = pii.Graph()
    for n, t in enumerate(texts):
        graph.add(n, t, pii.base_spans(t))
    assert {t for _, _, t in graph.edges} >= {pii.SIMILAR}
    assert pii.Field.fit(graph).agree[1] > pii.MILD + 0.5


def test_long_early_span_hides_no_other():
    text = "1" * 40 + " " + " ".join(f"10.0.0.{i}" for i in range(30)) + " joe@example.com"
    graph, base = pii.Graph(), pii.base_spans(text)
    graph.add(0, text, base)
    for (_, start, end), fixed in zip(graph.tokens, graph.fixed):
        over = [s for s in base if s[0] < end and s[2] > start]
        assert fixed == (min(over)[1] + 1 if over else 0)


def test_codec_against_library():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        v = vocabulary(f.read())
    rng = random.Random(3)
    pools = ["abc the ing ", " ▁\n\t", "日本語é́😀​", "0123 .,<s></s><0x41>", "aaaa    "]
    texts = ["".join(rng.choice("".join(rng.sample(pools, 2))) for _ in range(rng.randint(0, 200))) for _ in range(1500)] + ["", " ", "a" * 500, " " * 70, "x\x00y"]
    ids, at = v.encode(texts)
    for i, want in enumerate(v.library.encode(texts)):
        assert ids[at[i] : at[i + 1]].tolist() == want
        assert v.decode(want) == v.library.decode(want)


def test_codec_compares_every_text(spark, monkeypatch):
    """A fault in a text whose crc32 64 does not divide gives way to the library; the batches run in
    this process."""
    import public_tokenizers

    path, text = public_tokenizers.path("piece_bpe_32k.model"), "a text with a fault in its pieces"
    assert zlib.crc32(text.encode()) % 64
    with open(path, "rb") as f:
        vocab = vocabulary(f.read())
    right = vocab.encode
    monkeypatch.setattr(vocab, "encode", lambda texts: (right(texts)[0][::-1], right(texts)[1]))
    monkeypatch.setattr(sentencepiece_codec, "vocabulary", lambda model: vocab)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [text, "x"]})
    here = SimpleNamespace(columns=["doc_id", "text"], schema=T.StructType().add("doc_id", "long"), sparkSession=spark)
    here.select = lambda *c: here
    here.mapInArrow = lambda run, schema: list(run(iter([batch])))
    differing = spark.sparkContext.accumulator(0)
    (out,) = sentencepiece_codec.encode_decode(here, path, differing=differing)
    assert out.column("ids").to_pylist() == vocab.library.encode([text, "x"]) and out.column("decoded").to_pylist() == [text, "x"]
    assert differing.value >= 1


def test_codec_refuses_models_that_normalise(monkeypatch):
    import public_tokenizers
    import sentencepiece

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, t: "▁" + t.strip())
    with pytest.raises(ValueError, match="normalises"):
        sentencepiece_codec.MergeVocabulary(model)


@pytest.mark.parametrize(("op", "label", "least"), [(quality_pu, "quality", 0.97), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, op, label, least):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    got = op.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got["predicted"] == got[label]).mean() >= least


def test_mixture(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = mixture.mix(docs).toPandas()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect()}
    assert (got["size"] == got["doc_id"].map(size)).all()
    own = got.groupby("source")["size"].sum().sort_index(key=lambda s: s.map(lambda x: x.encode()))
    weight, level, cap = np.array([(5, 2, 1)[i % 3] for i in range(len(own))], float), 0.0, 3.0 * own.to_numpy()
    for _ in range(100):
        full = weight * level >= cap
        level = (own.sum() - cap[full].sum()) / weight[~full].sum()
    target = dict(zip(own.index, np.minimum(weight * level, cap)))
    assert np.allclose(got["target"], got["source"].map(target))
    taken = (got["copies"] * got["size"]).groupby(got["source"]).sum()
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items()) and (got["copies"] <= 3).all()
    again = mixture.mix(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id")["copies"].tolist() == again.sort_values("doc_id")["copies"].tolist()


def _brute_line_dedup(docs, min_sites=5, min_chars=16):
    key = lambda x: (k if len(k := x.strip(" ").lower()) >= min_chars else None)
    sites, first = defaultdict(set), {}
    for i, text, source in sorted(docs):
        for line in text.split("\n"):
            if key(line):
                sites[key(line)].add(source)
                first.setdefault(key(line), i)
    out = {}
    for i, text, _ in docs:
        seen, kept, lines = set(), [], text.split("\n")
        for line in lines:
            k = key(line)
            common = k and len(sites[k]) >= min_sites
            if not common or (first[k] == i and k not in seen):
                kept.append(line)
            seen.add(k)
        if len(kept) == len(lines) or "".join(kept).split():
            out[i] = "\n".join(kept)
    return out


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force on what the stage before it kept."""
    import public_tokenizers
    import sentencepiece

    now, kept = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        stage(spark, now, SMALL).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, now)
    before, after = kept["toxicity"]
    rejected = {r["doc_id"] for r in toxicity.classify(before, spark.read.parquet(f"{SMALL}/labels.parquet")).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - rejected
    before, after = kept["line dedup"]
    assert {r["doc_id"]: r["text"] for r in after.collect()} == _brute_line_dedup([(r["doc_id"], r["text"], r["source"]) for r in before.collect()])
    before, after = kept["n-gram Jaccard join"]
    sets = _sets([(r["doc_id"], r["text"]) for r in before.collect()])
    links, root = _near(sets), {}
    for i in sorted(sets):
        stack = [i] if i not in root else []
        while stack:
            j = stack.pop()
            if root.setdefault(j, i) == i:
                stack += [k for k in links[j] if k not in root]
    assert {r["doc_id"] for r in after.collect()} == {i for i, r in root.items() if i == r}
    before, after = kept["mixing sources to target weights"]
    copies = {r["doc_id"]: r["copies"] for r in mixture.mix(before).collect()}
    assert after.groupBy("doc_id").count().collect() and all(r["count"] == copies[r["doc_id"]] for r in after.groupBy("doc_id").count().collect())
    before, after = kept["SentencePiece encoding and decoding"]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((r["doc_id"], len(ids := sp.encode(r["text"])), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for r in before.collect())
    assert sorted(map(tuple, after.collect())) == want


def test_line_dedup_exact_counts_near_the_threshold(spark):
    rows = [(i, f"a line of some length\nown line number {i} here\nsix sites hold this one" if i < 6 else "a line of some length", f"s{i}") for i in range(4)]
    rows += [(i, "six sites hold this one", f"s{i}") for i in (4, 5)]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}


@pytest.mark.parametrize("offset", [0.0, 1.0, 2.0, 4.0])
def test_embedding_recall_off_centre(spark, offset):
    """Pairs at cosine 0.9 to 0.93 after an offset in one direction; at 4 nearly all rows link."""
    rng = np.random.default_rng(21)
    common, x = np.zeros(64), []
    common[3] = offset
    while len(x) < 1200:
        v = common + rng.standard_normal(64) / 8
        z = rng.standard_normal(64)
        u = v / np.linalg.norm(v)
        z -= (z @ u) * u
        c = 0.9 + 0.03 * rng.random()
        x += [v, c * u + np.sqrt(1 - c * c) * z / np.linalg.norm(z)]
    x = np.array(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, block_rows=256).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    have = np.array([got[i] for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.95 * want.sum(), (offset, have.sum(), want.sum())


def test_label_model_recovers_accuracies_and_pairs():
    """Simulated votes: voters of known accuracy, one that copies another, one that guesses."""
    rng = np.random.default_rng(3)
    n, right = 60000, [0.9, 0.8, 0.75, 0.85, 0.5]
    y = np.where(rng.random(n) < 0.2, 1, -1)
    v = np.stack([np.where(rng.random(n) < a, y, -y) for a in right], 1)
    v = np.concatenate([v, np.where(rng.random(n) < 0.9, v[:, 0], -v[:, 0])[:, None]], 1)
    v[rng.random(v.shape) < 0.3] = 0
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = toxicity.LabelModel(patterns, counts.astype(float))
    assert (0, 5) in model.cliques and sum(len(c) == 2 for c in model.cliques) == 1
    assert abs(model.prior - 0.2) < 0.03
    for c, t in zip(model.cliques, model.tables):
        if len(c) == 1:
            p = np.exp(t)
            assert abs(p[1][2] / (p[1][0] + p[1][2]) - right[c[0]]) < 0.04
    # the posterior equals Bayes' rule by enumeration over the factors
    for row in patterns[:50]:
        weight = [np.log(1 - model.prior), np.log(model.prior)]
        for c, t in zip(model.cliques, model.tables):
            for label in (0, 1):
                weight[label] += t[label][sum((row[k] + 1) * 3**i for i, k in enumerate(c))]
        assert abs(model.posterior(row[None])[0] - 1 / (1 + np.exp(weight[0] - weight[1]))) < 1e-9


def test_voters_speak_apart():
    words = toxicity.seed_keys()
    voters = toxicity.Voters(np.unique(words))
    texts = pa.array(["such an 1d10t he is", "I will KILL  you tomorrow", "THIS IS LOUD AND ALL IN CAPITALS", "a calm text about rivers and boats", None, "", "shut", "what a moron and a moron"])
    doc, place, n = voters.hits(texts)
    signs = voters.signs(texts, n)
    assert signs.tolist() == [[True, False, False], [False, True, False], [False, False, True], *[[False] * 3] * 5]
    votes = voters.votes(doc, place, n, signs)
    k = voters.WORDS + voters.STEMS
    assert votes.shape[1] == voters.number and (votes[:3, :k] == 0).all()
    assert votes[:, k + 1].tolist() == [1, 0, 0, 0, 0, 0, 0, 0] and votes[:, k].tolist() == [0, 0, 0, 0, 0, 0, 1, 1]
    assert len(np.unique(votes, axis=0)) <= voters.PATTERNS and votes[7, k + 4] == 1 and votes[3, k + 6] == -1


def test_quality_risk_gradient_and_prior():
    """The steps follow the non-negative risk: its gradient against finite differences, the estimated
    prior and the ranking on a mixture whose prior is known."""
    rng = np.random.default_rng(5)
    p, u = rng.standard_normal((40, 3)) + 0.5, rng.standard_normal((60, 3))
    for prior, w in ((0.3, np.array([0.3, -0.2, 0.5, 0.1])), (0.9, np.array([2.0, 2.0, 2.0, -3.0]))):
        g = quality_pu.risk_gradient(p, u, prior, w[:-1], w[-1])
        def risk(z):
            soft = lambda x: np.log1p(np.exp(x))
            minus = soft(u @ z[:-1] + z[-1]).mean() - prior * soft(p @ z[:-1] + z[-1]).mean()
            plus = prior * soft(-(p @ z[:-1] + z[-1])).mean()
            return plus + minus if minus >= 0 else -minus
        want = [(risk(w + e) - risk(w - e)) / 2e-6 for e in np.eye(4) * 1e-6]
        assert np.allclose(g, want, atol=1e-5)
    good, bad = rng.standard_normal((6000, 3)) + 1.6, rng.standard_normal((6000, 3)) - 1.6
    mixed = np.concatenate([good[3000:4800], bad[:4200]])
    assert abs(quality_pu.estimate_prior(good[:3000], mixed) - 0.3) < 0.06


# ---------------------------------------------------------------- exact dedup, vector codes, resampling


def test_rice_code():
    rng = np.random.default_rng(1)
    for width, n in ((1, 1), (50, 50), (1 << 20, 3), (1 << 40, 5000), (10**6, 400000)):
        values = np.unique(rng.integers(0, width, n)).astype(np.uint64)
        k = exact_dedup.rice_parameter(width, len(values))
        unary, rest = exact_dedup.rice_encode(values, k)
        assert (exact_dedup.rice_decode(len(values), k, unary, rest) == values.astype(np.int64)).all()
    assert len(unary) + len(rest) < 8 * len(values) / 10  # a dense set takes few bits a value
    clustered = np.r_[np.arange(3000), (1 << 40) - 1].astype(np.uint64)
    k = exact_dedup.rice_parameter(1 << 40, len(clustered))
    unary, rest = exact_dedup.rice_encode(clustered, k)
    assert len(unary) <= len(clustered) and (exact_dedup.rice_decode(len(clustered), k, unary, rest) == clustered.astype(np.int64)).all()


@pytest.mark.parametrize("bits", [None, 6])
def test_exact_dedup_over_many_messages(spark, bits):
    """A third of all rows are one text. Fingerprints of 6 bits make every row a suspect: texts decide."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta"]
    texts = ["the hot text"] * 500 + [" ".join(rng.choices(words, k=5)) for _ in range(600)] + [f"only {i}" for i in range(400)]
    rng.shuffle(texts)
    rows = [(i, t.replace(" ", rng.choice([" ", "  ", "\t", "\n ", "\x0b"])) if i % 3 else t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[ \\t-\\r]+", " ", t)].append(i)
    want = sorted((i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted(tuple(r) for r in exact_dedup.exact_duplicates(df, message_bits=5, bits=bits).collect()) == want


def test_only_suspects_are_shuffled(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 990}") for i in range(1000)], "doc_id long, text string").repartition(5)
    name = exact_dedup.write_senders(df, "text", 6)
    rows = spark.table(name)
    marks = exact_dedup.suspects(rows, 30, 3).collect()
    assert 20 <= len(marks) <= 24  # ten pairs, and hardly a false one
    mark = spark.createDataFrame(marks, "message long, uid long")
    with exact_dedup._placed_by_message(spark):
        plan = rows.join(mark.hint("merge"), ["message", "uid"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan  # the marks' own


def _lloyd(x, parts, entries, rounds):
    codes, error, books = np.empty((len(x), parts), int), np.zeros(len(x), int), []
    for p, y in enumerate(np.split(x, parts, 1)):
        book = y[:entries].copy()
        for r in range(rounds + 1):
            d = ((y[:, None] - book[None]) ** 2).sum(2)
            at = d.argmin(1)
            if r < rounds:
                for e in range(len(book)):
                    if (at == e).any():
                        book[e] = y[at == e].sum(0) // (at == e).sum()
        codes[:, p], books = at, [*books, book]
        error += d.min(1)
    return codes, error, books


@pytest.mark.parametrize("kind", ["clustered", "ties", "huge"])
def test_codes_against_brute_force(spark, kind):
    rng = np.random.default_rng(6)
    if kind == "clustered":
        x = (rng.standard_normal((40, 16)) * 3)[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 16)) / 10
    elif kind == "ties":  # few values, a third of all rows equal
        x = rng.integers(-2, 3, (1500, 8)) / 2.0
        x[::3] = x[0]
    else:  # beyond exact doubles
        x = rng.standard_normal((300, 8)) * 40000
    rows = [(i, v.tolist(), i % 5 if i % 7 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r for r in anchor_codes.compress(df, entries=32).collect()}
    n = np.floor(x * 1024).astype(np.int64)
    codes, error, books = _lloyd(n, 4, 32, 4)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    per = defaultdict(int)
    for i, e, in enumerate(error):
        per[rows[i][2]] += int(e)
    for i in range(len(x)):
        r = got[i]
        assert (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) == ("".join(f"{c:02x}" for c in codes[i]), error[i], per[rows[i][2]], sha)


def test_trees_save_distances():
    """On clustered rows most balls are owned whole by one entry; every node's ball holds its rows."""
    rng = np.random.default_rng(2)
    x = np.floor(((rng.standard_normal((30, 8)) * 4)[rng.integers(0, 30, 4000)] + rng.standard_normal((4000, 8)) / 20) * 1024).astype(np.int32)
    tree = anchor_codes.Tree(x)
    assert sorted(tree.order) == list(range(4000)) and tree.skip[0] == len(tree.runs) > 100
    for (a, b), centre, radius, total in zip(tree.runs, tree.centre, tree.radius, tree.sums):
        rows = x[tree.order[a:b]].astype(float)
        assert np.sqrt(((rows - centre) ** 2).sum(1)).max() <= radius + 1e-6 and (rows.sum(0) == total).all()
    balls, places, at, saved = anchor_codes.owned(tree, x, anchor_codes.Entries(x[:30].astype(np.int64)))
    assert saved["looked_at"] < 0.5 * saved["rows"] and sum(tree.runs[n][1] - tree.runs[n][0] for n, _ in balls) + len(places) == 4000


def test_crc_of_features():
    texts = pa.array(["Hello, World! hello 123-x", None, "", "Ünïcode wörds " + "y" * 500, "one"])
    got = defaultdict(list)
    base = 0
    for n, words, doc, bucket in importance_resampling.features(texts):
        for d, b in zip(doc, bucket):
            got[base + d].append(b)
        base += n
    for i, t in enumerate(texts.to_pylist()):
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        want = [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]
        assert sorted(got[i]) == sorted(want)


@pytest.mark.parametrize("spread", [0.002, 0.2, 1e-9])
def test_cutoff(spark, spread):
    """Many ties; a bracket that misses is widened until the counts prove it."""
    rng = random.Random(5)
    rows = [(rng.randrange(40) if rng.random() < 0.7 else rng.randrange(1000), i // 2 if i % 9 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "score long, doc_id long, uid long")
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    for k in (1, 2, 750, 2999, 3000):
        s, i, u = order[k - 1]
        assert tuple(importance_resampling.cutoff(df, k, spread, accuracy=50)) == (-s, i is None, i or 0, u)


@pytest.mark.parametrize("dimensions, rank", [(64, 64), (256, 24)])
def test_embedding_plan_holds_for_vectors_it_has_not_seen(dimensions, rank):
    """Tables planned for 1e8 vectors find pairs at the threshold that no sampled row is part of."""
    rng = np.random.default_rng(4)
    axes = rng.standard_normal((rank, dimensions)) if rank < dimensions else np.eye(dimensions)
    draw = lambda n: rng.standard_normal((n, rank)) @ axes + 0.01 * rng.standard_normal((n, dimensions))
    tables, mean, projections = embedding_dedup.plan(10**8, draw(8192), 0.9, 0.98)
    for left, right in embedding_dedup.pairs_at(draw(4096), 0.9, seed=31):
        a, b = (embedding_dedup.codes_of(side, mean, projections) for side in (left, right))
        far = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
        assert (tables.met(a, b, range(tables.number)) & (far <= tables.near)).mean() >= 0.975  # 0.98, less a sample's error
