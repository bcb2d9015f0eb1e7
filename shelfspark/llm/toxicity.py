"""Toxicity by weak supervision.

Voters look at each document and vote toxic, vote clean, or abstain. They speak from different
signs: mined whole words and mined word beginnings (those whose labelled training documents are
mostly toxic, dealt over voters), a fixed list of insults, its masked spellings (digits and marks
for letters), frames of threat and contempt, shouting, the number and the density of hits, and
their absence. Frames, masks and shouting vote without any lexicon hit. A generative label model
over the votes of all kinds of documents estimates each voter's accuracy by
expectation-maximisation and pairs up voters that stay correlated given the label, which then
share one factor. A linear classifier on lexicon and pattern features is trained on the posterior
labels; the labelled training rows of the sample set the scale and shift of its score (Platt).

Lexicon statistics cover at most ``label_rows`` labelled training rows, and the model holds the
``size`` strongest keys; the classifier's fit uses at most ``sample_rows`` documents. The label
model uses the counts of all vote patterns: the voters' states allow ``Voters.PATTERNS`` of them
at most. Every document is scored on its whole text.

Defined cases: null text counts as empty; empty texts get a score (votes: all abstain); labels,
lang, source and doc_id are no inputs of a score; rows that repeat an id are samples of their own;
without toxic training labels the lexicon is the seed list alone."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _WORD, held_out, materialize, mix, runs, slices, span_hashes, utf8
from .text_features import batches_with

HOLD = (5, 0)
# fixed values: plain insults, and frames of threat and contempt
SEED_WORDS = "idiot moron stupid scum trash worthless pathetic disgusting loser clown dumb hate shut ugly".split()
FRAMES = ("shut up", "hate you", "kill you", "hurt you", "destroy you", "go to hell", "you people", "you deserve", "sick of you", "drop dead", "you are nothing", "get lost")
FRAME = "\\b(?:" + "|".join(f.replace(" ", "\\s+") for f in FRAMES) + ")\\b"
MASKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
BEGINNINGS = (4, 5, 6, 7)
TOXIC, CLEAN, ABSTAIN = 1, -1, 0
_BYTES = np.arange(256)
_CAPITAL = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _CAPITAL | (_BYTES >= 97) & (_BYTES <= 122)
_MARK = np.isin(_BYTES, [ord(c) for c in MASKS])
_UNMASK = np.where(_CAPITAL, _BYTES + 32, _BYTES).astype(np.uint8)
_UNMASK[[ord(c) for c in MASKS]] = [ord(c) for c in MASKS.values()]


def text_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key) of every word and every word beginning of a few lengths in bytes, and
    each text's number of words. A beginning's key differs from the same bytes as a whole word."""
    docs, keys, counts = [], [], []
    for begin, end in slices(texts):
        data, at = utf8(texts.slice(begin, end - begin), lower=True)
        starts, ends, doc = runs(_WORD[data], at)
        counts.append(np.bincount(doc, minlength=end - begin))
        docs.append(doc + begin)
        keys.append(span_hashes(data, starts, ends))
        for n in BEGINNINGS:
            long = ends - starts > n
            docs.append(doc[long] + begin)
            keys.append(mix(span_hashes(data, starts[long], starts[long] + n) + np.uint64(n)))
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(counts)


@lru_cache
def seed_keys() -> np.ndarray:
    return text_keys(pa.array([" ".join(SEED_WORDS)]))[1][: len(SEED_WORDS)]


def known_labels(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic) of the labelled training rows, at most ``rows``, those of least hash."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(*HOLD)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id").join(known, "doc_id").distinct()
    return materialize(known.orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(rows))


def mine_lexicon(docs: DataFrame, known: DataFrame, size: int = 240, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Keys whose labelled training documents are toxic in a share near one, with the seed words,
    and those among them that are word beginnings; what comes to the driver is the ``size`` best
    keys. ``known`` has a bounded number of rows, so it is
    broadcast and no text is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            toxic = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            for begin, end in slices(batch.column(1)):
                doc, key, n_words = text_keys(batch.column(1).slice(begin, end - begin))
                stem_keys = np.unique(key[n_words.sum() :]) if len(n_words) else key
                order = np.lexsort((doc, key))
                doc, key = doc[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                doc, key = doc[new], key[new]
                uniq, inverse = np.unique(key, return_inverse=True)
                bad = np.bincount(inverse, toxic[begin + doc], len(uniq)).astype(np.int64)
                all_ = np.bincount(inverse, minlength=len(uniq))
                yield pa.RecordBatch.from_arrays([pa.array(uniq.astype(np.int64)), pa.array(all_), pa.array(bad), pa.array(np.isin(uniq, stem_keys))], names=["key", "n", "bad", "stem"])

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.col("toxic").cast("long"), "text")
    stats = rows.mapInArrow(count, "key long, n long, bad long, stem boolean").groupBy("key").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.bool_or("stem").alias("stem"))
    strength = F.col("bad") / F.col("n") - 1.0 / F.sqrt(F.col("n") + 1.0)
    best = stats.filter((F.col("bad") >= least) & (strength >= 0.59)).orderBy(strength.desc(), "key").limit(size)
    got = best.select("key", "stem").collect()
    mined, stem = (np.array([r[c] for r in got], t) for c, t in (("key", np.int64), ("stem", bool)))
    return np.unique(np.concatenate([seed_keys(), mined.astype(np.uint64)])), mined[stem].astype(np.uint64)


class Voters:
    """Voters of several kinds over the lexicon hits and the bytes of a text."""

    WORDS, STEMS, OTHERS = 4, 4, 7
    #: two states for each word, stem, seed, mask, frame, shouting and absence voter, three for the two others
    PATTERNS = 2 ** (WORDS + STEMS + 5) * 3**2

    def __init__(self, lexicon: np.ndarray, stems: np.ndarray | None = None):
        self.lexicon = lexicon
        stem = np.isin(lexicon, stems if stems is not None else np.empty(0, np.uint64))
        turn = np.argsort(np.argsort(mix(lexicon)))
        self.voter = np.where(stem, self.WORDS + turn % self.STEMS, turn % self.WORDS)
        self.seed = np.isin(lexicon, seed_keys())
        self.number = self.WORDS + self.STEMS + self.OTHERS

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, lexicon index) of each hit, and the word counts."""
        doc, key, words = text_keys(texts)
        place = np.minimum(np.searchsorted(self.lexicon, key), len(self.lexicon) - 1)
        found = self.lexicon[place] == key
        return doc[found], place[found], words

    def signs(self, texts: pa.Array, words: np.ndarray) -> np.ndarray:
        """Whether each text has a masked insult (marks read as letters make it one), a frame, and
        shouts: patterns of the bytes alone."""
        data, at = utf8(texts)
        out = np.zeros((len(words), 3), bool)
        plain = _UNMASK[data]
        starts, ends, doc = runs(_LETTER[plain], at)
        marks = np.concatenate([[0], np.cumsum(_MARK[data])])
        some = marks[ends] > marks[starts]
        out[doc[some][np.isin(span_hashes(plain, starts[some], ends[some]), seed_keys())], 0] = True
        out[:, 1] = pc.fill_null(pc.match_substring_regex(texts, FRAME, ignore_case=True), False).to_numpy(zero_copy_only=False)
        count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
        letters = count(_LETTER[data])
        out[:, 2] = (count(data == 33) > 0.2 * np.maximum(words, 1)) | ((count(_CAPITAL[data]) > 0.5 * letters) & (letters >= 20))
        return out

    def votes(self, doc: np.ndarray, place: np.ndarray, words: np.ndarray, signs: np.ndarray) -> np.ndarray:
        n = len(words)
        out = np.zeros((n, self.number), np.int8)
        out[doc, self.voter[place]] = TOXIC
        count = np.bincount(doc, minlength=n)
        k = self.WORDS + self.STEMS
        out[doc[self.seed[place]], k] = TOXIC
        out[:, k + 1 : k + 4] = np.where(signs, TOXIC, ABSTAIN)
        out[:, k + 4] = np.where(count >= 2, TOXIC, np.where(count == 0, CLEAN, ABSTAIN))
        out[:, k + 5] = np.where(count >= 0.004 * np.maximum(words, 1), TOXIC, CLEAN) * (count > 0)
        out[:, k + 6] = np.where((count == 0) & (words >= 5), CLEAN, ABSTAIN)
        return out

    def features(self, doc: np.ndarray, place: np.ndarray, words: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """Per text: which lexicon keys stand in it, how many hits, hits per word, and its signs."""
        n = len(words)
        x = np.zeros((n, len(self.lexicon) + 6), np.float32)
        x[doc, place] = 1
        count = np.bincount(doc, minlength=n)
        x[:, -6], x[:, -5], x[:, -4] = np.log1p(count), count > 0, np.minimum(count / np.maximum(words, 1) * 50, 3)
        x[:, -3:] = signs
        return x


class LabelModel:
    """Class-conditional vote tables of voters and of pairs of correlated voters."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, gain: float = 0.002, rounds: int = 60, tries: int = 25):
        """``gain``: how much a pair's factor must add to the mean log-likelihood of a document. A
        correlated pair bends the label towards itself, which hides its own residual, so pairs are
        judged by the likelihood of a fit with their factor."""
        v = patterns.astype(int)
        weight = counts / counts.sum()
        start = np.where((v == TOXIC).sum(1) > (v == CLEAN).sum(1), 0.9, 0.05)
        pairs: list[tuple[int, ...]] = []
        single = list(range(v.shape[1]))
        now = self._fit(v, weight, start, pairs, single, tries)
        while True:
            tried = {k: self._fit(v, weight, start, [*pairs, k], [x for x in single if x not in k], tries) for k in combinations(single, 2)}
            best = max(tried, key=lambda k: (tried[k], k), default=None)
            if best is None or tried[best] - now < gain:
                break
            pairs, single, now = [*pairs, best], [x for x in single if x not in best], tried[best]
        self._fit(v, weight, start, pairs, single, rounds)

    def _fit(self, v: np.ndarray, weight: np.ndarray, start: np.ndarray, pairs: list, single: list, rounds: int) -> float:
        """Fit these factors; the mean log-likelihood."""
        self.cliques = [*pairs, *((k,) for k in single)]
        states = [self._states(v, c) for c in self.cliques]
        q = start
        for _ in range(rounds):
            self.prior = float(np.clip((q * weight).sum(), 0.005, 0.5))
            self.tables = []
            log = np.empty((2, len(v)))
            log[0], log[1] = np.log(1 - self.prior), np.log(self.prior)
            for c, s in zip(self.cliques, states):
                t = np.stack([np.bincount(s, w * weight, 3 ** len(c)) + 1e-4 for w in (1 - q, q)])
                self.tables.append(np.log(t / t.sum(1, keepdims=True)))
                log += self.tables[-1][:, s]
            q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
        return float((np.logaddexp(log[0], log[1]) * weight).sum())

    def _states(self, v: np.ndarray, clique: tuple[int, ...]) -> np.ndarray:
        return sum((v[:, k] + 1) * 3**i for i, k in enumerate(clique))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(int)
        odds = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for c, t in zip(self.cliques, self.tables):
            s = self._states(v, c)
            odds += t[1][s] - t[0][s]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(x) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and shift of ``z`` that fit the labels (Platt's smoothed targets, Newton steps)."""
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target))
        w = w - step / max(1.0, np.abs(step).max())
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


class Model:
    def __init__(self, voters: Voters, labels: LabelModel, weights: np.ndarray):
        self.voters, self.labels, self.weights = voters, labels, weights

    def score(self, texts: pa.Array) -> np.ndarray:
        out = []
        for begin, end in slices(texts):
            part = texts.slice(begin, end - begin)
            doc, place, words = self.voters.hits(part)
            x = self.voters.features(doc, place, words, self.voters.signs(part, words))
            out.append(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))
        return np.concatenate(out) if out else np.empty(0)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20000, label_rows: int = 50000) -> Model:
    known = known_labels(docs, labels, label_rows)
    voters = Voters(*mine_lexicon(docs, known))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(1)):
                texts = batch.column(1).slice(begin, end - begin)
                doc, place, words = voters.hits(texts)
                signs = voters.signs(texts, words)
                votes = voters.votes(doc, place, words, signs)
                both = np.unique(np.stack([doc, place], 1), axis=0)  # each key once, and the count apart
                cuts = np.searchsorted(both[:, 0], np.arange(len(words) + 1))
                found = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(both[:, 1].astype(np.int32)))
                hits = np.bincount(doc, minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array([x.tobytes() for x in votes], pa.binary()), found, pa.array(hits), pa.array(words.astype(np.int64)), pa.array([x.tobytes() for x in signs], pa.binary())],
                    names=["doc_id", *COLUMNS],
                )

    voted = materialize(docs.select("doc_id", "text").mapInArrow(vote, "doc_id long, votes binary, found array<int>, hits long, words long, signs binary"))
    patterns = voted.groupBy("votes").count().orderBy("votes").toArrow()  # Voters.PATTERNS rows at most
    if not patterns.num_rows:
        return Model(voters, None, np.zeros(len(voters.lexicon) + 7))
    v = np.frombuffer(b"".join(patterns.column("votes").to_pylist()), np.int8).reshape(patterns.num_rows, -1)
    model = LabelModel(v, patterns.column("count").to_numpy().astype(float))
    # samples are limited row by row, so a repeated id cannot bring more
    order = [F.xxhash64(F.lit(11), "doc_id", "votes", "found", "words"), F.col("doc_id"), F.col("words")]
    rows = voted.orderBy(*order).limit(sample_rows).select(*COLUMNS).toArrow()
    weights = _logistic(_rows(voters, rows), model.posterior(np.frombuffer(b"".join(rows.column("votes").to_pylist()), np.int8).reshape(rows.num_rows, -1)))
    seen = voted.join(F.broadcast(known), "doc_id").orderBy(*order).limit(sample_rows).select(*COLUMNS, "toxic").toArrow()
    if seen.num_rows:
        scale, shift = _platt(_rows(voters, seen) @ weights[:-1] + weights[-1], seen.column("toxic").to_numpy().astype(float))
        weights = weights * scale
        weights[-1] += shift
    return Model(voters, model, weights)


COLUMNS = ["votes", "found", "hits", "words", "signs"]


def _rows(voters: Voters, rows: pa.Table) -> np.ndarray:
    found = rows.column("found").combine_chunks()
    doc = np.repeat(np.arange(rows.num_rows), np.asarray(found.value_lengths()))
    signs = np.frombuffer(b"".join(rows.column("signs").to_pylist()), bool).reshape(-1, 3)
    words, hits = rows.column("words").to_numpy(), rows.column("hits").to_numpy()
    x = voters.features(doc, found.flatten().to_numpy(), words, signs)
    x[:, -6], x[:, -4] = np.log1p(hits), np.minimum(hits / np.maximum(words, 1) * 50, 3)
    return x


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_with(batches, model.score, "score")

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(*HOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 20000) -> DataFrame:
    return score(docs, train(docs, labels, sample_rows))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pipeline's form: the rows of ``docs`` that the classifier does not reject."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.score(batch.column(batch.schema.get_field_index("text"))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
