"""Importance resampling of documents towards a target distribution.

Features are hashed runs of one and two words. Their counts over all documents and over the target
texts give one gain for each bucket, an array that scores every document; a Gumbel number drawn from
a hash of the id makes the highest scores a sample without replacement by weight. The cutoff is found
without sorting everything: a quantile sketch proposes a bracket of scores around it, exact counts
of what lies above and inside prove that the bracket holds the cutoff (else it is widened and
counted again), and only the bracket is sorted. What is drawn gets its place from sorted ranges.

Defined cases: null and empty texts have no features, weight 0 and, with fewer words than
``min_words``, no rank; long texts count whole; a null id is hashed as an empty one and stands after
others of its score; rows equal in score and id are ranked one after the other; repeated rows are
rows of their own; other columns are not read; empty tables give empty results, and without target
texts the gains only tell rare buckets from frequent ones."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import ranked
from .common import _WORD, materialize, runs, slices, utf8
from .text_features import _FOLD

BUCKETS = 10000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of each span, from the registers ``state`` before them: all
    spans take their next byte together, and the few longest end in zlib."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    start, now = starts[order], state[order].copy()
    longer = len(size) - np.searchsorted(np.sort(size), np.arange(int(size.max(initial=0)) + 1), "right")  # spans of more than j bytes
    for j in range(len(longer) - 1):
        m = int(longer[j])
        if m < 16:
            for i in range(m):
                rest = data[start[i] + j : ends[order[i]]].tobytes()
                now[i] = zlib.crc32(rest, int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            break
        now[:m] = _CRC[(now[:m] ^ data[start[:m] + j]) & 255] ^ (now[:m] >> 8)
    out = np.empty_like(now)
    out[order] = now
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of whole texts as (number of texts, words of each, then every feature's text and bucket)."""
    for begin, end in slices(texts):
        data, at = utf8(texts.slice(begin, end - begin))
        data = _FOLD[data]
        starts, ends, doc = runs(_WORD[data], at)
        first = crc_runs(data, starts, ends, np.full(len(starts), 0xFFFFFFFF, np.uint32))
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        spaced = _CRC[(first[pair] ^ np.uint32(32)) & 255] ^ (first[pair] >> 8)
        second = crc_runs(data, starts[pair + 1], ends[pair + 1], spaced)
        crc = np.concatenate([first, second]) ^ np.uint32(0xFFFFFFFF)
        yield end - begin, np.bincount(doc, minlength=end - begin), np.concatenate([doc, doc[pair]]), (crc % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: counted in tasks, summed by Spark; the driver gets one
    row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, bucket in features(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier a bucket is under the target, both smoothed by one."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(source, target)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each document's features."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, words, doc, bucket in features(batch.column(1), len(gain)):
                many = np.bincount(doc, minlength=n)
                total = np.bincount(doc, gain[bucket], minlength=n).astype(np.int64)
                rows.append(np.stack([words, many, total // np.maximum(many, 1)]).astype(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in np.concatenate(rows, 1)]], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """A Gumbel number of each id, in thousandths: the same in every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def cutoff(rows: DataFrame, k: int, spread: float = 0.002, accuracy: int = 10000) -> tuple:
    """The k-th of ``rows`` (1 <= k <= their number) in the order of ``_place``, as its key."""
    total = rows.count()
    at = 1 - k / total
    while True:
        low, high = max(0.0, at - spread), min(1.0, at + spread)
        a, b = rows.agg(F.percentile_approx("score", [low, high], accuracy)).first()[0]
        inside = (F.lit(True) if low == 0 else F.col("score") >= a) & (F.lit(True) if high == 1 else F.col("score") <= b)
        above = F.lit(False) if high == 1 else F.col("score") > b
        over, within = rows.agg(F.count_if(above), F.count_if(inside)).first()
        if over < k <= over + within:
            break
        spread *= 4  # the sketch missed: count a wider bracket
    return ranked(rows.filter(inside), [], _place(), "rank").filter(F.col("rank") == k - over).select(*_place()).first()


def _place() -> list[Column]:
    return [-F.col("score"), F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("uid")]


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", percent: int = 25, min_words: int = 20, seed: int = 7, spread: float = 0.002) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank 1, 2, ... where it is drawn."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    scored = weigh(docs, gain, text).withColumn("score", F.col("weight") + gumbel(seed)).withColumn("uid", F.monotonically_increasing_id())
    scored = materialize(scored)
    fit = scored.filter(F.col("n_words") >= min_words)
    k = fit.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = cutoff(fit, k, spread)
    drawn = (F.col("n_words") >= min_words) & (F.struct(*_place()) <= F.struct(*[F.lit(x).cast("boolean" if isinstance(x, bool) else "long") for x in last]))
    places = ranked(scored.filter(drawn).select(*columns, "uid"), [], _place(), "rank")
    return places.select(*columns, F.col("rank").cast("long").alias("rank")).unionByName(scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


#: The same in SQL, with CRC-32 computed from its polynomial, byte by byte, for each distinct feature.
ORACLE_SQL = f"""WITH RECURSIVE bits AS (SELECT range AS byte, 0 AS step, range AS value FROM range(256)
        UNION ALL SELECT byte, step + 1, CASE WHEN value % 2 = 1 THEN xor(value // 2, 3988292384) ELSE value // 2 END FROM bits WHERE step < 8),
    crc_table AS (SELECT list(value ORDER BY byte) AS entries FROM bits WHERE step = 8),
    texts AS (SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS place, text FROM documents UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark),
    worded AS (SELECT kind, id, place, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
    found AS (SELECT kind, id, place, unnest(w) AS feature FROM worded UNION ALL SELECT kind, id, place, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded WHERE len(w) > 1),
    distinct_features AS (SELECT feature, list_transform(range(0, len(hex(encode(feature))) // 2), lambda i: CAST('0x' || substr(hex(encode(feature)), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM (SELECT DISTINCT feature FROM found)),
    hashed AS (SELECT feature, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(c // 256, entries[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket FROM distinct_features, crc_table),
    counted AS (SELECT kind, id, place, bucket FROM found JOIN hashed USING (feature)),
    sizes AS (SELECT bucket, CAST(count(*) FILTER (kind = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (kind = 1) AS DOUBLE) AS t FROM counted GROUP BY 1),
    totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sizes),
    gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS g FROM sizes, totals),
    weighed AS (SELECT worded.id AS doc_id, worded.place, any_value(len(w)) AS n_words, count(bucket) AS n_features, CASE WHEN count(bucket) = 0 THEN 0 ELSE CAST(floor(CAST(sum(g) AS DOUBLE) / count(bucket)) AS BIGINT) END AS weight
        FROM worded LEFT JOIN (SELECT place, counted.bucket, g FROM counted JOIN gain USING (bucket) WHERE kind = 0) f ON f.place = worded.place WHERE worded.kind = 0 GROUP BY 1, 2),
    scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM weighed),
    placed AS (SELECT doc_id, place, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM placed) // 100 THEN rank END AS rank FROM scored LEFT JOIN placed USING (doc_id, place)"""
