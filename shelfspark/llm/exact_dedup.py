"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Texts are equal when identical after every run of ASCII white space became one space. Each input
partition (sender) writes its rows once, normalised, in messages of bounded size, to a table
bucketed by message, so that later joins on the message move no text. A message's fingerprints, cut
to the bits that the number of rows needs, go to their owners sorted and Rice-coded (Golomb's code
with a power of two): quotients in unary, remainders in plain bits. Owners decode all that came for
their range of fingerprints and answer with one bit for every value: does another message hold it
too? Rows whose bit is set, or whose value repeats in their own message, are suspects, and only these are
shuffled with their text and compared byte by byte (grouping by the text itself, partly aggregated
first). What hashes say never decides.

Defined cases: null text is empty, and empty texts are equal; long texts are compared whole; of
equal texts the smallest doc_id stays, null after all others, and of rows equal in that too exactly
one; repeated rows are rows of their own; other columns, whatever their names, are not read; an
empty table gives an empty result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_facts, materialize, shared_dir

SPACES = "[\\x20\\x09-\\x0D]+"
OWNER_ROWS = 1 << 20
SPARE_BITS = 10  # a fingerprint equals that of another text about once in 2**SPARE_BITS

ORACLE_SQL = """WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
    g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t"""


# ---------------------------------------------------------------- the code

def rice_parameter(width: int, n: int) -> int:
    """Bits of the remainder for ``n`` values spread over ``width``: the mean gap's."""
    return max(0, (width // max(n, 1)).bit_length() - 1)


def rice_encode(values: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """Sorted distinct values as (unary quotients, remainders) of their gaps."""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = (gaps[:, None] >> np.arange(k)) & 1
    return np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k)
    remainders = bits.astype(np.int64) @ (np.int64(1) << np.arange(k, dtype=np.int64))
    return np.cumsum((quotients.astype(np.int64) << k) + remainders + 1) - 1


# ---------------------------------------------------------------- senders and owners

@contextmanager
def _placed_by_message(spark: SparkSession) -> Iterator[None]:
    """While this holds, rows that lie together by message count as placed for joins on (message,
    uid) too, so that Spark does not shuffle the bucketed side."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def write_senders(docs: DataFrame, text: str, message_bits: int) -> str:
    """Name of the table (doc_id, text normalised, sha, fp, uid, message) of ``docs``, bucketed by
    message. A message is a run of at most 2**message_bits rows of one input partition."""
    spark = docs.sparkSession
    normal = docs.select("doc_id", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ").alias("text"))
    rows = normal.select("doc_id", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), F.xxhash64("text").alias("fp"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.withColumn("message", F.shiftright("uid", message_bits))
    name = f"exact_dedup_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.option("path", f"{shared_dir(spark)}/tables/{name}").bucketBy(buckets, "message").saveAsTable(name)
    return name


def suspects(rows: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """(message, uid) of rows whose fingerprint, cut to ``bits``, stands in another row too."""
    local_bits = bits - owner_bits

    def cut(table: pa.Table) -> np.ndarray:
        return table["fp"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        values = np.unique(cut(table))
        owners, first = np.unique(values >> np.uint64(local_bits), return_index=True)
        out: dict[str, list] = {"owner": [], "message": [], "n": [], "k": [], "unary": [], "rest": []}
        for owner, a, b in zip(owners, first, [*first[1:], len(values)]):
            k = rice_parameter(1 << local_bits, int(b - a))
            unary, rest = rice_encode(values[a:b] & np.uint64((1 << local_bits) - 1), k)
            for name, x in zip(out, (int(owner), key[0].as_py(), int(b - a), k, unary, rest)):
                out[name].append(x)
        return pa.table(out, schema=pa.schema([("owner", pa.int64()), ("message", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary())]))

    def own(key: tuple, table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        values = [rice_decode(m["n"], m["k"], m["unary"], m["rest"]) for m in got]
        _, back, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        again, at, answers = times[back] > 1, 0, []
        for m, v in zip(got, values):
            mine = again[at : at + len(v)]
            at += len(v)
            if mine.any():  # no answer says that nothing repeats
                answers.append((m["message"], m["owner"], np.packbits(mine).tobytes()))
        return pa.table([pa.array([a[i] for a in answers], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["message", "owner", "bitmap"])

    def receive(key: tuple, mine: pa.Table, answers: pa.Table) -> pa.Table:
        values, back, times = np.unique(cut(mine), return_inverse=True, return_counts=True)
        marked = times > 1
        owners = values >> np.uint64(local_bits)
        for a in answers.to_pylist():
            begin, end = np.searchsorted(owners, np.array([a["owner"], a["owner"] + 1], np.uint64))
            marked[begin:end] |= np.unpackbits(np.frombuffer(a["bitmap"], np.uint8), count=end - begin).astype(bool)
        return mine.select(["message", "uid"]).filter(pa.array(marked[back], pa.bool_()))

    narrow = rows.select("message", "uid", "fp")
    sent = narrow.groupBy("message").applyInArrow(send, "owner long, message long, n int, k int, unary binary, rest binary")
    answered = sent.groupBy("owner").applyInArrow(own, "message long, owner long, bitmap binary")
    return narrow.groupBy("message").cogroup(answered.groupBy("message")).applyInArrow(receive, "message long, uid long")


def exact_duplicates(docs: DataFrame, text: str = "text", message_bits: int = 17, bits: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``."""
    spark = docs.sparkSession
    name = write_senders(docs, text, message_bits)
    rows = spark.table(name)
    total = rows.count()
    owner_bits = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // OWNER_ROWS, 1).bit_length()
    bits = min(52, max(bits or total.bit_length() + SPARE_BITS, owner_bits))
    with _placed_by_message(spark):
        marks = materialize(suspects(rows, bits, owner_bits))
        found = materialize(rows.join(marks, ["message", "uid"]).groupBy("fp", "sha", "text").agg(
            F.count("*").alias("n"), F.min("doc_id").alias("keep_id"), F.coalesce(F.min_by("uid", "doc_id"), F.min("uid")).alias("keep_uid")).drop("text"))
        if not found.groupBy("fp", "sha").count().filter("count > 1").isEmpty():
            raise ValueError("two texts share one SHA-256 value")
        narrow = rows.select("message", "uid", "doc_id", "fp", "sha")
        alone = narrow.join(marks, ["message", "uid"], "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
        held = materialize(narrow.join(marks, ["message", "uid"], "left_semi").drop("message"))
        joined = join_facts(held, found, ["fp", "sha"], "n", total)
        grouped = joined.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("uid") == F.col("keep_uid")).alias("kept"), "sha")
        out = materialize(alone.unionByName(grouped))
    spark.sql(f"DROP TABLE {name}")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns. Rows are told apart by
    id and text; of rows equal in both one stays."""
    kept = exact_duplicates(docs, text).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ").cast("binary"), 256)
    first = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__doc"), sha.alias("__s"))
    hit = first.join(kept, first["__doc"].eqNullSafe(kept["__id"]) & (first["__s"] == kept["__sha"]))
    return hit.groupBy("__id", "__sha").agg(F.first("__row").alias("__row")).select("__row.*")
