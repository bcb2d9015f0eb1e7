"""Shared pieces of the training-data operators: shared-folder tables, hashed words of Arrow
text columns, blocks of hot groups, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SLICE_BYTES = 1 << 20
MAP_BITS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session
    (tests) may leave it unset and gets a fresh temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives the loss of
    an executor, and gives the planner true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(*columns: Column | str) -> list[Column]:
    """Two independent 64-bit hashes ``k1`` and ``k2`` of the columns: one 128-bit key."""
    return [F.xxhash64(F.lit(k), *columns).alias(f"k{k}") for k in (1, 2)]


def numbered(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... within each (null-safe) key, in no particular order. Ranks
    are taken per input partition and key and start at the sizes before, so that a hot key is
    never one task's."""
    rows = materialize(rows.withColumn("__p", F.spark_partition_id()))
    per = rows.groupBy("__p", *key).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("__before", before).drop("__n")  # a row per input partition and key
    local = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__p", *key).orderBy(F.lit(0))) - 1)
    on = [local[c].eqNullSafe(per[c]) for c in ("__p", *key)]
    joined = local.join(per, on[0] if len(on) == 1 else reduce(Column.__and__, on))
    return joined.select(*[local[c] for c in rows.columns if c != "__p"], (F.col("__r") + F.col("__before")).alias(name))


def join_facts(rows: DataFrame, facts: DataFrame, key: list[str], members: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``facts``, one row for each (null-safe) key and its number of
    ``members``. Keys of more than 1 / ``share`` of the ``total`` rows, fewer than ``share`` by that
    bound, are broadcast, so that no hot key is one task's; the others meet by shuffle."""
    named = facts.select(*[F.col(c).alias(f"__{c}") if c in key else F.col(c) for c in facts.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
    hot = F.col(members) * share > total
    large = F.broadcast(named.filter(hot))
    met = rows.join(large, same).unionByName(rows.join(large, same, "left_anti").join(named.filter(~hot), same))
    return met.drop(*[f"__{c}" for c in key])


def flagged(rows: DataFrame, keys: DataFrame, on: list[str], name: str, bits: int = 16, most: int = 1 << 28) -> DataFrame:
    """``rows`` with ``name``: false where the key ``on`` is none of ``keys`` for certain, true where
    it may be one. The keys' hashes set ``bits`` bits each, at most ``most`` (32 MB) in all, in bitmaps
    that are broadcast, so that a join of the true rows alone decides exactly, and texts whose key is
    not asked for are never shuffled. ``keys`` is read twice."""
    maps = min(keys.count() * bits, most) // MAP_BITS + 1
    slot = F.pmod(F.xxhash64(F.lit(97), *on), F.lit(maps * MAP_BITS))
    place = F.floor(slot / MAP_BITS).alias("__map"), F.pmod(slot, F.lit(MAP_BITS)).alias("__bit")
    held = keys.select(*place).repartition("__map").groupBy("__map").agg(F.substring(F.bitmap_construct_agg("__bit"), 1, MAP_BITS // 8).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, F.col("__bit") % 8) == 1, F.lit(False))
    return rows.select("*", *place).join(F.broadcast(held), "__map", "left").select(*rows.columns, found.alias(name))


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """Rows set apart: crc32 of the id as text leaves ``remainder`` modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


# ---------------------------------------------------------------- hashed words

_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {"n": 0}
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        _POWERS.update(n=n, up=np.cumprod(np.full(n, _MULT)), down=np.cumprod(np.full(n, inverse)))
    return _POWERS["up"], _POWERS["down"]


def utf8(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column, end to end, and each text's offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
    return data, at - at[0]


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``size`` bytes, so that work arrays stay bounded."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    begin = 0
    while begin < len(ends):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + size, "right")))
        yield begin, end
        begin = end


def runs(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of true bytes that lie in one text."""
    n = len(member)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = member[:-1], member[1:]
    edge = at[(at > 0) & (at < n)]
    before[edge], after[edge - 1] = False, False
    starts, ends = np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span, the same wherever the span lies."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(max(SLICE_BYTES, len(data)))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word: a run of ASCII letters, digits and non-ASCII characters
    of the lower-cased text."""
    data, at = utf8(texts, lower=True)
    starts, ends, doc = runs(_WORD[data], at)
    return doc, span_hashes(data, starts, ends)


def shingles(texts: pa.Array, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``k`` words. A text with fewer words has
    one shingle of all of them; a text without words has none."""
    out: list[np.ndarray] = []
    for begin, end in slices(texts):
        doc, h = words(texts.slice(begin, end - begin))
        n = np.bincount(doc, minlength=end - begin)
        first = np.concatenate([[0], np.cumsum(n)])
        weights = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
        padded = np.concatenate([h, np.zeros(k, np.uint64)])
        total = np.zeros(len(h), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                total += padded[j : j + len(h)] * weights[j]
        total = mix(total)
        for i in range(end - begin):
            if n[i] >= k:
                out.append(np.unique(total[first[i] : first[i + 1] - k + 1]))
            elif n[i]:
                with np.errstate(over="ignore"):
                    out.append(mix(np.array([(h[first[i] : first[i + 1]] * weights[: n[i]]).sum(dtype=np.uint64)])))
            else:
                out.append(np.empty(0, np.uint64))
    return out


# ---------------------------------------------------------------- groups in blocks

def in_blocks(rows: DataFrame, key: list[str], block_rows: int, by: str, met: str | None = None) -> DataFrame:
    """Split every group of more than ``block_rows`` rows into blocks by a hash of column ``by``
    and pair the blocks: a row gets the pairs (``block_a`` <= ``block_b``) of its block
    ``block``. Any two rows of a group meet in exactly one pair, and no task gets a whole hot
    group. Only the keys of large groups are kept beside the rows; Spark broadcasts them where
    they are below its size limit and joins by shuffle, with skew splitting, where not.

    ``met``: a column whose equal values (not null) say that rows have met elsewhere. Many rows of
    one such value get blocks of their own, which are not paired with each other, and a group
    whose rows have all met goes."""
    rows = rows.withColumn("__met", F.col(met) if met else F.lit(None).cast("long"))
    families = materialize(rows.groupBy(*key, "__met").agg(F.count("*").alias("n")))
    many = F.col("__met").isNotNull() & (F.col("n") >= block_rows)
    if met:
        new = families.groupBy(*key).agg(F.count("*").alias("f"), F.max("__met").alias("m")).filter("f > 1 or m is null")
        rows = rows.join(new, key, "left_semi")
    large = families.groupBy(*key).agg(F.sum("n").alias("all"), F.sum(F.when(many, 0).otherwise(F.col("n"))).alias("rest")).filter(F.col("all") > block_rows)
    large = large.select(*key, F.ceil(F.col("rest") / block_rows).cast("int").alias("__rest"))
    own = families.filter(many).join(large, key).withColumn("__own", F.ceil(F.col("n") / block_rows).cast("int"))
    upto = F.sum("__own").over(Window.partitionBy(*key).orderBy("__met").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    own = materialize(own.select(*key, "__met", "__own", (F.col("__rest") + upto - F.col("__own")).alias("__first")))
    per = materialize(large.join(own.groupBy(*key).agg(F.sum("__own").cast("int").alias("__more")), key, "left").select(*key, "__rest", (F.col("__rest") + F.coalesce("__more", F.lit(0))).alias("__all")))
    rows = rows.join(per, key, "left").join(own, [*key, "__met"], "left")
    hash_ = F.xxhash64(F.lit(71), by)
    block = F.when(F.col("__first").isNotNull(), F.col("__first") + F.pmod(hash_, "__own")).otherwise(F.pmod(hash_, F.greatest(F.coalesce("__rest", F.lit(1)), F.lit(1))))
    rows = rows.withColumn("block", block.cast("int"))
    every = F.sequence(F.lit(0), F.coalesce("__all", F.lit(1)) - 1)
    apart = F.filter(every, lambda x: F.col("__first").isNull() | (x < F.col("__first")) | (x >= F.col("__first") + F.col("__own")))
    rows = rows.select("*", F.explode(apart).alias("__other"))
    return rows.select(*[c for c in rows.columns if not c.startswith("__")], F.least("block", "__other").alias("block_a"), F.greatest("block", "__other").alias("block_b"))


def together(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of each key side by side in one partition, for ``groups_of``."""
    return rows.repartition(*key).sortWithinPartitions(*key)


def groups_of(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as one table, from batches sorted by key; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for c in key:
            v = batch.column(c).to_numpy(zero_copy_only=False)
            changed[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(changed), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(batch.column(c)[a].as_py() for c in key)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def binary_rows(column: pa.ChunkedArray | pa.Array, dtype: type = np.uint64) -> list[np.ndarray]:
    """Numpy views of a binary column's values."""
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


# ---------------------------------------------------------------- components

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b), component being the smallest id that can
    be reached. Alternates large-star and small-star contractions (Kiveris et al. 2014): a
    logarithmic number of rounds, all state in tables, no graph in a task or in the driver. The
    minima of a round are written first, so that Spark can split a hub in the join."""

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(pairs.distinct())
    seen = state(now)
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = materialize(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        was, seen = seen, state(now)
        if was == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def union_find(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component (vectorised label passing)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
