"""N-gram Jaccard join by chosen paths.

Each document is the set of its hashed five-word shingles. Documents of equal sets are one class
with a weight. The join (Christiani, Pagh and Sivertsen 2018) splits the sets recursively: at a
node every set goes down for each of its tokens whose hash, drawn with the node's path, falls
under 1 / (threshold * size), so similar sets go down together. A node with few sets, or with many
that are alike on average, is searched by brute force; others split again, to ``depth`` levels,
with ``FAN`` times as many children, so that few pairs are lost below the first level. Independent
runs repeat until the target recall at the threshold for pairs whose nodes split at every level
(see ``missed``).

Brute force has two steps, both in blocks of bounded size: sketches (the least hashes of each
set) drop pairs that cannot link, and whole sets decide the rest exactly. A pair is judged only in
the first leaf that both sets share, so it counts once, and sets whose first leaf is the same are
not paired in later ones. Blocks give link counts and a spanning forest of their links, never the
pairs of a hot group.

Words are runs of ASCII letters, digits and non-ASCII characters of the lower-cased text.

Defined cases: null and wordless texts link with nothing; a text with fewer than five words has
one shingle of all its words; equal texts link with Jaccard 1; repeated rows count each; unlike
texts under one id are documents of their own; a null id links with nothing; extra columns are not
read; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_rows, components, flagged, groups_of, in_blocks, materialize, mix, row_keys, shingles, slices, together, union_find

LEAF = ["leaf", "block_a", "block_b"]
ROW = ["doc_id", "k1", "k2"]
SKETCH = 32
ALIKE = 4
FAN = 2.0


def missed(runs: int, threshold: float, depth: int, fan: float = FAN) -> float:
    """Chance that ``runs`` lose a pair at the threshold whose nodes all split, down to ``depth``
    levels. The worst pair is a set and its subset: their larger set's sketch shares binomially
    many tokens with the other, the same in every run, and under half of them ends the pair."""
    lost = 0.0
    for s in range(SKETCH + 1):
        chance = math.comb(SKETCH, s) * threshold**s * (1 - threshold) ** (SKETCH - s)
        stays = 1.0
        for _ in range(depth - 1):
            stays = 1 - (1 - min(1.0, fan / (threshold * SKETCH)) * stays) ** s
        lost += chance * (math.exp(-runs * stays) if 2 * s >= SKETCH else 1.0)
    return lost


def runs_for(threshold: float, recall: float, depth: int = 3) -> int:
    """Runs that a pair at the threshold needs, if its nodes split at every level. Where the sketch
    itself loses more than the recall allows, runs add at most a tenth of the allowance."""
    runs, sketch = 1, missed(10**6, threshold, depth)
    while missed(runs, threshold, depth) > max(1 - recall, sketch + (1 - recall) / 10):
        runs += 1
    return runs


def _limit(size: int, threshold: float) -> np.uint64:
    return np.uint64(min(2**64 - 1, int(2**64 / (threshold * size))))


def first_paths(s: np.ndarray, runs: int, threshold: float) -> np.ndarray:
    limit, out = _limit(len(s), threshold), []
    for r in range(runs):
        salt = mix(np.array([r + 101], np.uint64))[0]
        drawn = mix(s ^ salt)
        out.append(mix(drawn[drawn <= limit] + np.uint64(r)))
    return np.concatenate(out)


def next_paths(s: np.ndarray, path: int, threshold: float) -> np.ndarray:
    drawn = mix(s ^ np.int64(path).astype(np.uint64))
    return mix(drawn[drawn <= _limit(len(s), threshold / FAN)])


def describe(docs: DataFrame, runs: int, threshold: float, text: str) -> DataFrame:
    """(doc_id, k1, k2, n, set_key, low, alike, paths) of every row; k1 and k2 key the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(3)):
                n, keys, low, alike, paths = [], [], [], [], []
                for s in shingles(batch.column(3).slice(begin, end - begin)):
                    n.append(len(s))
                    keys.append(set_key(s))
                    low.append(s[:SKETCH].tobytes())
                    alike.append([int(mix(s ^ np.uint64(k + 7)).min().astype(np.int64)) for k in range(ALIKE)] if len(s) else [])
                    paths.append(first_paths(s, runs, threshold).astype(np.int64) if len(s) else [])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(begin, end - begin) for k in range(3)), pa.array(n, pa.int32()), pa.array(keys, pa.binary()), pa.array(low, pa.binary()), pa.array(alike, pa.list_(pa.int64())), pa.array(paths, pa.list_(pa.int64()))],
                    names=["doc_id", "k1", "k2", "n", "set_key", "low", "alike", "paths"],
                )

    return docs.select("doc_id", *row_keys(text), text).mapInArrow(run, "doc_id long, k1 long, k2 long, n int, set_key binary, low binary, alike array<long>, paths array<long>")


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def with_sets(docs: DataFrame, of: DataFrame, text: str) -> DataFrame:
    """``of`` (sid, doc_id, k1, k2, and more) with ``tokens``, the whole set of the text that
    (doc_id, k1, k2) names; a row for each repetition of that text under its id. Only texts that
    ``of`` may name are shuffled."""
    more = [c for c in of.columns if c not in ROW]
    rows = flagged(docs.select("doc_id", *row_keys(text), F.col(text).alias("__text")), of, ROW, "__named")
    joined = rows.filter("__named").join(of, ROW).select(*more, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(begin, end - begin)
                sets = [s.tobytes() for s in shingles(part.column(part.num_columns - 1))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.binary())], names=[*more, "tokens"])

    return joined.mapInArrow(run, of.select(*more).schema.add("tokens", T.BinaryType()))


def leaves(sets: DataFrame, threshold: float, leaf_rows: int, depth: int) -> DataFrame:
    """(leaf, sid) of the nodes to search: with two sets at least, and few or alike ones. Below
    the first level a set is split on its sketch, a sample of its tokens that similar sets share
    to the same degree, so no text is read again."""
    now = sets.select(F.explode(F.array_distinct("paths")).alias("leaf"), "sid")
    out = None
    for level in range(1, depth + 1):
        nodes = materialize(now.groupBy("leaf").agg(F.count("*").alias("m")).filter("m > 1"))
        if level < depth:
            large = nodes.filter(F.col("m") > leaf_rows)
            rows = materialize(now.join(large, "leaf").join(sets.select("sid", "alike"), "sid").select("leaf", "m", "alike"))
            same = [rows.groupBy("leaf", "m", F.col("alike")[k].alias("value")).agg(F.count("*").alias("same")) for k in range(ALIKE)]
            same = reduce(DataFrame.unionByName, same)
            share = same.groupBy("leaf", "m").agg((F.sum(F.col("same") * F.col("same")) / (ALIKE * F.col("m") * F.col("m"))).alias("share"))
            split = materialize(share.filter(F.col("share") < threshold / 2).select("leaf"))
            stay = nodes.select("leaf").join(split, "leaf", "left_anti")
        else:
            split, stay = None, nodes.select("leaf")
        here = materialize(now.join(stay, "leaf", "left_semi"))
        out = here if out is None else out.unionByName(here)
        if split is None or split.isEmpty():
            break
        down = now.join(split, "leaf", "left_semi").join(sets.select("sid", "low"), "sid").select("leaf", "sid", "low")

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                paths = [next_paths(s, p, threshold).astype(np.int64) for p, s in zip(batch.column(0).to_pylist(), binary_rows(batch.column(2)))]
                if paths:
                    ids = np.repeat(batch.column(1).to_numpy(), [len(p) for p in paths])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths)), pa.array(ids)], names=["leaf", "sid"])

        now = materialize(down.mapInArrow(descend, "leaf long, sid long").distinct())
    return out


def _shared(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of the left with the right rows' token sets."""
    tokens = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    column, owner = column[keep], owner[keep]
    _, column = np.unique(column, return_inverse=True)
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, columns, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        one = np.zeros((len(rows), min(width, columns - a)), np.float32)
        one[owner[lo:hi], column[lo:hi] - a] = 1
        total += one[left] @ one[right].T
    return total


def _new_here(known: list[np.ndarray], leaf: int, left: np.ndarray, right: np.ndarray, possible: np.ndarray) -> np.ndarray:
    """Of the possible pairs those that share no leaf before ``leaf``."""
    if not possible.any():
        return possible
    return possible & (_shared([k[k < leaf] for k in known], left, right) == 0)


def _blocks(g: pa.Table) -> tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]:
    a, b = g.column("block_a")[0].as_py(), g.column("block_b")[0].as_py()
    block = g.column("block").to_numpy()
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    n = g.column("n").to_numpy().astype(float)
    return g.column("leaf")[0].as_py(), a == b, left, right, n


def links(docs: DataFrame, sets: DataFrame, threshold: float, leaf_rows: int, depth: int, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, n) link counts and (a, b) forest edges of the classes in ``sets``, by their sid."""
    at = leaves(sets, threshold, leaf_rows, depth)
    known = materialize(at.groupBy("sid").agg(F.sort_array(F.collect_set("leaf")).alias("known")))
    light = materialize(known.join(sets.select("sid", "n", "low"), "sid"))
    # two sets with one first leaf have met there: later leaves pair only those of unlike ones
    first = F.explode("known").alias("leaf"), F.get("known", F.lit(0)).alias("first")
    met = known.select("sid", *first).withColumn("met", F.when(F.col("first") < F.col("leaf"), F.col("first"))).drop("first")
    rows = in_blocks(met, ["leaf"], 2 * leaf_rows, "sid", "met").join(light, "sid")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, LEAF):
            if g.num_rows < 2:
                continue
            leaf, same, left, right, n = _blocks(g)
            size = np.minimum(n[left][:, None], n[right][None, :]) >= (threshold - 1e-9) * np.maximum(n[left][:, None], n[right][None, :])
            if same:
                size &= left[:, None] < right[None, :]
            if not size.any():
                continue
            shared = _shared(binary_rows(g.column("low")), left, right)
            some = size & (shared >= 0.5 * np.minimum(np.minimum(n[left][:, None], n[right][None, :]), SKETCH))
            some = _new_here([np.array(k, np.int64) for k in g.column("known").to_pylist()], leaf, left, right, some)
            i, j = np.nonzero(some)
            hit = np.unique(np.concatenate([left[i], right[j]]))
            if len(hit):
                yield pa.RecordBatch.from_arrays([g.column(c).combine_chunks().take(pa.array(hit)) for c in (*LEAF, "block", "sid")], names=[*LEAF, "block", "sid"])

    found = materialize(together(rows.select(*LEAF, "block", "sid", "n", "low", "known"), LEAF).mapInArrow(sketch, "leaf long, block_a int, block_b int, block int, sid long"))
    # a set's places go with it to its text, so that whole sets are shuffled once, to their leaves
    wanted = found.groupBy("sid").agg(F.collect_list(F.struct(*LEAF, "block")).alias("places"))
    wanted = materialize(wanted.join(light.select("sid", "n", "known"), "sid").join(sets.select("sid", "weight", *ROW), "sid"))
    whole = materialize(with_sets(docs, wanted, text))
    whole = whole.select(F.explode("places").alias("place"), "sid", "n", "known", "weight", "tokens").select("place.*", "sid", "n", "known", "weight", "tokens")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, LEAF):
            # a text that repeats under its id gives the same set again: one row stands for it
            g = g.take(pa.array(np.unique(g.column("sid").to_numpy(), return_index=True)[1]))
            if g.num_rows < 2:
                continue
            leaf, same, left, right, n = _blocks(g)
            shared = _shared(binary_rows(g.column("tokens")), left, right)
            linked = shared >= (threshold - 1e-9) * (n[left][:, None] + n[right][None, :] - shared)
            if same:
                linked &= left[:, None] < right[None, :]
            linked = _new_here([np.array(k, np.int64) for k in g.column("known").to_pylist()], leaf, left, right, linked)
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            i, j = left[i], right[j]
            ids, weight = g.column("sid").to_numpy(), g.column("weight").to_numpy()
            count = np.bincount(i, weight[j], g.num_rows) + np.bincount(j, weight[i], g.num_rows)
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            root = order[union_find(len(ids), place[i], place[j])[place]]
            hit = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[root[hit]]), pa.array(count[hit].astype(np.int64))], names=["id", "root", "n"])

    judged = materialize(together(whole, LEAF).mapInArrow(exact, "id long, root long, n long"))
    return judged.groupBy("id").agg(F.sum("n").alias("n")), judged.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))


def classes(docs: DataFrame, threshold: float, recall: float, leaf_rows: int, depth: int, text: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: what ``describe`` says of every row, and per set_key its class: class_id,
    n_links, component_id, and ``kept``, the (doc_id, k1, k2) of the row that stands for the
    component."""
    described = materialize(describe(docs, runs_for(threshold, recall, depth), threshold, text))
    usable = described.filter("n > 0 and doc_id is not null")
    sets = usable.groupBy("set_key", "n").agg(
        F.min(F.struct("doc_id", "k1", "k2")).alias("rep"), F.count("*").alias("weight"), F.first("low").alias("low"), F.first("alike").alias("alike"), F.first("paths").alias("paths")
    )
    # a number of its own names each set: an id may repeat, with texts of several sets
    sets = materialize(sets.select(F.monotonically_increasing_id().alias("sid"), "set_key", "n", "rep.*", "weight", "low", "alike", "paths"))
    counts, edges = links(docs.select("doc_id", text), sets, threshold, leaf_rows, depth, text)
    parts = components(edges)
    per = sets.select("sid", "set_key", "doc_id", "k1", "k2", "weight").join(counts.withColumnRenamed("id", "sid"), "sid", "left").join(parts.withColumnRenamed("id", "sid"), "sid", "left")
    per = materialize(per.select("set_key", "doc_id", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "sid").alias("part")))
    first = materialize(per.groupBy("part").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("kept")))
    return described, materialize(per.join(first, "part").select("set_key", F.col("doc_id").alias("class_id"), "n_links", F.col("kept.doc_id").alias("component_id"), "kept"))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, leaf_rows: int = 256, depth: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, n_links, class_id, component_id, kept) of every row: how many other rows link with
    it, the smallest doc_id with an equal set, and the smallest doc_id that links reach."""
    described, per = classes(docs, threshold, recall, leaf_rows, depth, text)
    linked = F.col("n") > 0
    members = described.filter(linked & F.col("doc_id").isNotNull()).select("doc_id", "set_key").join(per, "set_key").select("doc_id", "n_links", "class_id", "component_id")
    alone = described.filter(~linked | F.col("doc_id").isNull()).select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    both = members.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, leaf_rows: int = 256, depth: int = 3, text: str = "text") -> DataFrame:
    """The pipeline's form: of each group one row stays, of its smallest doc_id. Rows are told
    apart by id and text, so unlike texts under one id each stand for themselves; rows that repeat
    both count as one. Rows that link with nothing (no words, no id) all stay."""
    described, per = classes(docs, threshold, recall, leaf_rows, depth, text)
    usable = described.filter("n > 0 and doc_id is not null").select(*ROW, "set_key")
    own = F.struct(*ROW)
    gone = materialize(usable.join(per.select("set_key", "kept"), "set_key").filter(own != F.col("kept")).select(*ROW).distinct())
    again = materialize(usable.groupBy(*ROW).count().filter("count > 1").select(*ROW))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", *row_keys(text))
    # most rows are in neither table and pass as they are; the others meet the tables by shuffle
    asked = flagged(rows, gone.unionByName(again), ROW, "__asked")
    free = asked.filter("not __asked").select("__row.*")
    once = asked.filter("__asked").join(gone, ROW, "left_anti").join(again, ROW, "left_anti").select("__row.*")
    repeated = flagged(rows, again, ROW, "__asked").filter("__asked").join(again, ROW, "left_semi").join(gone, ROW, "left_anti")
    return free.unionByName(once).unionByName(repeated.groupBy(*ROW).agg(F.first("__row").alias("__row")).select("__row.*"))
