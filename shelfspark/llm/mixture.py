"""Mixing sources to target weights by balanced sampling with the cube method.

Targets: sources ordered by code point (null last) weigh 5, 2, 1, 5, 2, 1, ...; they share all
words by weight, no source above ``cap`` times its own words, the excess shared again by weight.
A source's factor (target / own words) has a whole part, taken from every document, and a
fraction, the inclusion probability of one more copy. Those copies are drawn by the cube method:
a flight phase moves the probabilities along null-space directions of the balancing constraints
(documents and words of the source) until they are 0 or 1. The flight runs in blocks of bounded
size within each source; twelve documents a block, of all sizes, wait and at most two more stay
undecided, and these fly in the blocks of the next level, level by level, until one block per source is left. Its largest documents and what the
flight left undecided are the landing problem, at most fourteen documents: all their choices are
listed and one is drawn, near-balanced ones likelier.

Defined cases: null text has size 0; documents of size 0 take no words and weigh nothing; a null
source is a source of its own, last; a null id is an id like another, beside ids of any size; equal
sizes and repeated rows are separate units, drawn each; long texts count whole; ``remix`` keeps all
columns, whatever their names; an empty table gives an empty result. Results depend on the rows
alone, so reruns agree."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered

WEIGHTS = (5, 2, 1)
LANDING = 12
UNIT = ["doc_id", "source", "size", "t", "n"]
WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(source, source_size, documents, target) from (source, size) rows. One row per source is
    ranked; the level that the weights reach is found by repeated sums over that table."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = materialize(per.withColumn("weight", weight))
    total, level = per.agg(F.sum("source_size"), F.sum("source_size") / F.sum("weight")).first()
    total, level = total or 0, level or 0.0
    full = F.lit(cap) * F.col("source_size")
    while total:
        over = F.col("weight") * level >= full
        capped, free = per.agg(F.sum(F.when(over, full)), F.sum(F.when(~over, F.col("weight")))).first()
        if not free:
            break
        new = (total - (capped or 0.0)) / free
        if new <= level * (1 + 1e-12):
            break
        level = new
    return per.select("source", "source_size", "documents", F.least(F.col("weight") * F.lit(float(level)), full).alias("target"))


def _flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``p`` within the null space of (1, size) until at most two entries are fractions."""
    p = p.copy()
    open_ = [i for i in range(len(p)) if 0.0 < p[i] < 1.0]
    window, rest = open_[:3], iter(open_[3:])
    while len(window) == 3:
        a, b, c = size[window]
        u = np.array([c - b, a - c, b - a], float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        x = p[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.nanmin(np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)))
            down = np.nanmin(np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)))
        x = x + up * u if rng.random() * (up + down) < down else x - down * u
        x[x < 1e-9], x[x > 1 - 1e-9] = 0.0, 1.0
        p[window] = x
        window = [i for i in window if 0.0 < p[i] < 1.0]
        while len(window) < 3:
            i = next(rest, None)
            if i is None:
                return p
            window.append(i)
    return p


def _land(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """0 or 1 for the last fractions (sixteen at most): all choices are listed, and one is drawn by
    its probability under independent draws times how near its words come to the words due."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    q, s = p[open_], size[open_]
    choice = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = choice @ s - q @ s
    scale = max(1.0, 0.001 * float(size @ p), float(np.abs(off).min()))
    odds = choice @ np.log(q / (1 - q)) - 0.5 * (off / scale) ** 2
    weight = np.exp(odds - odds.max())
    p = p.copy()
    p[open_] = choice[rng.choice(len(choice), p=weight / weight.sum())]
    return p


def cube_sample(rows: DataFrame, block_rows: int = 256, seed: int = 17) -> DataFrame:
    """``rows`` (doc_id, source, size, t, n, p) with ``p`` moved to 0 or 1, balanced on documents
    and words within each source. ``t`` and ``n`` tell rows of one id apart."""
    schema = "doc_id long, source string, size long, t long, n long, p double, level int"

    def fly(key: tuple, table: pa.Table) -> pa.Table:  # Arrow keeps a null id beside ids of all sizes
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in ("doc_id", "size", "t", "n", "p")], null_placement="at_start"))
        first = {c: table[c][0].as_py() for c in ("source", "block", "level", "blocks")}
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{first['source']}:{first['block']}:{first['level']}".encode()).digest()[:8], "big"))
        sizes = table["size"].to_numpy()
        order = np.argsort(-sizes, kind="stable")  # large first, so that small ones are left
        size, p = sizes[order].astype(float), table["p"].to_numpy()[order].astype(float)
        if first["blocks"] == 1:  # the source's last block: its largest documents wait for the landing
            moved = np.concatenate([p[:LANDING], _flight(size[LANDING:], p[LANDING:], rng)])
            moved = _land(size, moved, rng)
        else:  # some of every size wait for the next level, so that the last one can make up for a very large document
            fly_now = np.ones(len(p), bool)
            fly_now[np.linspace(0, len(p) - 1, LANDING).astype(int)] = False
            moved = p.copy()
            moved[fly_now] = _flight(size[fly_now], p[fly_now], rng)
        back = np.empty(len(table))
        back[order] = moved
        level = pa.array(np.full(len(table), first["level"] + 1), pa.int32())
        return table.select(UNIT).append_column("p", pa.array(back)).append_column("level", level)

    done, level = None, 0
    now = rows.select(*UNIT, "p", F.lit(0).alias("level"))
    while True:
        per = now.groupBy("source").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        per = materialize(per)
        spread = now.join(per, now.source.eqNullSafe(per.source)).select(now["*"], "blocks")
        spread = spread.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "size", "t", "n"), "blocks").cast("int"))
        flown = materialize(spread.groupBy("source", "block").applyInArrow(fly, schema))
        settled = flown.filter("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        now = flown.filter("p > 0 and p < 1")
        level += 1
        if now.isEmpty():
            return done.select(*UNIT, "p")


def units(docs: DataFrame, text: str, block_rows: int) -> DataFrame:
    """(doc_id, source, size, t, n) of every row: t is a hash of its text, n its number among equal
    rows where more than ``block_rows`` are equal (so that they spread over blocks), else 0."""
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(1), text).alias("t"))
    sizes = materialize(sizes)
    same = UNIT[:-1]
    hot = materialize(sizes.groupBy(*same).count().filter(F.col("count") > block_rows).select(*same))
    if hot.isEmpty():
        return sizes.withColumn("n", F.lit(0).cast("long"))
    many = numbered(sizes.join(hot, equal(sizes, hot, same), "left_semi"), same, "n").withColumn("n", F.col("n").cast("long"))
    return materialize(sizes.join(hot, equal(sizes, hot, same), "left_anti").withColumn("n", F.lit(0).cast("long")).unionByName(many))


def mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, block_rows: int = 256) -> DataFrame:
    """(doc_id, source, size, t, n, source_size, target, copies) of every row of ``docs``; t and n
    are those of ``units``."""
    sizes = units(docs, text, block_rows)
    targets = materialize(source_targets(sizes, weights, cap))
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(targets, sizes.source.eqNullSafe(targets.source)).select(sizes["*"], "source_size", "target", factor.alias("factor"))
    whole = F.floor(F.col("factor") + 1e-9)
    rows = rows.withColumn("whole", whole).withColumn("p", F.greatest(F.col("factor") - F.col("whole"), F.lit(0.0)))
    drawn = (F.col("size") > 0) & (F.col("p") > 1e-9)
    still = rows.filter(~drawn).select(*UNIT, F.lit(0.0).alias("p"))
    taken = cube_sample(rows.filter(drawn), block_rows).unionByName(still)
    out = taken.join(targets, taken.source.eqNullSafe(targets.source)).select(taken["*"], "source_size", "target", factor.alias("factor"))
    return out.select(*UNIT, "source_size", "target", F.when(F.col("size") > 0, whole + F.col("p")).otherwise(0).cast("int").alias("copies"))


def remix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Rows are told apart by id (a null id
    is one like others), source and text; rows equal in all three share their copies, and those of
    the first numbers take what does not divide."""
    key = ["__id", "__source", "__t"]
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.xxhash64(F.lit(1), "text").alias("__t"))
    taken = mix(docs).groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("t").alias("__t"))
    taken = materialize(taken.agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")))
    again = materialize(taken.filter("__rows > 1").select(*key))
    placed = rows.withColumn("__place", F.lit(0))
    if not again.isEmpty():
        many = numbered(rows.join(again, equal(rows, again, key), "left_semi"), key, "__place")
        placed = placed.join(again, equal(placed, again, key), "left_anti").unionByName(many)
    own = F.floor((F.col("__copies") + F.col("__rows") - 1 - F.col("__place")) / F.col("__rows")).cast("int")
    both = placed.join(taken, equal(placed, taken, key)).select("__row", own.alias("__own"))
    return both.filter("__own > 0").select("__row", F.explode(F.sequence(F.lit(1), "__own"))).select("__row.*")


def equal(a: DataFrame, b: DataFrame, on: list[str]) -> Column:
    """Null-safe equality of the columns ``on``."""
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in on])
