"""Vector codes (product quantisation) learned on metric trees built by the anchors hierarchy.

Vectors become integers, floor(scale * component), and are cut into consecutive parts. Rows are held in
blocks of bounded size; each block has one metric tree for each part position, built middle-out:
about sqrt(n) anchors first (a new anchor, the point farthest from its own, takes points over; the
triangle inequality names those that need no distance), their balls merged pairwise upwards and split the
same way downwards. Every ball caches its rows' count and sum. A round walks the trees from their roots with
a list of candidate entries: a child inherits what its parent could not rule out, an entry goes when
the whole ball lies on another's side of the plane between them, and a ball with one entry left adds
its cached sum and count without a look at its rows. Tasks add up their blocks, Spark adds up the tasks, and
the driver holds the codebooks alone (entries x dimensions numbers for each vector length).

All arithmetic that decides is on integers, exactly: distances are compared in doubles while they fit
into 2**52 and in 64-bit integers beyond; bounds that rule entries out leave room for rounding.

Defined cases: vectors that are null or hold null or non-finite components are dropped; vectors
of several lengths have codebooks of their own for each length, and a length that does not divide is cut
at floor(i * length / parts), so that parts may be empty; fewer rows than entries make fewer
entries; equal entries: the lower index takes all; a null id is the last of all ids, equal ids are ordered
by their components; null labels are one label; repeated rows are rows of their own; other
columns are not read; an empty table gives an empty result. Components whose squared distances would not fit
into 62 bits raise an error."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_facts, materialize

LEAF = 128
BLOCK_VALUES = 1 << 18
Codebooks = dict[int, list[np.ndarray]]


# ---------------------------------------------------------------- trees

def _anchors(x: np.ndarray) -> np.ndarray:
    """The anchor that owns each row of ``x``: about sqrt(n) anchors, each row with its nearest."""
    owner, distance = np.zeros(len(x), np.int64), np.sqrt(((x - x[0]) ** 2).sum(1))
    at = [0]
    for j in range(1, int(np.sqrt(len(x)))):
        new = int(distance.argmax())
        if distance[new] == 0:
            break
        apart = np.sqrt(((x[at] - x[new]) ** 2).sum(1))
        near = np.flatnonzero(distance > apart[owner] / 2)  # the others are no nearer to the new anchor than to their own
        d = np.sqrt(((x[near] - x[new]) ** 2).sum(1))
        taken = d < distance[near]
        owner[near[taken]], distance[near[taken]] = j, d[taken]
        at.append(new)
    return owner


def _merged(x: np.ndarray, groups: list[np.ndarray]) -> tuple:
    """The groups as leaves (numbers) of a binary tree: again and again the two balls whose common
    ball is smallest are joined."""
    trees: list = list(range(len(groups)))
    size = np.array([len(g) for g in groups], float)
    centre = np.stack([x[g].mean(0) for g in groups])
    radius = np.array([np.sqrt(((x[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, centre)])

    def common(i: int) -> np.ndarray:
        apart = np.sqrt(((centre - centre[i]) ** 2).sum(1))
        return np.maximum(np.maximum(radius, radius[i]), (apart + radius + radius[i]) / 2)

    cost = np.stack([common(i) for i in range(len(groups))])
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(groups) - 1):
        i, j = divmod(int(cost.argmin()), len(groups))
        r = cost[i, j]
        trees[i] = (trees[i], trees[j])
        centre[i] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        size[i], radius[i] = size[i] + size[j], r
        row = common(i)
        row[[i, j]] = np.inf
        row[np.isinf(cost[i])] = np.inf
        cost[i], cost[:, i] = row, row
        cost[j], cost[:, j] = np.inf, np.inf
    return trees[i] if len(groups) > 1 else trees[0]


class Tree:
    """A metric tree over integer rows. ``order``: the rows so that each node's are a run; node arrays
    are in preorder, ``skip`` being the first node after a node's own branch."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.runs: list[tuple[int, int]] = []
        self.skip: list[int] = []
        order: list[np.ndarray] = []
        done = 0

        def rows_of(branch, groups: list[np.ndarray]) -> np.ndarray:
            return groups[branch] if isinstance(branch, int) else np.concatenate([rows_of(b, groups) for b in branch])

        def put(rows: np.ndarray) -> None:
            """A ball, and below it its anchors' balls merged from the middle up."""
            nonlocal done
            spread = len(rows) > leaf and (x[rows] != x[rows[0]]).any()
            if spread:
                owner = _anchors(x[rows].astype(float))
                by = np.argsort(owner, kind="stable")
                groups = [rows[g] for g in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1)]
                inner(_merged(x, groups), groups)
            else:
                self.runs.append((done, done + len(rows)))
                order.append(rows)
                done += len(rows)
                self.skip.append(len(self.runs))

        def inner(branch, groups: list[np.ndarray]) -> None:
            if isinstance(branch, int):
                put(groups[branch])
                return
            here, begin = len(self.runs), done
            self.runs.append((begin, begin))
            self.skip.append(0)
            for b in branch:
                inner(b, groups)
            self.runs[here], self.skip[here] = (begin, done), len(self.runs)

        put(np.arange(len(x)))
        self.order = np.concatenate(order)
        held = x[self.order].astype(np.int64)
        upto = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(held, 0)])
        a, b = np.array(self.runs).T
        self.sums = upto[b] - upto[a]
        self.centre = self.sums / (b - a)[:, None]
        real = held.astype(float)
        self.radius = np.array([np.sqrt(((real[i:j] - c) ** 2).sum(1).max(initial=0)) for i, j, c in zip(a, b, self.centre)])


class Entries:
    """One part's codebook and the distances between its entries; equal entries stand for the first."""

    def __init__(self, entries: np.ndarray):
        self.all = entries
        _, first = np.unique(entries, axis=0, return_index=True) if len(entries) else (None, np.empty(0, np.int64))
        self.first = np.sort(first)
        self.real = entries.astype(float)
        if 4 * float(np.abs(self.real).max(initial=0)) ** 2 * max(entries.shape[1], 1) < 1 << 52:  # exact integers
            norm = (self.real**2).sum(1)
            self.apart = np.sqrt(norm[:, None] + norm[None] - 2 * self.real @ self.real.T)
        else:
            self.apart = np.sqrt(((self.real[:, None] - self.real[None]) ** 2).sum(2))


def nearest(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each integer row, exactly, the first of several."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(rows.shape[1], 1) < 1 << 52:
        e = entries.astype(float)
        return ((e * e).sum(1) - 2 * (rows.astype(float) @ e.T)).argmin(1)
    if 4 * most * most * max(rows.shape[1], 1) >= 1 << 62:
        raise ValueError("components too large for exact distances")
    step = max(1, (1 << 22) // max(1, entries.size))
    cut = [((rows[i : i + step, None].astype(np.int64) - entries[None]) ** 2).sum(2).argmin(1) for i in range(0, len(rows), step)]
    return np.concatenate(cut)


def owned(tree: Tree, rows: np.ndarray, entries: Entries) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, dict[str, int]]:
    """Balls with one entry left as (node, entry); then rows of balls that no entry owns whole, as
    places in ``tree.order``, and their entries; and how much work was saved."""
    balls, places, found = [], [], []
    stack = [(0, entries.first)]
    while stack:
        node, cand = stack.pop()
        d = ((entries.real[cand] - tree.centre[node]) ** 2).sum(1)
        i = int(d.argmin())
        slack = 1e-9 * (1 + d.max())
        keep = cand[d - d[i] <= 2 * tree.radius[node] * entries.apart[cand[i], cand] * (1 + 1e-9) + slack]
        begin, end = tree.runs[node]
        if len(keep) == 1:
            balls.append((node, int(keep[0])))
        elif tree.skip[node] == node + 1:
            places.append(np.arange(begin, end))
            found.append(keep[nearest(rows[tree.order[begin:end]], entries.all[keep])])
        else:
            child = node + 1
            while child < tree.skip[node]:
                stack.append((child, keep))
                child = tree.skip[child]
    none = np.empty(0, np.int64)
    saved = {"rows": len(tree.order), "looked_at": sum(map(len, places))}
    return balls, np.concatenate(places) if places else none, np.concatenate(found) if found else none, saved


# ---------------------------------------------------------------- blocks

def _cuts(dim: int, parts: int) -> list[int]:
    return [i * dim // parts for i in range(parts + 1)]


def finite(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, embedding) without vectors that are null or hold null or non-finite components."""
    v = F.col(embedding).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("embedding")).filter(v.isNotNull() & whole)


def blocks(rows: DataFrame, scale: int, parts: int, leaf: int = LEAF, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(dim, ids, labels, points, trees): rows of one length, at most about ``block_values`` numbers."""
    label = rows.schema["label"].dataType.simpleString()

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[pa.Array, pa.Array, np.ndarray]]] = {}
        held: dict[int, int] = {}

        def grow(dim: int) -> pa.RecordBatch:
            ids, labels, points = zip(*waiting.pop(dim))
            held.pop(dim)
            x = np.concatenate(points)
            cuts = _cuts(dim, parts)
            trees = [pickle.dumps(Tree(x[:, a:b], leaf), 5) for a, b in zip(cuts, cuts[1:])]
            one = lambda arrays: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays(arrays))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), one(ids), one(labels), pa.array([x.tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))], names=["dim", "ids", "labels", "points", "trees"])

        for batch in batches:
            vectors = batch.column("embedding")
            size = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                here = pa.array(np.flatnonzero(size == dim))
                real = np.floor(vectors.take(here).flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
                if len(real) and np.abs(real).max() >= 1 << 30:
                    raise ValueError("components too large for exact distances")
                x = real.astype(np.int32).reshape(len(here), int(dim))
                step = max(64, block_values // max(int(dim), 1))
                for i in range(0, len(x), step):
                    piece = here[i : i + step]
                    waiting.setdefault(int(dim), []).append((batch.column("vec_id").take(piece), batch.column("label").take(piece), x[i : i + step]))
                    held[int(dim)] = held.get(int(dim), 0) + len(piece)
                    if held[int(dim)] >= step:
                        yield grow(int(dim))
            while sum(n * max(d, 1) for d, n in held.items()) > 4 * block_values:
                yield grow(max(held, key=lambda d: held[d] * max(d, 1)))
        for dim in list(held):
            yield grow(dim)

    return rows.mapInArrow(plant, f"dim int, ids array<long>, labels array<{label}>, points binary, trees array<binary>")


def first_codebooks(rows: DataFrame, scale: int, parts: int, entries: int) -> Codebooks:
    """The parts of the smallest ids' vectors, for each length. Spark limits each partition to ``entries`` rows
    before it ranks them, so that no task sees a length whole."""
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    first = rows.withColumn("dim", F.size("embedding")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= entries)
    found: dict[int, list] = {}
    for r in first.select("dim", "place", "embedding").orderBy("dim", "place").collect():
        found.setdefault(r["dim"], []).append(r["embedding"])
    out = {}
    for dim, vectors in found.items():
        x = np.floor(np.array(vectors, float).reshape(len(vectors), dim) * scale).astype(np.int64)
        cuts = _cuts(dim, parts)
        out[dim] = [x[:, a:b] for a, b in zip(cuts, cuts[1:])]
    return out


def _opened(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, dict, np.ndarray, list[Tree]]]:
    for row in batch.to_pylist():
        x = np.frombuffer(row["points"], np.int32).reshape(len(row["ids"]), row["dim"])
        yield row["dim"], row, x, [pickle.loads(t) for t in row["trees"]]


def improved(held: DataFrame, books: Codebooks, parts: int) -> Codebooks:
    """One round: every part to its nearest entry, every entry the floored mean of its parts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {dim: [Entries(b) for b in book] for dim, book in books.items()}
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, _, x, trees in _opened(batch, parts):
                cuts = _cuts(dim, parts)
                for p, tree in enumerate(trees):
                    rows, entries = x[:, cuts[p] : cuts[p + 1]], known[dim][p]
                    if (dim, p) not in total:
                        total[dim, p] = np.zeros(len(entries.all), np.int64), np.zeros(entries.all.shape, np.int64)
                    count, sums = total[dim, p]
                    balls, places, at, _ = owned(tree, rows, entries)
                    for node, entry in balls:
                        count[entry] += tree.runs[node][1] - tree.runs[node][0]
                        sums[entry] += tree.sums[node]
                    count += np.bincount(at, minlength=len(count))
                    np.add.at(sums, at, rows[tree.order[places]].astype(np.int64))
        rows = []
        for (dim, p), (count, sums) in total.items():
            used = np.flatnonzero(count)
            both = np.concatenate([count[:, None], sums], 1)[used]
            rows.append((np.full(both.size, dim), np.full(both.size, p), np.repeat(used, both.shape[1]), np.tile(np.arange(-1, both.shape[1] - 1), len(used)), both.ravel()))
        columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.empty(0, np.int64)] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["dim", "part", "entry", "place", "value"])

    summed = held.mapInArrow(add, "dim long, part long, entry long, place long, value long").groupBy("dim", "part", "entry", "place").agg(F.sum("value").alias("value"))
    new = {dim: [b.copy() for b in book] for dim, book in books.items()}
    count = {dim: [np.zeros(len(b), np.int64) for b in book] for dim, book in books.items()}
    for r in summed.collect():  # entries x (dimensions + parts) numbers for each length
        if r["place"] < 0:
            count[r["dim"]][r["part"]][r["entry"]] = r["value"]
        else:
            new[r["dim"]][r["part"]][r["entry"], r["place"]] = r["value"]
    for dim, book in new.items():
        for b, n in zip(book, count[dim]):
            b[n > 0] //= n[n > 0, None]
    return new


def learn(held: DataFrame, books: Codebooks, rounds: int, parts: int) -> Codebooks:
    for _ in range(rounds):
        books = improved(held, books, parts)
    return books


def encoded(held: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of every row of the blocks."""
    label = held.schema["labels"].dataType.elementType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {dim: [Entries(b) for b in book] for dim, book in books.items()}
        digest = {dim: hashlib.sha256(",".join(str(v) for b in book for v in b.ravel()).encode()).hexdigest() for dim, book in books.items()}
        for batch in batches:
            for i, (dim, _, x, trees) in enumerate(_opened(batch, parts)):
                cuts, codes, error = _cuts(dim, parts), np.empty((len(x), parts), np.int64), np.zeros(len(x), np.int64)
                for p, tree in enumerate(trees):
                    rows, entries = x[:, cuts[p] : cuts[p + 1]], known[dim][p]
                    balls, places, at, _ = owned(tree, rows, entries)
                    codes[tree.order[places], p] = at
                    for node, entry in balls:
                        codes[tree.order[slice(*tree.runs[node])], p] = entry
                    error += ((rows.astype(np.int64) - entries.all[codes[:, p]]) ** 2).sum(1)
                text = ["".join(f"{c:02x}" for c in row) for row in codes]
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), batch.column("labels").slice(i, 1).flatten(), pa.array(text, pa.string()), pa.array(error), pa.array([digest[dim]] * len(x), pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return held.mapInArrow(code, f"vec_id long, label {label}, code string, error long, codebooks_sha256 string")


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is whole."""
    rows = finite(vectors, vec_id, embedding, label)
    held = materialize(blocks(rows, scale, parts))
    books = learn(held, first_codebooks(rows, scale, parts, entries), rounds, parts)
    out = materialize(encoded(held, books, parts))
    per = materialize(out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    return join_facts(out, per, ["label"], "n", out.count()).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_STEP = """a{i} AS (SELECT vec_id, part, CAST(min(d * 256 + entry) % 256 AS BIGINT) AS entry, CAST(min(d * 256 + entry) // 256 AS BIGINT) AS d FROM
        (SELECT vec_id, x.part, entry, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d FROM x JOIN c{i} c ON x.part = c.part AND x.place = c.place GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
_NEXT = """c{j} AS (SELECT c.part, c.entry, c.place, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT x.part, entry, place, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM x JOIN a{i} a ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY 1, 2, 3) m
        ON m.part = c.part AND m.entry = c.entry AND m.place = c.place)"""
ORACLE_SQL = (
    """WITH k AS MATERIALIZED (SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id) - 1 AS nth FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    x AS MATERIALIZED (SELECT vec_id, nth, (g - 1) // (len(e) // 4) AS part, (g - 1) % (len(e) // 4) AS place, CAST(floor(1024 * CAST(e[g] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT *, unnest(range(1, len(e) + 1)) AS g FROM k)),
    c0 AS MATERIALIZED (SELECT part, nth AS entry, place, v FROM x WHERE nth < 256), """
    + ", ".join((_STEP.format(i=i) + ", " + _NEXT.format(i=i, j=i + 1)).replace(" AS (SELECT vec", " AS MATERIALIZED (SELECT vec").replace(" AS (SELECT c.part", " AS MATERIALIZED (SELECT c.part") for i in range(4))
    + ", "
    + _STEP.format(i=4)
    + """, s AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c4),
    r AS (SELECT a4.vec_id, any_value(label) AS label, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 JOIN k ON k.vec_id = a4.vec_id GROUP BY 1)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, s"""
)
