"""Exact top-k search by inner product with a distributed M-tree.

Components become integers, floor(scale * x). Inner-product order is nearest-neighbour order after
one more coordinate, sqrt(M - |x|^2) with M the largest squared length (0 for queries), so metric
pruning is exact; scores themselves are integers.

The tree is split from the root down: each node with more than ``page_rows`` rows gets up to
``fan`` routing objects, far from each other, of a bounded sample of its rows, and each row goes
to its nearest one; levels repeat until nodes fit a page (a node whose sample is one point is cut
into pages by hash). A node keeps its routing object, its covering radius and its distance to its
parent; a page keeps its rows in leaves of the same kind, with each entry's distance to the leaf's
routing object.

Search goes best-first. Every query first goes down to the page where it would be put, whose k-th
score bounds all else. Then blocks of queries meet the nodes level by level: a node is left out
where, by the triangle inequality, stored distances (first the parent distance, then the
computed one) show that no query of the block can find better in it. In a page, leaves are taken
in order of their lower bounds, and most entries are excluded by their stored distances. A block's
queries are sent once for each node that they meet; no task holds all queries or all rows.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part;
a query meets the candidates of its own length; ties go to the smaller id; rows that share the
query's id are its own; fewer than k candidates are all returned; empty in, empty out. Scores are
exact while they stay below 2**53."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import groups_of, materialize, together
from .embedding_dedup import as_matrix

SLACK = 1e-6
FAN_BITS = 6  # a child's number is its parent's, moved by these bits, plus its place
MOST_LEVELS = 9
CHILDREN = "node long, children array<long>, centres binary, parents binary"


def _spread(points: np.ndarray, n: int) -> np.ndarray:
    """Indices of up to ``n`` points, each the farthest from those before."""
    chosen, best = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(n, len(points)) and best.max() > 0:
        chosen.append(int(best.argmax()))
        best = np.minimum(best, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return np.array(chosen)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def integers(vectors: DataFrame, scale: int, id: str, vector: str) -> DataFrame:
    """(id, v): rows that take part, components floor(scale * x) as doubles."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.filter(F.col(id).isNotNull() & F.col(vector).isNotNull() & finite & (F.size(vector) > 0))
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.rint(x * scale) - (F.rint(x * scale) > x * scale).cast("double"))
    return rows.select(F.col(id).alias("id"), whole.alias("v"))


def _matrix(raw: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(-1, columns)


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    """One more coordinate that gives all rows the length sqrt(largest)."""
    return np.concatenate([x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0))[:, None]], 1)


class Tree:
    """``levels``: per level a table of the nodes that were split (``CHILDREN``), and ``radii``
    (node, parent_distance, radius) of their children; ``leaves``: the pages' leaves."""

    def __init__(self, rows: DataFrame, largest: float, dimensions: int, fan: int = 32, page_rows: int = 1024, leaves: int = 24, sample_rows: int = 256):
        self.largest, self.columns = largest, dimensions + 1
        self.levels: list[DataFrame] = []
        self.radii: list[DataFrame] = []
        now, settled, d = rows.withColumn("node", F.lit(1).cast("long")), None, None
        for _ in range(MOST_LEVELS):
            count = materialize(now.groupBy("node").agg(F.count("*").alias("n")))
            large = count.filter(F.col("n") > page_rows)
            wide = F.least(F.lit(fan), F.greatest(F.lit(2), F.ceil(2 * F.col("n") / page_rows))).cast("int")
            split = self._split(now.join(large.select("node", wide.alias("fan")), "node"), sample_rows)
            stay = now.join(split.select("node"), "node", "left_anti")
            settled = stay if settled is None else settled.unionByName(stay)
            if split.isEmpty():
                break
            going = now.join(split.select("node"), "node", "left_semi")
            moved = materialize(self.descend(going, split, page_rows, lifted=True))
            self.levels.append(split)
            self.radii.append(materialize(moved.groupBy("node").agg(F.first("parent_distance").alias("parent_distance"), F.max("d").alias("radius"))))
            now = moved.select("id", "v", "node")
        else:
            settled = settled.unionByName(now)
        settled = materialize(settled)
        pages = settled.groupBy("node").agg(F.ceil(F.count("*") / page_rows).cast("int").alias("pages"))
        placed = settled.join(pages, "node").withColumn("page", F.pmod(F.xxhash64(F.lit(29), "id"), "pages").cast("int"))
        self.pages = materialize(pages)
        self.leaves = materialize(self._leaves(placed.select("id", "v", "node", "page"), leaves))

    def _split(self, rows: DataFrame, sample_rows: int) -> DataFrame:
        """Routing objects of each node, from its rows of least hash; none for a node whose sample is
        one point."""
        nth = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64(F.lit(23), "id", "v"), "id"))
        sample = rows.withColumn("nth", nth).filter(F.col("nth") <= sample_rows).select("node", "fan", "v")
        largest = self.largest

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in groups_of(batches, ["node"]):
                x = lift(as_matrix(g.column("v")), largest)
                x = x[np.lexsort(x.T)]
                centres = x[_spread(x, g.column("fan")[0].as_py())]
                if len(centres) > 1:
                    node = g.column("node")[0].as_py()
                    own = centres - centres.mean(0)  # a parent's reference point is its children's mean
                    children = [(node << FAN_BITS) + k for k in range(len(centres))]
                    yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([children], pa.list_(pa.int64())), pa.array([centres.tobytes()], pa.binary()), pa.array([np.linalg.norm(own, axis=1).tobytes()], pa.binary())], names=["node", "children", "centres", "parents"])

        return materialize(together(sample, ["node"]).mapInArrow(route, CHILDREN))

    def descend(self, rows: DataFrame, split: DataFrame, share: int, lifted: bool) -> DataFrame:
        """(id, v, node, d, parent_distance): each row at the nearest child of its node. A node's rows
        meet its routing objects in parts of about ``share`` rows, so that no task has a hot node."""
        largest, columns = self.largest, self.columns
        per = rows.groupBy("node").agg(F.ceil(F.count("*") / (16 * share)).cast("int").alias("parts"))
        split = split.join(per, "node").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        spread = rows.join(per, "node").withColumn("part", F.pmod(F.xxhash64(F.lit(37), "id", "v"), "parts").cast("int"))
        both = spread.select("node", "part", "id", "v").unionByName(split.select("node", "part", "children", "centres", "parents"), allowMissingColumns=True)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in groups_of(batches, ["node", "part"]):
                is_row = g.column("centres").is_null()
                own, at = g.filter(is_row), g.filter(pc.invert(is_row))
                if not own.num_rows:
                    continue
                centres = _matrix(at.column("centres")[0].as_py(), columns)
                children, parents = np.array(at.column("children")[0].as_py(), np.int64), np.frombuffer(at.column("parents")[0].as_py())
                for begin in range(0, own.num_rows, 4096):
                    part = own.slice(begin, 4096)
                    x = as_matrix(part.column("v"))
                    x = lift(x, largest) if lifted else np.concatenate([x, np.zeros((len(x), 1))], 1)
                    d = _distances(x, centres)
                    home = d.argmin(1)
                    exact = np.linalg.norm(x - centres[home], axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks(), part.column("v").combine_chunks(), pa.array(children[home]), pa.array(exact), pa.array(parents[home])], names=["id", "v", "node", "d", "parent_distance"])

        return together(both, ["node", "part"]).mapInArrow(nearest, "id long, v array<double>, node long, d double, parent_distance double")

    def _leaves(self, placed: DataFrame, leaves: int) -> DataFrame:
        largest = self.largest

        def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in groups_of(batches, ["node", "page"]):
                key = [g.column(k)[0].as_py() for k in ("node", "page")]
                ids, x = g.column("id").to_numpy(), lift(as_matrix(g.column("v")), largest)
                order = np.lexsort((*x.T, ids))
                ids, x = ids[order], x[order]
                centres = x[_spread(x, leaves)]
                home = _distances(x, centres).argmin(1)
                out = []
                for c in range(len(centres)):
                    own = np.flatnonzero(home == c)
                    if len(own):
                        away = np.linalg.norm(x[own] - centres[c], axis=1)
                        up = float(np.linalg.norm(centres[c] - x.mean(0)))
                        out.append((*key, x.mean(0).tobytes(), up, float(away.max()), centres[c].tobytes(), ids[own].tolist(), x[own, :-1].tobytes(), away.tobytes()))
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out), kinds)], names=["node", "page", "parent", "parent_distance", "radius", "centre", "ids", "entries", "distances"])

        return together(placed, ["node", "page"]).mapInArrow(leaf, "node long, page int, parent binary, parent_distance double, radius double, centre binary, ids array<long>, entries binary, distances binary")


QUERIES = "block int, query_ids array<long>, queries binary, bounds array<double>"


def blocks_of(asked: DataFrame) -> DataFrame:
    """One row (``QUERIES``) for each block of queries (block, query_id, q, bound)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, ["block"]):
            q = as_matrix(g.column("q"))
            yield pa.RecordBatch.from_arrays([pa.array([g.column("block")[0].as_py()], pa.int32()), pa.array([g.column("query_id").to_pylist()], pa.list_(pa.int64())), pa.array([q.tobytes()], pa.binary()), pa.array([g.column("bound").to_pylist()], pa.list_(pa.float64()))], names=["block", "query_ids", "queries", "bounds"])

    return materialize(together(asked.select("block", "query_id", "q", "bound"), ["block"]).mapInArrow(pack, QUERIES))


def _reach(q: np.ndarray, bounds: np.ndarray, largest: float) -> np.ndarray:
    """How far a row may lie from each query and still reach its bound (none: any distance)."""
    square = (q * q).sum(1) + largest
    return np.where(np.isnan(bounds), np.inf, np.sqrt(np.maximum(square - 2 * np.nan_to_num(bounds), 0)) + SLACK)


def _queries(row: pa.Table, i: int, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q = _matrix(row.column("queries")[i].as_py(), columns - 1)
    bounds = np.array([np.nan if b is None else b for b in row.column("bounds")[i].as_py()])
    return np.array(row.column("query_ids")[i].as_py(), np.int64), q, bounds


def visits(tree: Tree, asked: DataFrame) -> DataFrame:
    """(block, node) of the unsplit nodes that blocks of queries may not leave out."""
    at = asked.select("block").withColumn("node", F.lit(1).cast("long"))
    largest, columns = tree.largest, tree.columns
    ends = None
    for split, radii in zip(tree.levels, tree.radii):
        places = split.select("node", F.posexplode("children").alias("place", "child")).join(radii.select(F.col("node").alias("child"), "radius"), "child", "left")
        sizes = places.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("radius", F.lit(-1.0)).alias("r")))), lambda x: x["r"]).alias("radii"))  # fan entries
        inner = split.join(sizes, "node")
        stay = at.join(split.select("node"), "node", "left_anti")
        ends = stay if ends is None else ends.unionByName(stay)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    _, q, bounds = _queries(batch, i, columns)
                    reach = _reach(q, bounds, largest)
                    x = np.concatenate([q, np.zeros((len(q), 1))], 1)
                    centres, parents = _matrix(batch.column("centres")[i].as_py(), columns), np.frombuffer(batch.column("parents")[i].as_py())
                    radius = np.array(batch.column("radii")[i].as_py())
                    up = np.linalg.norm(x - centres.mean(0), axis=1)
                    may = np.abs(up[:, None] - parents) - radius <= reach[:, None]  # stored distances alone
                    some = np.flatnonzero(may.any(0) & (radius >= 0))
                    near = (_distances(x, centres[some]) - SLACK - radius[some] <= reach[:, None]) & may[:, some]
                    kept = np.array(batch.column("children")[i].as_py(), np.int64)[some[near.any(0)]]
                    if len(kept):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), batch.column("block")[i].as_py(), np.int32)), pa.array(kept)], names=["block", "node"])

        met = at.join(inner, "node").join(asked, "block")
        at = materialize(met.select("block", "query_ids", "queries", "bounds", "children", "centres", "parents", "radii").mapInArrow(meet, "block int, node long"))
    return at if ends is None else materialize(ends.unionByName(at))


def best_of_pages(tree: Tree, pairs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the best ``k`` of each page for the queries of each block in ``pairs``
    (block, node), as far as they reach their bounds. A page and a block meet in one group."""
    largest, columns = tree.largest, tree.columns
    met = pairs.join(tree.pages, "node").select("block", "node", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"))
    leaves = met.join(tree.leaves, ["node", "page"])
    both = leaves.unionByName(met.join(asked, "block"), allowMissingColumns=True)
    key = ["node", "page", "block"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, key):
            is_leaf = g.column("centre").is_valid()
            nodes, block = g.filter(is_leaf), g.filter(pc.invert(is_leaf))
            if not nodes.num_rows or not block.num_rows:
                continue
            qid, q, bounds = _queries(block, 0, columns)
            x = np.concatenate([q, np.zeros((len(q), 1))], 1)
            square = (q * q).sum(1) + largest
            centre = np.stack([np.frombuffer(c) for c in nodes.column("centre").to_pylist()])
            radius = nodes.column("radius").to_numpy()
            # stored parent distances first: what they exclude for every query is not computed
            up = np.linalg.norm(x - np.frombuffer(nodes.column("parent")[0].as_py()), axis=1)
            low = np.abs(up[:, None] - nodes.column("parent_distance").to_numpy()) - radius - SLACK
            some = np.flatnonzero((low <= _reach(q, bounds, largest)[:, None]).any(0))
            d = np.full(low.shape, np.inf)
            d[:, some] = _distances(x, centre[some])
            low = np.maximum(low, d - radius - SLACK)
            best = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]  # query, score, id
            least = bounds.copy()
            for c in some[np.argsort(np.maximum(low[:, some], 0).sum(0), kind="stable")]:
                reach = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(square - 2 * np.nan_to_num(least), 0)) + SLACK)
                who = np.flatnonzero(low[:, c] <= reach)
                if not len(who):
                    continue
                ids = np.array(nodes.column("ids")[int(c)].as_py(), np.int64)
                away = np.frombuffer(nodes.column("distances")[int(c)].as_py())
                may = np.abs(d[who, c][:, None] - away[None, :]) <= reach[who][:, None] + SLACK
                some = np.flatnonzero(may.any(0))
                if not len(some):
                    continue
                score = q[who] @ _matrix(nodes.column("entries")[int(c)].as_py(), columns - 1)[some].T
                good = may[:, some] & (ids[some][None, :] != qid[who][:, None]) & ~(score < least[who][:, None])
                i, j = np.nonzero(good)
                if not len(i):
                    continue
                best = [np.concatenate(p) for p in zip(best, (who[i], score[i, j], ids[some][j]))]
                order = np.lexsort((best[2], -best[1], best[0]))
                best = [p[order] for p in best]
                first = np.searchsorted(best[0], np.arange(len(q)))
                keep = np.arange(len(order)) - first[best[0]] < k
                best = [p[keep] for p in best]
                full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) == k)
                kth = best[1][np.searchsorted(best[0], full, "right") - 1]
                least[full] = np.where(np.isnan(least[full]), kth, np.maximum(least[full], kth))
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(qid[best[0]]), pa.array(best[2]), pa.array(best[1].astype(np.int64))], names=["query_id", "id", "score"])

    return together(both, key).mapInArrow(visit, "query_id long, id long, score long")


def search(rows: DataFrame, queries: DataFrame, dimensions: int, k: int, block_queries: int, **tree_options) -> tuple[DataFrame, DataFrame, Tree]:
    """(query_id, rank, id, score) of ``queries`` (id, v) among ``rows`` (id, v) of one length; the
    (block, node) pairs visited; and the tree."""
    largest = float(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    tree = Tree(rows, largest, dimensions, **tree_options)
    at, homes = queries.withColumn("node", F.lit(1).cast("long")), []
    for split in tree.levels:
        homes.append(at.join(split.select("node"), "node", "left_anti"))
        at = materialize(tree.descend(at.join(split.select("node"), "node", "left_semi"), split, block_queries, lifted=False).select("id", "v", "node"))
    home = materialize(reduce(DataFrame.unionByName, [*homes, at]).select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("node").alias("home")))
    blocks = max(1, -(-home.count() // block_queries))  # queries of one page side by side, so that a block's are alike
    home = materialize(home.repartitionByRange(blocks, "home", "query_id").withColumn("block", F.spark_partition_id()))
    own = home.select("block", F.col("home").alias("node")).distinct()
    found = materialize(best_of_pages(tree, own, blocks_of(home.withColumn("bound", F.lit(None).cast("double"))), k))
    # the k best of any pages bound the rest from below
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    bound = found.withColumn("nth", nth).filter(F.col("nth") == k).select("query_id", F.col("score").cast("double").alias("bound"))
    asked = blocks_of(home.join(bound, "query_id", "left"))
    pairs = visits(tree, asked)
    found = best_of_pages(tree, pairs, asked, k)
    best = found.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    return best, pairs, tree


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id: str = "vec_id", vector: str = "embedding", block_queries: int = 512, **tree_options) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` best rows of each row where ``is_query`` holds."""
    out = vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id} long, score long")
    rows = integers(vectors, scale, id, vector)
    asked = integers(vectors.filter(is_query), scale, id, vector).distinct()
    for length in [r["n"] for r in asked.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]:  # a row for each length
        of = F.size("v") == length
        best, _, _ = search(materialize(rows.filter(of)), materialize(asked.filter(of)), length, k, block_queries, **tree_options)
        out = out.unionByName(best.withColumnRenamed("id", id))
    return out


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
