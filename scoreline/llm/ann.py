"""Approximate nearest neighbours by vantage-point trees, one per shard.

1. Trees. Vectors are dealt by hash to shards of about SHARD_ROWS rows. Each shard's tree splits its vectors at the
   median distance from a vantage point, down to leaves of LEAF vectors; it is built once and written as one row.
2. Search. Queries are packed in blocks of QUERY_ROWS, one row each. Trees form bundles; a bundle's trees, then all blocks of
   queries pass by the same task in order, so it holds its trees and one block. A block
   first meets the leaf that each of its queries falls into, then walks the tree once: the queries that still need a
   side go on to it. With distance t of a query's k-th neighbour so far, a side is pruned for it if the triangle
   inequality puts the side's vectors farther than factor * t. Factor 1 restores exact search; smaller factors prune
   more and may miss. What a block has found in one tree of a bundle prunes the next.
3. The k best of each bundle are merged by rank.

So vectors are shuffled once, and queries, which are far fewer, once for each bundle; nothing of either goes through the
driver, and the plan doesn't grow with the number of blocks. A bundle is one tree as long as there are at most
BUNDLES trees, and TREES trees at most.

Distances in leaves come from one matrix product, which decides only what can't matter; those that can are
calculated anew, vector by vector, in double precision.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, as query or
candidate; fewer candidates give fewer rows; ties go to the smaller id; vectors of another length than the
query's are no candidates; rows that are no queries' own and repeat an id are one candidate each; all rows of a
query's id are its own and none of its candidates; a query that is repeated with the same vector is answered once,
with different vectors once for each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.common import written

SHARD_ROWS, QUERY_ROWS, LEAF = 16_384, 8_192, 256
#: Shards and blocks hold fewer rows where vectors are long.
SHARD_BYTES, QUERY_BYTES = 32 << 20, 8 << 20
#: Bundles are larger than a tree where there are more trees than this, and never more trees than that.
BUNDLES, TREES = 64, 16
#: Pairs of query and vector that numpy handles at once.
PAIRS = 1 << 20
#: Columns of a written tree.
TREE = ("points", "ids", "starts", "nodes", "vantages")
#: Columns of a block of queries: its numbers, the ids of its rows, and their vectors.
QUERIES = ("numbers", "own", "vectors")


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, each row by itself."""
    gap = rows - query
    return np.sqrt((gap * gap).sum(axis=1))


class Tree:
    """A vantage-point tree over distinct vectors of one length; the points of a node stand side by side.

    nodes: for each node the first and last point, the vantage point's row in vantages, the nearest and farthest
    distance of either side from it, and the nodes of both sides; leaves have -1 for the latter.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, starts: np.ndarray, nodes: np.ndarray, vantages: np.ndarray):
        self.points, self.ids, self.starts, self.nodes, self.vantages = points, ids, starts, nodes, vantages
        self.norms = (points * points).sum(axis=1)

    @staticmethod
    def of(vectors: np.ndarray, ids: np.ndarray, keep: int) -> Tree:
        """keep: so many of the smallest ids of equal vectors can be among a query's neighbours, besides its own id."""
        order = np.lexsort((ids, *vectors.T[::-1]))
        vectors, ids = vectors[order], ids[order]
        new = np.append(True, (vectors[1:] != vectors[:-1]).any(axis=1))
        point = new.cumsum() - 1
        other = new | np.append(True, ids[1:] != ids[:-1])
        run = other.cumsum() - 1
        repeat, rank = np.arange(len(ids)) - np.flatnonzero(other)[run], run - run[np.flatnonzero(new)][point]
        kept = (repeat < keep) & (rank <= keep)
        points, ids, point = vectors[new], ids[kept], point[kept]
        rows, nodes, vantages, rng = np.arange(len(points)), [], [], np.random.default_rng(3)

        def split(a: int, b: int) -> int:
            at = len(nodes)
            nodes.append([a, b, -1, 0.0, 0.0, 0.0, 0.0, -1, -1])
            if b - a > LEAF:
                vantages.append(points[rows[a + rng.integers(b - a)]])
                away = distances(points[rows[a:b]], vantages[-1])
                inner = np.argsort(away, kind="stable")
                rows[a:b], away, half = rows[a:b][inner], away[inner], (b - a) // 2
                nodes[at][2:7] = len(vantages) - 1, away[0], away[half - 1], away[half], away[-1]
                nodes[at][7:] = split(a, a + half), split(a + half, b)
            return at

        split(0, len(points))
        # Ids follow their points.
        size = np.bincount(point, minlength=len(points))[rows]
        begin = np.searchsorted(point, rows)
        ids = ids[np.arange(size.sum()) + np.repeat(begin - size.cumsum() + size, size)]
        return Tree(points[rows], ids, np.append(0, size.cumsum()), np.array(nodes, float), np.array(vantages, float).reshape(-1, points.shape[1]))

    def row(self) -> list[bytes]:
        return [x.tobytes() for x in (self.points, self.ids.astype(np.int64), self.starts.astype(np.int64), self.nodes, self.vantages)]

    @staticmethod
    def from_row(dim: int, points: bytes, ids: bytes, starts: bytes, nodes: bytes, vantages: bytes) -> Tree:
        return Tree(np.frombuffer(points).reshape(-1, dim), np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int64), np.frombuffer(nodes).reshape(-1, 9), np.frombuffer(vantages).reshape(-1, dim))


class Nearest:
    """A block of queries of one length, and the k best candidates of each so far."""

    def __init__(self, vectors: np.ndarray, own: np.ndarray, k: int, factor: float):
        self.vectors, self.own, self.k, self.factor = vectors, own, k, factor
        self.norms = (vectors * vectors).sum(axis=1)
        self.away = np.full((len(own), k), np.inf)
        self.ids = np.full((len(own), k), np.iinfo(np.int64).max)

    def visit(self, tree: Tree) -> None:
        everyone = np.arange(len(self.own))
        self.home = np.zeros(len(everyone), np.int64)
        self._descend(tree, 0, everyone)
        self._walk(tree, 0, everyone, np.zeros(len(everyone)))

    def _descend(self, tree: Tree, node: int, queries: np.ndarray) -> None:
        """To the leaf on whose side of each vantage point the queries lie."""
        _, _, vantage, _, inner, outer, _, near, far = tree.nodes[node]
        if not len(queries):
            return
        if near < 0:
            self.home[queries] = node
            self._compare(tree, node, queries)
            return
        inside = distances(self.vectors[queries], tree.vantages[int(vantage)]) <= (inner + outer) / 2
        self._descend(tree, int(near), queries[inside])
        self._descend(tree, int(far), queries[~inside])

    def _walk(self, tree: Tree, node: int, queries: np.ndarray, bound: np.ndarray) -> None:
        """bound: the least distance that the node's vectors can have from each query."""
        # A full list is needed before anything can be pruned: it is infinite until then.
        needed = ~(bound > self.away[queries, -1] * self.factor)
        queries, bound = queries[needed], bound[needed]
        if not len(queries):
            return
        _, _, vantage, *shells, near, far = tree.nodes[node]
        if near < 0:
            self._compare(tree, node, queries[self.home[queries] != node])
            return
        away = distances(self.vectors[queries], tree.vantages[int(vantage)])
        for side, low, high in ((near, *shells[:2]), (far, *shells[2:])):
            self._walk(tree, int(side), queries, np.maximum(bound, np.maximum(low - away, away - high)))

    def _compare(self, tree: Tree, node: int, queries: np.ndarray) -> None:
        a, b = tree.nodes[node, :2].astype(int)
        step = max(1, PAIRS // (b - a))
        for k in range(0, len(queries), step):
            self._merge(tree, a, b, queries[k : k + step])

    def _merge(self, tree: Tree, a: int, b: int, queries: np.ndarray) -> None:
        norms = self.norms[queries][:, None] + tree.norms[a:b]
        with np.errstate(invalid="ignore", over="ignore"):
            square = norms - 2 * (self.vectors[queries] @ tree.points[a:b].T)
            limit = self.away[queries, -1] ** 2
            if b - a > self.k + 1:  # one more than k, for one of them can be the query's own
                limit = np.minimum(limit, np.partition(square, self.k, axis=1)[:, self.k])
            # What rounding can hide is looked at too, and so is what isn't a number.
            q, p = np.nonzero(~(square > (limit + 1e-9 * np.abs(limit))[:, None] + 1e-9 * norms))
        n = tree.starts[a + p + 1] - tree.starts[a + p]
        ids = tree.ids[np.arange(n.sum()) + np.repeat(tree.starts[a + p] - n.cumsum() + n, n)]
        away = np.concatenate([np.empty(0), *(self._exact(tree, queries[q[s : s + 8192]], a + p[s : s + 8192]) for s in range(0, len(q), 8192))])
        q, away = np.repeat(q, n), np.repeat(away, n)
        other = ids != self.own[queries[q]]
        q, away, ids = q[other], away[other], ids[other]
        # With the best so far, by query, distance and id; of each query the first k stay.
        touched, q = np.unique(q, return_inverse=True)
        rows = queries[touched]
        q = np.append(q, np.repeat(np.arange(len(rows)), self.k))
        away, ids = np.append(away, self.away[rows].ravel()), np.append(ids, self.ids[rows].ravel())
        order = np.lexsort((ids, away, q))
        q, away, ids = q[order], away[order], ids[order]
        first = np.searchsorted(q, np.arange(len(rows)))[:, None] + np.arange(self.k)
        self.away[rows], self.ids[rows] = away[first], ids[first]

    def _exact(self, tree: Tree, queries: np.ndarray, points: np.ndarray) -> np.ndarray:
        return distances(tree.points[points], self.vectors[queries])


def usable(embedding: Column) -> Column:
    """Not null, not zero, all components finite numbers."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0)


def arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The components of all vectors one after another, and where each vector begins."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets - offsets[0]


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, factor: float = 0.9) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row that is_query marks, its k nearest among all others."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks")
    )
    size = F.size("embedding") * 8
    count, total, asks, asked = rows.agg(F.count("*"), F.sum(size), F.count_if("asks"), F.sum(F.when(F.col("asks"), size))).first()
    schema = "query long, query_id long, vec_id long, score double"
    shards = max(1, math.ceil(count / SHARD_ROWS), math.ceil((total or 0) / SHARD_BYTES))
    blocks = max(1, math.ceil(asks / QUERY_ROWS), math.ceil((asked or 0) / QUERY_BYTES))
    # Equal rows are dealt out too: their place in the input tells them apart.
    hashed = F.xxhash64("vec_id", "embedding", F.monotonically_increasing_id())
    dealt = rows.select(F.pmod(hashed, F.lit(shards)).cast("int").alias("shard"), F.size("embedding").alias("dim"), "vec_id", "embedding")
    bundle = F.concat_ws("-", F.col("dim"), F.floor(F.col("shard") / min(TREES, max(1, shards // BUNDLES))))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        flat, _ = arrays(table.column("embedding").combine_chunks())
        tree = Tree.of(flat.reshape(len(table), -1), table.column("vec_id").to_numpy(), k)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in zip(TREE, tree.row())}})

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("query").combine_chunks()
        flat, _ = arrays(table.column("embedding").chunk(0))
        columns = (table.column("query").to_numpy(), table.column("vec_id").to_numpy(), flat)
        return pa.table({"dim": pa.array([key[1].as_py()], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(QUERIES, columns)}})

    trees = written(dealt.groupBy("shard", "dim").applyInArrow(build, "shard int, dim int, " + ", ".join(f"{c} binary" for c in TREE))).withColumn("bundle", bundle)
    asking = written(rows.filter("asks").select("vec_id", "embedding").distinct().withColumn("query", F.monotonically_increasing_id()))
    placed = asking.select(F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"), F.size("embedding").alias("dim"), "query", "vec_id", "embedding")
    packed = written(placed.groupBy("block", "dim").applyInArrow(pack, "dim int, " + ", ".join(f"{c} binary" for c in QUERIES)))
    # Each block goes to each bundle of vectors as long as its own.
    asked_of = packed.join(trees.select("dim", "bundle").distinct(), "dim").select("bundle", F.lit(1).alias("kind"), "dim", *QUERIES)
    passing = trees.select("bundle", F.lit(0).alias("kind"), "dim", *TREE).unionByName(asked_of, allowMissingColumns=True)
    found = passing.repartition("bundle").sortWithinPartitions("bundle", "kind").mapInArrow(lambda batches: search(batches, k, factor), schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(batches: Iterator[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """(query, query_id, vec_id, score): the k best in a bundle of each query of the blocks that come after its trees."""
    bundle, trees = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bundle"] != bundle:
                bundle, trees = row["bundle"], []
            if row["kind"] == 0:
                trees.append(Tree.from_row(row["dim"], *(row[c] for c in TREE)))
                continue
            query, own = (np.frombuffer(row[c], np.int64) for c in QUERIES[:2])
            near = Nearest(np.frombuffer(row[QUERIES[2]]).reshape(len(own), -1), own, k, factor)
            for tree in trees:
                near.visit(tree)
            at, place = np.nonzero(np.isfinite(near.away) | (near.ids < np.iinfo(np.int64).max))
            columns = (query[at], own[at], near.ids[at, place], near.away[at, place])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "query_id", "vec_id", "score"])
