"""Approximate nearest neighbours by cosine on robust-pruned directed graphs.

Vectors of one direction become one node. Nodes are dealt by hash into shards of a
bounded size; each task builds one shard's graph: points are inserted in batches,
a beam search over the graph so far proposes neighbours, and relaxed pruning keeps
a candidate only if no kept one is closer to it by the factor ``ALPHA``, so that
edges point in diverse directions. Searches start from nodes that lie far apart,
and some places of every node are kept for edges of a tree that reaches all nodes,
so that tight clusters neither hide each other nor lose members. The graphs are
written as a table. Queries then run a beam search in every shard: they are broadcast
in blocks of at most ``BLOCK_BYTES``, so that no row is made for a pair of query and
shard, each task reads its shards' graphs, and the best of all shards are merged.
Every vector is indexed; recall is measured against brute force in the tests.

Distances are squared differences of unit vectors in double precision, which keep
their digits however close vectors are; scores are cosines of the original vectors,
summed in extended precision and rounded once, so that equal cosines tie.

Vectors that are null, zero, or hold null or non-finite components take no part, nor
do null ids. Vectors of different lengths are never compared: each length is a space
of its own. Directions that agree to 2**-40 in every component count as one; of its
rows those of least id come first. Rows that repeat an id with equal vectors count
once; of query rows that share an id with unlike vectors the least vector asks, and
none of that id is an answer. Fewer candidates than asked give fewer rows; an empty
table gives none. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialise

#: Nodes of a shard on average, edges of a node by pruning, places of a node for the tree, beam widths, relaxation of pruning, points inserted at once, nodes where searches start.
SHARD_NODES, DEGREE, KIN, BUILD_BEAM, SEARCH_BEAM, ALPHA, BATCH, ENTRIES = 8192, 32, 4, 48, 128, 1.2, 256, 32
SEED = 11
#: Bytes of query vectors that are broadcast at once.
BLOCK_BYTES = 64 << 20
INDEX = "shard int, place int, node bigint, x array<double>, edges array<int>"


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in extended precision where the machine has it."""
    a, b = a.astype(np.longdouble), b.astype(np.longdouble)
    return ((a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))).astype(np.float64)


def far_apart(unit: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` nodes, each the farthest from those before it."""
    found, distance = [0], ((unit - unit[0]) ** 2).sum(1)
    while len(found) < min(count, len(unit)) and distance.max() > 0:
        found.append(int(distance.argmax()))
        np.minimum(distance, ((unit - unit[found[-1]]) ** 2).sum(1), out=distance)
    return np.array(found)


class Graph:
    """A directed graph over unit vectors."""

    def __init__(self, vectors: np.ndarray):
        self.unit = units(vectors)
        n = len(vectors)
        self.edges = np.full((n, DEGREE + KIN), -1, np.int32)
        self.kin = np.zeros(n, np.int64)  # places of the tree in use
        self.entries = far_apart(self.unit, ENTRIES)
        rest = np.random.default_rng(SEED).permutation(n)
        rest = rest[~np.isin(rest, self.entries)]
        self.free = list(self.entries)  # nodes with a place of the tree left, in order of insertion
        for node in self.entries.tolist():
            self.edges[node, :DEGREE][: len(self.entries) - 1] = self.entries[self.entries != node][:DEGREE]
        at, size = 0, 16
        while at < len(rest):
            self._insert(rest[at : at + size])
            at += size
            size = min(BATCH, size * 2)

    @classmethod
    def stored(cls, vectors: np.ndarray, edges: np.ndarray) -> Graph:
        """A graph as it was built from these vectors."""
        graph = cls.__new__(cls)
        graph.unit, graph.edges = units(vectors), edges
        graph.entries = far_apart(graph.unit, ENTRIES)
        return graph

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each unit query, nearest first: nodes (-1 beyond those found) and squared distances."""
        b, n = len(queries), len(self.unit)
        rows = np.arange(b)
        start = self.entries[:width]
        first = ((queries[:, None, :] - self.unit[start]) ** 2).sum(2)
        order = np.argsort(first, 1, kind="stable")
        beam = np.full((b, width), -1, np.int32)
        far = np.full((b, width), np.inf)
        beam[:, : len(start)], far[:, : len(start)] = start[order], np.take_along_axis(first, order, 1)
        open_ = beam >= 0
        seen = np.zeros((b, n), bool)
        seen[:, start] = True
        while True:
            pick = np.where(open_, far, np.inf).argmin(1)
            live = np.flatnonzero(open_[rows, pick])
            if not len(live):
                return beam, far
            pick = pick[live]
            open_[live, pick] = False
            near = np.sort(self.edges[beam[live, pick]], 1)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]  # an edge of the tree may repeat another
            which = np.repeat(live, fresh.sum(1))
            seen[which, near[fresh]] = True
            distance = np.full(near.shape, np.inf)
            apart = queries[which] - self.unit[near[fresh]]
            distance[fresh] = np.einsum("ij,ij->i", apart, apart)
            ids, dists = np.hstack([beam[live], np.where(fresh, near, -1)]), np.hstack([far[live], distance])
            opens = np.hstack([open_[live], fresh])
            best = np.argsort(dists, 1, kind="stable")[:, :width]
            beam[live], far[live] = np.take_along_axis(ids, best, 1), np.take_along_axis(dists, best, 1)
            open_[live] = np.take_along_axis(opens, best, 1)

    def _prune(self, point: int, candidates: np.ndarray) -> np.ndarray:
        candidates = np.unique(candidates)
        candidates = candidates[(candidates >= 0) & (candidates != point)]
        own = self.unit[candidates] - self.unit[point]  # differences, so that close points keep their digits
        to_point = np.einsum("ij,ij->i", own, own)
        order = np.argsort(to_point, kind="stable")
        candidates, to_point, own = candidates[order], to_point[order], own[order]
        between = np.maximum(to_point[:, None] + to_point[None, :] - 2 * (own @ own.T), 0)
        covered = ALPHA**2 * between < to_point[None, :]
        alive, kept = np.ones(len(candidates), bool), []
        for k in range(len(candidates)):
            if alive[k]:
                kept.append(k)
                if len(kept) == DEGREE:
                    break
                alive &= ~covered[k]
        return candidates[kept]

    def _hang(self, point: int, found: np.ndarray) -> None:
        """Give a new point an edge of the tree from the nearest node found that has a place left, or else from the oldest that has one."""
        for parent in found.tolist():
            if parent >= 0 and self.kin[parent] < KIN:
                break
        else:
            while self.kin[self.free[0]] >= KIN:
                self.free.pop(0)
            parent = self.free[0]
        self.edges[parent, DEGREE + self.kin[parent]] = point
        self.kin[parent] += 1

    def _insert(self, points: np.ndarray) -> None:
        beam, _ = self.search(self.unit[points], BUILD_BEAM)
        reverse: dict[int, list[int]] = {}
        for p, found in zip(points.tolist(), beam):
            own = self._prune(p, np.concatenate([found, points]) if len(points) < BUILD_BEAM else found)
            self.edges[p, : len(own)] = own
            self._hang(p, found)
            self.free.append(p)
            for q in own.tolist():
                reverse.setdefault(q, []).append(p)
        for q, new in reverse.items():
            old = self.edges[q, :DEGREE][self.edges[q, :DEGREE] >= 0]
            both = np.unique(np.concatenate([old, np.array(new, np.int32)]))
            if len(both) > DEGREE:
                both = self._prune(q, both)
            self.edges[q, :DEGREE] = -1
            self.edges[q, : len(both)] = both


def _top(graph: Graph, vectors: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, node places and cosines of the k best of each beam; those next to them are scored too, as distances are rounded."""
    beam, _ = graph.search(units(queries), max(1, min(SEARCH_BEAM, len(vectors))))
    near = beam[:, : 4 * k]
    hit = near >= 0
    which = np.repeat(np.arange(len(queries)), hit.sum(1))
    score = np.full(near.shape, -np.inf)
    score[hit] = cosines(queries[which], vectors[near[hit]])
    best = np.argsort(-score, 1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(len(queries)), best.shape[1])
    nodes, scores = np.take_along_axis(near, best, 1).ravel(), np.take_along_axis(score, best, 1).ravel()
    return rows[nodes >= 0], nodes[nodes >= 0], scores[nodes >= 0]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one shard after another; a task's rows are sorted by their first column, the shard."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        shards = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                if kept and kept[-1].column(0)[0].as_py() != shards[a]:
                    yield pa.Table.from_batches(kept).combine_chunks()
                    kept = []
                kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks() if table.column(name).num_chunks != 1 else table.column(name).chunk(0)


def build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (shard, node, x) sorted by shard and node: rows of INDEX, in order of place."""
    for shard in _shards(batches):
        graph = Graph(_matrix(_column(shard, "x")))
        for at in range(0, shard.num_rows, 1024):
            part, edges = shard.slice(at, 1024), graph.edges[at : at + 1024]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(edges) + 1, dtype=np.int32) * edges.shape[1]), pa.array(edges.ravel()))
            yield pa.RecordBatch.from_arrays([_column(part, "shard"), pa.array(np.arange(at, at + len(edges), dtype=np.int32)), _column(part, "node"), _column(part, "x"), lists], ["shard", "place", "node", "x", "edges"])


def search_shards(shared, k: int):
    """Rows of INDEX, sorted by shard and place, as (query_id, node, score): the k best of each shard for each query of the block, a list of (ids, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            vectors, names = _matrix(_column(shard, "x")), _column(shard, "node").to_numpy()
            edges = _column(shard, "edges")
            graph = Graph.stored(vectors, edges.flatten().to_numpy().reshape(len(edges), -1))
            for ids, queries in shared.value:
                if queries.shape[1] != vectors.shape[1]:
                    continue
                for at in range(0, len(ids), BATCH):
                    rows, nodes, scores = _top(graph, vectors, queries[at : at + BATCH], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + BATCH][rows]), pa.array(names[nodes]), pa.array(scores)], ["query_id", "node", "score"])

    return run


def _asked(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Queries (id, x) by length of their vectors."""
    if not rows.num_rows:
        return []
    rows = rows.combine_chunks()
    x, ids = _column(rows, "x"), rows.column("id").to_numpy()
    sizes = np.diff(x.offsets.to_numpy())
    return [(ids[sizes == n], _matrix(x.take(pa.array(np.flatnonzero(sizes == n))))) for n in np.unique(sizes).tolist()]


def nearest(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_nodes: int = SHARD_NODES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row for which the column expression ``is_query`` holds: query_id, rank, vec_id and score of its k nearest other rows."""
    x = F.col("x")
    given = df.select(F.col(id_col).cast("bigint").alias("id"), F.transform(F.col(vector_col), lambda v: v.cast("double")).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    given = given.filter(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(sound & F.exists(x, lambda v: v != 0))
    largest = F.array_max(F.transform(x, lambda v: F.abs(v)))
    scaled = F.transform(x, lambda v: v / F.col("largest"))
    length = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, v: s + v * v))
    direction = F.transform("scaled", lambda v: F.floor(v / F.col("length") * float(1 << 40) + 0.5))
    given = given.withColumn("largest", largest).withColumn("scaled", scaled).withColumn("length", length).withColumn("direction", direction)
    given = materialise(given.select("id", "x", "asks", F.size(x).alias("dim"), F.xxhash64("direction").alias("d1"), F.xxhash64(F.lit(1), "direction").alias("d2")), "vectors")
    line = ["dim", "d1", "d2"]
    nodes = materialise(given.groupBy(*line).agg(F.min(F.struct("id", "x")).alias("least")).select(*line, F.col("least.id").alias("node"), F.col("least.x").alias("x")), "nodes")

    # Each length of vectors has shards of its own, numbered one after another.
    spaces = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_nodes).cast("int").alias("shards"))
    spaces = materialise(spaces.withColumn("before", (F.sum("shards").over(Window.orderBy("dim")) - F.col("shards")).cast("int")), "spaces")
    total = spaces.agg(F.sum("shards")).first()[0] or 1
    base = nodes.join(spaces, "dim").select((F.col("before") + F.pmod(F.xxhash64("node"), "shards")).cast("int").alias("shard"), "node", "x")
    placed = lambda df, *order: df.repartitionById(total, F.col("shard")).sortWithinPartitions("shard", *order)
    index = materialise(placed(base, "node").mapInArrow(build_shards, INDEX), "index")
    queries = materialise(given.filter("asks").groupBy("id").agg(F.min("x").alias("x")), "queries")
    numbers = queries.agg(F.sum(F.size("x"))).first()[0] or 0
    blocks = max(1, -(-8 * numbers // block_bytes))
    parts = []
    for block in range(blocks):
        shared = df.sparkSession.sparkContext.broadcast(_asked(queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()))
        parts.append(materialise(placed(index, "place").mapInArrow(search_shards(shared, k + 1), "query_id bigint, node bigint, score double"), "found"))
        shared.destroy()
    found = reduce(DataFrame.unionByName, parts)

    # Of rows of one direction only the k + 1 of least id can be among a query's k; hot directions are first cut in salted parts.
    member = given.select("id", *line).distinct().join(nodes.drop("x"), line).select("node", F.col("id").alias("vec_id"))
    salted = Window.partitionBy("node", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    member = member.withColumn("nth", F.row_number().over(salted)).filter(F.col("nth") <= k + 1)
    member = member.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).filter(F.col("nth") <= k + 1).drop("nth")
    best = found.join(member, "node").filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
