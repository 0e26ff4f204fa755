"""Hard negatives by exact search in multiway hyperplane trees.

Rows are dealt by hash into shards; a task builds the tree of its shard. Every split
point of a node takes the rows that are nearer to it than to its siblings, and keeps,
for each sibling's subtree, the range of distances from itself to the rows there. A
query that knows its distance to a split point thereby bounds its distance to all
rows of every sibling: with the lengths of vectors these bounds are bounds of inner
products, and a subtree whose range does not meet the query's window of scores, or
cannot beat what it has found already, is left out. Leaves are scored exactly, so
results are exact, whatever is left out.

Anchors are searched in blocks of at most ``BLOCK_BYTES``, one after another; a block
is broadcast, so no row is made for a pair of anchor and shard, let alone of rows.
First every anchor's positives are found, then one window of scores for each of
their distinct scores is searched for negatives.

Components are floor(256 x) in double precision, saturated at 64 bits; scores are
exact sums, cut at the 64-bit limits. Rows with a null id, label or vector, an
empty vector or a null or non-finite component take no part; vectors of different
lengths are never compared; of rows that repeat an id, vector and label one counts,
others of that id stay, and an anchor never meets its own id. Where no row fits there
are no rows; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialise

#: Split points of a node, rows of a leaf, rows of a shard on average, bytes of a block of anchors, queries searched at once.
FAN, LEAF, SHARD_ROWS, BLOCK_BYTES, QUERIES = 12, 96, 1 << 16, 64 << 20, 256
LIMIT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
SEED = 7


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, cut at 64 bits."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    # Magnitudes as doubles: that of the least 64-bit number has no positive counterpart.
    if a.shape[1] * np.abs(a.astype(np.float64)).max() * np.abs(b.astype(np.float64)).max() < LIMIT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), LEAST, MOST).astype(np.int64)


class _Node:
    """Rows first..last in the tree's order; below an inner node, its split points, and for each of them and each subtree the least and largest distance."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last
        self.children: list[_Node] = []
        self.points = self.near = self.far = None


class Tree:
    """A tree over integer vectors of one length, with ids and labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.place = vectors.astype(np.float64)
        self.length = np.sqrt((self.place**2).sum(1))
        order = np.arange(len(ids))
        self.random = np.random.default_rng(SEED)
        self.root = _Node(0, len(ids))
        todo = [self.root]
        while todo:
            todo += self._split(todo.pop(), order)
        self.ids, self.labels, self.vectors, self.place, self.length = (x[order] for x in (ids, labels, vectors, self.place, self.length))
        self._summarise(self.root)

    def _far_apart(self, rows: np.ndarray) -> np.ndarray:
        """Up to FAN split points, each the farthest from those before it among some of the rows."""
        rows = rows if len(rows) <= 20 * FAN else self.random.choice(rows, 20 * FAN, replace=False)
        at = self.place[rows]
        found, distance = [0], ((at - at[0]) ** 2).sum(1)
        while len(found) < FAN and distance.max() > 0:
            found.append(int(distance.argmax()))
            np.minimum(distance, ((at - at[found[-1]]) ** 2).sum(1), out=distance)
        return rows[found]

    def _split(self, node: _Node, order: np.ndarray) -> list[_Node]:
        rows = order[node.first : node.last]
        if len(rows) <= LEAF:
            return []
        points = self._far_apart(rows)
        distance = distances(self.place[rows], self.length[rows], self.place[points], self.length[points])
        nearest = distance.argmin(1)
        counts = np.bincount(nearest, minlength=len(points))
        if counts.max() == len(rows):
            return []  # all alike: a leaf of its own
        sort = np.argsort(nearest, kind="stable")
        order[node.first : node.last] = rows[sort]
        used = np.flatnonzero(counts)
        ends = np.cumsum(counts[used])
        edges = np.concatenate([[0], ends[:-1]])
        sorted_ = distance[sort]
        node.points = self.place[points], self.length[points]
        node.near, node.far = np.minimum.reduceat(sorted_, edges, 0).T, np.maximum.reduceat(sorted_, edges, 0).T
        node.children = [_Node(node.first + a, node.first + b) for a, b in zip(edges.tolist(), ends.tolist())]
        return node.children

    def _summarise(self, root: _Node) -> None:
        todo = [root]
        while todo:
            node = todo.pop()
            part = slice(node.first, node.last)
            if node.last > node.first:
                node.short, node.long = self.length[part].min(), self.length[part].max()
                one = self.labels[node.first]
                node.label = one if (self.labels[part] == one).all() else None
            todo += node.children


def distances(a: np.ndarray, a_length: np.ndarray, b: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(a_length[:, None] ** 2 + b_length[None, :] ** 2 - 2 * (a @ b.T), 0))


def _slack(q_length: np.ndarray, longest) -> np.ndarray:
    """What rounding may add to a squared distance."""
    return 1e-9 * (q_length + longest) ** 2 + 1e-3


def bounds(node: _Node, queries: np.ndarray, q_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that each child's rows can have with each query, from the ranges of all split points."""
    d = distances(queries, q_length, *node.points)
    children = node.children
    short, long = np.array([c.short for c in children]), np.array([c.long for c in children])
    slack = _slack(q_length[:, None], long[None, :])
    error = np.sqrt(_slack(q_length, max(node.points[1].max(), long.max())))[:, None]
    low, high = np.zeros((len(queries), len(children))), np.full((len(queries), len(children)), np.inf)
    for k in range(d.shape[1]):
        at = d[:, k : k + 1]
        np.maximum(low, np.maximum(node.near[k] - at, at - node.far[k]) - error, out=low)
        np.minimum(high, at + node.far[k] + error, out=high)
    q2 = q_length[:, None] ** 2
    # Cauchy-Schwarz also bounds what far distances leave open.
    reach = q_length[:, None] * long[None, :]
    most = np.minimum((q2 + long**2 - low**2) / 2, reach) + slack
    least = np.maximum((q2 + short**2 - high**2) / 2, -reach) - slack
    return least, most


class Best:
    """The k rows of largest score of each query, of equal scores those of least id; an id counts once."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(queries, LEAST, np.int64)  # score of the k-th
        self.full = np.zeros(queries, bool)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = ~self.full[query] | (score >= self.floor[query])
        if not good.any():
            return
        query, score, ids = (np.concatenate(x) for x in ((self.query, query[good]), (self.score, score[good]), (self.id, ids[good])))
        order = np.lexsort((ids, ~score, query))  # ~ turns the order round without overflow
        query, score, ids = query[order], score[order], ids[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        query, score, ids = query[new], score[new], ids[new]
        first = np.searchsorted(query, query)
        nth = np.arange(len(query)) - first
        keep = nth < self.k
        last = nth == self.k - 1
        self.floor[query[last]], self.full[query[last]] = score[last], True
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> Best:
    """For each query the k best rows of the same label, or of another, whose score is within low..high; never rows of its own id."""
    best = Best(len(queries), k)
    place = queries.astype(np.float64)
    length = np.sqrt((place**2).sum(1))
    everyone = np.arange(len(queries))
    todo = [(tree.root, everyone, np.full(len(queries), np.inf))] if len(tree.ids) else []
    while todo:
        node, active, most = todo.pop()
        need = np.maximum(low[active], np.where(best.full[active], best.floor[active], LEAST)).astype(np.float64)
        alive = most >= need - np.abs(need) * 1e-12
        if node.label is not None:
            alive &= (labels[active] == node.label) == same
        active = active[alive]
        if not len(active):
            continue
        if node.children:
            least, most = bounds(node, place[active], length[active])
            most_wanted = high[active].astype(np.float64)[:, None]
            meets = least <= most_wanted + np.abs(most_wanted) * 1e-12
            for c in np.argsort(most.mean(0)).tolist():  # the most promising comes off the stack first
                on = meets[:, c]
                if on.any():
                    todo.append((node.children[c], active[on], most[on, c]))
            continue
        part = slice(node.first, node.last)
        score = products(queries[active], tree.vectors[part])
        floor = np.where(best.full[active], np.maximum(best.floor[active], low[active]), low[active])
        fits = (score >= floor[:, None]) & (score <= high[active][:, None]) & (tree.ids[None, part] != own[active][:, None])
        fits &= (tree.labels[None, part] == labels[active][:, None]) == same
        q, r = np.nonzero(fits)
        best.add(active[q], score[q, r], tree.ids[part][r])
    return best


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _trees(batches: Iterator[pa.RecordBatch]) -> list[Tree]:
    """One tree for each length of vectors among a task's rows (id, label, vector)."""
    kept: dict[int, list] = {}
    for batch in batches:
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        for size in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == size))
            kept.setdefault(size, []).append((part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2))))
    return [Tree(*(np.concatenate(x) for x in zip(*parts))) for parts in kept.values()]


def _asks(shared, same: bool, k: int):
    """Rows (id, label, vector) of a shard as (query, score, id): the shard's best of each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _trees(batches):
            for query, own, labels, vectors, low, high in shared.value:
                if vectors.shape[1] != tree.vectors.shape[1]:
                    continue
                for at in range(0, len(query), QUERIES):
                    part = slice(at, at + QUERIES)
                    best = search(tree, vectors[part], own[part], labels[part], low[part], high[part], same, k)
                    yield pa.RecordBatch.from_arrays([pa.array(query[part][best.query]), pa.array(best.score), pa.array(best.id)], ["query", "score", "id"])

    return run


def _found(rows: DataFrame, asked: list[tuple], same: bool, k: int) -> DataFrame:
    """(query, rank, score, id) of the k best rows of all shards for each query; written, as the block goes after that."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(asked)
    found = rows.mapInArrow(_asks(shared, same, k), "query bigint, score bigint, id bigint").distinct()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    out = materialise(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "found")
    shared.destroy()
    return out


def _block(anchors: pa.Table) -> list[tuple]:
    """Anchors (id, label, x) by length of their vectors, most alike first, as (places in the block, ids, labels, vectors)."""
    column = anchors.column("x").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = []
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        vectors = _matrix(column.take(pa.array(at)))
        big = np.argsort(np.abs(vectors.astype(np.float64)).max(1), kind="stable")  # large ones need slower sums: keep them together
        out.append((at[big], anchors.column("id").to_numpy()[at[big]], anchors.column("label").to_numpy()[at[big]], vectors[big]))
    return out


def given(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label=None) -> DataFrame:
    """id, label and x, the integer components, of rows that take part."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), (F.col("label") if label is None else label).cast("bigint").alias("label"), x.alias("x"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0)).filter(sound)
    return rows.select("id", "label", F.transform("x", lambda v: F.floor(v * 256)).alias("x"))


def mine(df: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label=None, block_bytes: int = BLOCK_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for whose ``id`` the column expression ``is_anchor`` holds; ``label`` may replace the column of
    that name. A negative's score is 80 % to 100 % of the positive's.
    """
    spark = df.sparkSession
    rows = materialise(given(df, id_col, vector_col, label), "rows")
    # Of rows of one vector and label only those of least id can be among the first, the anchor's own aside.
    alike = Window.partitionBy("x", "label").orderBy("id")
    most = max(positives + 1, negatives)
    base = materialise(rows.dropDuplicates(["id", "label", "x"]).withColumn("nth", F.row_number().over(alike)).filter(F.col("nth") <= most).drop("nth"), "base")
    anchors = materialise(rows.filter(is_anchor).dropDuplicates(["id", "label", "x"]), "anchors")
    size = anchors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("x")).alias("numbers")).first()
    # A window is a copy of its anchor's vector, so a block has room for those of all its positives.
    blocks = max(1, -(-8 * (size.numbers or 0) * positives // block_bytes))
    shards = max(spark.sparkContext.defaultParallelism, -(-base.count() // shard_rows))
    base = base.repartition(shards, "id")
    out = []
    for b in range(blocks):
        now = anchors.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not now.num_rows:
            continue
        groups = _block(now)
        whole = [(q, own, lab, v, np.full(len(q), LEAST), np.full(len(q), MOST)) for q, own, lab, v in groups]
        near = _found(base, whole, True, positives)
        # One window for each anchor and distinct score; windows below zero are empty, as 80 % of it is more.
        scores = near.filter("score >= 0").select("query", "score").distinct().toArrow().to_pydict()
        of: dict[int, list[int]] = {}
        for q, s in zip(scores["query"], scores["score"]):
            of.setdefault(q, []).append(s)
        windows, table = [], []
        for q, own, lab, v in groups:
            pick = [(k, s) for k, query in enumerate(q.tolist()) for s in sorted(of.get(query, []))]
            if pick:
                at, high = np.array([k for k, _ in pick]), np.array([s for _, s in pick], np.int64)
                number = len(table) + np.arange(len(pick))
                table += [(int(q[k]), s) for k, s in pick]
                windows.append((number, own[at], lab[at], v[at], high - high // 5, high))
        hard = _found(base, windows, False, negatives)
        ids = pa.table({"query": pa.array(np.arange(now.num_rows)), "anchor_id": now.column("id")})
        asked = pa.table({"window": pa.array(range(len(table)), pa.int64()), "query": pa.array([t[0] for t in table], pa.int64()), "score": pa.array([t[1] for t in table], pa.int64())})
        named = near.join(F.broadcast(spark.createDataFrame(ids)), "query").join(F.broadcast(spark.createDataFrame(asked)), ["query", "score"])
        out.append(named.select("window", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(hard.select(F.col("query").alias("window"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "window").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    if not out:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return reduce(DataFrame.unionByName, out)
