import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import neighbours


def brute(ids, x, queries, k=5):
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        score = (x @ x[at]) / (norm * norm[at])
        order = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def test_recall_on_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    out = neighbours.nearest(df, F.col("vec_id") % 50 == 0, shard_nodes=200).collect()
    expected = brute(ids, x, [i for i in ids.tolist() if i % 50 == 0])
    hits = sum(r.vec_id in {v for v, _ in expected[r.query_id]} for r in out)
    assert hits >= 0.95 * sum(map(len, expected.values()))
    score = {(q, v): s for q, found in expected.items() for v, s in found}
    assert all(abs(score.get((r.query_id, r.vec_id), r.score) - r.score) < 1e-12 for r in out)
    for q in expected:
        assert [r.rank for r in sorted((r for r in out if r.query_id == q), key=lambda r: (-r.score, r.vec_id))] == [1, 2, 3, 4, 5]


def test_recall_of_a_graph_on_random_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64))
    graph = neighbours.Graph(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows, nodes, _ = neighbours._top(graph, x, x[:100], 6)
    truth = np.argsort(-(unit[:100] @ unit.T), 1)[:, :6]
    assert np.mean([n in truth[r] for r, n in zip(rows, nodes)]) > 0.9


def recall(spark, x, queries, shard_nodes, k=5):
    """Share of answers as near as brute force has them, by rank."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    out = neighbours.nearest(df, F.col("vec_id").isin(queries), k=k, shard_nodes=shard_nodes).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in queries:
        apart = ((unit - unit[q]) ** 2).sum(1)
        apart[q] = np.inf
        bound = np.sort(apart)[k - 1]
        hits += sum(apart[r.vec_id] <= bound * (1 + 1e-9) + 1e-15 for r in out if r.query_id == q)
    return hits / (k * len(queries))


def test_parallel_vectors_tie_and_smaller_ids_come_first(spark):
    x = np.outer(np.arange(1, 600), [1.0, 2.0, -3.0])
    df = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    out = neighbours.nearest(df, F.col("vec_id") == 500).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(k, 1.0) for k in range(1, 6)]


def test_tight_clusters(spark):
    rng = np.random.default_rng(3)
    for noise in (1e-7, 1e-4, 0.05):
        x = np.repeat(rng.normal(size=(4, 32)), 500, 0) + noise * rng.normal(size=(2000, 32))
        assert recall(spark, x, list(range(0, 2000, 50)), 8192) >= 0.95, noise


def test_several_full_shards(spark):
    x = np.random.default_rng(4).normal(size=(6000, 32))
    assert recall(spark, x, list(range(0, 6000, 100)), 2000) >= 0.95


def test_lengths_are_spaces_and_ids_may_repeat(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0, 1.0]), (100, [1.0, 1.0, 2.0]), (3, [1e200, 1e200, 1e200]), (4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in out) == [(50, 1, 4, 1.0), (50, 2, 1, 0.0), (100, 1, 2, 0.942809), (100, 2, 3, 0.942809)]


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.0]) for k in range(0, 40)] + [(100, [0.0, 1.0]), (101, [1.0, 1.0]), (102, None), (103, [0.0, 0.0]), (104, [nan, 1.0]), (105, [inf, 1.0]), (106, [None, 1.0]), (107, [1.0]), (None, [1.0, 0.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, node int, score int")
    out = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    found = {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in out}
    assert [found[0, k] for k in range(1, 6)] == [(k, 1.0) for k in range(1, 6)]
    assert [found[100, k][0] for k in range(1, 6)] == [101, 0, 1, 2, 3]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    two = df.filter("vec_id in (0, 101)")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 101)]


def test_no_answer_comes_twice(spark, sf):
    """Edges of the tree may repeat others; a beam holds each node once."""
    x = np.random.default_rng(6).normal(size=(1500, 24))
    graph = neighbours.Graph(x)
    assert any(len(set(e[e >= 0])) < (e >= 0).sum() for e in graph.edges.astype(int))
    beam, far = graph.search(graph.unit[:100], 64)
    assert all(len(set(b.tolist())) == 64 for b in beam) and (np.diff(far, axis=1) >= 0).all()
    out = neighbours.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 50 == 0).collect()
    assert len({(r.query_id, r.vec_id) for r in out}) == len(out)


def test_small_blocks_find_the_same(spark):
    x = np.random.default_rng(7).normal(size=(900, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000, [1.0, 2.0]), (2050, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    rows = lambda **more: sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 50 == 0, shard_nodes=300, **more).collect()))
    assert rows() == rows(block_bytes=500) and len(rows()) == 18 * 5 + 2


def test_recall_of_a_full_shard_of_embeddings():
    """The measured share of the five nearest, on vectors without clusters, in one graph of full size."""
    x = np.random.default_rng(8).normal(size=(4096, 64))
    graph = neighbours.Graph(x)
    rows, nodes, _ = neighbours._top(graph, x, x[:150], 6)
    near = graph.unit[:150] @ graph.unit.T
    near[np.arange(150), np.arange(150)] = -9
    truth = np.argsort(-near, 1)[:, :5]
    got = [[n for r, n in zip(rows, nodes) if r == q and n != q][:5] for q in range(150)]
    assert np.mean([t in g for g, own in zip(got, truth) for t in own]) > 0.95
