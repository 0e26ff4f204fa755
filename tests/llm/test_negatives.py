import math
import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import negatives
from larkspur.llm.negatives import LEAST, MOST


def brute(rows):
    """rows (id, label, vector) by the definition; ids are distinct."""
    good = [(i, lab, [min(max(math.floor(256 * float(v)), LEAST), MOST) for v in x]) for i, lab, x in rows if i is not None and lab is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for a, al, ax in good:
        if a % 3:
            continue
        score = {b: (min(max(sum(p * q for p, q in zip(ax, bx)), LEAST), MOST), bl) for b, bl, bx in good if b != a and len(bx) == len(ax)}
        order = sorted(score, key=lambda b: (-score[b][0], b))
        for p in [b for b in order if score[b][1] == al][:5]:
            ps = score[p][0]
            hard = [b for b in order if score[b][1] != al and 80 * ps <= 100 * score[b][0] <= 100 * ps][:5]
            out += [(a, p, k + 1, b, ps, score[b][0]) for k, b in enumerate(hard)]
    return sorted(out)


def corpus(seed=2):
    rng = random.Random(seed)
    rows = []
    hot = [0.25, -0.5, 0.125, 1.0]
    for i in range(420):
        kind = i % 6
        x = hot if kind == 0 else [rng.choice([-1.0, 0.0, 0.5, 1.0, 0.004]) for _ in range(4)] if kind < 3 else [rng.gauss(0, 1) for _ in range(4)]
        rows.append((i, rng.randrange(3) if kind else rng.choice([0, 0, 0, 1]), x))
    rows += [(420, None, hot), (421, 1, None), (422, 1, []), (423, 1, [0.0, None, 1.0, 1.0]), (424, 2, [math.nan] * 4), (425, 2, [math.inf, 1.0, 1.0, 1.0]), (None, 1, hot), (426, 1, [0.0] * 4)]
    rows += [(k, k % 2, [1.0, rng.random()]) for k in range(430, 450)] + [(450, 7, [1e30, 1.0, 1.0, 1.0]), (451, 7, [1e14, -1e13, 3.0, 1.0]), (453, 8, [9e13, 1e12, 1.0, 1.0]), (456, 8, [-1e300, 0.5, 0.5, 0.5])]
    return rows


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, lab, x, "a", "b") for i, lab, x in rows], "vec_id bigint, label int, embedding array<double>, x string, query string")
    return sorted(tuple(r) for r in negatives.mine(df, F.col("id") % 3 == 0, **more).collect())


def test_against_brute_force(spark):
    rows = corpus()
    expected = brute(rows)
    assert len(expected) > 1500
    assert mined(spark, rows + rows[:7]) == expected  # repeated rows count once
    assert mined(spark, rows, block_bytes=4000, shard_rows=40) == expected


def test_none_fit(spark):
    assert mined(spark, []) == [] and mined(spark, [(3, 1, [1.0]), (6, 1, [1.0])]) == [] and mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    assert mined(spark, [(3, 1, [1.0]), (4, 1, [-1.0]), (5, 2, [-1.0])]) == []  # below zero no window has a score


def clusters(n=6000, dim=12, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    which = rng.integers(0, 40, n)
    vectors = np.floor(256 * (centres[which] + 0.03 * rng.normal(size=(n, dim)))).astype(np.int64)
    return np.arange(n), which % 5, vectors


def test_bounds_hold_for_every_subtree():
    ids, labels, vectors = clusters()
    tree = negatives.Tree(ids, labels, vectors)
    queries = np.concatenate([vectors[:20], np.zeros((1, 12), np.int64), 5 * vectors[20:25]])
    place = queries.astype(np.float64)
    scores = negatives.products(queries, tree.vectors)
    todo, inner = [tree.root], 0
    while todo:
        node = todo.pop()
        if node.children:
            inner += 1
            least, most = negatives.bounds(node, place, np.sqrt((place**2).sum(1)))
            for k, child in enumerate(node.children):
                part = scores[:, child.first : child.last]
                assert (least[:, k] <= part.min(1)).all() and (part.max(1) <= most[:, k]).all()
        todo += node.children
    assert inner > 10


def test_siblings_are_left_out(monkeypatch):
    """On clustered vectors a search scores a small part of the rows, and still finds what all rows would give."""
    ids, labels, vectors = clusters()
    tree = negatives.Tree(ids, labels, vectors)
    scored = []
    products = negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, b: (scored.append(len(a) * len(b)), products(a, b))[1])
    queries, everything = vectors[:50], products(vectors[:50], vectors)
    for same in (True, False):
        low = np.full(50, LEAST) if same else (0.8 * everything.max(1)).astype(np.int64)
        high = np.full(50, MOST) if same else (0.9 * everything.max(1)).astype(np.int64)
        best = negatives.search(tree, queries, ids[:50], labels[:50], low, high, same, 5)
        for q in range(50):
            fits = [i for i in range(len(ids)) if i != q and (labels[i] == labels[q]) == same and low[q] <= everything[q, i] <= high[q]]
            expected = sorted(fits, key=lambda i: (-everything[q, i], i))[:5]
            assert best.id[best.query == q].tolist() == expected
    assert sum(scored) < 0.25 * 2 * 50 * len(ids)


def test_sums_are_exact_or_cut():
    big = np.array([[1 << 40, 1, -3], [MOST, MOST, LEAST], [5, 7, 9]])
    got = negatives.products(big, big)
    for i in range(3):
        for j in range(3):
            assert got[i, j] == min(max(sum(int(a) * int(b) for a, b in zip(big[i], big[j])), LEAST), MOST)
