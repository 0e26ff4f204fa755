import random
import re

import numpy as np
import pytest

from larkspur.llm import dedup, minhash
from larkspur.llm.components import components

SPLIT = re.compile("[\x20\x09-\x0d]+")


def shingles(text, k=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in SPLIT.split(lowered) if w]
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, nth = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 9, 60, 300]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((nth, rng.choice([" ", "\n", "  "]).join(copy) if rng.random() < 0.5 else " ".join(copy).upper()))
            nth += 1
    rng.shuffle(rows)
    return rows + [(nth, None), (nth + 1, ""), (nth + 2, " \n "), (nth + 3, "a"), (nth + 4, "A"), (None, "lone row"), (nth + 5, "x " * 30_000)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id bigint, text string, node string, bands int")
    out = dedup.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None} == brute(rows)
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]
    assert len(out) == len(rows)


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_NODES", 3)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = dedup.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None} == brute(rows)


def boilerplate(seed=9):
    """Texts that share three quarters of their words, so that they tie but are not near, and some near copies among them."""
    rng = random.Random(seed)
    shared, rows = [f"b{k}" for k in range(300)], []
    for k in range(80):
        own = [f"{k}x{j}" for j in range(90)]
        rows.append((len(rows), " ".join(shared + own)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(own)
            copy[rng.randrange(90)] = "changed"
            rows.append((len(rows), " ".join(shared + copy)))
    return rows


def test_shared_boilerplate(spark, monkeypatch):
    rows = boilerplate()
    near = brute(rows)
    monkeypatch.setattr(dedup, "BLOCK_NODES", 8)
    out = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == near

    number = {}
    sets = [(0, i, sorted(number.setdefault(s, len(number)) for s in shingles(t)), i) for i, t in rows]
    finer = dedup._regroup(spark.createDataFrame(sets, "super bigint, node bigint, shingles array<bigint>, comp bigint"), 85).collect()
    group = {r.node: r.super for r in finer}
    assert all(group[i] == group[near[i][1]] for i, _ in rows)
    assert max(list(group.values()).count(g) for g in group.values()) <= 8


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")] * 2 + [(2, "A b c d e f g")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in dedup.near_duplicates(df).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert dedup.near_duplicates(df.limit(0)).count() == 0


def test_words_of_like_structure(spark):
    x, y = ("".join(p[bin(k).count("1") % 2] for k in range(1024)) for p in ("ab", "ba"))
    df = spark.createDataFrame([(1, f"p q r {x} s t"), (2, f"p q r {y} s t")], "doc_id bigint, text string")
    assert [r.component_id for r in dedup.near_duplicates(df).orderBy("doc_id").collect()] == [1, 2]


def test_rows_of_one_id_with_unlike_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(100)) for c in "ab")
    df = spark.createDataFrame([(1, a), (5, a + " z"), (5, b), (7, b + " y")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in dedup.near_duplicates(df).collect()) == [(1, 1), (5, 1), (5, 1), (7, 1)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2050)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {n: find(n) for n in list(root) if find(n) != n}


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_by_either_join(spark, monkeypatch, few):
    monkeypatch.setattr("larkspur.llm.components.FEW", few)
    hub = [(900 + k, 950) for k in range(50)] + [(k, 5) for k in range(6, 60)]
    edges = [(k, k + 1) for k in range(100, 140)] * 3 + hub + [(b, a) for a, b in hub] + [(5, 5), (None, 3), (140, 60), (60, 61)]
    out = sorted(tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert out == [(n, 5) for n in range(6, 60)] + [(n, 60) for n in (61, *range(100, 141))] + [(900 + k, 900) for k in range(1, 51)]


@pytest.fixture
def many_partitions(spark):
    wanted = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield 40
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_round_of_contraction_is_short(spark, many_partitions):
    context = spark.sparkContext
    context.setJobGroup("contraction", "components of a chain")
    assert components(spark.createDataFrame([(k, k + 1) for k in range(64)], "a bigint, b bigint")).count() == 64
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("contraction") for s in tracker.getJobInfo(job).stageIds}
    context.setLocalProperty("spark.jobGroup.id", None)
    # 1,022 tasks; 2,075 while a round shuffled its edges four times and wrote them in all partitions
    assert sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info) < 1500


@pytest.mark.parametrize("similarity", [0.5, 0.85])
def test_signatures_estimate_similarity(similarity):
    rng = np.random.default_rng(0)
    found = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        shared = int(600 * similarity / (1 + similarity))
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, 300 - shared).astype(np.uint64)])
        s = minhash.signatures(np.concatenate([a, b]), np.array([0, 300, 600]), 100)
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - similarity) < 0.02
