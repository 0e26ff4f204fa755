import math
import re
from collections import defaultdict

from larkspur.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_targets(size, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(size.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * size[s] for s in capped)
        goal = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} | {s: most * size[s] for s in capped}
        over = {s for s in free if goal[s] > most * size[s]}
        if not over:
            return goal
        capped |= over


def check(spark, df):
    out = mixing.mix(df).collect()
    rows = df.collect()
    size = defaultdict(int)
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    goal = brute_targets(size)
    assert sorted((str(r.doc_id), r.size, r.source_size) for r in out) == sorted((str(r.doc_id), len(WORD.findall(r.text or "")), size[r.source]) for r in rows)
    taken = defaultdict(int)
    for r in out:
        assert abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    return goal, taken, out


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    goal, taken, out = check(spark, df)
    largest = max(r.size for r in out)
    for source, t in goal.items():
        assert abs(taken[source] - t) <= max(0.1 * t, largest / 10)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "d e", None), (4, "f " * 5000, "é"), (5, "g", "z"), (6, None, "empty")]
    df = spark.createDataFrame([(*r, 5, 1) for r in rows], "doc_id bigint, text string, source string, size int, copies int")
    check(spark, df)
    assert mixing.mix(df.limit(0)).count() == 0


def test_many_rows_without_an_id_and_of_equal_size(spark):
    rows = [(None, "w " * (k % 5), "x") for k in range(3000)] + [(7, "a b", "y")] * 2000 + [(k, "v " * (k % 50), "z") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    goal, taken, out = check(spark, df)
    for source, t in goal.items():
        assert abs(taken[source] - t) <= max(0.02 * t, 50)
    assert sorted(map(str, mixing.mix(df.repartition(9)).collect())) == sorted(map(str, out))


def test_apply_repeats_rows(spark):
    df = spark.createDataFrame([(k, "w " * (k % 7 + 1), f"s{k % 3}") for k in range(300)], "doc_id bigint, text string, source string")
    mixed = mixing.mix(df)
    out = mixing.apply(df, mixed)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in mixed.collect())


def solved(sizes, target, most=2.0):
    """Rates of one source by bisection of the dual variable."""
    mean = sum(sizes) / len(sizes)
    low, high = -1000.0 * mean, mean
    for _ in range(200):
        mid = (low + high) / 2
        if sum(x * min(most, math.exp(min(mid * x / mean, 50))) for x in sizes) < target:
            low = mid
        else:
            high = mid
    return [min(most, math.exp(min(low * x / mean, 50))) for x in sizes]


def test_rates_solve_the_dual(spark, sf):
    """Each document's rate is the exponential tilt of its length that meets the target, as a direct solver has it."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    _, _, out = check(spark, df)
    by = defaultdict(list)
    for r in out:
        if r.size:
            by[r.source].append(r)
    assert len({r.rate for r in out}) > 100
    for rows in by.values():
        target = rows[0].target
        expected = solved([r.size for r in rows], target)
        assert max(abs(r.rate - e) for r, e in zip(rows, expected)) < 2e-6
        assert abs(sum(r.size * r.rate for r in rows) - target) < 1e-5 * target + 1e-6 * sum(r.size for r in rows)
        # Nearer to one in entropy than one common rate that meets the same target.
        entropy = lambda w: w * math.log(w) - w + 1 if w else 1.0
        assert sum(entropy(r.rate) for r in rows) <= len(rows) * entropy(target / rows[0].source_size) + 1e-4


def test_sources_at_every_level(spark):
    """Targets far below, near and at the limit, and sources of one document or of one length."""
    rows = [(k, "w " * (1 + k % 9), "a") for k in range(50)] + [(100, "w " * 1000, "b")] + [(200 + k, "w " * 5, "c") for k in range(40)] + [(300 + k, "w " * (1 + k * k), "d") for k in range(60)]
    goal, taken, out = check(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    for source, target in goal.items():
        mine = [r for r in out if r.source == source]
        expected = solved([r.size for r in mine], target) if target < 2 * mine[0].source_size * (1 - 1e-9) else [2.0] * len(mine)
        assert max(abs(r.rate - e) for r, e in zip(mine, expected)) < 1e-5
