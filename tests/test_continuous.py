"""Bootstraps of continuous values, penalised splines and stored sums, against direct computation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.operators import bootstrap as B
from larkspur.operators import smooth
from larkspur.operators import sums as T
from larkspur.sources.upkeep import Upkeep


def lines(spark, n=4000, seed=0):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"i": np.arange(n), "k": rng.choice(["hot", "hot", "hot", "b", None], n), "s": rng.choice(["u", "v"], n), "x": rng.lognormal(1, 0.8, n)})
    frame["y"] = (rng.random(n) < 1 / (1 + np.exp(1.5 - 0.4 * frame.x))).astype(float)
    df = spark.createDataFrame([(int(a), b, c, float(d), float(e)) for a, b, c, d, e in frame.itertuples(index=False)], "i bigint, k string, s string, x double, y double")
    odd = spark.createDataFrame([(-1, "hot", "u", None, 1.0), (-2, "hot", "u", float("nan"), 0.0), (-3, "b", None, float("inf"), 1.0)], df.schema)
    hashes = df.select("i", F.xxhash64("i").alias("h")).toPandas().set_index("i")["h"]
    frame["h"] = frame["i"].map(hashes)
    return frame, df.unionByName(odd).repartition(5)


def test_weights_are_poisson_and_independent_of_batches():
    ids = np.random.default_rng(0).integers(-(2**63), 2**63, 20000)
    w = B.poisson_weights(ids, 30)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.005
    assert np.abs(np.corrcoef(w.T) - np.eye(30)).max() < 0.04
    assert (np.concatenate([B.poisson_weights(p, 30) for p in np.array_split(ids, 7)]) == w).all()


@pytest.mark.parametrize("strata", [[], ["s"]])
def test_mean_intervals_are_those_of_the_same_weights(spark, strata):
    frame, df = lines(spark)
    found = {r.k: r for r in B.mean_interval(df, "k", "x", ["i"], 80, strata).collect()}
    again = {r.k: r for r in B.mean_interval(df.repartition(3), "k", "x", ["i"], 80, strata).collect()}
    assert set(found) == {"hot", "b", None}
    for k, r in found.items():
        own = frame[frame.k.isna() if k is None else frame.k == k]
        drawn = 0
        for _, part in own.groupby(strata) if strata else [(None, own)]:
            w = B.poisson_weights(part.h.to_numpy(), 80)
            drawn = drawn + len(part) * (part.x.to_numpy() @ w) / w.sum(0)
        low, high = np.quantile(drawn / len(own), [0.025, 0.975])
        assert r.n == len(own) and np.allclose([r.mean, r.low, r.high], [own.x.mean(), low, high], rtol=1e-9)
        assert np.allclose(r[2:], again[k][2:], rtol=1e-12)
        half = 1.96 * own.x.std() / math.sqrt(len(own))
        assert 0.6 * half < (r.high - r.low) / 2 < 1.5 * half


def test_bca_leans_with_the_skew(spark):
    frame, df = lines(spark, 1500)
    found = {r.k: r for r in B.bca_interval(df, "k", "x", ["i"], 400).collect()}
    from larkspur.operators import distributions as D

    for k in ("hot", "b"):
        own = frame[frame.k == k]
        x, w = own.x.to_numpy(), B.poisson_weights(own.h.to_numpy(), 400)
        drawn, mean = x @ w / w.sum(0), x.mean()
        # The replicates keep the number of rows; the jackknife is taken row by row.
        left = (x.sum() - x) / (len(x) - 1)
        gap = left.mean() - left
        lean = (gap**3).sum() / (6 * (gap**2).sum() ** 1.5)
        z0 = D.normal_quantile((drawn < mean).mean())
        z = z0 + D.normal_quantile(np.array([0.025, 0.975]))
        assert np.allclose([found[k].low, found[k].high], np.quantile(drawn, D.normal_cdf(z0 + z / (1 - lean * z))), rtol=1e-9)
    flat = spark.createDataFrame([("c", 1, 2.0), ("c", 2, 2.0), ("d", 3, 5.0)], "k string, i bigint, x double")
    assert sorted((r.k, r.low, r.high) for r in B.bca_interval(flat, "k", "x", ["i"], 20).collect()) == [("c", 2.0, 2.0), ("d", 5.0, 5.0)]
    assert B.bca_interval(flat.limit(0), "k", "x", ["i"], 20).count() == 0


def maximised(x, y, w):
    b, design = np.zeros(2), np.column_stack([np.ones(len(x)), x])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ b))
        b = b + np.linalg.solve(design.T @ (design * (w * p * (1 - p))[:, None]), design.T @ (w * (y - p)))
    return b


def test_logistic_replicates_are_fits_of_their_weights(spark):
    frame, df = lines(spark, 1200)
    fits = B.logistic_replicates(df, "k", "x", "y", ["i"], 6)
    for k in ("hot", "b", None):
        own = frame[frame.k.isna() if k is None else frame.k == k]
        w = np.column_stack([np.ones(len(own)), B.poisson_weights(own.h.to_numpy(), 6)])
        b, done = fits[k]
        assert done
        for r in range(7):
            assert np.allclose(b[:, r], maximised(own.x.to_numpy(), own.y.to_numpy(), w[:, r]), atol=1e-6)
    rows = B.parameter_intervals(df, "k", "x", "y", ["i"], 40).collect()
    assert len(rows) == 6 and all(r.low <= r.estimate <= r.high and r.converged for r in rows)
    assert all(r.significant for r in rows if r.k == "hot")


def test_row_quantiles_are_exact_and_keep_with_scale(spark):
    frame, _ = lines(spark)
    frame["x"] = frame.x.round(1)
    rows = [(k, float(x)) for k, x in zip(frame.k, frame.x)]
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "k string, x double")
    once = {r.k: r.quantiles for r in T.row_quantiles(df, "k", "x", shares, slots=5).collect()}
    tripled = {r.k: r.quantiles for r in T.row_quantiles(df.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(3)))), "k", "x", shares).collect()}
    assert once == tripled
    for k in ("hot", "b", None):
        own = np.sort(frame.x[frame.k.isna() if k is None else frame.k == k])
        assert once[k] == [own[max(0, math.ceil(q * len(own) - 1e-9) - 1)] for q in shares]


def test_basis_and_roughness():
    breaks = np.array([0, 0.1, 0.4, 0.45, 0.8, 1.0])
    u = np.linspace(0, 1, 20001)
    b = smooth.basis(u, breaks)
    assert b.shape[1] == 8 and np.allclose(b.sum(1), 1) and (b >= -1e-12).all()
    second = np.gradient(np.gradient(b, u, axis=0), u, axis=0)
    direct = (second[:, :, None] * second[:, None, :]).mean(0)
    s = smooth.roughness(breaks)
    assert np.abs(s - direct).max() < 5e-3 * np.abs(s).max()
    line = np.linalg.lstsq(b, 3 - 2 * u, rcond=None)[0]
    assert abs(line @ s @ line) < 1e-6


def test_penalised_logistic_spline_against_a_direct_maximiser(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.gamma(2, 2, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-1.5 * np.sin(x)))).astype(float)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)] + [("a", None, 1.0), ("flat", 2.0, 1.0), ("flat", 2.0, 0.0)], "k string, x double, y double").repartition(4)
    fits = smooth.penalised_spline(df, "k", "x", "y")
    f = fits["a"]
    assert f["converged"] and f["n"] == n
    design, s = smooth.basis((x - f["low"]) / f["width"], f["breaks"]), smooth.roughness(f["breaks"])
    p = 1 / (1 + np.exp(-design @ f["b"]))
    assert np.abs(design.T @ (y - p) - f["strength"] * s @ f["b"]).max() < 1e-3
    # No other strength has a smaller risk on the products at the fit, and the curve is near the truth.
    w = p * (1 - p)
    z = design @ f["b"] + (y - p) / w
    a, r, zz = design.T @ (design * w[:, None]), design.T @ (w * z), w @ z**2
    risks = [smooth.score(a, r, zz, n, s, f["strength"] * t, True) for t in (0.2, 0.5, 0.8, 1, 1.25, 2, 5)]
    assert min(risks) > risks[3] - 1e-4 and 4 < f["edf"] < 14
    assert np.abs(p - 1 / (1 + np.exp(-1.5 * np.sin(x))))[x < 8].mean() < 0.06
    assert abs(1 / (1 + np.exp(-smooth.basis(np.array([0.0]), fits["flat"]["breaks"]) @ fits["flat"]["b"]))[0] - 0.5) < 1e-6
    assert {r.k: r.n for r in smooth.table(df, "k", fits).collect()} == {"a": n, "flat": 2}


def test_least_squares_spline_takes_the_cross_validated_penalty(spark):
    rng = np.random.default_rng(4)
    x = rng.random(2000) * 10
    y = np.cos(x) + rng.normal(0, 0.3, 2000)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "k int, x double, y double").repartition(3)
    f = smooth.penalised_spline(df, "k", "x", "y", binomial=False)[1]
    design, s = smooth.basis((x - f["low"]) / f["width"], f["breaks"]), smooth.roughness(f["breaks"])

    def gcv(t):
        hat = design @ np.linalg.solve(design.T @ design + t * s, design.T)
        return 2000 * ((y - hat @ y) ** 2).sum() / (2000 - np.trace(hat)) ** 2

    assert gcv(f["strength"]) <= min(gcv(f["strength"] * t) for t in (0.01, 0.3, 0.9, 1.1, 3, 100)) + 1e-9
    assert abs(gcv(f["strength"]) - f["score"]) < 1e-9 and abs(f["fit"] - 0.09) < 0.01
    line = smooth.penalised_spline(df.withColumn("y", 2 * F.col("x") - 1 + F.xxhash64("x") % 7), "k", "x", "y", binomial=False)[1]
    assert line["edf"] < 6


def compared(store, rows, df):
    got = {(r.a, r.b): (r.n, r.known_x, float(r.total_x)) for r in store.read(df).collect()}
    want = {}
    for a, b, x in rows:
        n, known, total = want.get((a, b), (0, 0, 0))
        want[(a, b)] = (n + 1, known + (x is not None), total + round((x or 0) * 1000))
    assert got == {k: (n, known, total / 1000) for k, (n, known, total) in want.items()}


def test_upkeep_equals_recomputation_after_random_changes(spark, tmp_path):
    rng = np.random.default_rng(5)
    make = lambda n: [(None if a == 0 else f"a{a}", int(b), None if x < -1.5 else round(float(x), 3)) for a, b, x in zip(np.minimum(rng.integers(0, 12, n), 5), rng.integers(0, 6, n), rng.normal(size=n))]
    frame = lambda rows: spark.createDataFrame(rows, "a string, b int, x double")
    store, rows = Upkeep(spark, f"file://{tmp_path}/store", ["a", "b"], ["x"], 8), []
    assert store.read(frame([])).count() == 0
    for _ in range(4):
        new, gone = make(60), [rows[i] for i in rng.permutation(len(rows))[: len(rows) // 2]]
        for g in gone:
            rows.remove(g)
        rows += new
        store.change(frame(new), frame(gone))
        compared(store, rows, frame(rows))
    before = store.folders(store.version())
    one = [("a1", 1, 4.5)]
    store.change(frame(one))
    after = store.folders(store.version())
    assert sum(before.get(p) != f for p, f in after.items()) == 1
    compared(store, rows + one, frame(rows))
    at = store.version()
    assert store.change(frame(one), frame(one)) == at
    store.change(old=frame(one))
    store.vacuum()
    compared(store, rows, frame(rows))
    store.change(old=frame(rows))
    assert store.read(frame(rows)).count() == 0


def test_overtaken_writers_start_over(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "a string, x double")
    store = Upkeep(spark, f"file://{tmp_path}/store", ["a"], ["x"], 4)
    store.change(frame([("k", 1.0)]))
    first, commit = [True], store._commit

    def beaten(version, folders):
        if first:
            first.clear()
            Upkeep(spark, f"file://{tmp_path}/store", ["a"], ["x"], 4).change(frame([("k", 10.0), ("l", 3.0)]))
        return commit(version, folders)

    store._commit = beaten
    store.change(frame([("k", 100.0)]))
    assert store.version() == 3 and {r.a: float(r.total_x) for r in store.read(frame([])).collect()} == {"k": 111.0, "l": 3.0}


def test_replicates_of_a_logistic_fit_take_two_passes(spark, monkeypatch):
    """Newton steps work on sums, not on rows."""
    frame, df = lines(spark, 1200)
    passes = []
    monkeypatch.setattr(B, "keyed_sums", lambda *a: passes.append(1) or T.keyed_sums(*a))
    fits = B.logistic_replicates(df, "k", "x", "y", ["i"], 6)
    assert len(passes) == 2 and all(done for _, done in fits.values())


def test_separated_and_steep_rows_are_fitted_row_by_row(spark):
    rng = np.random.default_rng(1)
    rows = [("apart", k, float(k), float(k >= 20)) for k in range(40)] + [("ones", k, float(k % 5), 1.0) for k in range(40, 60)] + [("flat", k, 3.0, float(k % 3 == 0)) for k in range(60, 100)]
    steep = rng.normal(size=600) * np.where(rng.random(600) < 0.02, 60, 1)
    rows += [("steep", 100 + k, float(x), float(rng.random() < 1 / (1 + math.exp(-3 * x)))) for k, x in enumerate(steep)]
    df = spark.createDataFrame(rows, "k string, i bigint, x double, y double")
    fits = B.logistic_replicates(df, "k", "x", "y", ["i"], 5)
    ids = {r.i: r.h for r in df.select("i", F.xxhash64("i").alias("h")).collect()}
    assert {k: done for k, (_, done) in fits.items()} == {"apart": False, "ones": False, "flat": True, "steep": True}
    own = [r for r in rows if r[0] == "steep"]
    w = np.column_stack([np.ones(len(own)), B.poisson_weights(np.array([ids[r[1]] for r in own]), 5)])
    for r in range(6):
        assert np.allclose(fits["steep"][0][:, r], maximised(np.array([r[2] for r in own]), np.array([r[3] for r in own]), w[:, r]), rtol=1e-6)
    share = np.mean([r[3] for r in rows if r[0] == "flat"])
    assert np.allclose(fits["flat"][0][:, 0], [math.log(share / (1 - share)), 0])


def drawn_at_once(ids, rounds):
    """The definition of the weights, in one piece."""
    z = ids.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    return np.searchsorted(upto, (z >> np.uint64(11)) * 2.0**-53, "right").astype(float)


def test_weights_are_drawn_in_small_blocks(spark):
    import tracemalloc

    rng = np.random.default_rng(3)
    ids, x = rng.integers(-(2**63), 2**63, 3000), rng.random(3000)
    expected = drawn_at_once(ids, 1000)
    assert (B.poisson_weights(ids, 1000) == expected).all() and B.poisson_weights(ids[:0], 7).shape == (0, 7)
    tracemalloc.start()
    sums = B.weighted_sums(np.stack([np.ones(3000), x]), ids, np.arange(1001))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # all weights at once hold 24 MB
    assert np.allclose(sums[:, 1:], [expected.sum(0), x @ expected], rtol=1e-12) and np.allclose(sums[:, 0], [3000, x.sum()])


def test_rows_of_one_file_are_dealt_over_all_cores(spark):
    """Strata or not, a table that is one task is resampled by many."""
    from pyspark import TaskContext

    frame, df = lines(spark, 800)
    rows = B._rows(df.coalesce(1), ["k", "s"], ["i"], x="x")
    for dealt, least in ((rows, 1), (B._spread(rows), 8)):
        tasks = dealt.mapInPandas(lambda fs: (pd.DataFrame({"t": [TaskContext.get().partitionId()]}) for f in fs if len(f)), "t int").distinct().count()
        assert tasks >= least and (least > 1 or tasks == 1)
    plan = B.mean_interval(df.coalesce(1), "k", "x", ["i"], 20, ["s"])._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_weights_are_drawn_in_17_bytes_each():
    """Two numbers of 64 bits and a byte a weight; the first kernel in blocks held three numbers and marks."""
    import tracemalloc

    rng = np.random.default_rng(6)
    ids, x = rng.integers(-(2**63), 2**63, 2000), rng.random(2000)
    numbers = np.array([0, 5, 1, 900, *range(1000, 2500)])
    drawn = drawn_at_once(ids, 2500)
    expected = np.column_stack([np.ones(2000), drawn[:, numbers[1:] - 1]])
    for values in (np.stack([np.ones(2000), x]), np.stack([x**d for d in range(6)])):
        B.weighted_sums(values, ids[:10], numbers)
        tracemalloc.start()
        sums = B.weighted_sums(values, ids, numbers)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.allclose(sums, values @ expected, rtol=1e-12)
        assert peak < 17 * B._BLOCK + (512 << 10)
    # Draws of ranges with more than one weight, in every place of a block and of the last, shorter one.
    mixed = np.isin(drawn[:, :40], [7, 8, 9]).any(1) | (rng.random(2000) < 0.01)
    for some in (ids[mixed], ids[mixed][:1], ids[:0]):
        assert (B.poisson_weights(some, 2500) == drawn_at_once(some, 2500)).all()


def test_batches_are_joined_over_keys(spark):
    """A task draws weights for many rows at once, however few rows of a stratum a batch holds."""
    frame, df = lines(spark, 2000)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        one = df.filter(F.col("i") >= 0).select("k", "s", "x", F.when(F.col("i") % 150 < 120, F.col("i")).alias("m")).coalesce(1).cache()
        counted = lambda _, part: np.array([1.0, len(part)])
        found = {rows: {(r.k, r.s): r.sums for r in T.keyed_sums(one.select("k", "s", "x"), ["k", "s"], counted, rows).collect()} for rows in (0, 1000, B._ROWS)}
        # Integers come as another type from a batch with nulls; such batches are not joined with others.
        apart = {r.m: r.sums[1] for r in T.keyed_sums(one.select("m", "x"), ["m"], counted, 1000).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found[0]) == 6 and all({k: s[1] for k, s in f.items()} == {k: s[1] for k, s in found[0].items()} for f in found.values())
    assert min(s[0] for s in found[0].values()) > 10 and {s[0] for s in found[B._ROWS].values()} == {1.0} and max(s[0] for s in found[1000].values()) <= 3
    values = [r.m for r in one.collect()]
    assert apart == {m: values.count(m) for m in set(values)}
