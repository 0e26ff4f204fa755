"""Rank sums and contingency against direct computation."""

import numpy as np
import pandas as pd

from larkspur.operators import inference as I
from larkspur.operators import statistics as S


def test_rank_sums_with_ties_and_a_hot_key(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"k": rng.choice(["hot", "hot", "b", None], 5000), "g": rng.choice(["x", "y", "z", None], 5000), "v": np.where(rng.random(5000) < 0.4, 3.0, np.round(rng.normal(0, 4, 5000), 1))})
    frame.loc[rng.random(5000) < 0.05, "v"] = None
    df = spark.createDataFrame([(None if pd.isna(a) else a, None if pd.isna(b) else b, None if pd.isna(c) else float(c)) for a, b, c in frame.itertuples(index=False)], "k string, g string, v double").repartition(5)
    found = {r.k: r for r in I.normal_p(S.rank_sums(df, "k", "g", "x", "y", "v", slots=7)).collect()}
    for k in ("hot", "b", None):
        own = frame[(frame.k.isna() if k is None else frame.k == k) & frame.v.notna()]
        a, b = own[own.g == "x"].v.to_numpy(), own[own.g == "y"].v.to_numpy()
        u = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
        t = pd.Series(np.concatenate([a, b])).value_counts().to_numpy().astype(float)
        n = len(a) + len(b)
        z = (u - len(a) * len(b) / 2) / np.sqrt(len(a) * len(b) / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
        r = found[k]
        assert (r.n_a, r.n_b, r.u, r.ties) == (len(a), len(b), u, (t**3 - t).sum()) and abs(r.z - z) < 1e-9 and 0 <= r.p <= 1
    alike = spark.createDataFrame([("k", g, 1.0) for g in "xxyy"], "k string, g string, v double")
    assert [(r.u, r.z) for r in S.rank_sums(alike, "k", "g", "x", "y", "v").collect()] == [(2.0, None)]


def test_contingency(spark):
    rng = np.random.default_rng(1)
    r, c = rng.integers(0, 4, 3000), rng.integers(0, 3, 3000)
    c = np.where(rng.random(3000) < 0.2, np.minimum(r, 2), c)
    found = S.contingency(spark.createDataFrame([(int(a), int(b)) for a, b in zip(r, c)] + [(None, 1)], "r int, c int"), "r", "c").first()
    o = np.zeros((4, 3))
    np.add.at(o, (r, c), 1)
    e = o.sum(1, keepdims=True) * o.sum(0) / 3000
    chi2 = ((o - e) ** 2 / e).sum()
    assert found.n == 3000 and found.df == 6 and abs(found.chi2 - chi2) < 1e-6 and abs(found.cramers_v - np.sqrt(chi2 / 6000)) < 1e-9
