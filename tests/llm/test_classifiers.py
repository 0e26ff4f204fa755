import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import quality, toxicity


def held_out_accuracy(scored, labels, label):
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    return np.mean([r.predicted == r[label] for r in rows]), rows


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.vectors(docs)
    scored = quality.score(stats, quality.train(stats, labels))
    accuracy, rows = held_out_accuracy(scored, labels, "quality")
    assert accuracy > 0.95 and len(rows) > 50
    assert scored.count() == docs.count() and scored.filter("score < 0 or score > 1 or score is null").isEmpty()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs.join(labels, "doc_id", "left_semi").withColumn("score", F.lit("x")), model)
    accuracy, rows = held_out_accuracy(scored, labels, "toxic")
    found = sum(r.predicted and r.toxic for r in rows)
    assert accuracy > 0.94
    assert found >= 0.7 * sum(r.toxic for r in rows) and found >= 0.85 * sum(r.predicted for r in rows)
    # scores are those of the fitted weights on the features of whole texts
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows[:200]:
        at = [model.place[f] for f in toxicity.text_features(texts[r.doc_id]) if f in model.place]
        assert abs(r.score - 1 / (1 + np.exp(-(sum(model.weights[k] for k in at) + model.weights[-1])))) < 1e-9


def test_feature_rates_are_counted_over_all_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").unionAll(spark.sql("SELECT CAST(NULL AS string) UNION ALL SELECT ''"))
    texts = [r.text for r in docs.collect()]
    own = [toxicity.text_features(x) for x in texts]
    features = sorted(set().union(*own))[::3]
    rates, n = toxicity._rates(docs.repartition(5), features)
    assert n == len(texts)
    assert all(rates.get(f, 0) == sum(f in o for o in own) for f in features) and len(rates) == len(features)
    assert toxicity._rates(docs.limit(0), features) == ({}, 0)


def test_fit_reaches_a_minimum_of_the_risk():
    """Held against the non-negative risk computed directly: no small step along any weight lowers it."""
    rng = np.random.default_rng(5)
    p, u = (rng.random((300, 4)) < [0.5, 0.4, 0.3, 0.2]).astype(np.float32), (rng.random((3000, 4)) < [0.1, 0.2, 0.3, 0.2]).astype(np.float32)
    prior, decay = 0.05, 1e-3

    def risk(w):
        at_p, at_u = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        rest = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
        return prior * np.logaddexp(0, -at_p).mean() + max(0.0, rest) + decay / 2 * (w[:-1] ** 2).sum()

    w = toxicity.fit(p, u, prior, steps=4000, rate=0.02, decay=decay)
    for k in range(5):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += step
            assert risk(moved) > risk(w) - 1e-6


def test_quality_fit_is_the_ridge_solution(spark):
    """Moments, normal equations and calibration summed over partitions, against numpy on all rows at once."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.vectors(docs.repartition(5))
    model = quality.train(stats, labels)
    rows = {r.doc_id: np.array(r.x, np.float64) for r in stats.collect()}
    x = np.array(list(rows.values()))
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.deviation, np.where(x.std(0) > 1e-9, x.std(0), 1))
    known = [(r.doc_id, r.quality) for r in labels.collect() if r.quality is not None and r.doc_id in rows]
    part = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in known}
    fitted = [(rows[i], y) for i, y in known if part[i] in (0, 1)]
    z, y = model.map(np.array([a for a, _ in fitted])), np.array([b for _, b in fitted], float)
    gram = z.T @ z + quality.RIDGE * len(y) / quality.COSINES * np.diag([1.0] * quality.COSINES + [1e-6])
    assert np.allclose(model.weights, np.linalg.solve(gram, z.T @ y), atol=1e-6)
    aside = [(float((model.map(rows[i][None]) @ model.weights)[0]), y) for i, y in known if part[i] == 3]
    knots, values = quality.isotonic(*np.array(sorted(aside)).T)
    assert np.allclose(model.knots, knots) and np.allclose(model.values, values)
    for r in quality.score(stats, model).collect():
        assert abs(r.score - np.clip(np.interp((model.map(rows[r.doc_id][None]) @ model.weights)[0], knots, values), 0, 1)) < 1e-6


def test_non_negative_risk_finds_the_positives_in_unlabelled_rows():
    rng = np.random.default_rng(0)
    positive = (rng.random((400, 6)) < [0.7, 0.6, 0.3, 0.3, 0.3, 0.3]).astype(np.float32)
    mixed = np.vstack([(rng.random((200, 6)) < [0.7, 0.6, 0.3, 0.3, 0.3, 0.3]), (rng.random((1800, 6)) < [0.01, 0.01, 0.3, 0.3, 0.3, 0.3])]).astype(np.float32)
    w = toxicity.fit(positive, mixed, 0.1)
    assert w[0] > 2 and w[1] > 2 and np.abs(w[2:6]).max() < 1.5
    p = 1 / (1 + np.exp(-(mixed @ w[:-1] + w[-1])))
    assert p[200:].mean() < 0.1 < 0.5 < p[:200].mean()


def test_isotonic_is_the_least_squares_fit():
    raw, label = np.arange(8.0), np.array([0, 1, 0, 0, 1, 1, 0, 1.0])
    knots, values = quality.isotonic(raw, label)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()
    assert len(knots) == 4  # 0 | 1 0 0 | 1 1 0 | 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x"), (3, "y " * 100_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    stats = quality.vectors(docs.withColumn("x", F.lit(1)))
    for scored in (quality.score(stats, quality.train(stats, labels)), toxicity.score(docs, toxicity.train(docs, labels))):
        assert scored.count() == 5 and scored.filter("score is null or held_out is null").isEmpty()
    empty = docs.limit(0)
    stats = quality.vectors(empty)
    assert quality.score(stats, quality.train(stats, labels)).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


@pytest.mark.parametrize("text", [b"", b"A", "Ä ö\n\nx!".encode()])
def test_statistics_are_finite(text):
    assert len(quality.statistics(text)) == quality.STATISTICS and np.isfinite(quality.statistics(text)).all()
