"""Held-out accuracy, the scores against textbook densities, odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa

from paperloom.llm import classifier as c


def rows(rng, n):
    docs, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choices("etaoinshr", k=rng.randint(1, 8))) for _ in range(rng.randint(20, 200))]
        if not good:
            words = [w + rng.choice(["###", "!!", "|"]) for w in words] if k % 2 else words[:4] * 20
        docs.append((k, " ".join(words)))
        labels.append((k, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = rows(random.Random(1), 600)
    got = c.classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {k: q for k, q, _ in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_held_out_labels_do_not_matter(spark):
    docs, labels = rows(random.Random(2), 200)
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q, t) for k, q, t in labels]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [sorted(map(tuple, c.classify(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (labels, flipped)]
    assert [r[:2] for r in got[0]] == [r[:2] for r in got[1]] and np.allclose([r[2] for r in got[0]], [r[2] for r in got[1]])


def test_scores_are_density_ratios():
    rng = np.random.default_rng(0)
    size = len(c.FEATURES)
    x = [rng.normal(k, 1 + k, (300, size)) for k in (0, 1)]
    sums = np.stack([np.hstack([np.ones((300, 1)), v]).T @ np.hstack([np.ones((300, 1)), v]) for v in x])
    model = c.solve(sums, to_pooled=0.0, to_round=0.0)
    point = rng.normal(0.5, 1, (5, size))
    logs = []
    for v in x:
        cov = np.cov(v.T)
        z = point - v.mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(c.scores(point, model), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-6)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (2, 7), (None, 0)], "doc_id long, quality int")
    assert c.classify(no_docs, labels).collect() == []
    got = c.classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and {r.score for r in got} == {1.0 if zlib.crc32(b"1") % 4 != 2 else 0.5}
    assert {r.score for r in c.classify(odd_docs, labels.limit(0)).collect()} == {0.5}
    x = c.features(pa.array(["", " ", "a", "é" * 9, "x " * 99_999]))
    assert np.isfinite(x).all()
