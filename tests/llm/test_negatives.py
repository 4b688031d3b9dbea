"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import negatives

SCHEMA = "vec_id long, label int, vector array<double>, score double, place string"


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain(rows, positives=5, limit=5, share=80, every=10):
    fine = [r for r in rows if None not in r[:3] and all(x is not None and math.isfinite(x) for x in r[2])]
    out = []
    for i, (anchor, label, v, *_) in enumerate(fine):
        if anchor % every:
            continue
        scored = sorted(((-product(v, w), other, j) for j, (other, _, w, *_) in enumerate(fine) if j != i))
        same = [s for s in scored if fine[s[2]][1] == label][:positives]
        for top, positive, _ in same:
            inside = [s for s in scored if fine[s[2]][1] != label and share * -top <= 100 * -s[0] <= 100 * -top][:limit]
            out += [(anchor, positive, k + 1, other, float(-top), float(-score)) for k, (score, other, _) in enumerate(inside)]
    return sorted(out)


def whole_numbers(rng, n, width, labels=4, spread=3):
    middles = [[rng.randint(-6, 6) for _ in range(width)] for _ in range(labels)]
    rows = []
    for k in range(n):
        label = min(rng.randrange(labels * 2), labels - 1)  # the last label has over half of all rows
        rows.append((k, label, [float(x + rng.randint(-spread, spread)) for x in middles[label if rng.random() < 0.6 else 0]], 0.5, "p"))
    return rows


@pytest.mark.parametrize(("block", "step", "numbers"), [(negatives.BLOCK, negatives.STEP, negatives.NUMBERS), (7, 3, 60)])
def test_against_all_pairs(spark, monkeypatch, block, step, numbers):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "STEP", step)
    rows = whole_numbers(random.Random(4), 300, 9)
    rows += [(k, 1, rows[0][2], 0.1, None) for k in (20, 20, 500, 501)]  # ties and repeated anchors
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0, numbers=numbers)
    want = plain(rows)
    assert len(want) > 200 and sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize(("positives", "limit", "share"), [(1, 3, 80), (7, 2, 100), (3, 50, 0)])
def test_other_limits(spark, positives, limit, share):
    rows = whole_numbers(random.Random(positives), 120, 5, spread=2)
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, positives=positives, negatives=limit, share=share)
    assert sorted(map(tuple, got.collect())) == plain(rows, positives, limit, share)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = whole_numbers(random.Random(8), 40, 4, labels=2)
    odd = [(None, 1, [1.0] * 4), (10, None, [1.0] * 4), (10, 1, None), (20, 0, [1.0, None, 1.0, 1.0]), (20, 0, [nan] * 4), (30, 1, [inf, 0.0, 0.0, 0.0]), (30, 1, [-inf] * 4)]
    short = [(40, 0, []), (50, 1, [5.0]), (60, 0, [3.0] * 9), (70, 1, [0.0] * 4), (80, 0, [-4.0] * 4)]
    rows = good + [(*r, None, None) for r in odd + short] * 2
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == plain(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(none, F.col("vec_id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([r for r in good if r[1] == 1], SCHEMA)
    assert negatives.hard_negatives(alone, F.col("vec_id") % 10 == 0).collect() == []


def test_scan_keeps_what_the_bounds_allow():
    rng = np.random.default_rng(5)
    rows = rng.integers(-9, 10, (500, 33)).astype(float)
    block = negatives.Block(0, np.arange(500), np.arange(500), rows)
    looked = []
    for anchor in rng.integers(-9, 10, (20, 33)).astype(float):
        exact = rows @ anchor
        least, most = block.reach(anchor[None, :])
        assert least[0] <= exact.min() and exact.max() <= most[0]
        floor = np.sort(exact)[-5]

        def keep(low, high):
            looked.append(len(low))
            return high >= floor

        at, score = block.scan(anchor, keep)
        assert (score == exact[at]).all() and set(np.flatnonzero(exact >= floor)) == set(at.tolist())
    assert min(looked) < 100  # the bounds do refuse rows before the last dimensions


def test_blocks_have_one_label():
    labels = np.repeat([1, 1, 2, 5], [30, 5, 40, 1])
    vectors = pa.array([[float(k)] * (k % 3) for k in range(76)])
    batch = pa.RecordBatch.from_arrays([pa.array(labels), pa.array(np.arange(76)), pa.array(np.arange(76)), vectors], ["label", "vec_id", "place", "vector"])
    for cut in (76, 10, 3):
        found = list(negatives.blocks([batch.slice(a, cut) for a in range(0, 76, cut)]))
        assert [b.label for b in found] == [1, 2, 5] and np.concatenate([b.ids for b in found]).tolist() == list(range(76))
