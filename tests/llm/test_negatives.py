import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailcast.llm import negatives as neg

SCHEMA = "vec_id long, embedding array<float>, label int, list string, score int"


def brute(rows, anchors, k=5, m=5, low=80):
    good = sorted({(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and None not in v and np.isfinite(v).all()}, key=lambda r: (r[0], r[2], str(r[1])))
    out, seen = [], set()
    for i, lab, v in good:
        if not anchors(i) or i in seen:
            continue
        seen.add(i)
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in good if j != i)
        for s, j, _ in [r for r in scored if r[2] == lab][:k]:
            window = [(t, n) for t, n, other in scored if other != lab and low * -s <= 100 * -t <= 100 * -s][:m]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, anchors, **how):
    df = spark.createDataFrame([(i, v, lab, "x", 3) for i, v, lab in rows], SCHEMA)
    return sorted(tuple(r) for r in neg.mined(df, anchors, **how).collect())


def blobs(n, dim, centres, spread, seed=0, labels=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    x = (middle[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    return [(i, v.tolist(), int(rng.integers(labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_against_brute_force(spark, monkeypatch, spread):
    """Tight clusters, where bounds leave lists out, and loose ones, with several parts and blocks."""
    monkeypatch.setattr(neg, "LIST_PART", 40)
    monkeypatch.setattr(neg, "ANCHOR_BLOCK", 9)
    rows = blobs(700, 12, 9, spread)
    assert mined(spark, rows, F.col("vec_id") % 20 == 0) == brute(rows, lambda i: i % 20 == 0)


def test_lists_are_left_out(spark):
    """Of tight clusters far apart an anchor later visits few; none that it leaves out could count."""
    x = np.array([v for _, v, _ in blobs(2000, 16, 12, 0.03)], dtype=float)
    centre = neg.centroids(x, 22)
    near, away = neg.nearest(x, centre)
    radius = np.array([away[near == j].max() if (near == j).any() else -1.0 for j in range(len(centre))])
    lower, upper = neg.bounds(x[:50], centre, radius)
    scores = x[:50] @ x.T
    for j in range(len(centre)):
        if (near == j).any():
            assert (scores[:, near == j] <= upper[:, [j]]).all() and (scores[:, near == j] >= lower[:, [j]]).all()
    fifth = -np.sort(-scores, axis=1)[:, 4]
    assert (upper >= fifth[:, None])[:, radius >= 0].mean() < 0.5


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = blobs(60, 4, 3, 0.5, labels=2)
    rows += [(100, None, 1), (101, [1.0, None, 0.0, 0.0], 1), (102, [nan, 0.0, 0.0, 0.0], 1), (103, [inf, 0.0, 0.0, 0.0], 0), (104, [0.0] * 4, 1), (105, [1.0, 2.0, 3.0, 4.0], None), (None, [1.0, 2.0, 3.0, 4.0], 1)]
    rows += [rows[0], rows[0], rows[7]] + [(200 + k, [0.5, 0.5, 0.5, 0.5], k % 2) for k in range(30)] + [(20, [9.0, 9.0, -9.0, 1.0], 1), (20, [9.0, 9.0, -9.0, 1.0], 0)]
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)
    longer = [*rows, (300, [1.0] * 5, 0), (310, [1.0] * 5, 0), (320, [], 0)]
    assert mined(spark, longer, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)


def test_one_vector_many_times(spark, monkeypatch):
    monkeypatch.setattr(neg, "LIST_PART", 50)
    rows = [(i, [0.3, -0.2, 0.1], i % 3) for i in range(400)]
    got = mined(spark, rows, F.col("vec_id") % 50 == 0)
    assert got == brute(rows, lambda i: i % 50 == 0) and got


def test_few_or_no_partners(spark):
    none = mined(spark, [(0, [1.0, 0.0], 1)], F.col("vec_id") == 0)
    assert none == [] and mined(spark, [], F.col("vec_id") == 0) == [] and mined(spark, blobs(20, 3, 2, 1.0), F.lit(False)) == []
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.45, 0.1], 2), (3, [-1.0, 0.0], 1), (4, [-0.9, 0.1], 2)]
    assert mined(spark, rows, F.lit(True)) == brute(rows, lambda i: True)


def test_large_components(spark):
    """Whole numbers past what float64 products hold exactly; and an error where no score fits."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * 2e5).astype(np.float32).tolist(), i % 2) for i in range(40)]
    assert mined(spark, rows, F.col("vec_id") % 4 == 0) == brute(rows, lambda i: i % 4 == 0)
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e9, 1.0], 0), (1, [1.0, 1.0], 0)], F.col("vec_id") == 0)


def test_first_takes_ties_in_order():
    scores = np.array([5, 7, 7, 1, 7])
    assert neg.first(scores, np.ones(5, bool), 2).tolist() == [1, 2]
    assert neg.first(scores, scores < 7, 9).tolist() == [0, 3]
