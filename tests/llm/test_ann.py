import numpy as np
import pytest
from pyspark.sql import functions as F

from tailcast.llm import ann


def test_parallel_error_weighs_more():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = ann.fit(x)
    codes = ann.encode(x, centres)
    near = np.stack([((ann._pairs(x)[:, m, None] - centres[m]) ** 2).sum(-1).argmin(1) for m in range(32)], axis=1)

    def loss(c):
        r = x - np.concatenate([centres[m][c[:, m]] for m in range(32)], axis=1)
        along = (r * x).sum(1)
        return ((r**2).sum(1) + (ann.parallel_weight(64) - 1) * along**2).mean(), np.abs(along).mean()

    assert loss(codes)[0] < loss(near)[0] and loss(codes)[1] < loss(near)[1]


def test_scan_adds_the_table_entries():
    rng = np.random.default_rng(1)
    for dim in (7, 8, 10):
        x, q = rng.normal(size=(50, dim)), rng.normal(size=(4, dim))
        centres = ann.fit(x)
        codes = ann.encode(x, centres)
        made = np.concatenate([centres[m][codes[:, m]] for m in range(codes.shape[1])], axis=1)[:, :dim]
        pad = np.concatenate([centres[m][codes[:, m]] for m in range(codes.shape[1])], axis=1)[:, dim:]
        assert not pad.size or not (q @ np.zeros((dim, 1))).any()
        np.testing.assert_allclose(ann.scan(q, ann.pack(codes), centres), q @ made.T, rtol=1e-4, atol=1e-4)


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            out[i] = sorted((-float(v @ w), j) for j, w in good if j != i)[:k]
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.searched(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(s == pytest.approx(float(x[q].astype(float) @ x[i].astype(float)), abs=1e-9) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {j for _, j in want[q]})
    assert hits >= 0.95 * 20 * len(want)


def test_copies_and_odd_rows(spark):
    """A vector of which there are many copies: the smallest ids win, whole and in order."""
    rows = [(i, [1.0, 0.5, 0.0]) for i in range(200)] + [(200 + i, [float(i), 1.0, -1.0]) for i in range(1, 9)]
    rows += [(300, None), (301, []), (302, [0.0, 0.0, 0.0]), (303, [1.0, None, 0.0]), (304, [float("nan"), 1.0, 1.0]), (305, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (306, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("id", F.lit("x"))
    got = {}
    for r in ann.searched(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {q: [j for _, j in found] for q, found in brute([r for r in rows if r[0] != 306], 20).items()}
    assert got == want
    assert ann.searched(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [3.0, 0.5])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in ann.searched(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_tight_groups(spark):
    """More vectors lie close together than are ranked first; none of the best is missed."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2400, 16))
    x[:800] = x[0] + 0.05 * rng.normal(size=(800, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [j for _, j in found] for q, found in brute(rows, 20).items()}


def test_repeated_ids(spark):
    """Rows of one id with different vectors: the smallest asks, all are candidates, whatever the partitions."""
    rows = [(0, [2.0, 1.0]), (0, [1.0, 9.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [3.0, 3.0])]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = [tuple(r)[2:] for r in ann.searched(df, F.col("vec_id") == 0).orderBy("rank").collect()]
        assert got == [(2, 30.0), (1, 9.0), (1, 1.0)]
