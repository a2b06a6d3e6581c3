import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailcast.functions.statistics import gev_nll, lmoments_start
from tailcast.operators import gevfit, newton


def draws(c, loc, scale, n, seed, slope=0.0, wider=0.0, x=None):
    y = -np.log(np.random.default_rng(seed).random(n))
    x = np.zeros(n) if x is None else x
    return loc + slope * x + (scale + wider * x) * (1 - y**c) / c


def frame(spark, samples):
    rows = [(g, i, float(v), float(x)) for g, (values, xs) in samples.items() for i, (v, x) in enumerate(zip(values, xs, strict=True))]
    return spark.createDataFrame(rows, "g string, i int, value double, x double")


def test_equal_to_the_simplex(spark):
    """Light, heavy and bounded tails, far from zero and narrow; better than the simplex, by which it is close."""
    kinds = {"a": (0.2, 5, 2), "b": (-0.4, -300, 40), "c": (1e-4, 1e6, 3), "d": (-0.1, 0, 1e-3), "e": (0.45, 10, 1)}
    samples = {g: (draws(*p, 900, k), np.zeros(900)) for k, (g, p) in enumerate(kinds.items())}
    got = {r["g"]: r for r in newton.fit_by_sums(frame(spark, samples), ["g"]).collect()}
    for g, (x, _) in samples.items():
        theta, nll = gevfit.fit_samples(x[None], lmoments_start(x[None]), passes=8)
        mine = np.array([got[g]["c"], got[g]["location"], got[g]["scale"]])
        own = gev_nll(mine[None], x[None])[0]
        assert got[g]["n"] == 900 and math.isclose(own, got[g]["nllf"], rel_tol=1e-9, abs_tol=1e-6)
        assert own <= nll[0] + 1e-6
        np.testing.assert_allclose((mine - theta[0]) / [1, theta[0, 2], theta[0, 2]], 0, atol=2e-4)
        # flat in all directions: no step of a millionth gets lower
        for k in range(3):
            for h in (-1e-6, 1e-6):
                moved = mine + h * np.eye(3)[k] * [1, mine[2], mine[2]][k]
                assert gev_nll(moved[None], x[None])[0] >= own - 1e-9 * abs(own)


def test_trends_bounds_and_pins(spark):
    x = np.linspace(1990, 2020, 1200)
    samples = {"t": (draws(-0.1, 20.0, 3.0, 1200, 1, 0.5, 0.05, x - 1990), x), "u": (draws(0.1, 5.0, 1.0, 1200, 2), x)}
    df = frame(spark, samples)
    free = {r["g"]: r for r in newton.fit_by_sums(df, ["g"], covariate="x").collect()}
    r = free["t"]
    assert math.isclose(r["location_1"], 0.5, rel_tol=0.1) and math.isclose(r["scale_0"] + 2005 * r["scale_1"], 3.75, rel_tol=0.1) and abs(r["c"] + 0.1) < 0.06
    limits = {"c": (-0.05, 0.3), "location_0": (-950.0, 100.0), "location_1": (0.2, 0.45), "scale_0": (0.5, 3.0), "scale_1": (0.0, 0.01)}
    for row in newton.fit_by_sums(df, ["g"], covariate="x", bounds=limits).collect():
        for name, (lo, hi) in limits.items():
            assert lo - 1e-9 <= row[name] <= hi + 1e-9, (name, row)
        assert row["nllf"] >= free[row["g"]]["nllf"] - 1e-6
    pinned = {r["g"]: r for r in newton.fit_by_sums(df, ["g"], fixed={"c": 0.1}).collect()}
    assert pinned["u"]["c"] == pytest.approx(0.1) and pinned["u"]["location"] == pytest.approx(5.0, abs=0.2)


def test_odd_groups(spark):
    rows = [("few", 0, 1.0, 0.0), ("few", 1, 2.0, 0.0), ("one", 0, 3.0, 1.0)] + [("one", i, 3.0, 1.0) for i in range(9)] + [("null", i, None, 1.0) for i in range(6)]
    rows += [("good", i, float(v), 1.0) for i, v in enumerate(draws(0.1, 0, 1, 200, 3))] + [("good", 900, float("nan"), 1.0), ("good", 901, float("inf"), 1.0), (None, 1, 2.0, 3.0)]
    rows += [(None, i, float(v), 1.0) for i, v in enumerate(draws(0.1, 0, 1, 200, 3))]
    df = spark.createDataFrame(rows, "g string, i int, value double, x double")
    got = {r["g"]: r for r in newton.fit_by_sums(df, ["g"]).collect()}
    assert set(got) == {"few", "one", "good", None}
    assert got["few"]["c"] is None and got["one"]["c"] is None and got["one"]["n"] == 10
    assert got["good"]["n"] == 200 and abs(got["good"]["c"] - 0.1) < 0.15 and got[None]["c"] is not None
    assert newton.fit_by_sums(df.limit(0), ["g"]).count() == 0


def test_counts_are_draws(spark):
    df = spark.range(3000).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    w = df.select("k", newton.resampled_count(4, F.col("k"), F.col("id")).alias("w"))
    r = w.agg(F.avg("w"), F.variance("w"), F.max("w")).first()
    assert abs(r[0] - 1) < 0.02 and abs(r[1] - 1) < 0.05 and r[2] <= 12
    again = df.repartition(7).select("k", newton.resampled_count(4, F.col("k"), F.col("id")).alias("w"))
    assert again.groupBy("k").sum("w").exceptAll(w.groupBy("k").sum("w")).count() == 0


def test_samples_are_fits_of_counted_rows(spark):
    x = draws(-0.2, 10, 2, 150, 5)
    df = frame(spark, {"a": (x, np.zeros(150))})
    fits = newton.fit_by_sums(df, ["g"], n_resamples=6, row=["i"], seed=9)
    counts = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("w", newton.resampled_count(9, F.col("k"), F.col("i")))
    drawn = {}
    for r in counts.collect():
        drawn.setdefault(r["k"], []).extend([r["value"]] * r["w"])
    for r in fits.where("k >= 0").collect():
        v = np.array(drawn[r["k"]])[None]
        theta, nll = gevfit.fit_samples(v, lmoments_start(v), passes=6)
        assert r["n"] == v.size and r["nllf"] <= nll[0] + 1e-4
        np.testing.assert_allclose([r["c"], r["location"], r["scale"]], theta[0], atol=2e-3)


def test_intervals_with_trends_cover(spark):
    """Of 40 populations whose level at a covariate is known, about nine in ten intervals hold it."""
    x = np.linspace(0, 1, 120)
    samples = {f"{k:02d}": (draws(0.1, 10.0, 2.0, 120, 100 + k, 3.0, 0.5, x), x) for k in range(40)}
    rows = gevfit.fit_confidence(frame(spark, samples), ["g"], periods=[20], level=0.9, covariate="x", at=[0.0, 1.0], row=["i"], n_resamples=80).collect()
    level = lambda at: 10 + 3 * at + (2 + 0.5 * at) * (1 - (-math.log(1 - 1 / 20)) ** 0.1) / 0.1
    assert len(rows) == 80 and all(r["ci_lower"] <= r["return_level"] <= r["ci_upper"] for r in rows)
    held = sum(r["ci_lower"] <= level(r["x"]) <= r["ci_upper"] for r in rows) / 80
    assert 0.72 <= held <= 0.99
    near = gevfit.event_confidence(frame(spark, {"00": samples["00"]}), ["g"], 17.0, covariate="x", at=[0.5], row=["i"], n_resamples=40).first()
    assert near["ci_lower"] < near["return_period"] < near["ci_upper"]
    with pytest.raises(ValueError):
        gevfit.fit_confidence(frame(spark, {"00": samples["00"]}), ["g"], covariate="x")


def test_the_chain_climbs_out_of_a_poor_minimum():
    """Two valleys: from the shallow one restarts of the same width can't see the deep one, a chain gets there."""
    f = lambda t: 0.05 * (t[:, 0] - 6) ** 2 - 2 * np.cos(2 * t[:, 0]) + (t[:, 1:] ** 2).sum(1)

    def minimum(tries):
        t = tries.copy()
        for _ in range(400):
            t[:, 0] -= 0.02 * (0.1 * (t[:, 0] - 6) + 4 * np.sin(2 * t[:, 0]))
            t[:, 1:] *= 0.9
        return t, f(t)

    start, value = minimum(np.array([[-9.0, 1.0]]))
    end = gevfit.hop(minimum, start[0], float(value[0]), np.array([4.0, 1.0]), 150, 1.0, 0.5, np.random.default_rng(0))
    assert abs(end[0] - 6.28) < 0.2
    cold = gevfit.hop(minimum, start[0], float(value[0]), np.array([4.0, 1.0]), 0, 1.0, 0.5, np.random.default_rng(0))
    assert (cold == start[0]).all()


def test_hops_recover_planted_trends(spark):
    x = np.arange(600.0)
    values = draws(-0.1, 10.0, 2.0, 600, 8, 0.01, 0.0, x)
    bad = np.array([0.5, values.max(), 5.0])
    theta, nll = gevfit.fit_trend(values, x, bad, basin_hops=25, bounds={3: (1e-6, np.inf)})
    good, best = gevfit.fit_trend(values, x, lmoments_start(values[None])[0], bounds={3: (1e-6, np.inf)})
    assert nll <= best + 0.01 and abs(theta[2] - 0.01) < 0.004
    limits = {0: (-0.02, 0.02), 1: (9.0, 10.0), 2: (0.0, 0.005), 3: (1.0, 2.0), 4: (0.0, 1e-4)}
    held, value = gevfit.fit_trend(values, x, good[[0, 1, 3]], bounds=limits)
    assert all(lo - 1e-9 <= held[k] <= hi + 1e-9 for k, (lo, hi) in limits.items()) and value >= best
    df = frame(spark, {"a": (values, x)})
    r = gevfit.fit_gev(df, ["g"], stationary=False, covariate="x", bounds={"location_1": (0.0, 0.004), "scale_0": (1e-6, 50.0)}, basin_hops=3).first()
    assert 0 <= r["location_1"] <= 0.004 + 1e-9
    with pytest.raises(ValueError):
        gevfit.fit_gev(df, ["g"], bounds={"shape": (0, 1)})


def test_rows_are_packed_once(spark, monkeypatch):
    """Counts are drawn once and held beside the rows, whose blocks add up to the same fits, whatever their size and the keys."""
    x = draws(-0.2, 10, 2, 120, 5)
    df = frame(spark, {"a": (x, np.arange(120.0)), "b": (x[:50] + 1, np.arange(50.0))}).withColumn("g", F.when(F.col("g") == "a", "a"))
    rows = df.select("g", F.col("value").alias("_value"), F.col("x").alias("_x"), F.col("i").cast("string").alias("_id"))
    wanted = {(r["g"], r["value"], k): r["w"] for k in range(3) for r in df.withColumn("w", newton.resampled_count(2, F.lit(k), F.col("i"))).collect()}
    fits = {}
    for size in (17, 10_000):
        monkeypatch.setattr(newton, "BLOCK_ROWS", size)
        blocks = newton._packed(rows, rows.groupBy("g").agg(F.count("*").alias("_n")), ["g"], 3, 2).collect()
        assert len(blocks) == (11 if size == 17 else 2)
        got = {}
        for b in blocks:
            counts = np.frombuffer(b["_counts"], dtype=np.uint8).reshape(-1, 2)
            for v, c in zip(np.frombuffer(b["_y"]), counts, strict=True):
                got |= {(b["g"], v, k): c[k // 2] >> 4 * (k % 2) & 15 for k in range(3)}
        assert got == wanted
        fits[size] = newton.fit_by_sums(df, ["g"], covariate="x", n_resamples=3, row=["i"], seed=2).orderBy("g", "k").collect()
    assert len(fits[17]) == 8
    for a, b in zip(*fits.values(), strict=True):
        assert a["n"] == b["n"]
        np.testing.assert_allclose(list(a)[3:], list(b)[3:], rtol=1e-4, atol=1e-4)


def test_sums_at_given_parameters(spark, monkeypatch):
    """Likelihoods, and slopes as differences have them, of the values that the parameters allow, in blocks of any size; groups without parameters have no row."""
    monkeypatch.setattr(newton, "BLOCK_ROWS", 37)
    x = np.linspace(0, 1, 300)
    samples = {"a": (draws(0.2, 5, 2, 300, 1), x), "b": (draws(-0.3, -10, 4, 300, 2, 3.0, 1.0, x), x), "gumbel": (draws(1e-9, 0, 1, 300, 3), x), "none": (draws(0.1, 0, 1, 9, 4), x[:9]), "nan": (draws(0.1, 0, 1, 9, 5), x[:9]), "above": (np.full(9, 99.0), x[:9])}
    df = frame(spark, samples).withColumn("g", F.when(F.col("g") != "b", F.col("g"))).union(frame(spark, {"a": ([math.nan, math.inf], [0.0, 0.0])}))
    given = {"a": (0.4, 5.0, 2.0), None: (-0.3, -10.0, 4.0), "gumbel": (0.0, 0.1, 1.1), "none": (None, 0.0, 1.0), "nan": (math.nan, 0.0, 1.0), "above": (0.5, 0.0, 1.0), "elsewhere": (0.1, 0.0, 1.0)}
    fits = spark.createDataFrame([(g, *p) for g, p in given.items()], "g string, c double, location double, scale double")
    got = {r["g"]: r for r in newton.sums_at(df, fits, ["g"]).collect()}
    assert set(got) == {"a", None, "gumbel"} and 200 < got["a"]["n"] < 300 == got[None]["n"]
    for g, p in [(g, np.array(given[g])) for g in got]:
        values = samples[g or "b"][0]
        values = values[p[0] * (values - p[1]) < 0.999 * p[2]] if g == "a" else values
        inner = spark.createDataFrame([(g, float(v)) for v in values], "g string, value double")
        r = newton.sums_at(inner, fits, ["g"]).first()
        assert r["n"] == len(values) and math.isclose(r["nllf"], gev_nll(p[None], values[None])[0], rel_tol=1e-9)
        slope = [(gev_nll((p + h)[None], values[None])[0] - gev_nll((p - h)[None], values[None])[0]) / 2e-6 for h in 1e-6 * np.eye(3)]
        np.testing.assert_allclose([r["by_c"], r["by_location"], r["by_scale"]], slope, rtol=1e-4, atol=1e-3)
    trends = spark.createDataFrame([(None, -0.3, -10.0, 3.0, 4.0, 1.0)], "g string, c double, location_0 double, location_1 double, scale_0 double, scale_1 double")
    r, y = newton.sums_at(df, trends, ["g"], covariate="x").first(), samples["b"][0]
    one = [gev_nll(np.array([[-0.3, -10 + 3 * v, 4 + v]]), np.array([[u]]))[0] for u, v in zip(y, x, strict=True)]
    assert r["n"] == 300 and math.isclose(r["nllf"], sum(one), rel_tol=1e-9) and {"by_location_1", "by_scale_1"} <= set(r.asDict())
