import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailcast.functions import dates, gev, indices, statistics, units


def test_units(spark):
    df = spark.createDataFrame([(300.0,)], "v double")
    v = F.col("v")
    row = df.select(units.convert_units(v, "K", "degC"), units.convert_units(v, "kg m-2 s-1", "mm day-1"), units.convert_units(v, "m/s", "km/h")).first()
    assert row[0] == pytest.approx(26.85) and row[1] == 300 * 86400 and row[2] == pytest.approx(1080)
    with pytest.raises(ValueError):
        units.convert_units(v, "K", "m")
    assert units.rate_after_sum("mm day-1", "D", "ME") == "mm month-1"
    assert units.rate_after_sum("mm d-1", "D", "YE-DEC") == "mm yr-1"
    assert units.rate_after_sum("mm", "D", "A-DEC") == "mm"


def test_gev_columns(spark):
    rows = [(x, c, 2.0, 1.5) for x in (-30.0, 0.0, 2.5, 60.0) for c in (-0.3, 0.0, 0.25)]
    df = spark.createDataFrame(rows, "x double, c double, l double, s double")
    x, p = F.col("x"), [F.col(k) for k in "cls"]
    for r in df.select("*", gev.cdf(x, *p).alias("cdf"), gev.sf(x, *p).alias("sf"), gev.pdf(x, *p).alias("pdf"), gev.nllf(x, *p).alias("nll"), gev.return_period(x, *p).alias("t")).collect():
        z = (r["x"] - 2) / 1.5
        inner = 1 - r["c"] * z
        if r["c"] and inner <= 0:
            want = 1.0 if r["c"] > 0 else 0.0
            assert r["nll"] is None and r["pdf"] == 0
        else:
            t = math.exp(-z) if not r["c"] else inner ** (1 / r["c"])
            want = math.exp(-t)
            assert r["nll"] == pytest.approx(math.log(1.5) - (1 - r["c"]) * math.log(t) + t)
        assert r["cdf"] == pytest.approx(want, abs=1e-12) and r["sf"] == pytest.approx(1 - want, abs=1e-12)
        assert r["t"] > 1e15 if want == 1 else r["t"] == pytest.approx(1 / (1 - want))
    back = df.where("x = 2.5").select(gev.isf(gev.sf(x, *p), *p).alias("x")).collect()
    assert all(r["x"] == pytest.approx(2.5) for r in back)
    ends = [r[0] for r in df.where("x = 0").select(gev.isf(F.lit(1.0), *p)).collect()]
    assert ends == [2 - 1.5 / 0.3, -math.inf, -math.inf]


def test_gamma(spark):
    df = spark.createDataFrame([(x,) for x in (-0.9, -0.4, 0.0, 0.3, 2.5)], "x double")
    for r in df.select("x", gev.gamma_of_one_plus(F.col("x")).alias("g")).collect():
        assert r["g"] == pytest.approx(math.gamma(1 + r["x"]), rel=1e-12)



def test_drought_and_fire(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "t int, pr double")
    rows = indices.drought_factor(df, "pr", [], "t").orderBy("t").collect()
    sums = [sum(k % 7 for k in range(i - 19, i + 1)) for i in range(19, 60)]
    assert all(r["drought_factor"] is None for r in rows[:19])
    for r, s in zip(rows[19:], sums, strict=True):
        assert r["drought_factor"] == pytest.approx(10 - 10 * (s - min(sums)) / (max(sums) - min(sums)))
    value = spark.range(1).select(indices.ffdi(F.lit(8.0), F.lit(30.0), F.lit(20.0), F.lit(40.0))).first()[0]
    assert value == pytest.approx(8**0.987 * math.exp(0.0338 * 30 - 0.0345 * 20 + 0.0234 * 40) + 0.243147)


def test_published_p_values():
    assert statistics.ks_two_sample_p(0.07429516, 123, 5900) == pytest.approx(0.49535686, abs=1e-6)
    assert statistics.ks_two_sample_p(0.2797175, 123, 5900) == pytest.approx(7.914835e-09, rel=1e-3)
    assert statistics.anderson_darling_p(29.255798) == pytest.approx(0.001)
    assert statistics.anderson_darling_p(-0.158) == pytest.approx(0.25)


def test_one_sample_tails():
    assert statistics.kolmogorov_sf(1.3581) == pytest.approx(0.05, abs=1e-4)
    assert statistics.cramer_von_mises_p(0.46136) == pytest.approx(0.05, abs=2e-3)
    assert statistics.cramer_von_mises_p(0.34730) == pytest.approx(0.10, abs=2e-3)


def test_minimise_many():
    goals = np.array([[1.0, -2.0], [5.0, 3.0], [0.0, 0.0]])
    x, v = statistics.minimise(lambda t, at: ((t - goals[at]) ** 2).sum(1), np.ones((3, 2)), np.full((3, 2), 0.5), tolerance=1e-12)
    np.testing.assert_allclose(x, goals, atol=1e-3)
    assert (v < 1e-6).all()


def test_ad_statistic_is_standard_under_the_null(spark):
    from tailcast.operators import similarity

    rng = np.random.default_rng(0)
    f = [(k, float(v)) for k in range(200) for v in rng.normal(size=40)]
    o = [(k, float(v)) for k in range(200) for v in rng.normal(size=60)]
    both = similarity.pooled(spark.createDataFrame(f, "g int, value double"), spark.createDataFrame(o, "g int, value double"), ["g"])
    a = np.array([r["ad_statistic"] for r in similarity.anderson_darling_test(both, ["g"]).collect()])
    assert abs(a.mean()) < 0.25 and 0.7 < a.std() < 1.3


def test_dates(spark):
    df = spark.createDataFrame([("2001-2-3", 2001, 2, 3), ("1999-12-31T06", 1999, 12, 31), ("2001-02-30", 2001, 2, 30)], "t string, y int, m int, d int")
    y, m, d = F.col("y"), F.col("m"), F.col("d")
    rows = df.select(dates.to_text(dates.from_text(F.col("t"))), dates.switch_calendar(y, m, d), dates.ordinal(y, m, d, "360_day"), dates.ordinal(y, m, d, "noleap")).collect()
    assert [r[0] for r in rows] == ["2001-02-03", "1999-12-31", None]
    assert rows[2][1] is None and rows[0][1].isoformat() == "2001-02-03"
    assert [r[2] for r in rows] == [31 * 360 + 32, 29 * 360 + 360, 31 * 360 + 59]
    assert rows[1][3] == 30 * 365 - 1
    with pytest.raises(ValueError):
        dates.ordinal(y, m, d, "other")
    row = df.limit(1).select(dates.covariate(F.lit("2001-02-03").cast("date")), dates.covariate(F.lit("1970-01-11").cast("date"), "days")).first()
    assert tuple(row) == (2001, 10.0)


def test_fire_danger(spark):
    df = spark.createDataFrame([(i, float(i % 7), 30.0, 20.0, 3.0, 4.0) for i in range(30)], "time int, pr double, tasmax double, hur double, uas double, vas double")
    rows = indices.fire_danger(df).orderBy("time").collect()
    assert rows[0]["ffdi"] is None and rows[29]["wsp"] == 5 and rows[29]["ffdi"] > 0.24
