from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailcast.operators import bias, extremes, gevfit, independence, moments, resampling, reshape, selection, similarity, spatial, temporal


@pytest.fixture(scope="module")
def daily(spark):
    rows = [(date(2000, 1, 1) + timedelta(days=i), float(i)) for i in range(731)]
    return spark.createDataFrame(rows, "time date, value double").cache()


@pytest.fixture(scope="module")
def cube(spark):
    rng = np.random.default_rng(0)
    rows = [(date(2000 + m // 12, m % 12 + 1, 1), e, k, float(rng.uniform())) for m in range(24) for e in range(3) for k in range(12)]
    return reshape.lead_to_time(spark.createDataFrame(rows, "init_date date, ensemble int, lead_time int, value double")).cache()


def one(df):
    return [tuple(r) for r in df.orderBy(*df.columns).collect()]


@pytest.mark.parametrize("offset, stride, n", [(0, 1, 1), (10, 10, 10), (0, 37, 10), (10, 100, 400)])
def test_stack(spark, daily, offset, stride, n):
    times = [date(2000, 1, 1) + timedelta(days=i) for i in range(731)]
    starts = times[offset::stride]
    got = one(reshape.stack_by_init_date(daily, spark.createDataFrame([(t,) for t in starts], "init_date date"), n))
    want = [(t, k, t + timedelta(days=k), float((t - times[0]).days + k)) if t + timedelta(days=k) <= times[-1] else (t, k, None, None) for t in starts for k in range(n)]
    assert got == sorted(want, key=lambda r: r[:2])


def test_starts_outside_are_left_out(spark, daily):
    starts = spark.createDataFrame([(date(1999, 12, 31),), (date(2000, 5, 1),), (date(2002, 1, 1),)], "init_date date")
    assert {r["init_date"] for r in reshape.stack_by_init_date(daily, starts, 3).collect()} == {date(2000, 5, 1)}


def test_period_ends(spark):
    days = [(date(2001, m, 15),) for m in range(1, 13)]
    df = spark.createDataFrame(days, "t date")
    rows = df.select(*[temporal.period_end(F.col("t"), f).alias(f) for f in ("ME", "YE-JUN", "Q-NOV", "A-DEC")]).orderBy("ME").collect()
    assert [r["Q-NOV"].month for r in rows] == [2, 2, 5, 5, 5, 8, 8, 8, 11, 11, 11, 2]
    assert rows[-1]["Q-NOV"] == date(2002, 2, 28) and rows[6]["YE-JUN"] == date(2002, 6, 30) and rows[5]["YE-JUN"] == date(2001, 6, 30)
    assert {r["A-DEC"] for r in rows} == {date(2001, 12, 31)}
    with pytest.raises(ValueError):
        temporal.period_end(F.col("t"), "W")


def test_monthly_max_with_dates(daily):
    rows = temporal.event_dates(daily, "ME", "max").orderBy("time").collect()
    assert len(rows) == 24
    assert all(r["event_time"] == str(r["time"]) for r in rows)
    low = temporal.event_dates(daily, "ME", "min").orderBy("time").collect()
    assert all(r["event_time"].endswith("-01") for r in low)


def test_ties_take_the_first_day(spark):
    df = spark.createDataFrame([(date(1960, 1, d), v) for d, v in ((3, 5.0), (4, 7.0), (9, 7.0), (10, None))], "time date, value double")
    assert temporal.event_dates(df, "YE-DEC", "max").first()["event_time"] == "1960-01-04"


def test_bins(spark, daily):
    reset = temporal.temporal_aggregation(daily, "YE-DEC", "max", reset_times=True).collect()
    assert {r["time"] for r in reset} == {date(2000, 1, 1), date(2001, 1, 1)}
    assert temporal.temporal_aggregation(daily, "YE-JUN", "max", min_tsteps=360).count() == 1
    gap = daily.where(~F.month("time").isin(3))
    got = {r["time"]: r["value"] for r in temporal.temporal_aggregation(gap, "ME", "sum").collect()}
    assert got[date(2000, 3, 31)] == 0 and len(got) == 24
    got = {r["time"]: r["value"] for r in temporal.temporal_aggregation(gap, "ME", "mean").collect()}
    assert got[date(2000, 3, 31)] is None
    same = temporal.temporal_aggregation(daily, "ME", "mean", input_freq="M")
    assert same.count() == 731
    with pytest.raises(ValueError):
        temporal.temporal_aggregation(daily, "ME", "mode")


def test_weighted_year_counts_missing_months(spark):
    df = spark.createDataFrame([(date(2001, m, 1), 1.0 if m < 7 else None) for m in range(1, 13)], "time date, value double")
    got = temporal.temporal_aggregation(df, "YE-DEC", "mean", input_freq="M").first()["value"]
    assert got == pytest.approx(181 / 365)


def test_periods(daily):
    assert selection.select_time_period(daily, ["2000-06-01", "2001-06-01"]).count() == 366
    stamps = daily.withColumn("time", F.col("time").cast("timestamp_ntz") + F.expr("interval 6 hours"))
    assert selection.select_time_period(stamps, ["2000-06-01", "2000-06-03"]).count() == 3
    assert selection.select_time_period(stamps, ["2000-06-01", "2000-06-03"], auxiliary=True).count() == 2
    with pytest.raises(ValueError):
        selection.select_time_period(daily, ["June", "2001-01-01"])
    with pytest.raises(ValueError):
        selection.select_time_period(daily, ["2000-01-01", "2001-01-01"], time="when")


def test_selection(spark):
    g = spark.createDataFrame([(float(a), float(o), 1.0) for a in range(-90, 91, 30) for o in range(-180, 180, 30)], "lat double, lon double, value double")
    assert one(selection.select_point(g, -55, 50).select("lat", "lon")) == [(-60.0, 60.0)]
    assert one(selection.select_point(g, 70, -80).select("lat", "lon")) == [(60.0, -90.0)]
    assert one(selection.select_point(g, 15, 0).select("lat")) == [(30.0,)]
    assert {r["lon"] for r in selection.subset_lon(g, 60, 120).collect()} == {60, 90, 120}
    assert {r["lon"] for r in selection.subset_lon(g, 120, -120).collect()} == {120, 150, -180, -150, -120}
    with pytest.raises(ValueError):
        selection.subset_lat(g, -100, 0)
    assert {r["lat"] for r in selection.isel(g, "lat", -1).collect()} == {90}
    assert {r["lat"] for r in selection.isel(g, "lat", slice(1, 5, 2)).collect()} == {-60, 0}
    assert {r["lat"] for r in selection.sel(g, "lat", slice(-60, 0)).collect()} == {-60, -30, 0}
    assert selection.squeeze(g.where("lat = 0"), ["lat", "lon"]).columns == ["lon", "value"]


def test_masks(spark, cube):
    got = selection.mask_leads(cube, {1: 5}).where("month(init_date) = 1")
    assert got.where("value is not null").agg(F.min("lead_time")).first()[0] == 5
    assert selection.mask_leads(cube, 4).where("value is not null").count() == 24 * 3 * 8
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 3.0), (2, None)], "g int, value double")
    assert one(selection.drop_max(df, ["g"])) == [(1, None), (1, None), (1, 1.0), (2, None)]
    assert one(selection.drop_missing(df, "g").select("g").distinct()) == [(1,)]


GRID = [(float(-23.5 + i), float(119.5 + j), float(7 * i + j)) for i in range(4) for j in range(7)]
SHAPES = {
    "nw": (120, -21.75, 122, -20.25), "ne": (122, -21.75, 125, -20.25), "sw": (120, -23.25, 123, -21.75), "se": (123, -23.25, 125, -21.75),
}


@pytest.mark.parametrize("overlap, sums, means", [(None, (76, 129, 27, 23), (19.01172476, 21.51172476, 9, 11.5)), (0.5, (76, 129, 27, 23), (19.01172476, 21.51172476, 9, 11.5)), (0.1, (76, 129, 81, 69), (19.01172476, 21.51172476, 9.03373887, 11.53373887))])
def test_regions(spark, overlap, sums, means):
    g = spark.createDataFrame(GRID, "lat double, lon double, value double")
    shapes = spatial.shapes_table(spark, {k: spatial.ring_of_box(*map(float, b)) for k, b in SHAPES.items()})
    mask = spatial.overlap_mask(g, shapes, overlap) if overlap else spatial.centre_mask(g, shapes)
    got = {r["region"]: r["value"] for r in spatial.select_regions(g, mask, "sum", [], shapes=shapes).collect()}
    assert [got[k] for k in SHAPES] == list(sums)
    got = {r["region"]: r["value"] for r in spatial.select_regions(g, mask, "weighted_mean", [], combine=True).collect()}
    assert [got[k] for k in SHAPES] == pytest.approx(list(means), abs=1e-7) and "all" in got
    far = spatial.shapes_table(spark, {"far": spatial.ring_of_box(0.0, 0.0, 1.0, 1.0)})
    with pytest.raises(ValueError):
        spatial.select_regions(g, spatial.centre_mask(g, far), "sum", [], shapes=far)


def test_polygons(spark):
    triangle = spatial.shapes_table(spark, {"t": [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]})
    points = spark.createDataFrame([(float(a) + 0.5, float(o) + 0.5) for a in range(-2, 12) for o in range(-2, 12)], "lat double, lon double")
    got = {(r["lat"], r["lon"]) for r in spatial.centre_mask(points, triangle).collect()}
    assert got == {(a + 0.5, o + 0.5) for a in range(10) for o in range(10) if a + o + 1 < 10}
    near = {(r["lat"], r["lon"]) for r in spatial.buffered(points, triangle, 1.0).collect()}
    assert got < near and (-0.5, 5.5) in near and (-1.5, 5.5) not in near
    holed = triangle.union(spatial.shapes_table(spark, {"t": spatial.ring_of_box(1.0, 1.0, 3.0, 3.0)}))
    assert (1.5, 1.5) not in {(r["lat"], r["lon"]) for r in spatial.centre_mask(points, holed).collect()}


def test_regrid_keeps_a_constant_and_missing(spark):
    rows = [(float(a), float(o), 7.0) for a in range(0, 50, 10) for o in range(0, 50, 10)]
    g = spark.createDataFrame(rows, "lat double, lon double, value double")
    target = spark.createDataFrame([(float(a), float(o)) for a in (12, 25, 37) for o in (8, 22, 36)], "lat double, lon double")
    for method in spatial.WEIGHTS:
        got = spatial.regrid(g, target, method, []).collect()
        if method == "nearest_d2s":
            assert sum(r["value"] for r in got) == 7 * 25
        else:
            assert len(got) == 9 and all(r["value"] == pytest.approx(7) for r in got)
    holed = g.withColumn("value", F.when((F.col("lat") == 20) & (F.col("lon") == 20), None).otherwise(F.col("value")))
    assert any(r["value"] is None for r in spatial.regrid(holed, target, "bilinear", []).collect())


def test_named_grid(spark):
    g = spatial.create_grid(spark, "AUS100i")
    lo, hi = g.agg(F.min("lat"), F.min("lon")).first(), g.agg(F.max("lat"), F.max("lon")).first()
    assert tuple(lo) == (-44.0, 112.5) and tuple(hi) == (-11.0, 155.5)
    moved = spatial.create_grid(spark, "AUS300i", lat_offset=0.25)
    assert moved.agg(F.min("lat")).first()[0] == -42.75
    with pytest.raises(ValueError):
        spatial.create_grid(spark, "EUR100i")


def test_bias_is_removed(spark, cube):
    obs = spark.createDataFrame([(date(2000 + m // 12, m % 12 + 1, 1), 10.0 + m) for m in range(40)], "time date, value double")
    for method in bias.METHODS:
        found = bias.bias(cube, obs, method, rounding="M", by_lead=True)
        fixed = bias.remove_bias(cube, found, method)
        left = bias.bias(fixed, obs, method, rounding="M", by_lead=True)
        want = 0.0 if method == "additive" else 1.0
        assert left.count() == 12 * 12 and all(r["bias"] == pytest.approx(want, abs=1e-9) for r in left.collect())
    with pytest.raises(ValueError):
        bias.bias(cube, obs, "other")


def gev_draws(rng, c, loc, scale, n):
    return loc + scale * (1 - (-np.log(rng.uniform(size=n))) ** c) / c


@pytest.mark.parametrize("c, loc, scale", [(-0.3, 5.0, 2.0), (0.2, -4.0, 0.7), (0.45, 8.0, 9.0)])
def test_fits_recover(spark, c, loc, scale):
    rng = np.random.default_rng(0)
    rows = [(g, float(v), k) for g in ("a", "b") for k, v in enumerate(gev_draws(rng, c, loc, scale, 1500))]
    df = spark.createDataFrame(rows + [("c", 1.0, 0), ("c", 1.0, 1), ("d", None, 0)], "g string, value double, k int")
    got = {r["g"]: r for r in gevfit.fit_gev(df, ["g"], retry=True).collect()}
    for g in ("a", "b"):
        assert [got[g][p] for p in ("c", "location", "scale")] == pytest.approx([c, loc, scale], rel=0.3)
        assert got[g]["pvalue"] > 0.01
    assert got["c"]["c"] is None and got["d"]["n"] == 0
    fixed = gevfit.fit_gev(df.where("g = 'a'"), ["g"], fixed={"location": loc}).first()
    assert fixed["location"] == pytest.approx(loc, abs=1e-9)


def test_trends(spark):
    rng = np.random.default_rng(1)
    flat = gev_draws(rng, -0.1, 5.0, 1.5, 1200)
    rows = [("flat", float(v), k) for k, v in enumerate(flat)] + [("up", float(v + 3.0 * k / 1200), k) for k, v in enumerate(flat)]
    df = spark.createDataFrame(rows, "g string, value double, k int")
    got = {r["g"]: r for r in gevfit.fit_gev(df, ["g"], stationary=False, covariate="k", pick_best_model="lrt").collect()}
    assert got["up"]["location_1"] == pytest.approx(3 / 1200, rel=0.3)
    assert got["flat"]["location_1"] == 0 and got["flat"]["scale_1"] == 0
    for bad in ({"pick_best_model": "aic"}, {"stationary": False}, {"start": "other"}):
        with pytest.raises(ValueError):
            gevfit.fit_gev(df, ["g"], **bad)


def test_fit_interval(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("a", float(v)) for v in gev_draws(rng, -0.1, 5.0, 1.5, 300)], "g string, value double")
    for parametric in (False, True):
        rows = gevfit.fit_confidence(df, ["g"], n_resamples=60, parametric=parametric).collect()
        assert all(r["ci_lower"] < r["return_level"] < r["ci_upper"] for r in rows)
    r = gevfit.event_confidence(df, ["g"], 9.0, n_resamples=60, max_shape_ratio=6.0).first()
    assert 1 < r["ci_lower"] < r["return_period"] < r["ci_upper"]


def test_ks_statistic_by_hand(spark):
    f = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "value double")
    o = spark.createDataFrame([(2.5,), (4.0,)], "value double")
    assert similarity.ks_statistic(similarity.pooled(f, o)).first()["ks_statistic"] == pytest.approx(2 / 3)
    same = spark.createDataFrame([(1.0,)] * 5, "value double")
    assert similarity.anderson_darling_test(similarity.pooled(same, same)).first()["ad_statistic"] is None


def test_correlation_ways_agree(cube):
    keys = ["lead_time"]
    shaped = cube.withColumn("_e", F.lit(3)).withColumn("_i", F.lit(24)).withColumn("_n", F.lit(72))
    dense = {r["lead_time"]: r["r"] for r in independence._dense(shaped, keys, "ensemble", "init_date", "value").collect()}
    pairs = {r["lead_time"]: r["r"] for r in independence._by_pairs(shaped, keys, "ensemble", "init_date", "value").collect()}
    assert dense == pytest.approx(pairs)


def test_independent_draws_are_found(cube):
    r, bounds, least = independence.run_tests(cube.where("month(init_date) = 1").withColumn("init_date", F.col("init_date")), n_resamples=10)
    assert r.count() == 12 and bounds.count() == 1 and least.count() == 1


def test_min_lead_rule(spark):
    r = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.4), (1, 2, 0.8), (2, 0, 0.9), (2, 1, 0.95), (3, 0, None)], "init_month int, lead_time int, r double")
    b = spark.createDataFrame([(k, -0.5, 0.5) for k in (1, 2, 3)], "init_month int, ci_lower double, ci_upper double")
    assert one(independence.min_independent_lead(r, b)) == [(1, 1), (2, 0), (3, 0)]


def test_draws_do_not_depend_on_partitions(daily):
    a = resampling.resample(daily, [], ["time"], 3, size=50, block=5)
    b = resampling.resample(daily.repartition(7), [], ["time"], 3, size=50, block=5)
    assert one(a) == one(b) and a.count() == 150
    runs = a.where("k = 0").orderBy("pos").collect()
    assert all(runs[i + 1]["value"] - runs[i]["value"] == 1 for i in range(49) if (i + 1) % 5)


def test_joint_draws_over_dims(cube):
    got = resampling.resample_dims(cube, {"init_date": (6, 3), "ensemble": (3, 1)}, 4)
    assert got.groupBy("k").count().select("count").distinct().collect()[0][0] == 6 * 3 * 12


def test_permutation_is_one(daily):
    rows = resampling.permutation(daily, [], ["time"], 2).where("k = 1").collect()
    assert sorted(r["pos"] for r in rows) == list(range(731)) and [r["value"] for r in sorted(rows, key=lambda r: r["pos"])] != sorted(r["value"] for r in rows)


def test_independence_reads_its_source_once(spark):
    """Each test read the cube anew, with all that it is made of."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rng = np.random.default_rng(3)
    rows = [(date(1990 + i, 1, 1), e, lead, float(v)) for i in range(6) for e in range(3) for lead, v in enumerate(rng.normal(size=2))]
    df = spark.createDataFrame(rows, "init_date date, ensemble int, lead_time int, value double")
    r, bounds, least = independence.run_tests(df.mapInPandas(counted, df.schema), n_resamples=5)
    assert r.count() == 2 and bounds.count() == 1 and least.count() == 1
    assert read.value == len(rows)


def test_leads_are_numbered_by_ranges(spark):
    """No task holds a group: with all rows in one group, equal times too, the rows to be numbered are dealt out evenly."""
    df = spark.range(4000).select((F.col("id") % 2).cast("int").alias("e"), F.when(F.col("id") < 2000, F.lit(7)).otherwise(F.col("id")).cast("timestamp").alias("time"), "id").unionByName(spark.sql("select cast(null as int) e, timestamp'2000-01-01' time, 9999L id"))
    out = reshape.to_init_lead(df, by=["e"])
    rows = out.orderBy("e", "lead_time").collect()
    for e, n in ((0, 2000), (1, 2000), (None, 1)):
        own = [r for r in rows if r["e"] == e]
        assert [r["lead_time"] for r in own] == list(range(n)) and [r["time"] for r in own] == sorted(r["time"] for r in own)
        assert {r["init_date"] for r in own} == {min(r["time"] for r in own).date()}
    files = out.inputFiles()
    sizes = [r["count"] for r in spark.read.parquet(*files).groupBy("_slot").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 4001 / 4


def test_intervals(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("g", float(v)) for v in rng.normal(size=200)], "g string, value double")
    for method in ("percentile", "bca"):
        r = resampling.statistic_interval(df, ["g"], lambda v: float(v.mean()), n_resamples=300, method=method).first()
        assert r["ci_lower"] < r["statistic"] < r["ci_upper"]
    bounds = moments.moments_interval(df.withColumn("i", F.monotonically_increasing_id()), [], ["i"], 200, 50, gev=True)
    out = moments.compared(moments.moments(df, gev="lmoments"), bounds).collect()
    assert len(out) == 7 and all(r["consistent"] for r in out)


def test_empirical(spark):
    df = spark.createDataFrame([(float(k),) for k in range(1, 101)] + [(None,)], "value double")
    assert extremes.empirical_return_period(df, 90.0).first()[0] == 10
    assert extremes.empirical_return_period(df, 100.0).first()[0] is None
    levels = dict(one(extremes.empirical_return_level(df, [1.0001, 2, 10, 1e6])))
    assert levels[2] == 50 and levels[10] == 90 and levels[1e6] == pytest.approx(99.9999) and levels[1.0001] == 1
    r = extremes.event_in_context(df, 95, "above").first()
    assert (r["n_events"], r["n_population"], r["return_period"], r["percentile"]) == (5, 100, 20, 94)
    curve = one(extremes.empirical_return_curve(df))
    assert curve[0] == (1.0, 1.0) and curve[-1] == (100.0, 100.0)


def test_plans(spark):
    """Columns are pruned, ranges reach the scan, small tables are broadcast."""
    from tailcast.plans.views import table

    sf = "/root/testdata/sf0.001"
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderdate", "time")
    plan = selection.select_time_period(orders.select("time", "o_totalprice"), ["1996-01-01", "1996-12-31"])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_numbering_without_a_window_over_all(spark):
    from tailcast.operators.resampling import numbered

    rows = [(g, d, e) for g in ("a", None) for d in (3, 1, 1, None, 2) for e in (2, 1)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, d int, e int, i int").repartition(3)
    for by in ([], ["g"]):
        got = numbered(df, by, ["d", "e", "i"]).collect()
        groups = {}
        for r in got:
            groups.setdefault(r["g"] if by else 0, []).append(r)
        for own in groups.values():
            own.sort(key=lambda r: (r["d"] is not None, r["d"] or 0, r["e"], r["i"]))
            assert [r["idx"] for r in own] == list(range(len(own))) and {r["n"] for r in own} == {len(own)}
    assert numbered(df.limit(0), [], ["d", "e"]).count() == 0


def test_ranks_in_slices(spark):
    from tailcast.functions.gev import ranked

    values = [1e9, *[float(v % 7) for v in range(60)], None, -5.5]
    df = spark.createDataFrame([(g, v) for g in ("a", "b", None) for v in values] + [("one", 2.0)], "g string, v double")
    for by in (["g"], []):
        for r in ranked(df, "v", by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_j", "_x"))).alias("all"), F.max("_n").alias("n")).collect():
            assert [x["_j"] for x in r["all"]] == list(range(1, r["n"] + 1))
            assert [x["_x"] for x in r["all"]] == sorted(x["_x"] for x in r["all"])


def test_starts_bounds_and_checks_of_given_parameters(spark):
    rng = np.random.default_rng(3)
    x = 4 + 2 * (1 - (-np.log(rng.random(800))) ** 0.15) / 0.15
    year = np.arange(800) / 100
    df = spark.createDataFrame([("a", float(v), float(t)) for v, t in zip(x, year, strict=True)], "g string, value double, year double")
    ends = {}
    for start in gevfit.STARTS:
        r = gevfit.fit_gev(df, ["g"], start=start).first()
        ends[start] = r["nllf"]
        assert abs(r["location"] - 4) < 0.4 and abs(r["scale"] - 2) < 0.4, start
    assert max(ends.values()) - min(ends.values()) < 0.5
    held = gevfit.fit_gev(df, ["g"], bounds={"c": (-0.05, 0.05), "scale": (0.1, 1.5)}).first()
    assert -0.05 <= held["c"] <= 0.05 and held["scale"] <= 1.5 + 1e-9
    sloped = gevfit.fit_gev(df.withColumn("value", F.col("value") + 3 * F.col("year")), ["g"], stationary=False, covariate="year", loc1=2.5, scale1=0.0).first()
    assert abs(sloped["location_1"] - 3) < 0.3
    fitted = gevfit.fit_gev(df, ["g"])
    for test in ("ks", "cvm"):
        own = gevfit.fit_gev(df, ["g"], test=test).first()["pvalue"]
        assert gevfit.check_gev_fit(df, fitted, ["g"], test=test).first()["pvalue"] == pytest.approx(own, abs=1e-9)
    five = spark.createDataFrame([("a", 0.15, 4.0, 0.0, 2.0, 0.0)], "g string, c double, location_0 double, location_1 double, scale_0 double, scale_1 double")
    assert gevfit.check_gev_fit(df, five, ["g"], covariate="year").first()["pvalue"] > 0.01
    off = five.withColumn("location_0", F.lit(6.0))
    assert gevfit.check_gev_fit(df, off, ["g"], covariate="year").first()["pvalue"] < 1e-6
    nll = spark.createDataFrame([("a", 50, 100.0, 96.0), ("b", 50, 100.0, 99.5)], "g string, n long, nllf_stationary double, nllf_trend double")
    for test in gevfit.TESTS:
        got = {r["g"]: r["prefers_trend"] for r in gevfit.check_gev_relative_fit(nll, ["g"], test).collect()}
        assert got == {g: gevfit.prefers_trend(test, 100.0, e, 50, 2, 0.05) for g, e in (("a", 96.0), ("b", 99.5))}


def test_plot_tables(spark):
    from tailcast.plans import plotdata

    tests = spark.createDataFrame([(1.0, 2.0, 0.5, 0.01, 3.0, 0.2)], "lat double, lon double, ks_statistic double, ks_pvalue double, ad_statistic double, ad_pvalue double")
    assert {tuple(r) for r in plotdata.similarity_map(tests).collect()} == {(1.0, 2.0, "ks", 0.5, 0.01, True), (1.0, 2.0, "ad", 3.0, 0.2, False)}
    periods = plotdata.curve_periods(5)
    assert periods == pytest.approx([1, 10, 100, 1000, 10_000]) and len(plotdata.curve_periods()) == 10_000
    made = spark.createDataFrame([("mean", float(k)) for k in range(10)] + [("std", 1.0)], "moment string, value double")
    seen = spark.createDataFrame([("mean", 3.5)], "moment string, obs double")
    rows = plotdata.moment_densities(made, seen, 5).collect()
    assert sum(r["n"] for r in rows if r["moment"] == "mean") == 10 and len(rows) == 6
    assert {r["obs"] for r in rows if r["moment"] == "mean"} == {3.5}


def test_cross_correlation_pairs(spark):
    """As many pairs as members of both in order, each by the starts that both have."""
    from tailcast.operators import independence

    rows = [(m, i, float((m * 7 + i * 3) % 11)) for m in (1, 2, 5) for i in range(9)]
    other = [(m, i, -v) for m, i, v in rows if (m, i) != (2, 4)]
    spec = "ensemble int, init_date int, value double"
    got = independence.cross_correlation(spark.createDataFrame(rows, spec), spark.createDataFrame(other, spec), []).first()["r"]
    own, rest = {(m, i): v for m, i, v in rows}, {(m, i): v for m, i, v in other}

    def rank(v):
        return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]

    pairs = [(a, b) for a in (1, 2, 5) for b in (1, 2, 5) if a <= b]
    r = [np.corrcoef(*(rank([t[m, i] for i in range(9) if (b, i) in rest]) for t, m in ((own, a), (rest, b))))[0, 1] for a, b in pairs]
    assert got == pytest.approx(np.mean(r))


def test_ranges_hold_outliers_and_ties(spark):
    """One far outlier, half zeros and a heavy tail: values are dealt evenly, whatever their spread, and ties are one row."""
    from tailcast.functions.gev import distinct_ranks, fit_lmoments

    rng = np.random.default_rng(0)
    tail = 1 / rng.random(4000) ** 3
    values = np.concatenate([np.zeros(4000), tail, [1e30]])
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    rows = distinct_ranks(df, "v", ["g"]).orderBy("_x").collect()
    assert len(rows) == 4002 and rows[0]["_m"] == 4000 and rows[-1]["_before"] == 8000 and rows[0]["_n"] == 8001
    assert [r["_before"] for r in rows[1:]] == list(range(4000, 8001))
    dealt = spark.read.parquet(*{f.rpartition("/")[0] for f in distinct_ranks(df, "v", ["g"]).inputFiles()})
    sizes = [r["count"] for r in dealt.groupBy("_slot").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 2 * 4002 / len(sizes)
    tied = np.concatenate([rng.gumbel(size=500), np.full(300, 0.25)])
    want = gevfit.start_of(tied[None], "LMM")[0]
    r = fit_lmoments(spark.createDataFrame([("t", float(v)) for v in tied], "g string, v double"), "v", ["g"]).first()
    np.testing.assert_allclose([r["c"], r["location"], r["scale"]], want, rtol=1e-9)


def test_draws_without_replacement_are_the_first_of_an_order(spark):
    """The same rows as of whole orders, and few more than are wanted pass."""
    rows = [(g, i, float(i)) for g, n in (("a", 3000), ("b", 40), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, value double").withColumn("size", F.when(F.col("g") == "a", 60).otherwise(25))
    whole = resampling.permutation(df, ["g"], ["i"], 20, seed=2).where("pos < size").select("g", "k", "pos", "i")
    part = resampling.drawn_first(df, ["g"], ["i"], "size", 20, seed=2).select("g", "k", "pos", "i")
    assert part.count() == whole.count() == 20 * (60 + 25 + 1) and part.exceptAll(whole).count() == 0


def test_buffers_on_the_projection(spark):
    """At 40 degrees south against a brute force in metres; coarser outlines; holes and poles of the simplifying."""
    import math

    e = spatial.ECCENTRICITY
    up = lambda lat: spatial.AXIS * (math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) + e / 2 * math.log((1 - e * math.sin(math.radians(lat))) / (1 + e * math.sin(math.radians(lat)))))
    across = lambda lon: spatial.AXIS * math.radians(lon)
    ring = [(140.0, -42.0), (144.0, -41.0), (146.0, -38.0), (141.0, -38.5)]
    shapes = spatial.shapes_table(spark, {"s": ring})
    points = [(-45 + 0.25 * a, 136 + 0.25 * o) for a in range(40) for o in range(60)]
    cells = spark.createDataFrame(points, "lat double, lon double")
    corners = [(across(lon), up(lat)) for lon, lat in ring]

    def away(x, y):
        best = []
        for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
            dx, dy = x2 - x1, y2 - y1
            t = min(1, max(0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
            best.append(math.hypot(x - x1 - t * dx, y - y1 - t * dy))
        inside = sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1) for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True)) % 2
        return 0.0 if inside else min(best)

    got = {(r["lat"], r["lon"]) for r in spatial.projected_buffer(cells, shapes, 1.0).collect()}
    want = {(lat, lon) for lat, lon in points if away(across(lon), up(lat)) <= spatial.DEGREE}
    assert got == want and got != {(r["lat"], r["lon"]) for r in spatial.buffered(cells, shapes, 1.0).collect()}
    south, west = spatial.ring_of_box(140.0, -40.0, 142.0, -38.0), spark.createDataFrame([(-40.75, 141.0), (-40.85, 141.0), (-39.0, 139.05), (-39.0, 138.95)], "lat double, lon double")
    near = spatial.projected_buffer(west, spatial.shapes_table(spark, {"b": south}), 1.0)
    assert {(r["lat"], r["lon"]) for r in near.collect()} == {(-40.75, 141.0), (-39.0, 139.05)}
    notched = [(0, 0), (5, 0.001), (10, 0), (10, 10), (5, 9.999), (0, 10), (0, 0)]
    assert spatial.simplified(notched, 0.01) == [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    assert spatial.simplified([(0, 0), (1e-3, 0), (1e-3, 1e-3), (0, 0)], 0.01) == [(0, 0), (1e-3, 0), (1e-3, 1e-3), (0, 0)]


def test_corrected_intervals_by_columns(spark):
    """As by leaving each value out in turn, for odd and even numbers, ties and tiny groups."""
    from tailcast.functions.statistics import bca_interval

    rng = np.random.default_rng(1)
    groups = {"odd": rng.gumbel(size=41), "even": rng.exponential(size=60), "ties": rng.integers(0, 4, 30).astype(float), "two": np.array([1.0, 3.0]), "one": np.array([2.0]), "flat": np.full(12, 7.0)}
    df = spark.createDataFrame([(g, i, float(v)) for g, x in groups.items() for i, v in enumerate(x)] + [("one", 9, None)], "g string, i int, value double")
    kinds = {"mean": np.mean, "std": np.std, 0.5: np.median, 0.9: lambda x: np.quantile(x, 0.9), 0.0: np.min}
    for kind, f in kinds.items():
        drawn = {}
        for r in resampling.resample(df.where("value is not null"), ["g"], ["i", "value"], 200, seed=0).groupBy("g", "k").agg(F.collect_list("value").alias("v")).collect():
            drawn.setdefault(r["g"], []).append(f(np.array(r["v"])))
        got = {r["g"]: r for r in resampling.bca_interval_by_columns(df, ["g"], kind, ["i"], n_resamples=200).collect()}
        assert set(got) == set(groups)
        for g, x in groups.items():
            r = got[g]
            assert r["statistic"] == pytest.approx(f(x))
            if len(x) == 1:
                assert r["ci_lower"] is None
            elif np.ptp(x) == 0:
                assert r["ci_lower"] == r["ci_upper"] == pytest.approx(f(x))
            else:
                left = np.array([f(np.delete(x, i)) for i in range(len(x))])
                d = left.mean() - left
                a = (d**3).sum() / (6 * (d**2).sum() ** 1.5) if (d**2).sum() > 1e-20 else 0.0
                assert r["acceleration"] == pytest.approx(a, abs=1e-6), (kind, g)
                if g in ("odd", "even"):
                    lo, hi = bca_interval(x, f, np.array(drawn[g]), 0.95)
                    assert (r["ci_lower"], r["ci_upper"]) == (pytest.approx(lo, abs=1e-6), pytest.approx(hi, abs=1e-6)), (kind, g)
    with pytest.raises(ValueError):
        resampling.bca_interval_by_columns(df, ["g"], "mode", ["i"])


def test_intervals_of_quantiles_by_rank(spark, monkeypatch):
    """As by drawing whole samples and leaving each value out; many more values cost no more draws; odd groups stay."""
    rng = np.random.default_rng(2)
    groups = {"odd": rng.gumbel(size=41), "even": rng.exponential(size=60), "ties": rng.integers(0, 4, 50).astype(float), None: rng.normal(size=80), "flat": np.full(12, 7.0), "one": np.array([2.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("one", None), ("odd", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    for cells, q, size in ((1_000_000, 0.5, None), (5, 0.6, 41)):
        monkeypatch.setattr(resampling, "_CELLS", cells)
        got = {r["g"]: r for r in resampling.quantile_interval(df, ["g"], q, sample_size=size, n_resamples=4000).collect()}
        whole = {r["g"]: r for r in resampling.statistic_interval(df.where("g is null or g not in ('one', 'none')"), ["g"], lambda v: float(np.quantile(v, q)), sample_size=size, n_resamples=4000, method="bca").collect()}
        assert set(got) == {*groups, "none"} and len(whole) == 5
        for g, r in whole.items():
            assert got[g]["statistic"] == pytest.approx(r["statistic"])
            near = 0.15 * max(np.ptp(groups[g]), 1e-9) if g != "flat" else 1e-9
            assert got[g]["ci_lower"] == pytest.approx(r["ci_lower"], abs=near) and got[g]["ci_upper"] == pytest.approx(r["ci_upper"], abs=near)
        assert got["one"]["statistic"] == 2.0 and got["one"]["ci_lower"] is None and got["none"]["statistic"] is None
    many = spark.range(2_000_000).select(F.lit("a").alias("g"), (F.col("id") % 1000).cast("double").alias("value"))
    r = resampling.quantile_interval(many, ["g"], 0.5, n_resamples=999).first()
    # the median's deviation is half the root of 2,000,000, in places of 2,000 to a value
    assert r["statistic"] == 499.5 and 498.0 <= r["ci_lower"] <= r["ci_upper"] <= 501.0


def test_functions_of_tables_drawn_together(spark):
    """Tables that share a dim are read at the same labels; one at a time or bundled; a table without the dims whole."""
    import pandas as pd

    a = spark.createDataFrame([(i, e, float(10 * i + e)) for i in range(6) for e in range(3)], "start int, member int, value double")
    b = spark.createDataFrame([(i, float(10 * i)) for i in range(6)], "start int, seen double")
    c = spark.createDataFrame([(7.0,)], "scale double")
    dims = {"start": (4, 2), "member": (3, 1)}

    def gap(a, b, c):
        both = a.merge(b, on=["start_pos", "start"])
        return pd.DataFrame({"n": [len(both)], "least": [(both["value"] - both["seen"]).min()], "scale": [c["scale"].sum()]})

    rows = resampling.resample_tables({"a": a, "b": b, "c": c}, dims, 5, gap, "n long, least double, scale double", bundled=True).collect()
    assert len(rows) == 5 and all(r["n"] == 12 and 0 <= r["least"] < 3 and r["scale"] == 7 for r in rows)
    one = resampling.resample_tables({"a": a, "b": b}, dims, 5, lambda t: pd.DataFrame({"n": [len(t)]}), "n long").collect()
    assert sorted((r["table"], r["n"]) for r in one) == [("a", 12)] * 5 + [("b", 4)] * 5
    joint = {r["k"]: r for r in resampling.resample_dims(a, dims, 5).groupBy("k").agg(F.sum("value").alias("v")).collect()}
    summed = resampling.resample_tables({"a": a}, dims, 5, lambda t: pd.DataFrame({"v": [t["value"].sum()]}), "v double").collect()
    assert {r["k"]: r["v"] for r in summed} == {k: r["v"] for k, r in joint.items()}


def test_tests_by_lead_count_observations_once(spark):
    """As each lead's own test; observations are counted before they meet the leads, ties and nulls in either."""
    from tailcast.operators import similarity as sim

    model = spark.createDataFrame([(p, k, float((i * (k + 3) + p) % 7) if i else None) for p in (0, 1) for k in range(3) for i in range(20)], "lat int, lead_time int, value double")
    seen = spark.createDataFrame([(p, float(i % 6) if i else None) for p in (0, 1) for i in range(30)], "lat int, value double")
    got = {(r["lat"], r["lead_time"]): tuple(r)[2:] for r in sim.similarity_tests(model, seen, ["lat"], by_lead=True).collect()}
    assert len(got) == 6
    for k in range(3):
        for r in sim.similarity_tests(model.where(F.col("lead_time") == k).drop("lead_time"), seen, ["lat"]).collect():
            assert got[r["lat"], k] == pytest.approx(tuple(r)[1:])
    both = sim.similarity_tests(model.drop("lat"), seen.drop("lat"), by_lead=True)
    assert both.count() == 3 and both.where("ks_pvalue is null").count() == 0
