"""What plots draw, p-values, and files of arrays."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.functions import gev
from tailcast.functions.statistics import AD_CRITICAL, AD_LEVELS
from tailcast.operators import extremes, gevfit
from tailcast.operators import independence as ind
from tailcast.operators import moments as m
from tailcast.operators import similarity as sim
from tailcast.operators.selection import squeeze
from tailcast.plans import plotdata
from tailcast.plans.views import FCST, GRID, OBS, SAMPLE, fcst, grid, obs, sample, table
from tailcast.queries import query
from tailcast.queries.extremes import LMM, OUTSIDE
from tailcast.queries.models import BOUNDS, DETREND, RESAMPLES, TWO, _central, _hash, _spearman, _two
from tailcast.queries.selection import r6
from tailcast.sources import files
from tailcast.sources.dataset import OpenSpec, open_dataset
from tailcast.tables import shared_dir


@query(f"""with {OBS}, y as (select year(time)::integer as year, value from obs), q as (select year, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from y group by 1)
    select year, round(min(value) filter (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 4) as low, round(any_value(q1), 4) as q1, round(any_value(median), 4) as median, round(any_value(q3), 4) as q3,
        round(max(value) filter (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 4) as high from y join q using (year) group by 1""")
def timeseries_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes and whiskers by year."""
    made = plotdata.timeseries_boxes(obs(spark, d))
    return made.select("year", *[F.round(c, 4).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query(f"with {FCST} select year(time)::integer as year, value from fcst where value is not null")
def timeseries_points(spark: SparkSession, d: str) -> DataFrame:
    """All values by year."""
    return plotdata.timeseries_points(fcst(spark, d))


REPLICATES, SIZE, BINS = 200, 200, 20


@query(f"""with {SAMPLE}, rows as (select value, row_number() over (order by event_id) - 1 as idx, count(*) over () as n from sample), n as (select max(n) as n from rows),
    draws as (select k, {_hash(0, "k", "pos")} % n as idx from n, (select unnest(range(0, {REPLICATES})) as k), (select unnest(range(0, {SIZE})) as pos)), drawn as (select k, value from draws join rows using (idx)),
    each as ({_central('drawn', 'k', 14)}), long as (unpivot (select mean, std, skew, kurtosis from each) on mean, std, skew, kurtosis into name moment value v),
    ends as (select moment, min(v) as lo, (max(v) - min(v)) / {BINS} as w from long group by 1), own as (unpivot (select 'all' as g, * exclude (g) from ({_central("(select 'all' as g, value from sample)", 'g', 14)})) on mean, std, skew, kurtosis into name moment value obs)
    select moment, cast(least(floor((v - lo) / w), {BINS - 1}) as integer) as bin, count(*) as n, round(any_value(obs), 6) as obs from long join ends using (moment) join own using (moment) group by 1, 2""")
def moment_densities(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of moments of samples drawn from all, with those of all."""
    found = m.moment_replicates(sample(spark, d), [], ["event_id"], SIZE, REPLICATES)
    own = m.moments(sample(spark, d)).unpivot([], ["mean", "std", "skew", "kurtosis"], "moment", "obs")
    return r6(plotdata.moment_densities(found, own, BINS).select("moment", "bin", "n", "obs"), "obs")


@query(f"""with {DETREND}, {_spearman('flat', 'init_month, lead_time')}, {BOUNDS}
    select cast(init_month as integer) as init_month, lead_time, round(r, 6) + 0 as r, round(lo, 6) as ci_lower, round(hi, 6) as ci_upper from mean_r join bounds using (init_month)""")
def independence_points(spark: SparkSession, d: str) -> DataFrame:
    """Correlations by lead, and the band about none."""
    r, bounds, _ = ind.run_tests(fcst(spark, d), n_resamples=RESAMPLES)
    return r6(plotdata.independence_points(r, bounds))


# The standard deviation of the statistic of two samples, as Scholz and Stephens (1987) write it.
SIGMA = """sizes as (select {k}, max(nf) as n1, max(nobs) as n2, max(nf) + max(nobs) as n from cum group by 1), hs as (select n, (select sum(1.0 / i) from range(1, n::bigint) t(i)) as h,
        (select sum(tail / (n - i)) from (select i, sum(1.0 / (i + 1)) over (order by i rows between current row and unbounded following) as tail from range(1, (n - 1)::bigint) t(i))) as g from (select distinct n from sizes)),
    four as (select {k}, n, (4 * g - 6) + (10 - 6 * g) * bh as a, (2 * g - 4) * 4 + 8 * h * 2 + (2 * g - 14 * h - 4) * bh - 8 * h + 4 * g - 6 as b, (6 * h + 2 * g - 2) * 4 + (4 * h - 4 * g + 6) * 2 + (2 * h - 6) * bh + 4 * h as c, (2 * h + 6) * 4 - 8 * h as d
        from (select *, 1.0 / n1 + 1.0 / n2 as bh from sizes join hs using (n))),
    sigma as (select {k}, sqrt((a * pow(n, 3) + b * pow(n, 2) + c * n + d) / ((n - 1.0) * (n - 2.0) * (n - 3.0))) as sigma from four)"""
RAW = """parts as (select *, f + o as l, nf + nobs as n, cf + co - (f + o) / 2 as b from cum),
    p as (select {k}, n, nf, nobs, l / n * pow(n * (cf - f / 2) - b * nf, 2) / nullif(b * (n - b) - n * l / 4, 0) as pf, l / n * pow(n * (co - o / 2) - b * nobs, 2) / nullif(b * (n - b) - n * l / 4, 0) as po from parts),
    raw as (select {k}, (max(n) - 1) / max(n) * (sum(pf) / max(nf) + sum(po) / max(nobs)) as a2 from p group by 1)"""
_Q = [float(x) for x in np.polyfit(AD_CRITICAL, np.log(AD_LEVELS), 2)]
AD_P = f"case when s <= {AD_CRITICAL[0]} then 0.25 when s >= {AD_CRITICAL[-1]} then 0.001 else least(0.25, greatest(0.001, exp({_Q[0]!r}::double * s * s + {_Q[1]!r}::double * s + {_Q[2]!r}::double))) end"
CUM = "counted as (select {k}, value, count(*) filter (src = 'f') as f, count(*) filter (src = 'o') as o from pool group by 1, 2), cum as (select *, sum(f) over w as cf, sum(o) over w as co, sum(f) over (partition by {k}) as nf, sum(o) over (partition by {k}) as nobs from counted window w as (partition by {k} order by value))"


@query(f"with {TWO}, {RAW.format(k='m')}, {SIGMA.format(k='m')} select cast(m as integer) as m, round(s, 4) as ad_statistic, round({AD_P}, 6) as ad_pvalue from (select m, (a2 - 1) / sigma as s from raw join sigma using (m))")
def ad_test(spark: SparkSession, d: str) -> DataFrame:
    """The standardised statistic of model against observations, and its p-value."""
    return sim.anderson_darling_test(_two(spark, d), ["m"]).select("m", F.round("ad_statistic", 4).alias("ad_statistic"), F.round("ad_pvalue", 6).alias("ad_pvalue"))


HALVES = f"""{FCST}, pool as (select lead_time as k, case when ensemble <= 3 then 'f' else 'o' end as src, value from fcst), {CUM.format(k='k')}"""


@query(f"""with {HALVES}, {RAW.format(k='k')}, {SIGMA.format(k='k')}, s as (select k, (a2 - 1) / sigma as s from raw join sigma using (k)), tested as (select k, s, round({AD_P}, 6) as p from s)
    select k as lead_time, 'ad' as test, round(s, 4) as statistic, p as pvalue, p <= 0.05 as differs from tested""")
def similarity_by_lead_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Some members against the others, by lead: what a map of p-values draws, of one test."""
    cube = fcst(spark, d)
    tests = sim.similarity_tests(cube.where("ensemble <= 3"), cube.where("ensemble > 3"), ["lead_time"])
    drawn = plotdata.similarity_map(tests, by=["lead_time"]).where("test = 'ad'")
    return drawn.select("lead_time", "test", F.round("statistic", 4).alias("statistic"), F.round("pvalue", 6).alias("pvalue"), "differs")


@query(f"with {FCST} select init_date, lead_time, time, value from fcst where ensemble = 2")
def one_member(spark: SparkSession, d: str) -> DataFrame:
    """A dimension that has one label goes."""
    return squeeze(fcst(spark, d).where("ensemble = 2"), ["ensemble", "lead_time"])


FLAGS = f"""pool as (select l_returnflag as k, case when l_linenumber <= 2 then 'f' else 'o' end as src, case when l_returnflag = 'N' then 1.0::double else l_quantity::double end as value from lineitem), {CUM.format(k='k')}"""


@query(f"with {FLAGS}, {RAW.format(k='k')} select k, case when k <> 'N' then round(a2, 5) end as a2 from raw")
def similarity_of_equal_values(spark: SparkSession, d: str) -> DataFrame:
    """Groups of which one has a single value: its statistic is missing."""
    lines = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), "l_linenumber", F.when(F.col("l_returnflag") == "N", 1.0).otherwise(F.col("l_quantity").cast("double")).alias("value"))
    both = sim.pooled(lines.where("l_linenumber <= 2"), lines.where("l_linenumber > 2"), ["k"])
    return sim.ad_raw(both, ["k"]).select("k", F.round("a2", 5).alias("a2"))


# Tail of the Kolmogorov distribution at t, by the series that converges faster.
TAIL = "case when t < 1.18 then 1 - sqrt(2 * pi()) / t * list_sum(list_transform(range(1, 30), lambda k: exp(-pow(2 * k - 1, 2) * pi() * pi() / (8 * t * t)))) else 2 * list_sum(list_transform(range(1, 30), lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2.0 * k * k * t * t))) end"


@query(f"""with {FCST}, {LMM}, v as (select lead_time, n, value as v, c, location, scale from fcst join params using (lead_time)), u as (select lead_time, n, case when not ({OUTSIDE}) then exp(-pow(1 - c * (v - location) / scale, 1 / c)) else case when c > 0 then 1 else 0 end end as u from v),
    r as (select *, row_number() over (partition by lead_time order by u) as j from u), g as (select lead_time, any_value(n) as n, max(greatest(j / n - u, u - (j - 1) / n)) as statistic from r group by 1)
    select lead_time, n, round(statistic, 6) as statistic, round({TAIL}, 4) as pvalue from (select *, statistic * (sqrt(n) + 0.12 + 0.11 / sqrt(n)) as t from g)""")
def gev_goodness_by_lead(spark: SparkSession, d: str) -> DataFrame:
    """Distance and p-value of each lead's values from their fit by L-moments."""
    cube = fcst(spark, d)
    found = gevfit.check_gev_fit(cube, gev.fit_lmoments(cube, "value", ["lead_time"]), ["lead_time"])
    return found.select("lead_time", "n", F.round("statistic", 6).alias("statistic"), F.round("pvalue", 4).alias("pvalue"))


LINEAR = f"""{FCST}, line as (select lead_time, regr_slope(value, year(time)) as slope, avg(year(time)) as x0 from fcst group by 1),
    flat as (select lead_time, value - slope * (year(time) - x0) as value from fcst join line using (lead_time)),
    {LMM.replace('ranked', 'ranked0').replace('sums', 'sums0').replace('shape', 'shape0').replace('curved', 'curved0').replace('scaled', 'scaled0').replace('params', 'one')},
    {LMM.replace('fcst', 'flat').replace('params', 'other')}"""


def _nllf(rows: str, params: str) -> str:
    term = f"case when {OUTSIDE} then {gev.PENALTY!r}::double else ln(scale) - (1 / c - 1) * ln(1 - c * (v - location) / scale) + pow(1 - c * (v - location) / scale, 1 / c) end"
    return f"(select lead_time, count(*) as n, sum({term}) as nll from (select lead_time, value as v, c, location, scale from {rows} join {params} using (lead_time)) group by 1)"


@query(f"""with {LINEAR} select lead_time, round(a.nll, 2) as nllf_stationary, round(b.nll, 2) as nllf_trend, exp(-greatest(a.nll - b.nll, 0)) <= 0.05 as lrt, 10 + 2 * b.nll < 6 + 2 * a.nll as aic, 5 * ln(a.n) + 2 * b.nll < 3 * ln(a.n) + 2 * a.nll as bic
    from {_nllf('fcst', 'one')} a join {_nllf('flat', 'other')} b using (lead_time)""")
def gev_best_model(spark: SparkSession, d: str) -> DataFrame:
    """Fits of each lead with and without a trend of the location, and which of them the tests prefer."""
    cube = fcst(spark, d).withColumn("year", F.year("time"))
    line = cube.groupBy("lead_time").agg(F.regr_slope("value", "year").alias("slope"), F.avg("year").alias("x0"))
    flat = cube.join(line, "lead_time").withColumn("value", F.col("value") - F.col("slope") * (F.col("year") - F.col("x0")))

    def likelihood(rows: DataFrame, name: str) -> DataFrame:
        fitted = gev.fit_lmoments(rows, "value", ["lead_time"]).select("lead_time", "c", "location", "scale")
        return rows.join(fitted, "lead_time").groupBy("lead_time").agg(F.count("value").alias("n"), gev.penalised_sum(F.col("value"), F.col("c"), F.col("location"), F.col("scale")).alias(name))

    fits = likelihood(cube, "nllf_stationary").join(likelihood(flat, "nllf_trend").drop("n"), "lead_time")
    out = fits.select("lead_time", F.round("nllf_stationary", 2).alias("nllf_stationary"), F.round("nllf_trend", 2).alias("nllf_trend"))
    for test in ("lrt", "aic", "bic"):
        out = out.join(gevfit.check_gev_relative_fit(fits, ["lead_time"], test).withColumnRenamed("prefers_trend", test), "lead_time")
    return out


CELLS = LMM.replace("fcst", "cells").replace("lead_time", "cell")


@query(f"""with {GRID}, cells as (select lat || ':' || lon as cell, value from grid), {CELLS}, where_ as (select distinct lat || ':' || lon as cell, lat, lon from grid),
    long as (unpivot (select lat, lon, c, location, scale from params join where_ using (cell)) on c, location, scale into name parameter value value)
    select lat, lon, parameter, round(value / case when parameter = 'c' then 1 else 1000000 end, 5) as value from long""")
def spatial_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of each cell's fit, as a map has them; large ones in millions."""
    found = plotdata.spatial_parameters(gev.fit_lmoments(grid(spark, d), "value", ["lat", "lon"]).select("lat", "lon", "c", "location", "scale"))
    return found.withColumn("value", F.round(F.col("value") / F.when(F.col("parameter") == "c", 1).otherwise(1_000_000), 5))


@query("""with m as (select date_trunc('month', o_orderdate) as mm, sum(o_totalprice * 0.001) as early, count(o_totalprice) as n from orders group by 1)
    select cast(last_day(mm) as date) as time, round(early, 4) as early, round(sum_late * 0.001, 4) as late, 'm month-1' as unit from m join (select date_trunc('month', o_orderdate) as mm, sum(o_totalprice) as sum_late from orders group by 1) using (mm)""")
def units_before_and_after(spark: SparkSession, d: str) -> DataFrame:
    """Monthly sums of what is converted before them, and of what is after; of the first, the unit is that of a month."""
    meta = {"rename": {"o_orderdate": "time", "o_totalprice": "price"}, "units": {"price": "mm"}}

    def opened(**more: object) -> DataFrame:
        return open_dataset(spark, f"{d}/orders.parquet", OpenSpec(variables=("price",), metadata=meta, time_freq="ME", time_agg="sum", units={"price": "m"}, **more))

    rates = open_dataset(spark, f"{d}/orders.parquet", OpenSpec(variables=("price",), metadata=meta | {"units": {"price": "m day-1"}}, time_freq="ME", time_agg="sum"))
    early = opened(units_timing="start").select("time", F.round("price", 4).alias("early"))
    return early.join(opened().select("time", F.round("price", 4).alias("late")), "time").withColumn("unit", F.lit(files.unit_of(rates, "price")))


@query(f"with {GRID} select time, lat, lon, value from grid where lat >= -30 and time < date '1998-01-01'")
def array_file(spark: SparkSession, d: str) -> DataFrame:
    """Fields written into one file of arrays by many tasks, and a part of them read back: chunks of other places and times are left out."""
    path = f"{shared_dir(spark)}/tailcast-{uuid.uuid4().hex}.nc"
    files.write(grid(spark, d), path, history=files.provenance(argv=["array_file"]))
    return files.read(spark, path).where("lat >= -30 and time < date '1998-01-01' and value is not null")


@query(f"""with {FCST}, b as (select lead_time, ensemble, avg(value) as v from fcst group by 1, 2) select lead_time, round(max(v) - min(v), 4) as spread, count(*) as members from b group by 1""")
def spread_of_members(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts written with their times as a variable, read back and compared between members."""
    path = f"{shared_dir(spark)}/tailcast-{uuid.uuid4().hex}.nc"
    files.write(fcst(spark, d), path)
    back = files.read(spark, path, variables=["value"]).where("value is not null")
    return back.groupBy("lead_time", "ensemble").agg(F.avg("value").alias("v")).groupBy(F.col("lead_time").cast("int").alias("lead_time")).agg(F.round(F.max("v") - F.min("v"), 4).alias("spread"), F.count("*").alias("members"))
