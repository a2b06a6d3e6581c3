"""Ensembles: moments, similarity, independence, bootstraps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.operators import independence as ind
from tailcast.operators import moments as m
from tailcast.operators import resampling as r
from tailcast.operators import similarity as sim
from tailcast.plans.views import FCST, OBS, SAMPLE, fcst, obs, sample
from tailcast.queries import query
from tailcast.queries.selection import r6

KINDS = ["event_type"]


def _central(source: str, key: str, digits: int = 6) -> str:
    """Population moments from central sums."""
    return f"""select {key}, round(avg(a), {digits}) as mean, round(sqrt(avg(d2)), {digits}) as std, round(avg(d3) / pow(avg(d2), 1.5), {digits}) as skew, round(avg(d4) / pow(avg(d2), 2) - 3, {digits}) as kurtosis
        from (select {key}, a, pow(value - a, 2) as d2, pow(value - a, 3) as d3, pow(value - a, 4) as d4 from (select *, avg(value) over (partition by {key}) as a from {source})) group by {key}"""


@query(f"with {SAMPLE} {_central('sample', 'event_type')}")
def moments(spark: SparkSession, d: str) -> DataFrame:
    return r6(m.moments(sample(spark, d), KINDS))


def _hash(seed: int, k: str, i: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {k} || ':' || {i}), 1, 8))::BIGINT"


BOOT = f"""rows as (select event_type, value, row_number() over (partition by event_type order by event_id) - 1 as idx from sample),
    sizes as (select event_type, count(*) as n from sample group by 1),
    draws as (select event_type, k, {_hash(0, "k", "pos")} % n as idx from sizes, (select unnest(range(0, 1000)) as k), (select unnest(range(0, 200)) as pos)),
    drawn as (select event_type, k, value, event_type || ':' || k as g from draws join rows using (event_type, idx))"""


@query(f"""with {SAMPLE}, {BOOT}, each as (select g as gg, mean, std, skew, kurtosis from ({_central('drawn', 'g', 14)})),
    long as (unpivot each on mean, std, skew, kurtosis into name moment value v)
    select split_part(gg, ':', 1) as event_type, moment, round(quantile_cont(v, 0.025), 9) as ci_lower, round(quantile_cont(v, 0.975), 9) as ci_upper from long group by 1, 2""")
def moments_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    out = m.moments_interval(sample(spark, d), KINDS, ["event_id"], 200, 1000)
    return out.withColumns({c: F.round(c, 9) for c in ("ci_lower", "ci_upper")})


TWO = f"""{OBS}, {FCST}, pool as (select month(init_date) as m, 'f' as src, value from fcst union all select mm, 'o', value / 10 from (select unnest([1, 4, 7, 10]) as mm), obs),
    counted as (select m, value, count(*) filter (src = 'f') as f, count(*) filter (src = 'o') as o from pool group by 1, 2),
    cum as (select *, sum(f) over w as cf, sum(o) over w as co, sum(f) over (partition by m) as nf, sum(o) over (partition by m) as nobs from counted window w as (partition by m order by value))"""


def _two(spark: SparkSession, d: str) -> DataFrame:
    model = fcst(spark, d).withColumn("m", F.month("init_date"))
    seen = obs(spark, d).withColumn("value", F.col("value") / 10).withColumn("m", F.explode(F.array(*[F.lit(k) for k in (1, 4, 7, 10)])))
    return sim.pooled(model, seen, ["m"])


@query(f"with {TWO} select cast(m as integer) as m, round(max(abs(cf / nf - co / nobs)), 6) as ks_statistic, cast(max(nf) as bigint) as n_f, cast(max(nobs) as bigint) as n_o from cum group by 1")
def ks_statistic(spark: SparkSession, d: str) -> DataFrame:
    return r6(sim.ks_statistic(_two(spark, d), ["m"]))


@query(f"""with {TWO}, parts as (select *, f + o as l, nf + nobs as n, cf + co - (f + o) / 2 as b from cum),
    p as (select m, n, nf, nobs, l / n * pow(n * (cf - f / 2) - b * nf, 2) / nullif(b * (n - b) - n * l / 4, 0) as pf, l / n * pow(n * (co - o / 2) - b * nobs, 2) / nullif(b * (n - b) - n * l / 4, 0) as po from parts)
    select cast(m as integer) as m, round((max(n) - 1) / max(n) * (sum(pf) / max(nf) + sum(po) / max(nobs)), 5) as a2, cast(max(nf) as bigint) as n_f, cast(max(nobs) as bigint) as n_o from p group by 1""")
def ad_statistic(spark: SparkSession, d: str) -> DataFrame:
    return sim.ad_raw(_two(spark, d), ["m"]).withColumn("a2", F.round("a2", 5))


@query()
def ks_pvalue(spark: SparkSession, d: str) -> DataFrame:
    return sim.ks_test(_two(spark, d), ["m"])


@query()
def ad_pvalue(spark: SparkSession, d: str) -> DataFrame:
    return sim.anderson_darling_test(_two(spark, d), ["m"])


DETREND = f"""{FCST}, days as (select *, month(init_date) as m, datediff('day', date '1970-01-01', init_date)::double as x from fcst),
    means as (select m, lead_time, x, avg(value) as a from days group by 1, 2, 3),
    lines as (select m, lead_time, regr_slope(a, x) as slope, min(x) as x0 from means group by 1, 2),
    flat as (select days.m as init_month, days.lead_time, init_date, ensemble, value - coalesce(slope, 0) * (x - x0) as value from days join lines on days.m = lines.m and days.lead_time = lines.lead_time)"""


@query(f"with {DETREND} select cast(init_month as integer) as init_month, lead_time, init_date, ensemble, round(value, 5) as value from flat")
def ensemble_detrend(spark: SparkSession, d: str) -> DataFrame:
    return ind.detrended(fcst(spark, d)).select("init_month", "lead_time", "init_date", "ensemble", F.round("value", 5).alias("value"))


def _spearman(source: str, keys: str) -> str:
    """Mean over pairs, ranks among the starts that both members have."""
    same = " and ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    own = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f"""pairs as (select {own}, x.ensemble as a, y.ensemble as b, x.value as vx, y.value as vy from {source} x join {source} y on {same} and x.init_date = y.init_date and x.ensemble < y.ensemble),
        ranks as (select {keys}, a, b, rank() over (partition by {keys}, a, b order by vx) + (count(*) over (partition by {keys}, a, b, vx) - 1) / 2 as rx, rank() over (partition by {keys}, a, b order by vy) + (count(*) over (partition by {keys}, a, b, vy) - 1) / 2 as ry from pairs),
        each as (select {keys}, a, b, corr(rx, ry) as r from ranks group by all),
        mean_r as (select {keys}, avg(r) as r from each group by all)"""


@query(f"with {DETREND}, {_spearman('flat', 'init_month, lead_time')} select cast(init_month as integer) as init_month, lead_time, round(r, 6) + 0 as r from mean_r")
def mean_pairwise_spearman(spark: SparkSession, d: str) -> DataFrame:
    return r6(ind.mean_correlation(ind.detrended(fcst(spark, d)), ["init_month", "lead_time"]))


RESAMPLES = 100
NULL = f"""shape as (select init_month, count(distinct init_date) as i, count(distinct ensemble) as e from flat group by 1),
    idx as (select *, row_number() over (partition by init_month order by init_date, lead_time, ensemble) - 1 as idx from flat),
    drawn as (select init_month, k, value, row_number() over (partition by init_month, k order by {_hash(0, "k", "idx")}, idx) - 1 as pos from idx, (select unnest(range(0, {RESAMPLES})) as k)),
    cells as (select drawn.init_month, k, pos // e as init_date, pos % e as ensemble, value from drawn join shape using (init_month) where pos < i * e)"""
NULL_R = _spearman("cells", "init_month, k").replace("pairs", "npairs").replace("ranks", "nranks").replace("each", "neach").replace("mean_r", "null_r")
BOUNDS = f"{NULL}, {NULL_R}, bounds as (select init_month, quantile_cont(r, 0.025) as lo, quantile_cont(r, 0.975) as hi from null_r group by 1)"


@query(f"with {DETREND}, {BOUNDS} select cast(init_month as integer) as init_month, round(lo, 6) as ci_lower, round(hi, 6) as ci_upper from bounds")
def null_correlation_bounds(spark: SparkSession, d: str) -> DataFrame:
    return r6(ind.null_bounds(ind.detrended(fcst(spark, d)), n_resamples=RESAMPLES))


@query(f"""with {DETREND}, {_spearman('flat', 'init_month, lead_time')}, {BOUNDS}
    select cast(init_month as integer) as init_month, cast(coalesce(min(lead_time) filter (not coalesce(r >= lo and r >= hi, false)), 0) as integer) as min_lead from mean_r join bounds using (init_month) group by 1""")
def min_independent_lead(spark: SparkSession, d: str) -> DataFrame:
    return ind.run_tests(fcst(spark, d), n_resamples=RESAMPLES)[2]


@query(f"""with {SAMPLE}, rows as (select event_type, value, row_number() over (partition by event_type order by event_id) - 1 as idx from sample), sizes as (select event_type, count(*) as n from sample group by 1),
    blocks as (select event_type, n, k, b, {_hash(0, "k", "b")} % (n - 5 + 1) as s from sizes, (select unnest(range(0, 10)) as k), (select unnest(range(0, 20)) as b)),
    pos as (select event_type, k, b * 5 + j as pos, s + j as idx from blocks, (select unnest(range(0, 5)) as j))
    select event_type, cast(k as integer) as k, cast(pos as bigint) as pos, value from pos join rows using (event_type, idx)""")
def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    out = r.resample(sample(spark, d).select("event_type", "event_id", "value"), KINDS, ["event_id"], 10, block=5, size=100)
    return out.select("event_type", "k", F.col("pos").cast("long").alias("pos"), "value")


@query(f"with {SAMPLE}, {BOOT}, each as (select event_type, k, avg(value) as s from drawn group by 1, 2) select event_type, round(quantile_cont(s, 0.025), 9) as ci_lower, round(quantile_cont(s, 0.975), 9) as ci_upper from each group by 1")
def statistic_ci_percentile(spark: SparkSession, d: str) -> DataFrame:
    drawn = r.resample(sample(spark, d).select("event_type", "event_id", "value"), KINDS, ["event_id"], 1000, size=200)
    return r.percentile_interval(drawn, KINDS, F.avg("value")).withColumns({c: F.round(c, 9) for c in ("ci_lower", "ci_upper")})


@query()
def statistic_ci_bca(spark: SparkSession, d: str) -> DataFrame:
    """Of medians."""
    return r.quantile_interval(sample(spark, d), KINDS, 0.5)


LEFT_OUT = """others as (select event_type, count(*) as n, avg(value) as m, stddev_pop(value) as s, median(value) as q, sum(value) as a, sum(value * value) as b from sample group by 1),
    ordered as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as r from sample),
    mid as (select event_type, n, floor((n - 2) * 0.5) as f, (n - 2) * 0.5 - floor((n - 2) * 0.5) as g from others),
    near as (select event_type, n, f, g, max(value) filter (r = f) as x0, max(value) filter (r = f + 1) as x1, max(value) filter (r = f + 2) as x2 from ordered join mid using (event_type) group by all),
    without as (
        select event_type, 'mean' as name, m as whole, (a - value) / (n - 1) as t from sample join others using (event_type)
        union all select event_type, 'std', s, sqrt((b - value * value) / (n - 1) - pow((a - value) / (n - 1), 2)) from sample join others using (event_type)
        union all select event_type, 'median', q, case when r <= f then x1 + g * (x2 - x1) when r = f + 1 then x0 + g * (x2 - x0) else x0 + g * (x1 - x0) end from ordered join near using (event_type) join others using (event_type)),
    pull as (select event_type, name, any_value(whole) as whole, sum(pow(c - t, 3)) / (6 * pow(sum(pow(c - t, 2)), 1.5)) as acceleration from (select *, avg(t) over (partition by event_type, name) as c from without) group by 1, 2),
    each as (unpivot (select event_type, k, avg(value) as mean, stddev_pop(value) as std, median(value) as median from drawn group by 1, 2) on mean, std, median into name name value v)"""


@query(f"""with {SAMPLE}, {BOOT}, {LEFT_OUT}
    select event_type, name, round(any_value(whole), 6) as statistic, avg((v < whole)::int::double) as below, round(any_value(acceleration), 5) + 0 as acceleration from each join pull using (event_type, name) group by 1, 2""")
def bca_parts(spark: SparkSession, d: str) -> DataFrame:
    """What bias-corrected intervals of means, deviations and medians are made of."""
    parts = [r.bca_interval_by_columns(sample(spark, d), KINDS, s, ["event_id"], sample_size=200, n_resamples=1000).withColumn("name", F.lit(name)) for name, s in (("mean", "mean"), ("std", "std"), ("median", 0.5))]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.select("event_type", "name", F.round("statistic", 6).alias("statistic"), "below", (F.round("acceleration", 5) + 0.0).alias("acceleration"))


@query(f"""with {FCST}, {OBS}, quarters as (select cast(date_trunc('quarter', time) as date) as init_date, sum(value) as seen from obs group by 1),
    labels as (select init_date, row_number() over (order by init_date) - 1 as idx, count(*) over () as n from (select distinct init_date from fcst)),
    starts as (select k, b, {_hash(0, "k", "b")} % (n - 3 + 1) as s from (select distinct n from labels), (select unnest(range(0, 100)) as k), (select unnest(range(0, 8)) as b)),
    drawn as (select k, b * 3 + j as pos, s + j as idx from starts, (select unnest(range(0, 3)) as j)),
    both_of as (select k, pos, avg(value) as forecast, any_value(seen) as seen from drawn join labels using (idx) join fcst using (init_date) join quarters using (init_date) group by 1, 2)
    select cast(k as integer) as k, count(*) as n, round(corr(forecast, seen), 6) + 0 as r from both_of group by 1""")
def bundled_block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of forecasts' means with what was seen, over blocks of three starts that are drawn for both tables together."""
    seen = obs(spark, d).groupBy(F.trunc("time", "quarter").alias("init_date")).agg(F.sum("value").alias("seen"))

    def correlation(forecast: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([forecast.groupby("init_date_pos")["value"].mean(), seen.groupby("init_date_pos")["seen"].first()], axis=1).dropna()
        return pd.DataFrame({"n": [len(both)], "r": [round(both["value"].corr(both["seen"]), 6) + 0.0]})

    tables = {"forecast": fcst(spark, d).select("init_date", "ensemble", "lead_time", "value"), "seen": seen}
    return r.resample_tables(tables, {"init_date": (24, 3)}, 100, correlation, "n long, r double", bundled=True)
