"""Calendar bins, climatologies, reshaping and bias."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.functions.indices import rolling_sum
from tailcast.operators import bias as b
from tailcast.operators import reshape, temporal
from tailcast.operators.extremes import empirical_return_period
from tailcast.plans.views import FCST, GRID, OBS, fcst, grid, obs
from tailcast.queries import query
from tailcast.queries.selection import r6

YEAR_END = "make_date(year(time), 12, 31)"
ROLL = "rx as (select time, case when count(value) over w = 5 then sum(value) over w end as value from obs window w as (order by time rows between 4 preceding and current row))"


def _rx5(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).withColumn("value", rolling_sum(F.col("value"), 5, [], "time"))


@query(f"with {OBS}, {ROLL} select time, round(value, 2) as value from rx")
def rolling_sum_5(spark: SparkSession, d: str) -> DataFrame:
    return _rx5(spark, d).withColumn("value", F.round("value", 2))


@query(f"""with {OBS}, {ROLL}, a as (select {YEAR_END} as time, max(round(value, 2)) as value, arg_max(rx.time, round(value, 2)) as t from rx group by 1),
    n as (select a.*, (select min(rx.time) from rx where round(rx.value, 2) = a.value and make_date(year(rx.time), 12, 31) = a.time) as first from a)
    select time, value, strftime(first, '%Y-%m-%d') as event_time from n""")
def rx5_annual_max(spark: SparkSession, d: str) -> DataFrame:
    """Largest five-day sum of each year and its date."""
    rx = _rx5(spark, d).withColumn("value", F.round("value", 2))
    return temporal.event_dates(rx, "YE-DEC", "max")


@query(f"""with {OBS}, {ROLL}, a as (select {YEAR_END} as time, max(round(value, 2)) as value from rx group by 1)
    select round(count(*) / nullif(sum(case when value > 40000000 * 0 + (select quantile_cont(value, 0.5) from a) then 1 else 0 end), 0), 6) as return_period from a""")
def rx5_return_period(spark: SparkSession, d: str) -> DataFrame:
    """Return period of the median annual largest five-day sum."""
    annual = temporal.temporal_aggregation(_rx5(spark, d).withColumn("value", F.round("value", 2)), "YE-DEC", "max")
    middle = annual.agg(F.percentile("value", 0.5).alias("event"))
    return r6(empirical_return_period(annual.crossJoin(F.broadcast(middle)), F.col("event")))


@query(f"""with {OBS}, a as (select {YEAR_END} as time, max(value) as value, max({{'v': value, 'd': -epoch(time)}}) as m from obs group by 1)
    select a.time, a.value, strftime(min(obs.time), '%Y-%m-%d') as event_time from a join obs on make_date(year(obs.time), 12, 31) = a.time and obs.value = a.value group by 1, 2""")
def annual_max_event_date(spark: SparkSession, d: str) -> DataFrame:
    return temporal.event_dates(obs(spark, d), "YE-DEC", "max")


@query(f"with {OBS} select last_day(time) as time, round(avg(value), 6) as value from obs group by 1")
def monthly_mean(spark: SparkSession, d: str) -> DataFrame:
    return r6(temporal.temporal_aggregation(obs(spark, d), "ME", "mean"))


@query(f"with {GRID} select {YEAR_END} as time, lat, lon, round(sum(value * day(last_day(time))) / sum(day(last_day(time))), 6) as value from grid group by 1, 2, 3")
def annual_mean_days_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Monthly values weighted by their days."""
    return r6(temporal.temporal_aggregation(grid(spark, d), "YE-DEC", "mean", by=["lat", "lon"], input_freq="M", dense=False))


@query(f"""with {OBS}, q as (select last_day(cast(date_trunc('month', time) + to_months(((11 - month(time)) % 3 + 3) % 3) as date)) as label, * from obs)
    select label as time, round(avg(value), 6) as value from q where month(label) = 2 group by 1""")
def seasonal_mean_djf(spark: SparkSession, d: str) -> DataFrame:
    return r6(temporal.temporal_aggregation(obs(spark, d), "Q-NOV", "mean", season="DJF"))


@query(f"with {OBS} select last_day(make_date(year(time) + case when month(time) > 6 then 1 else 0 end, 6, 1)) as time, round(sum(value), 2) as value from obs group by 1 having count(value) >= 300")
def annual_sum_min_tsteps(spark: SparkSession, d: str) -> DataFrame:
    return temporal.temporal_aggregation(obs(spark, d), "YE-JUN", "sum", min_tsteps=300).withColumn("value", F.round("value", 2))


@query(f"with {OBS} select make_date(year(time), month((select min(time) from obs)), day((select min(time) from obs))) as time, min(value) as value from obs group by 1")
def reset_times_annual(spark: SparkSession, d: str) -> DataFrame:
    return temporal.temporal_aggregation(obs(spark, d), "YE-DEC", "min", reset_times=True)


@query(f"""with {GRID}, labels as (select distinct last_day(make_date(cast(y as bigint), 12, 1)) as time from (select unnest(range(year(min(time)), year(max(time)) + 1)) as y from grid)),
    every as (select * from labels, (select distinct lat, lon from grid))
    select every.time, every.lat, every.lon, round(coalesce(sum(value), 0), 2) as value from every left join grid on every.lat = grid.lat and every.lon = grid.lon and year(grid.time) = year(every.time) group by 1, 2, 3""")
def annual_sum_dense(spark: SparkSession, d: str) -> DataFrame:
    return temporal.temporal_aggregation(grid(spark, d), "YE-DEC", "sum", by=["lat", "lon"], input_freq="M").withColumn("value", F.round("value", 2))


PERIOD = ["1996-01-01", "1999-12-31"]
IN_PERIOD = "time >= date '1996-01-01' and time <= date '1999-12-31'"


@query(f"with {FCST} select cast(month(init_date) as integer) as init_month, lead_time, round(avg(value), 6) as value from fcst where {IN_PERIOD} group by 1, 2")
def climatology_by_init_month(spark: SparkSession, d: str) -> DataFrame:
    return r6(temporal.climatology(fcst(spark, d), by=["lead_time"], period=PERIOD, init="init_date"))


@query(f"""with {OBS}, c as (select month(time) as m, avg(value) as c from obs where {IN_PERIOD} group by 1)
    select time, round(value - c, 6) as value from obs left join c on month(time) = m""")
def anomaly_monthly(spark: SparkSession, d: str) -> DataFrame:
    return r6(temporal.anomalies(obs(spark, d), PERIOD, "month").select("time", "value"))


@query(f"""with {FCST}, c as (select month(init_date) as m, lead_time, avg(value) as c from fcst where {IN_PERIOD} group by 1, 2)
    select init_date, ensemble, fcst.lead_time, round(value - c, 6) as value from fcst left join c on month(init_date) = m and fcst.lead_time = c.lead_time""")
def anomaly_forecast(spark: SparkSession, d: str) -> DataFrame:
    return r6(temporal.forecast_anomalies(fcst(spark, d), PERIOD).select("init_date", "ensemble", "lead_time", "value"))


@query(f"with {OBS} select time, value, cast(date '1997-01-01' as date) as init_date, cast(row_number() over (order by time) - 1 as integer) as lead_time from obs where time >= date '1997-01-01' and time <= date '1997-12-31'")
def to_init_lead(spark: SparkSession, d: str) -> DataFrame:
    from tailcast.operators.selection import select_time_period

    out = reshape.to_init_lead(select_time_period(obs(spark, d), ["1997-01-01", "1997-12-31"]), init_date="1997-01-01")
    return out.select("time", "value", "init_date", "lead_time")


@query(f"with {FCST} select init_date, ensemble, cast(dense_rank() over (partition by init_date, ensemble order by time) - 1 as integer) as lead_time, value from fcst")
def time_to_lead(spark: SparkSession, d: str) -> DataFrame:
    return reshape.time_to_lead(fcst(spark, d).drop("lead_time"), by=["ensemble"]).select("init_date", "ensemble", "lead_time", "value")


STACK = """monthly as (select last_day(time) as time, avg(value) as value from obs group by 1),
    spot as (select time, value, row_number() over (order by time) as i from monthly),
    starts as (select distinct init_date from fcst),
    m as (select init_date, min(i) as s from starts join spot on date_trunc('month', spot.time) = date_trunc('month', init_date) group by 1),
    lattice as (select init_date, cast(l as integer) as lead_time, s + l as i from m, (select unnest(range(0, 12)) as l)),
    stacked as (select init_date, lead_time, time, value from lattice left join spot using (i))"""


@query(f"with {OBS}, {FCST}, {STACK} select init_date, lead_time, time, round(value, 6) as value from stacked")
def stack_by_init_date(spark: SparkSession, d: str) -> DataFrame:
    monthly = temporal.temporal_aggregation(obs(spark, d), "ME", "mean")
    return r6(reshape.stack_by_init_date(monthly, fcst(spark, d).select("init_date"), 12, rounding="M"))


BIAS = f"""{OBS}, {FCST}, {STACK},
    cf as (select month(init_date) as m, lead_time, avg(value) as f from fcst where {IN_PERIOD} group by 1, 2),
    co as (select month(init_date) as m, lead_time, avg(value) as o from stacked where {IN_PERIOD} group by 1, 2),
    bias as (select cf.m, cf.lead_time, f, o from cf join co on cf.m = co.m and cf.lead_time = co.lead_time)"""


def _bias(spark: SparkSession, d: str, method: str) -> DataFrame:
    monthly = temporal.temporal_aggregation(obs(spark, d), "ME", "mean")
    return b.bias(fcst(spark, d), monthly, method, PERIOD, "M", by_lead=True, n_leads=12)


@query(f"with {BIAS} select cast(m as integer) as init_month, lead_time, round(f - o, 6) as bias from bias")
def bias_additive(spark: SparkSession, d: str) -> DataFrame:
    return r6(_bias(spark, d, "additive"))


@query(f"with {BIAS} select cast(m as integer) as init_month, lead_time, round(f / o, 6) as bias from bias")
def bias_multiplicative(spark: SparkSession, d: str) -> DataFrame:
    return r6(_bias(spark, d, "multiplicative"))


@query(f"with {BIAS} select init_date, ensemble, fcst.lead_time, round(value / (f / o), 4) as value from fcst left join bias on month(init_date) = m and fcst.lead_time = bias.lead_time")
def remove_bias(spark: SparkSession, d: str) -> DataFrame:
    out = b.remove_bias(fcst(spark, d), _bias(spark, d, "multiplicative"), "multiplicative")
    return out.select("init_date", "ensemble", "lead_time", F.round("value", 4).alias("value"))
