"""Selection, masks and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.functions import gev, indices, units
from tailcast.operators import selection as s
from tailcast.plans.views import FCST, GRID, OBS, SAMPLE, fcst, grid, obs, sample
from tailcast.queries import query


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six decimals (and no negative zero), as on the other side."""
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names or [c for c, t in df.dtypes if t == "double"]})


@query(f"with {OBS} select * from obs where month(time) in (6, 7, 8)")
def select_months(spark: SparkSession, d: str) -> DataFrame:
    return s.select_months(obs(spark, d), [6, 7, 8])


@query(f"""with {OBS}, k as (select * from obs where month(time) in (6, 7, 8)), f as (select (select min(time) from k) - (select min(time) from obs) as days)
    select cast(k.time - to_days(cast(f.days as integer)) as date) as time, k.value from k, f""")
def select_months_init(spark: SparkSession, d: str) -> DataFrame:
    return s.select_months(obs(spark, d), [6, 7, 8], init_month=True)


@query(f"with {OBS} select * from obs where time >= date '1996-03-01' and time <= date '1997-06-30'")
def select_time_period(spark: SparkSession, d: str) -> DataFrame:
    return s.select_time_period(obs(spark, d), ["1996-03-01", "1997-06-30"])


@query(f"with {SAMPLE} select event_id, value from sample where time >= timestamp '2024-01-05' and time <= timestamp '2024-01-12'")
def select_time_period_auxiliary(spark: SparkSession, d: str) -> DataFrame:
    return s.select_time_period(sample(spark, d), ["2024-01-05", "2024-01-12"], auxiliary=True).select("event_id", "value")


@query(f"with {OBS} select * from obs where not (month(time) = 2 and day(time) = 29)")
def drop_leap_days(spark: SparkSession, d: str) -> DataFrame:
    return s.drop_leap_days(obs(spark, d))


@query(f"""with {FCST}, t as (select distinct init_date from fcst), k as (select init_date, row_number() over (order by init_date) - 1 as i from t)
    select fcst.* from fcst semi join (select init_date from k where i >= 2 and i < 8) using (init_date)""")
def isel_init_dates(spark: SparkSession, d: str) -> DataFrame:
    return s.isel(fcst(spark, d), "init_date", slice(2, 8))


@query(f"with {FCST} select * from fcst where lead_time between 3 and 6 and ensemble = 2")
def sel_labels(spark: SparkSession, d: str) -> DataFrame:
    return s.sel(s.sel(fcst(spark, d), "lead_time", slice(3, 6)), "ensemble", 2)


@query(f"""with {GRID},
    a as (select lat from (select distinct lat from grid) order by abs(lat + 32.6), -lat limit 1),
    o as (select lon from (select distinct lon from grid) order by abs(lon - 131), -lon limit 1)
    select grid.* from grid where lat in (from a) and lon in (from o)""")
def select_point_nearest(spark: SparkSession, d: str) -> DataFrame:
    return s.select_point(grid(spark, d), -32.6, -229.0)


@query(f"with {GRID} select * from grid where lat between -35 and -25")
def subset_lat(spark: SparkSession, d: str) -> DataFrame:
    return s.subset_lat(grid(spark, d), -35, -25)


@query(f"with {GRID} select * from grid where lon >= 140 or lon <= 110")
def subset_lon_wrap(spark: SparkSession, d: str) -> DataFrame:
    return s.subset_lon(grid(spark, d), 140, 110)


@query(f"with {FCST} select init_date, ensemble, lead_time, case when lead_time >= case month(init_date) when 1 then 2 when 4 then 3 when 7 then 4 else 5 end then value end as value from fcst")
def min_lead_mask(spark: SparkSession, d: str) -> DataFrame:
    leads = spark.createDataFrame([(1, 2), (4, 3), (7, 4), (10, 5)], "month int, min_lead int")
    return s.mask_leads(fcst(spark, d), leads).select("init_date", "ensemble", "lead_time", "value")


@query(f"with {FCST} select init_date, ensemble, lead_time, case when value < max(value) over (partition by ensemble, lead_time) then value end as value from fcst")
def drop_max(spark: SparkSession, d: str) -> DataFrame:
    return s.drop_max(fcst(spark, d), ["ensemble", "lead_time"]).select("init_date", "ensemble", "lead_time", "value")


@query(f"""with {FCST}, m as (select * replace (case when lead_time >= month(init_date) % 5 then value end as value) from fcst),
    good as (select lead_time from m group by 1 having count(value) = count(*))
    select init_date, ensemble, lead_time, value from m where lead_time in (from good)""")
def drop_missing_leads(spark: SparkSession, d: str) -> DataFrame:
    masked = fcst(spark, d).withColumn("value", F.when(F.col("lead_time") >= F.month("init_date") % 5, F.col("value")))
    return s.drop_missing(masked, "lead_time").select("init_date", "ensemble", "lead_time", "value")


@query(f"with {FCST} select * from fcst where lead_time < 4")
def first_leads(spark: SparkSession, d: str) -> DataFrame:
    return s.first_leads(fcst(spark, d), 4)


@query(f"with {OBS} select time, round(value / day(last_day(time)), 6) as value from obs")
def scale_days_in_month(spark: SparkSession, d: str) -> DataFrame:
    return r6(obs(spark, d).withColumn("value", units.scaled(F.col("value"), "days_in_month", F.col("time"))))


@query(f"with {SAMPLE} select event_id, round(value + 273.15, 6) as kelvin, round(value * 1.8 + 32, 6) as fahrenheit, round(value * 86400, 6) as rain from sample")
def convert_units(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return r6(sample(spark, d).select("event_id", units.convert_units(v, "degC", "K").alias("kelvin"), units.convert_units(v, "degC", "degF").alias("fahrenheit"), units.convert_units(v, "kg/m2/s", "mm day-1").alias("rain")))


@query("select l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) as speed from lineitem")
def wind_speed(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    return r6(lines.select("l_orderkey", "l_linenumber", "l_partkey", indices.wind_speed(F.col("l_quantity"), F.col("l_tax")).alias("speed")))


@query(f"""with {OBS}, r as (select *, case when count(value) over w = 20 then sum(value) over w end as s from obs window w as (order by time rows between 19 preceding and current row))
    select time, round(10 - 10 * (s - min(s) over ()) / (max(s) over () - min(s) over ()), 6) as df from r""")
def drought_factor(spark: SparkSession, d: str) -> DataFrame:
    return r6(indices.drought_factor(obs(spark, d), "value", [], "time", "df").select("time", "df"))


@query("""select event_id, round(pow(2 + value / 100, 0.987) * exp(0.0338 * (value % 40) - 0.0345 * (event_id % 100) + 0.0234 * (user_id % 60)) + 0.243147, 6) as ffdi from events""")
def ffdi(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return r6(e.select("event_id", indices.ffdi(2 + F.col("value") / 100, F.col("value") % 40, (F.col("event_id") % 100).cast("double"), (F.col("user_id") % 60).cast("double")).alias("ffdi")))


@query("""select event_id, round(case when value % 110 < 100 then 1 / nullif(-ln(1 - nullif(value % 110, 0) / 100), 0) end, 6) as ari, round(100 * (exp(1 / (1 + value)) - 1) / exp(1 / (1 + value)), 6) as aep from events""")
def aep_ari(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    share = F.col("value") % 110
    return r6(e.select("event_id", gev.aep_to_ari(F.when(share != 0, share)).alias("ari"), gev.ari_to_aep(1 + F.col("value")).alias("aep")))


@query(f"with {FCST} select distinct l.lead_time, e.ensemble, i.init_date, fcst.value from (select distinct lead_time from fcst) l, (select distinct ensemble from fcst) e, (select distinct init_date from fcst) i left join fcst on fcst.lead_time = l.lead_time and fcst.ensemble = e.ensemble and fcst.init_date = i.init_date")
def reindex_forecast(spark: SparkSession, d: str) -> DataFrame:
    from tailcast.operators.reshape import densify

    return densify(fcst(spark, d).drop("time"), ["init_date", "ensemble", "lead_time"]).select("lead_time", "ensemble", "init_date", "value")
