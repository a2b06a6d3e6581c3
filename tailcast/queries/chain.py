"""The chain of preparations, concatenation, covariates and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.functions import dates
from tailcast.operators import gevfit, reshape, spatial
from tailcast.operators import independence as ind
from tailcast.operators import moments as m
from tailcast.operators import similarity as sim
from tailcast.operators.selection import within_longitudes
from tailcast.plans import plotdata
from tailcast.plans.views import FCST, GRID, OBS, SAMPLE, fcst, grid, obs, sample
from tailcast.queries import query
from tailcast.queries.models import BOOT, KINDS, _central
from tailcast.queries.selection import r6
from tailcast.queries.spatial import BOXES, _shapes
from tailcast.sources.dataset import OpenSpec, open_dataset, open_forecasts

BUFFER = 6.0
NEAR_BOX = " union all ".join(
    f"select '{k}' as region, lat, lon from (select distinct lat, lon from grid) where sqrt(pow(greatest({x1} - lon, 0, lon - {x2}), 2) + pow(greatest({y1} - lat, 0, lat - {y2}), 2)) <= {BUFFER}" for k, (x1, y1, x2, y2) in BOXES.items()
)


@query(f"with {GRID} {NEAR_BOX}")
def region_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Cells in a region or within so many degrees of it."""
    return spatial.buffered(grid(spark, d), _shapes(spark), BUFFER)


def _up(lat: str) -> str:
    """SQL of the projection's way north, in degrees of 111.32 km."""
    e = spatial.ECCENTRICITY
    return f"({spatial.AXIS} / {spatial.DEGREE} * (ln(tan(pi() / 4 + radians({lat}) / 2)) + {e / 2} * ln((1 - {e} * sin(radians({lat}))) / (1 + {e} * sin(radians({lat}))))))"


EAST = spatial.AXIS / spatial.DEGREE
PROJECTED_BOX = " union all ".join(
    f"select '{k}' as region, lat, lon from (select distinct lat, lon from grid) where sqrt(pow({EAST} * radians(greatest({x1} - lon, 0, lon - {x2})), 2) + pow(greatest({_up(f'{y1}::double')} - {_up('lat')}, 0, {_up('lat')} - {_up(f'{y2}::double')}), 2)) <= {BUFFER}"
    for k, (x1, y1, x2, y2) in BOXES.items()
)


@query(f"with {GRID} {PROJECTED_BOX}")
def region_buffer_projected(spark: SparkSession, d: str) -> DataFrame:
    """Cells in a region or within so many degrees of it on the projection."""
    return spatial.projected_buffer(grid(spark, d), _shapes(spark), BUFFER)


@query("select cast(make_date(year(o_orderdate), 12, 31) as date) as time, max(o_totalprice) as price from orders where month(o_orderdate) in (6, 7, 8) group by 1")
def open_dataset_chain(spark: SparkSession, d: str) -> DataFrame:
    """Rename, months and annual maxima, as the programs run them."""
    meta = {"rename": {"o_orderdate": "time", "o_totalprice": "price"}}
    return open_dataset(spark, f"{d}/orders.parquet", OpenSpec(variables=("price",), metadata=meta, months=(6, 7, 8), time_freq="YE-DEC", time_agg="max"))


@query("""select cast(make_date(year(l_shipdate), 12, 31) as date) as time, round(avg(l_extendedprice / 10), 6) as price, round(avg(l_quantity), 6) as quantity
    from lineitem where not (month(l_shipdate) = 2 and day(l_shipdate) = 29) group by 1""")
def open_dataset_two_variables(spark: SparkSession, d: str) -> DataFrame:
    """Two variables through one scan."""
    meta = {"rename": {"l_shipdate": "time", "l_extendedprice": "price", "l_quantity": "quantity"}}
    spec = OpenSpec(variables=("price", "quantity"), metadata=meta, scale_factors={"price": 10}, no_leap_days=True, time_freq="YE-DEC", time_agg="mean")
    return r6(open_dataset(spark, f"{d}/lineitem.parquet", spec))


@query("select ts as time, value, cast(min(ts) over () as date) as init_date, 0 as ensemble, cast(row_number() over (order by ts) - 1 as integer) as lead_time from events")
def open_forecast_files(spark: SparkSession, d: str) -> DataFrame:
    """A list of one file: one start with one member, leads in the order of times."""
    meta = {"rename": {"ts": "time"}}
    spec = OpenSpec(variables=("value",), metadata=meta, squeeze=False)
    return open_forecasts(spark, [f"{d}/events.parquet"], spec)


@query("""with a as (select unnest(range(0, 20)) as i), b as (select unnest(range(0, 20)) as j)
    select cast(-44.5 + 1.5 + 3 * i as double) as lat, cast(112 + 1.5 + 3 * j + 1 as double) as lon from a, b where -44.5 + 1.5 + 3 * i < -10 - 1.5 and 112 + 1.5 + 3 * j < 156.25 - 1.5""")
def create_grid(spark: SparkSession, d: str) -> DataFrame:
    return spatial.create_grid(spark, "AUS300i", lon_offset=1.0)


NAMED = """tlat as (select cast(-44.5 + 1.5 + 3 * i as double) as dlat from (select unnest(range(0, 20)) as i) where -44.5 + 1.5 + 3 * i < -10 - 1.5),
    tlon as (select cast(112 + 1.5 + 3 * j + 1 as double) as dlon from (select unnest(range(0, 20)) as j) where 112 + 1.5 + 3 * j < 156.25 - 1.5),
    nlat as (select dlat, first(lat order by abs(lat - dlat), -lat) as lat from tlat, (select distinct lat from grid) group by 1),
    nlon as (select dlon, first(lon order by abs(lon - dlon), -lon) as lon from tlon, (select distinct lon from grid) group by 1)"""


@query(f"with {GRID}, {NAMED} select dlat as lat, dlon as lon, count(*) as n, round(avg(value), 6) as value from grid join nlat using (lat) join nlon using (lon) group by 1, 2")
def named_grid_means(spark: SparkSession, d: str) -> DataFrame:
    """Fields on a named grid, from the nearest cells, and their means."""
    on_grid = spatial.regrid(grid(spark, d), spatial.create_grid(spark, "AUS300i", lon_offset=1.0), "nearest_s2d", ["time"])
    return r6(on_grid.groupBy("lat", "lon").agg(F.count("*").alias("n"), F.avg("value").alias("value")))


@query(f"with {SAMPLE}, {OBS} select event_id, sample.value, obs.value as covariate from sample left join obs on cast(sample.time as date) = obs.time")
def covariate_join(spark: SparkSession, d: str) -> DataFrame:
    events = sample(spark, d).withColumn("time", F.col("time").cast("date"))
    return reshape.with_covariate(events, obs(spark, d)).select("event_id", "value", "covariate")


@query(f"with {FCST} select 0 as part, init_date, ensemble, lead_time, value, cast(null as double) as other from fcst where ensemble <= 3 union all select 1, init_date, ensemble, lead_time, null, value from fcst where ensemble > 3")
def concat_along_dimension(spark: SparkSession, d: str) -> DataFrame:
    cube = fcst(spark, d).drop("time")
    return reshape.concatenated([cube.where("ensemble <= 3"), cube.where("ensemble > 3").withColumnRenamed("value", "other")], "part")


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as text, cast(o_orderdate as date) as back, year(o_orderdate)::integer as year, datediff('day', date '1970-01-01', cast(o_orderdate as date))::double as days,
    cast((year(o_orderdate) - 1970) * 360 + (month(o_orderdate) - 1) * 30 + day(o_orderdate) - 1 as integer) as of_360 from orders""")
def dates_and_covariates(spark: SparkSession, d: str) -> DataFrame:
    t, text = F.col("o_orderdate"), dates.to_text(F.col("o_orderdate"))
    return spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", text.alias("text"), dates.from_text(text).alias("back"), dates.covariate(t).alias("year"), dates.covariate(t, "days").alias("days"), dates.ordinal(F.year(t), F.month(t), F.day(t), "360_day").alias("of_360")
    )


@query(f"""with {SAMPLE}, p as (select event_type, avg(value) as location, stddev_pop(value) as scale from sample group by 1), c as (select unnest([0.0, 10.0]) as covariate), t as (select unnest([2.0, 50.0]) as return_period)
    select event_type, covariate::double as covariate, return_period::double as return_period, round(location + 0.5 * covariate + (scale + 0.25 * covariate) * (1 - pow(-ln(1 - 1 / return_period), 0.125)) / 0.125, 6) as value from p, c, t""")
def nonstationary_return_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of five given parameters at two values of the covariate."""
    p = sample(spark, d).groupBy("event_type").agg(F.avg("value").alias("location_0"), F.stddev_pop("value").alias("scale_0"))
    params = p.withColumns({"c": F.lit(0.125), "location_1": F.lit(0.5), "scale_1": F.lit(0.25)})
    return r6(plotdata.nonstationary_return_curve(params, [0.0, 10.0], KINDS, [2.0, 50.0]), "value")


LEADS = f"""{OBS}, {FCST}, pool as (select lead_time, 'f' as src, value from fcst union all select lead_time, 'o', value / 10 from obs, (select distinct lead_time from fcst)),
    counted as (select lead_time, value, count(*) filter (src = 'f') as f, count(*) filter (src = 'o') as o from pool group by 1, 2),
    cum as (select *, sum(f) over w as cf, sum(o) over w as co, sum(f) over (partition by lead_time) as nf, sum(o) over (partition by lead_time) as nobs from counted window w as (partition by lead_time order by value))"""


@query(f"with {LEADS} select lead_time, round(max(abs(cf / nf - co / nobs)), 6) as ks_statistic, true as both from cum group by 1")
def similarity_tests_by_lead(spark: SparkSession, d: str) -> DataFrame:
    """Both tests of each lead against all observations, merged; p-values within their bounds."""
    tests = sim.similarity_tests(fcst(spark, d), obs(spark, d).withColumn("value", F.col("value") / 10), by_lead=True)
    both = F.col("ks_pvalue").between(0, 1) & F.col("ad_pvalue").between(0.001, 0.25) & F.col("ad_statistic").isNotNull()
    return r6(tests.select("lead_time", "ks_statistic", both.alias("both")), "ks_statistic")


@query(f"""with {SAMPLE}, {BOOT}, each as (select g as gg, mean, std, skew, kurtosis from ({_central('drawn', 'g', 14)})), long as (unpivot each on mean, std, skew, kurtosis into name moment value v),
    ci as (select split_part(gg, ':', 1) as event_type, moment, quantile_cont(v, 0.025) as lo, quantile_cont(v, 0.975) as hi from long group by 1, 2),
    own as (unpivot ({_central('sample', 'event_type', 14)}) on mean, std, skew, kurtosis into name moment value obs)
    select event_type, moment, round(obs, 6) as obs, obs between lo and hi as consistent from own join ci using (event_type, moment)""")
def moments_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Observed moments held against the intervals of bootstrap samples."""
    bounds = m.moments_interval(sample(spark, d), KINDS, ["event_id"], 200, 1000)
    found = m.compared(m.moments(sample(spark, d), KINDS), bounds, KINDS)
    return r6(found.select("event_type", "moment", "obs", "consistent"), "obs")


@query(f"""with {FCST}, labels as (select ensemble, row_number() over (order by ensemble) as i from (select distinct ensemble from fcst)), x as (select lead_time, init_date, i, value from fcst join labels using (ensemble)),
    pairs as (select x.lead_time, x.i as a, y.i as b, x.value as vx, -y.value as vy from x join x y on x.lead_time = y.lead_time and x.init_date = y.init_date and x.i <= y.i),
    ranks as (select lead_time, a, b, rank() over (partition by lead_time, a, b order by vx) + (count(*) over (partition by lead_time, a, b, vx) - 1) / 2 as rx, rank() over (partition by lead_time, a, b order by vy) + (count(*) over (partition by lead_time, a, b, vy) - 1) / 2 as ry from pairs),
    each as (select lead_time, a, b, corr(rx, ry) as r from ranks group by all) select lead_time, round(avg(r), 6) + 0 as r from each group by 1""")
def correlation_of_two_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a member and one of another dataset, here the same upside down, at no smaller place."""
    cube = fcst(spark, d)
    return r6(ind.cross_correlation(cube, cube.withColumn("value", -F.col("value")), ["lead_time"]))


@query(f"""with {SAMPLE}, p as (select event_type, avg(value) as loc, stddev_pop(value) as scale, count(*) as n from sample group by 1),
    u as (select event_type, n, exp(-exp(-(value - loc) / scale)) as u from sample join p using (event_type)), r as (select *, row_number() over (partition by event_type order by u) as j from u)
    select event_type, any_value(n) as n, round(max(greatest(j / n - u, u - (j - 1) / n)), 6) as statistic, true as tested from r group by 1""")
def gev_check_of_given_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The distance of values from a distribution that is given, not fitted."""
    p = sample(spark, d).groupBy("event_type").agg(F.lit(0.0).alias("c"), F.avg("value").alias("location"), F.stddev_pop("value").alias("scale"))
    found = gevfit.check_gev_fit(sample(spark, d), p, KINDS)
    return r6(found.select("event_type", "n", "statistic", F.col("pvalue").between(0, 1).alias("tested")), "statistic")


@query(f"""with {SAMPLE}, n as (select event_type, count(*) as n, count(*) * 1.0 as one, count(*) - 4.0 as two from sample group by 1) select event_type, exp(-(one - two)) <= 0.05 as prefers_trend from n""")
def gev_relative_fit(spark: SparkSession, d: str) -> DataFrame:
    counts = sample(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    fits = counts.select("event_type", "n", F.col("n").cast("double").alias("nllf_stationary"), (F.col("n") - 4.0).alias("nllf_trend"))
    return gevfit.check_gev_relative_fit(fits, KINDS)


@query(f"with {GRID} select time, lat, lon, value from grid where lon between 120 and 140")
def subset_lon_within(spark: SparkSession, d: str) -> DataFrame:
    """Bounds that must lie within the data's longitudes."""
    from tailcast.operators.selection import subset_lon

    return subset_lon(within_longitudes(grid(spark, d), (120, 140)), 120, 140)
