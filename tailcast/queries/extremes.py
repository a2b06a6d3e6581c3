"""Extremes: empirical, closed-form and fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.functions import gev
from tailcast.operators import extremes as x
from tailcast.operators import gevfit, newton
from tailcast.operators.resampling import replicates
from tailcast.operators.temporal import temporal_aggregation
from tailcast.plans.views import FCST, GRID, OBS, SAMPLE, fcst, grid, obs, sample
from tailcast.queries import query
from tailcast.queries.selection import r6

KINDS = ["event_type"]


@query(f"with {SAMPLE} select event_type, count(*) filter (value > 100) as n_events, count(*) as n_population, round(count(*) / nullif(count(*) filter (value > 100), 0), 6) as return_period, round(100.0 * count(*) filter (value < 100) / count(*), 6) as percentile from sample group by 1")
def event_in_context(spark: SparkSession, d: str) -> DataFrame:
    return r6(x.event_in_context(sample(spark, d), 100, "above", KINDS))


@query("with m as (select cast(unnest(range(1, 13)) as integer) as month) select month, count(value) as n_events from m left join (select month(o_orderdate) as mm, o_totalprice as value from orders where o_totalprice > 300000) on mm = month group by 1")
def event_seasonality(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").alias("time"), F.col("o_totalprice").alias("value"))
    return x.event_seasonality(orders, 300000)


@query(f"with {SAMPLE} select event_type, round(count(value) / nullif(count(*) filter (value > 150), 0), 6) as return_period from sample group by 1")
def empirical_return_period(spark: SparkSession, d: str) -> DataFrame:
    return r6(x.empirical_return_period(sample(spark, d), 150, KINDS))


LEVELS = """counted as (select event_type, value as x, count(*) as n from sample group by 1, 2),
    steps as (select event_type, x, sum(n) over (partition by event_type order by x) / sum(n) over (partition by event_type) as p from counted),
    pairs as (select *, lag(x) over w as x0, lag(p) over w as p0, lead(p) over w as p1 from steps window w as (partition by event_type order by x)),
    wanted as (select t, 1 - 1 / t as q from (values (2.0::double), (10.0), (100.0), (1e9)) v(t))"""


@query(f"""with {SAMPLE}, {LEVELS} select event_type, t as return_period, round(case when p0 is not null and q > p0 and q <= p then x0 + (q - p0) / (p - p0) * (x - x0) else x end, 6) as return_level from pairs, wanted
    where (p0 is null and q <= p) or (q > p0 and q <= p) or (p1 is null and q > p)""")
def empirical_return_level(spark: SparkSession, d: str) -> DataFrame:
    return r6(x.empirical_return_level(sample(spark, d), [2, 10, 100, 1e9], KINDS))


@query(f"with {FCST} select lead_time, round(count(*) over (partition by lead_time) / row_number() over (partition by lead_time order by value desc), 6) as return_period, value from fcst")
def return_curve_empirical(spark: SparkSession, d: str) -> DataFrame:
    return r6(x.empirical_return_curve(fcst(spark, d), ["lead_time"]))


LMM = """ranked as (select lead_time, value as x, row_number() over (partition by lead_time order by value) as j, count(*) over (partition by lead_time) as n from fcst),
    sums as (select lead_time, count(*) as n, avg(x) as b0, avg((j - 1) / (n - 1) * x) as b1, avg((j - 1) * (j - 2) / ((n - 1) * (n - 2)) * x) as b2 from ranked group by 1),
    shape as (select *, 2 * b1 - b0 as l2, 2 / (3 + (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0)) - ln(2) / ln(3) as y from sums),
    curved as (select *, 7.8590 * y + 2.9554 * y * y as c from shape),
    scaled as (select *, l2 * c / ((1 - pow(2, -c)) * gamma(1 + c)) as scale from curved),
    params as (select lead_time, n, c, b0 - scale * (1 - gamma(1 + c)) / c as location, scale from scaled)"""
OUTSIDE = "(1 - c * (v - location) / scale) <= 0"
SF = f"case when {OUTSIDE} then case when c > 0 then 0 else 1 end else 1 - exp(-pow(1 - c * (v - location) / scale, 1 / c)) end"


def _params(spark: SparkSession, d: str) -> DataFrame:
    return gev.fit_lmoments(fcst(spark, d), "value", ["lead_time"])


def _p() -> list[Column]:
    return [F.col(k) for k in ("c", "location", "scale")]


@query(f"with {FCST}, {LMM} select lead_time, n, round(c, 6) as c, round(location, 4) as location, round(scale, 4) as scale from params")
def gev_lmm_fit(spark: SparkSession, d: str) -> DataFrame:
    return _params(spark, d).select("lead_time", "n", F.round("c", 6).alias("c"), F.round("location", 4).alias("location"), F.round("scale", 4).alias("scale"))


@query(f"with {FCST}, {LMM} select lead_time, t as return_period, round(location + scale * (1 - pow(-ln(1 - 1 / t), c)) / c, 3) as return_level from params, (values (2.0::double), (20.0), (200.0)) v(t)")
def gev_return_level(spark: SparkSession, d: str) -> DataFrame:
    each = _params(spark, d).withColumn("return_period", F.explode(F.array(F.lit(2.0), F.lit(20.0), F.lit(200.0))))
    return each.select("lead_time", "return_period", F.round(gev.return_level(F.col("return_period"), *_p()), 3).alias("return_level"))


@query(f"with {FCST}, {LMM}, v as (select *, location + 0.5 * scale as v from params) select lead_time, round(1 / ({SF}), 5) as return_period from v")
def gev_return_period(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("location") + 0.5 * F.col("scale")
    return _params(spark, d).select("lead_time", F.round(gev.return_period(at, *_p()), 5).alias("return_period"))


@query(f"""with {FCST}, {LMM}, v as (select lead_time, value as v, c, location, scale from fcst join params using (lead_time))
    select lead_time, round(sum(case when {OUTSIDE} then {gev.PENALTY!r} else ln(scale) - (1 / c - 1) * ln(1 - c * (v - location) / scale) + pow(1 - c * (v - location) / scale, 1 / c) end), 3) as nllf from v group by 1""")
def gev_nllf(spark: SparkSession, d: str) -> DataFrame:
    joined = fcst(spark, d).join(_params(spark, d), "lead_time")
    return joined.groupBy("lead_time").agg(F.round(gev.penalised_sum(F.col("value"), *_p()), 3).alias("nllf"))


@query(f"with {FCST}, {LMM}, v as (select lead_time, t as v, c, location, scale from params, (values (60000.0::double), (90000.0)) w(t)), u as (select *, case when not ({OUTSIDE}) then pow(1 - c * (v - location) / scale, 1 / c) end as t from v) select lead_time, v as x, round(coalesce(exp(-t), case when c > 0 then 1 else 0 end), 6) as cdf, round(1e6 * coalesce(pow(t, 1 - c) * exp(-t) / scale, 0), 5) as pdf from u")
def gev_distribution(spark: SparkSession, d: str) -> DataFrame:
    each = _params(spark, d).withColumn("x", F.explode(F.array(F.lit(60000.0), F.lit(90000.0))))
    return each.select("lead_time", "x", F.round(gev.cdf(F.col("x"), *_p()), 6).alias("cdf"), F.round(1e6 * gev.pdf(F.col("x"), *_p()), 5).alias("pdf"))


SELECTION = f"""with {FCST}, {LMM}, v as (select lead_time, n, value as v, c, location, scale from fcst join params using (lead_time)),
    l as (select lead_time, n, sum(case when {OUTSIDE} then 0 else ln(scale) - (1 / c - 1) * ln(1 - c * (v - location) / scale) + pow(1 - c * (v - location) / scale, 1 / c) end) as a,
        sum(ln(scale) + (v - location) / scale + exp(-(v - location) / scale)) as b from v group by 1, 2)
    select lead_time, round(6 + 2 * a, 3) as aic, round(6 + 2 * a + 24.0 / (n - 4), 3) as aicc, round(3 * ln(n) + 2 * a, 3) as bic, round(exp(-greatest(2 * (b - a), 0) / 2), 6) as p from l"""


@query(SELECTION)
def gev_model_selection(spark: SparkSession, d: str) -> DataFrame:
    """Criteria of each lead's fit, and its likelihood ratio against the fit without a shape."""
    joined = fcst(spark, d).join(_params(spark, d), "lead_time")
    own, flat = gev.nllf(F.col("value"), *_p()), gev.nllf(F.col("value"), F.lit(0.0), *_p()[1:])
    sums = joined.groupBy("lead_time", "n").agg(F.sum(F.coalesce(own, F.lit(0.0))).alias("a"), F.sum(flat).alias("b"))
    made = x.information_criteria(F.col("n"), 3, F.col("a"))
    return sums.select("lead_time", *[F.round(v, 3).alias(k) for k, v in made.items()], F.round(x.likelihood_ratio_p(F.col("b"), F.col("a"), 2), 6).alias("p"))


@query(f"with {OBS} select time, value from obs order by value desc, time limit 10")
def top_n_events(spark: SparkSession, d: str) -> DataFrame:
    return x.top_events(obs(spark, d), 10)


@query(f"""with {OBS}, {GRID}, top as (select cast(row_number() over (order by value desc, time) as integer) as event, time from obs qualify event <= 5)
    select event, lat, lon, round(avg(value), 6) as value from top join grid on grid.time between top.time - 100 and top.time group by 1, 2, 3""")
def event_circulation_window(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    top = x.top_events(obs(spark, d), 5).withColumn("event", F.row_number().over(Window.orderBy(F.desc("value"), "time")))
    return r6(x.event_windows(top, grid(spark, d), 100))


EDGES = [0.0, 25.0, 50.0, 75.0, 100.0, 150.0]


@query(f"with {SAMPLE}, b as (select event_type, case when value >= 100 then 4 when value >= 75 then 3 when value >= 50 then 2 when value >= 25 then 1 when value >= 0 then 0 end as bin from sample), c as (select event_type, cast(bin as integer) as bin, count(*) as n from b where bin is not null group by 1, 2) select event_type, bin, [0, 25, 50, 75, 100][bin + 1]::double as left, [25, 50, 75, 100, 150][bin + 1]::double as right, n from c")
def stacked_histogram(spark: SparkSession, d: str) -> DataFrame:
    return x.histogram(sample(spark, d), EDGES, KINDS)


@query(f"""with {FCST}, s as (select lead_time, stddev_samp(value) * pow(count(*), -0.2) as h from fcst group by 1), p as (select unnest([50000, 70000, 90000])::double as x)
    select lead_time, x, round(1e6 * avg(exp(-0.5 * pow((x - value) / h, 2)) / (h * 2.5066282746310002)), 6) as density from fcst join s using (lead_time), p group by 1, 2""")
def kde_by_lead(spark: SparkSession, d: str) -> DataFrame:
    return x.kernel_density(fcst(spark, d), [50000, 70000, 90000], ["lead_time"]).withColumn("density", F.round(1e6 * F.col("density"), 6))


@query()
def gev_mle_fit(spark: SparkSession, d: str) -> DataFrame:
    return gevfit.fit_gev(fcst(spark, d), ["lead_time"])


@query()
def gev_nonstationary_fit(spark: SparkSession, d: str) -> DataFrame:
    cube = fcst(spark, d).withColumn("year", F.year("time"))
    return gevfit.fit_gev(cube, ["ensemble"], stationary=False, covariate="year", pick_best_model="lrt")


@query()
def gev_goodness_of_fit(spark: SparkSession, d: str) -> DataFrame:
    return gevfit.fit_gev(fcst(spark, d), ["ensemble"], test="cvm", retry=True).select("ensemble", "n", "pvalue")


@query()
def gev_confidence_interval(spark: SparkSession, d: str) -> DataFrame:
    return gevfit.fit_confidence(fcst(spark, d), ["ensemble"])


@query()
def gev_trend_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Levels at two days of fits with trends, and their bootstrap intervals."""
    dated = sample(spark, d).withColumn("day", F.dayofmonth("time"))
    return gevfit.fit_confidence(dated, KINDS, covariate="day", at=[1, 31], row=["event_id"], n_resamples=100)


COUNTED = " ".join(f"when u < {v} then {k}" for k, v in enumerate(newton.POISSON))


@query(f"""with {FCST}, drawn as (select ensemble, k, value, year(time) as year, ('0x' || substr(md5('0:' || k || ':' || cast(init_date as varchar) || '|' || lead_time), 1, 8))::BIGINT as u from fcst, (select unnest(range(0, 1000)) as k)),
    counted as (select *, case {COUNTED} else {len(newton.POISSON)} end as w from drawn)
    select ensemble, cast(k as integer) as k, cast(sum(w) as bigint) as n, round(sum(w * value) / sum(w), 6) as mean_value, round(sum(w * year) / sum(w), 6) as mean_year from counted group by 1, 2""")
def bootstrap_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the bootstrap samples that intervals of fits come from, and their means of values and covariates."""
    cube = fcst(spark, d).withColumn("_id", F.concat_ws("|", F.col("init_date").cast("string"), F.col("lead_time").cast("string")))
    drawn = replicates(cube, 1000).withColumn("w", newton.resampled_count(0, F.col("k"), F.col("_id")))
    means = [F.round(F.sum(F.col("w") * c) / F.sum("w"), 6).alias(name) for name, c in (("mean_value", F.col("value")), ("mean_year", F.year("time")))]
    return drawn.groupBy("ensemble", "k").agg(F.sum("w").cast("long").alias("n"), *means)


@query()
def gev_fit_by_sums(spark: SparkSession, d: str) -> DataFrame:
    """Fits of all orders' values by priority, each one group over the whole table."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderpriority", F.col("o_totalprice").alias("value"))
    return newton.fit_by_sums(orders, ["o_orderpriority"]).drop("k")


SCORED = f"""v as (select lead_time, value as v, c, location, scale from fcst join params using (lead_time)),
    g as (select lead_time, (v - location) / scale as z, 1 - c * (v - location) / scale as w, c, scale from v),
    t as (select *, ln(w) / c as u, exp(ln(w) / c) as t from g where w > 0)"""


@query(f"""with {FCST}, {LMM}, {SCORED}
    select lead_time, count(*) as n, round(sum(ln(scale) - (1 - c) * u + t), 3) as nllf, round(sum(u - (t - 1 + c) * (u + z / w) / c), 3) as by_shape,
        round(1e3 * sum((t - 1 + c) / (w * scale)), 3) as by_location, round(1e3 * sum((1 + z * (t - 1 + c) / w) / scale), 3) as by_scale from t group by 1""")
def gev_score(spark: SparkSession, d: str) -> DataFrame:
    """The likelihood and its gradient at the L-moment fits of each lead, of the values that these allow."""
    made = newton.sums_at(fcst(spark, d), _params(spark, d), ["lead_time"])
    rounded = (("nllf", "nllf", 1.0), ("by_shape", "by_c", 1.0), ("by_location", "by_location", 1e3), ("by_scale", "by_scale", 1e3))
    return made.select("lead_time", "n", *[F.round(f * F.col(c), 3).alias(name) for name, c, f in rounded])


@query()
def gev_return_curve(spark: SparkSession, d: str) -> DataFrame:
    """Curves from the fits of annual maxima in each cell."""
    annual = temporal_aggregation(grid(spark, d), "YE-DEC", "max", by=["lat", "lon"], input_freq="M", dense=False)
    return x.gev_return_curve(gevfit.fit_gev(annual, ["lat", "lon"]).where("c is not null"), ["lat", "lon"], n=1000)
