"""What plots would draw, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailcast.functions import gev
from tailcast.operators import extremes, gevfit
from tailcast.plans import stability


def curve_periods(n: int = 10_000, largest: float = 4.0) -> list[float]:
    """``n`` return periods from 1 to 10 ** ``largest``, evenly spaced in logarithms."""
    return [10 ** (largest * k / (n - 1)) for k in range(n)]


def gev_return_curve(df: DataFrame, by: Sequence[str], n_resamples: int = 1000, periods: Sequence[float] | None = None) -> DataFrame:
    """(by..., kind, return_period, value, ci_lower, ci_upper): fitted levels with their
    interval, at ``curve_periods`` unless others are given, and the sample's own points."""
    periods = curve_periods() if periods is None else periods
    curve = gevfit.fit_confidence(df, by, periods=periods, n_resamples=n_resamples).select(*by, F.lit("curve").alias("kind"), "return_period", F.col("return_level").alias("value"), "ci_lower", "ci_upper")
    none = F.lit(None).cast("double")
    points = extremes.empirical_return_curve(df, by).select(*by, F.lit("point").alias("kind"), "return_period", "value", none.alias("ci_lower"), none.alias("ci_upper"))
    return curve.unionByName(points)


def nonstationary_pdfs(params: DataFrame, covariates: Sequence[float], lo: float, hi: float, by: Sequence[str] = (), n: int = 40) -> DataFrame:
    """(by..., covariate, x, density) at ``n`` edges between ``lo`` and ``hi``."""
    xs = [lo + (hi - lo) * k / (n - 1) for k in range(n)]
    each = _at(params, covariates).withColumn("x", F.explode(F.array(*[F.lit(float(x)) for x in xs])))
    return each.select(*by, "covariate", "x", gev.pdf(F.col("x"), F.col("c"), F.col("loc_"), F.col("scale_")).alias("density"))


def nonstationary_return_curve(params: DataFrame, covariates: Sequence[float], by: Sequence[str] = (), periods: Sequence[float] = stability.PERIODS) -> DataFrame:
    each = _at(params, covariates).withColumn("return_period", F.explode(F.array(*[F.lit(float(t)) for t in periods])))
    return each.select(*by, "covariate", "return_period", gev.return_level(F.col("return_period"), F.col("c"), F.col("loc_"), F.col("scale_")).alias("value"))


def trend_curves(params: DataFrame, df: DataFrame, covariate: str, by: Sequence[str] = (), n: int = 40) -> DataFrame:
    """(by..., kind, covariate, x, y) at the least and the largest covariate: levels by return period (``curve``), and
    densities at ``n`` values between the least and the largest (``density``)."""
    early, late, lo, hi = df.where(F.col("value").isNotNull()).agg(F.min(covariate), F.max(covariate), F.min("value"), F.max("value")).first()
    if early is None:
        raise ValueError("no values to draw")
    curve = nonstationary_return_curve(params, [early, late], by).select(*by, F.lit("curve").alias("kind"), "covariate", F.col("return_period").alias("x"), F.col("value").alias("y"))
    density = nonstationary_pdfs(params, [early, late], lo, hi, by, n).select(*by, F.lit("density").alias("kind"), "covariate", "x", F.col("density").alias("y"))
    return curve.unionByName(density)


def _at(params: DataFrame, covariates: Sequence[float]) -> DataFrame:
    each = params.withColumn("covariate", F.explode(F.array(*[F.lit(float(c)) for c in covariates])))
    _, loc, scale = gev.at_covariate({k: F.col(k) for k in gevfit.PARAMETERS[False]}, F.col("covariate"))
    return each.withColumn("loc_", loc).withColumn("scale_", scale)


def stacked_histogram(df: DataFrame, other: DataFrame, n: int = 20, value: str = "value") -> DataFrame:
    """(source, bin, left, right, n) of two samples over common bins."""
    both = df.select(F.lit("a").alias("source"), value).unionByName(other.select(F.lit("b").alias("source"), value))
    lo, hi = both.agg(F.min(value), F.max(value)).first()
    return extremes.histogram(both, extremes.bin_edges(lo, hi, n), ["source"], value)


def spatial_parameters(params: DataFrame) -> DataFrame:
    """(lat, lon, parameter, value)."""
    names = [c for c in params.columns if c in (*gevfit.PARAMETERS[True], *gevfit.PARAMETERS[False])]
    return params.unpivot(["lat", "lon"], names, "parameter", "value")


def lead_densities(df: DataFrame, points: Sequence[float]) -> DataFrame:
    return extremes.kernel_density(df, points, ["lead_time"])


def slice_densities(df: DataFrame, points: Sequence[float], start_years: Sequence[int]) -> DataFrame:
    return extremes.kernel_density(stability.time_slices(df, start_years), points, ["slice"])


def circulation(events: DataFrame, field: DataFrame, days: int, n: int = 5) -> DataFrame:
    """Field anomalies around the ``n`` largest events."""
    ranked = extremes.top_events(events, n).withColumn("event", F.row_number().over(Window.orderBy(F.desc("value"), "time")))
    return extremes.event_windows(ranked, field, days)


def timeseries_boxes(df: DataFrame, time: str = "time", value: str = "value") -> DataFrame:
    """(year, low, q1, median, q3, high): boxes by year, whiskers within 1.5 quartile ranges."""
    d = df.withColumn("year", F.year(time))
    q = d.groupBy("year").agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    d = d.join(q, "year")
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = F.when(F.col(value).between(F.col("q")[0] - reach, F.col("q")[2] + reach), F.col(value))
    return d.groupBy("year").agg(F.min(inside).alias("low"), F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"), F.first(F.col("q")[2]).alias("q3"), F.max(inside).alias("high"))


def timeseries_points(df: DataFrame, time: str = "time", value: str = "value") -> DataFrame:
    """(year, value): all points of a scatter by year."""
    return df.where(F.col(value).isNotNull()).select(F.year(time).alias("year"), value)


def similarity_map(tests: DataFrame, alpha: float = 0.05, by: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """(by..., test, statistic, pvalue, differs) of ``similarity_tests``: a row for each test, with
    whether it tells model from observations at level ``alpha``."""
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("test"), F.col(f"{t}_statistic").alias("statistic"), F.col(f"{t}_pvalue").alias("pvalue")) for t in ("ks", "ad")]))
    return tests.select(*by, one.alias("_t")).select(*by, "_t.*", (F.col("_t.pvalue") <= alpha).alias("differs"))


def independence_points(r: DataFrame, bounds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(init_month, by..., lead_time, r, ci_lower, ci_upper): correlations by lead and the band around none."""
    return r.join(bounds, ["init_month", *by])


def independence_map(least: DataFrame) -> DataFrame:
    """(init_month, lat, lon, min_lead)."""
    return least.select("init_month", "lat", "lon", "min_lead")


def moment_densities(replicates: DataFrame, observed: DataFrame, bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """(by..., moment, bin, left, right, n, obs): histograms of (by..., moment, value), the moments of bootstrap samples,
    over ``bins`` bins of each moment's range, with the observed moment of (by..., moment, obs)."""
    keys = [*by, "moment"]
    ends = replicates.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    joined = replicates.join(ends, keys).withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("_lo"), F.col("_w"))), F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = joined.where("value is not null").groupBy(*keys, at.alias("bin"), "_lo", "_w").agg(F.count("*").alias("n"))
    edges = counted.select(*keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("right"), "n")
    return edges.join(observed.select(*keys, "obs"), keys, "left")
