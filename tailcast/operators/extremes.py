"""Empirical extremes: events, return periods and levels, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailcast.functions import gev


def event_in_context(df: DataFrame, threshold: float, direction: str, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(by..., n_events, n_population, return_period, percentile): values strictly beyond the
    threshold, the population, population a event (missing without events), and the share
    below the threshold in %."""
    if direction not in ("above", "below"):
        raise ValueError(f"unknown direction {direction}")
    v = F.col(value)
    beyond = v > threshold if direction == "above" else v < threshold
    n = F.count(v)
    events = F.count(F.when(beyond, 1))
    return df.groupBy(*by).agg(
        events.alias("n_events"), n.alias("n_population"), F.try_divide(n.cast("double"), events).alias("return_period"), (100 * F.try_divide(F.count(F.when(v < threshold, 1)).cast("double"), n)).alias("percentile")
    )


def event_seasonality(df: DataFrame, threshold: float, direction: str = "above", value: str = "value", time: str = "time") -> DataFrame:
    """(month, n_events) for all twelve months."""
    v = F.col(value)
    beyond = v > threshold if direction == "above" else v < threshold
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    counted = df.where(beyond).groupBy(F.month(time).alias("month")).agg(F.count("*").alias("n"))
    return months.join(counted, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n_events"))


def empirical_return_period(df: DataFrame, event: float | Column, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(by..., return_period): population over the number of larger values; missing if none."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.try_divide(F.count(v).cast("double"), F.count(F.when(v > event, 1))).alias("return_period"))


def empirical_return_level(df: DataFrame, periods: Sequence[float], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(by..., return_period, return_level): the distinct values' distribution read at
    1 - 1/T, linear in between and clamped at its ends. Values are counted first, so
    that windows hold distinct ones only."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("x")).count()
    w = Window.partitionBy(*by)
    up = w.orderBy("x")
    p = F.sum("count").over(up.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("count").over(w)
    steps = counted.withColumn("p", p)
    steps = steps.select(*by, "x", "p", F.lag("x").over(up).alias("x0"), F.lag("p").over(up).alias("p0"), F.lead("p").over(up).alias("p1"))
    wanted = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(1 - 1 / t).alias("q")) for t in periods]))
    each = steps.select("*", wanted.alias("w"))
    q = F.col("w.q")
    first = F.col("p0").isNull() & (q <= F.col("p"))
    between = F.col("p0").isNotNull() & (q > F.col("p0")) & (q <= F.col("p"))
    last = F.col("p1").isNull() & (q > F.col("p"))
    read = F.when(between, F.col("x0") + (q - F.col("p0")) / (F.col("p") - F.col("p0")) * (F.col("x") - F.col("x0"))).otherwise(F.col("x"))
    return each.where(first | between | last).select(*by, F.col("w.t").alias("return_period"), read.alias("return_level"))


def empirical_return_curve(df: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(by..., return_period, value): the k-th largest of n values has period n / k."""
    w = Window.partitionBy(*by)
    kept = df.where(F.col(value).isNotNull())
    k = F.row_number().over(w.orderBy(F.desc(value)))
    return kept.select(*by, (F.count("*").over(w) / k).alias("return_period"), F.col(value).alias("value"))


def log_periods(spark: SparkSession, n: int = 10_000, decades: float = 4.0) -> DataFrame:
    """(return_period): ``n`` periods from 1 to 10**decades, even in the logarithm."""
    return spark.range(n).select(F.pow(F.lit(10.0), F.col("id") * (decades / (n - 1))).alias("return_period"))


def gev_return_curve(params: DataFrame, by: Sequence[str] = (), n: int = 10_000, decades: float = 4.0) -> DataFrame:
    """(by..., return_period, value) for (by..., c, location, scale)."""
    periods = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.pow(F.lit(10.0), k * (decades / (n - 1)))))
    each = params.select(*by, "c", "location", "scale", periods.alias("return_period"))
    return each.select(*by, "return_period", gev.return_level(F.col("return_period"), F.col("c"), F.col("location"), F.col("scale")).alias("value"))


def top_events(df: DataFrame, n: int, value: str = "value", ties: Sequence[str] = ("time",)) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(value), *ties).limit(n)


def event_windows(events: DataFrame, field: DataFrame, days: int, agg: str = "mean", event: str = "event", time: str = "time", by: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """(event, by..., value): the field over the ``days`` before each event's ``time`` and that
    day itself. Events are spread over the days of their window, so the join is by day."""
    spread = events.select(event, F.explode(F.sequence(F.date_sub(time, days), F.col(time).cast("date"))).alias("_day"))
    made = {"mean": F.avg, "sum": F.sum}[agg]("value")
    return field.withColumn("_day", F.col("time").cast("date")).join(spread, "_day").groupBy(event, *by).agg(made.alias("value"))


def information_criteria(n: Column, k: int, nll: Column) -> dict[str, Column]:
    aic = 2 * k + 2 * nll
    return {"aic": aic, "aicc": aic + F.try_divide(F.lit(2.0 * k * (k + 1)), n - k - 1), "bic": k * F.ln(n) + 2 * nll}


def likelihood_ratio_p(nll_small: Column, nll_large: Column, df: int) -> Column:
    """Chi-squared tail of twice the gain, for one or two more parameters."""
    gain = F.greatest(2 * (nll_small - nll_large), F.lit(0.0))
    if df == 2:
        return F.exp(-gain / 2)
    if df != 1:
        raise ValueError("one or two degrees of freedom")
    # erfc by its continued rational form (7.1.26 of Abramowitz and Stegun, error below 1.5e-7)
    x = F.sqrt(gain / 2)
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def histogram(df: DataFrame, bins: Sequence[float], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(by..., bin, left, right, n): counts in half-open bins; the last takes all above it."""
    at = F.lit(None).cast("int")
    for i, edge in enumerate(bins[:-1]):
        at = F.when(F.col(value) >= edge, F.lit(i)).otherwise(at)
    lefts, rights = F.array(*[F.lit(float(b)) for b in bins[:-1]]), F.array(*[F.lit(float(b)) for b in bins[1:]])
    counted = df.withColumn("bin", at).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return counted.select(*by, "bin", lefts[F.col("bin")].alias("left"), rights[F.col("bin")].alias("right"), "n")


def bin_edges(lo: float, hi: float, n: int) -> list[float]:
    """``n`` bins from ``lo`` to ``hi``; with a width of 1 or more, at whole numbers."""
    width = (hi - lo) / n
    if width >= 1:
        step = -(-width // 1)
        return [float(lo // 1 + k * step) for k in range(n + 1)]
    return [lo + k * width for k in range(n + 1)]


def kernel_density(df: DataFrame, points: Sequence[float], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(by..., x, density): Gaussian kernels of Scott's width. Each value is spread over the
    fixed points and summed at once."""
    stats = df.groupBy(*by).agg(F.stddev_samp(value).alias("_s"), F.count(value).cast("double").alias("_n"))
    wide = df.where(F.col(value).isNotNull())
    joined = wide.join(stats, list(by)) if by else wide.crossJoin(F.broadcast(stats))
    h = F.col("_s") * F.pow(F.col("_n"), F.lit(-0.2))
    each = joined.select(*by, F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("x"), F.col(value).alias("_v"), h.alias("_h"))
    z = F.try_divide(F.col("x") - F.col("_v"), F.col("_h"))
    return each.groupBy(*by, "x").agg(F.avg(F.try_divide(F.exp(-0.5 * z * z), F.col("_h") * 2.5066282746310002)).alias("density"))
