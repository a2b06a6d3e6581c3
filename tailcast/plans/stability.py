"""Does the model drift with lead, or its distribution with time?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailcast.functions.gev import fit_lmoments
from tailcast.operators import extremes
from tailcast.operators.resampling import resample

PERIODS = (2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0)


def time_slices(df: DataFrame, start_years: Sequence[int]) -> DataFrame:
    """Adds ``slice``, the first year of the slice; each lasts until the next begins, the
    last as long as the one before. A slice's last day is 25 December."""
    years = sorted(start_years)
    width = years[-1] - years[-2] if len(years) > 1 else 10
    ends = [*[y - 1 for y in years[1:]], years[-1] + width - 1]
    which = F.lit(None).cast("int")
    for start, end in zip(years, ends, strict=True):
        which = F.when(F.col("time").cast("date").between(F.lit(f"{start}-01-01").cast("date"), F.lit(f"{end}-12-25").cast("date")), F.lit(start)).otherwise(which)
    return df.withColumn("slice", which).where("slice is not null")


def return_levels(df: DataFrame, by: Sequence[str], method: str, periods: Sequence[float] = PERIODS) -> DataFrame:
    """(by..., return_period, value): empirical, or of the fitted distribution."""
    if method == "empirical":
        return extremes.empirical_return_level(df, periods, by).withColumnRenamed("return_level", "value")
    if method != "gev":
        raise ValueError(f"unknown method {method}")
    from tailcast.functions.gev import return_level

    each = fit_lmoments(df, "value", list(by)).withColumn("return_period", F.explode(F.array(*[F.lit(float(t)) for t in periods])))
    return each.select(*by, "return_period", return_level(F.col("return_period"), F.col("c"), F.col("location"), F.col("scale")).alias("value"))


def uncertainty(df: DataFrame, size: int, method: str, n_resamples: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(return_period, ci_lower, ci_upper) of samples of ``size`` from all values."""
    one = df.where(F.col("value").isNotNull()).withColumn("_all", F.lit(1)).select("_all", "init_date", "ensemble", "lead_time", "value")
    drawn = resample(one, ["_all"], ["init_date", "ensemble", "lead_time"], n_resamples, seed, size=size)
    levels = return_levels(drawn, ["_all", "k"], method)
    tail = (1 - level) / 2
    return levels.groupBy("return_period").agg(F.percentile("value", tail).alias("ci_lower"), F.percentile("value", 1 - tail).alias("ci_upper"))


def summary(df: DataFrame, start_years: Sequence[int], method: str = "empirical", with_uncertainty: bool = False) -> DataFrame:
    """(kind, label, return_period, value[, ci_lower, ci_upper]): curves by lead and by slice.
    The interval is of samples as large as the last slice."""
    leads = return_levels(df, ["lead_time"], method).select(F.lit("lead").alias("kind"), F.col("lead_time").cast("int").alias("label"), "return_period", "value")
    sliced = time_slices(df, start_years)
    slices = return_levels(sliced, ["slice"], method).select(F.lit("slice").alias("kind"), F.col("slice").alias("label"), "return_period", "value")
    out = leads.unionByName(slices)
    if not with_uncertainty:
        return out
    last = sliced.where((F.col("slice") == max(start_years)) & F.col("value").isNotNull()).count()
    return out.join(F.broadcast(uncertainty(df, last, method)), "return_period")
