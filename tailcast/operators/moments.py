"""Moments of model samples against observations, with bootstrap bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailcast.functions.gev import fit_lmoments
from tailcast.operators.gevfit import fit_gev
from tailcast.operators.resampling import resample

MOMENTS = ("mean", "std", "skew", "kurtosis")
SHAPE = ("c", "location", "scale")


def moment_columns(value: str = "value") -> list[Column]:
    """Population moments: kurtosis is that beyond the normal's."""
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis")]


def moments(df: DataFrame, by: Sequence[str] = (), value: str = "value", gev: str | None = None) -> DataFrame:
    """(by..., mean, std, skew, kurtosis[, c, location, scale]); ``gev`` is ``lmoments`` or ``mle``."""
    made = df.groupBy(*by).agg(*moment_columns(value))
    if gev is None:
        return made
    keys = list(by)
    keyed = df if keys else df.withColumn("_all", F.lit(1))
    fitted = fit_lmoments(keyed, value, keys or ["_all"]) if gev == "lmoments" else fit_gev(keyed, keys or ["_all"], value)
    fitted = fitted.select(*keys, *SHAPE)
    return made.join(fitted, keys) if keys else made.crossJoin(fitted)


def moment_replicates(df: DataFrame, by: Sequence[str], order: Sequence[str], size: int, n_resamples: int = 1000, value: str = "value", gev: bool = False, seed: int = 0) -> DataFrame:
    """(by..., k, moment, value) of samples of ``size`` model values, all replicates in one job;
    with ``gev`` the L-moment parameters too."""
    drawn = resample(df.where(F.col(value).isNotNull()).select(*by, *order, value), by, order, n_resamples, seed, size=size)
    each = moments(drawn, [*by, "k"], value, "lmoments" if gev else None)
    return each.unpivot([*by, "k"], list(MOMENTS + (SHAPE if gev else ())), "moment", "value")


def moments_interval(df: DataFrame, by: Sequence[str], order: Sequence[str], size: int, n_resamples: int = 1000, level: float = 0.95, value: str = "value", gev: bool = False, seed: int = 0) -> DataFrame:
    """(by..., moment, ci_lower, ci_upper): percentiles over ``moment_replicates``."""
    long = moment_replicates(df, by, order, size, n_resamples, value, gev, seed)
    tail = (1 - level) / 2
    return long.groupBy(*by, "moment").agg(F.percentile("value", tail).alias("ci_lower"), F.percentile("value", 1 - tail).alias("ci_upper"))


def compared(observed: DataFrame, bounds: DataFrame, by: Sequence[str] = (), units: str = "") -> DataFrame:
    """(by..., moment, obs, ci_lower, ci_upper, consistent, text): observed moments against the
    model's bounds; ``units`` go into the text."""
    names = [c for c in observed.columns if c not in by]
    long = observed.unpivot(list(by), names, "moment", "obs")
    both = long.join(bounds, [*by, "moment"])
    text = F.format_string("%s: obs %.4f, model 95%% interval %.4f to %.4f" + (" " + units.replace("%", "%%") if units else ""), "moment", "obs", "ci_lower", "ci_upper")
    return both.withColumn("consistent", F.col("obs").between(F.col("ci_lower"), F.col("ci_upper"))).withColumn("text", text)
