"""Fire weather and wind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def rolling_sum(value: Column, n: int, by: Sequence[str], order: str) -> Column:
    """Sum over the row and the ``n - 1`` before it; missing unless all are there."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, F.sum(value).over(w))


def drought_factor(df: DataFrame, rain: str, by: Sequence[str], order: str, name: str = "drought_factor", n: int = 20) -> DataFrame:
    """10 where the rain of the last ``n`` steps is least, 0 where it is most, within ``by``."""
    d = df.withColumn("_sum", rolling_sum(F.col(rain), n, by, order))
    w = Window.partitionBy(*by)
    lo, hi = F.min("_sum").over(w), F.max("_sum").over(w)
    return d.withColumn(name, F.lit(10) - F.try_divide(F.lit(10) * (F.col("_sum") - lo), hi - lo)).drop("_sum")


def fire_danger(df: DataFrame, by: Sequence[str] = (), time: str = "time", pr: str = "pr", tmax: str = "tasmax", rh: str = "hur", u: str = "uas", v: str = "vas") -> DataFrame:
    """Adds ``df``, ``wsp`` and ``ffdi``; rain is scaled within ``by``."""
    scaled = drought_factor(df, pr, by, time, "df").withColumn("wsp", wind_speed(F.col(u), F.col(v)))
    return scaled.withColumn("ffdi", ffdi(F.col("df"), F.col(tmax), F.col(rh), F.col("wsp")))


def ffdi(drought: Column, temperature: Column, humidity: Column, wind: Column) -> Column:
    """Forest fire danger: degC, %, km h-1."""
    return F.pow(drought, F.lit(0.987)) * F.exp(0.0338 * temperature - 0.0345 * humidity + 0.0234 * wind) + F.lit(0.243147)
